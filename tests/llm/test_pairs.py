"""Near copies and near-duplicate vectors against all pairs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import components, embedding_dedup, jaccard_join


def reach(nodes, links):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def copies():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = [None, "", " \n\t", "one two", "One  TWO", "one two three", "é É", "a b c d e", "A B c d E"]
    base = [word() for _ in range(120)]
    for _ in range(60):  # one large group
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows += [" ".join(base)] * 15
    for _ in range(40):  # a shared passage alone is no link
        rows.append(" ".join([word() for _ in range(rng.randrange(5, 150))] + passage + [word() for _ in range(30)]))
    for _ in range(30):
        w = [word() for _ in range(rng.randrange(3, 60))]
        rows += [" ".join(w), " ".join(w[:-1]), " ".join([word(), *w[1:]])]
    rows.append(" ".join(word() for _ in range(30_000)))
    return rows


@pytest.mark.parametrize("rows_at_once", [1 << 16, 5])
def test_jaccard_components(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(jaccard_join, "RUN", rows_at_once)
    monkeypatch.setattr(jaccard_join, "SUBLIST", 8 if rows_at_once > 5 else 100)
    monkeypatch.setattr(jaccard_join, "COUNTED", 3000)
    monkeypatch.setattr(jaccard_join, "REPORTS", 1)
    if rows_at_once == 5:
        monkeypatch.setattr(jaccard_join, "BLOCK", 4)
        monkeypatch.setattr(jaccard_join, "LONG", 3)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 200_000 if rows_at_once > 5 else 10)
    rows = copies()
    df = spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(rows)], "doc_id bigint, text string, n string").repartition(3)
    sets = {100 + i: shingle_set(t) for i, t in enumerate(rows)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least = reach(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_components(df).collect()}
    assert got == {k: (len(s), least[k]) for k, s in sets.items()}
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {k for k in sets if least[k] == k}


def test_jaccard_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard_join.similarity_components(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "x y"), (3, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.similarity_components(twice).collect() if r.doc_id)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert sorted((r.doc_id or 0) for r in jaccard_join.one_of_each(twice).collect()) == [0, 1, 3]


def test_prefixes_share_enough():
    rng = np.random.default_rng(2)
    hot = np.sort(rng.integers(0, 1 << 63, 40).astype(np.uint64))
    counts = rng.integers(1, 500, 40).astype(np.float64)
    seen = 0
    for _ in range(300):
        common = np.concatenate([rng.choice(hot, 12, replace=False), rng.integers(0, 1 << 63, rng.integers(5, 40)).astype(np.uint64)])
        x, y = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(2))
        both = len(np.intersect1d(x, y))
        if both * 9 < 4 * (len(x) + len(y)):
            continue
        seen += 1
        (tx, mx), (ty, my) = (jaccard_join.prefix(s, hot, counts) for s in (x, y))
        c = len(np.intersect1d(tx, ty))
        assert c >= min(mx, my)
        assert c + max(jaccard_join.least_overlap(len(x)) - mx, jaccard_join.least_overlap(len(y)) - my) >= -(-4 * (len(x) + len(y)) // 9)
    assert seen > 100


def test_components_in_rounds(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(900, k) for k in range(901, 950)]
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    least = reach({n for e in edges for n in e}, edges)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    for most in (0, 10_000):
        got = {r.node: r.component for r in components.components(df, driver_edges=most).collect()}
        assert got == {n: least[n] for n in nodes}


def vectors():
    rng = np.random.default_rng(6)
    rows = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [1.0] * 7]
    centres = rng.standard_normal((30, 8))
    for c in centres:
        for _ in range(rng.integers(1, 9)):
            rows.append([float(v) for v in c + rng.standard_normal(8) * 0.08])
    rows += [rows[7], rows[7], [2 * v for v in rows[8]], [1e200] * 8, [2e200] * 8, [1.0, 2.0]]
    return rows


@pytest.mark.parametrize("block", [1024, 7])
def test_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>, label int, links string")
    good = {i: np.array(v, float) for i, v in enumerate(rows) if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    links = [(a, b) for a, b in itertools.combinations(unit, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    least = reach(range(len(rows)), links)
    degree = {i: sum(i in e for e in links) for i in range(len(rows))}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {i: (degree[i], least[i], least[i] == i) for i in range(len(rows))}


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_recall_of_planted_links_at_real_key_lengths(spark, monkeypatch):
    """Keys of eight bits and more over 4,000 vectors with planted links on both sides of the threshold: every link is found, none below it."""
    assert embedding_dedup.plan(4000, 0.95, bucket=8)[0] >= 8
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 32))
    for i in range(0, 3000, 3):
        for k in (1, 2):
            x[i + k] = x[i] + rng.standard_normal(32) * rng.uniform(0.05, 0.4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    unit = embedding_dedup.scaled(x)
    near = np.triu(unit @ unit.T >= 0.95, 1)
    links = [*zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)]
    assert len(links) > 1000
    plan = embedding_dedup.plan
    monkeypatch.setattr(embedding_dedup, "plan", lambda n, t, r: plan(n, t, r, 8))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    degree, least = (near | near.T).sum(1), reach(range(4000), links)
    wrong = sum(got[i] != (degree[i], least[i]) for i in range(4000))
    assert all(got[i][0] <= degree[i] for i in range(4000)) and wrong <= 0.002 * 4000
    a = embedding_dedup.Codes(unit)
    i, j = map(np.array, zip(*links, strict=True))
    assert (a.differing(a)[i, j] <= embedding_dedup.most_differing(32, 0.95)).all() and (a.upper_of(i, a, j) >= 0.95).all()


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.standard_normal((400, 64)) * 0.05
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    a, b = embedding_dedup.Codes(x), embedding_dedup.Codes(y)
    true = np.einsum("ij,ij->i", x, y)
    estimate = np.diag(a.code @ b.rotated.T) / a.factor
    assert abs((estimate - true).mean()) < 0.02
    assert (np.diag(a.upper(b)) >= true).all()
    bits, tables = embedding_dedup.plan(51_282, 0.95)
    same = (1 - np.arccos(0.95) / np.pi) ** bits
    assert 1 - (1 - same) ** tables >= embedding_dedup.RECALL


def test_short_texts_of_a_hot_passage(spark, monkeypatch):
    """Most postings of a split list can stand alone in their part; those in the first part count as well."""
    monkeypatch.setattr(jaccard_join, "SUBLIST", 12)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(600)]
    rows = [" ".join([*passage, *(word() for _ in range(700))]) for _ in range(24)]
    cuts = [" ".join(passage[i : i + k]) for i in range(0, 580, 12) for k in (8, 9)]
    df = spark.createDataFrame(list(enumerate(rows + cuts)), "doc_id bigint, text string").repartition(3)
    sets = dict(enumerate(map(shingle_set, rows + cuts)))
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) == len(cuts) // 2
    assert {r.doc_id: r.component_id for r in jaccard_join.similarity_components(df).collect()} == reach(sets, links)


def test_keys_of_different_texts(spark):
    """One row of each component stays, also where rows of different texts share a key."""
    a, b, c = "a b c d e f", "g h i j k l", "m n o p q r"
    rows = [(1, a), (1, b), (1, b), (2, c), (5, a), (5, "s t u v w x"), (7, c), (7, "y z y z y z"), (8, "y z y z y z"), (None, a), (9, ""), (9, None)]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(0, a), (1, a), (1, b), (2, c), (5, "s t u v w x"), (7, "y z y z y z"), (9, "")])


def test_lengths_never_share_a_bucket(spark):
    near = np.r_[np.ones(4097), np.zeros(0)]
    other = near.copy()
    other[:20] = 0.0
    rows = [(1, [1.0]), (2, [2.0]), (3, near.tolist()), (4, other.tolist()), (5, [1.0, 0.0]), (6, [1.0, 0.01])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5)}


def test_rows_that_are_first_for_nobody_stay_at_home(spark):
    """Candidates against all pairs; nodes that share fewer lists than any pair needs send nothing."""
    rng = random.Random(8)
    of = {k: {2 * rng.randrange(40) for _ in range(12)} for k in range(40)} | {100 + k: {1000 + k, 1001 + k} for k in range(30)}
    rows = [(i, k, 10, 4, 1 + i % 2, k // 2) for k, x in of.items() for i in x]
    lists = spark.createDataFrame(rows, "name int, node bigint, n int, matches int, weight bigint, component bigint")
    facts = lists.groupBy("name").agg(F.min("matches").alias("least"), F.count("*").alias("size")).where("size > 1")
    lists = lists.join(facts, "name")
    assert all(r.node < 100 for r in jaccard_join._sent(lists).collect()) and jaccard_join._sent(lists).count() < lists.where("node < 100").count()
    got = [(r.a, r.b) for r in jaccard_join._candidates(lists).collect()]
    needed = int(jaccard_join._least_common_of(*(np.array([x]) for x in (10, 4, 10, 4)))[0])
    want = [(a, b) for a, b in itertools.combinations(of, 2) if a // 2 != b // 2 and sum(1 + i % 2 for i in of[a] & of[b]) >= needed]
    assert sorted(got) == sorted(want) and want
