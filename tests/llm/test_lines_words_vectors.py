"""Line dedup, spelling variants and whitening against plain versions on small fixtures."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import line_dedup, spelling, whitening

DOCS = "doc_id bigint, text string"


def lines_kept(rows, least_chars=40, least_docs=5):
    """{row position: (n_lines, n_dropped, text)}; rows of one doc_id, or of none, are one document."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip("\t\n\x0b\x0c\r "))
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(doc)
    last = {k: max((d for d in ds if d is not None), default=None) for k, ds in holders.items() if len(ds) >= least_docs}
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        stay = [x for x in parts if not (key(x) in last and last[key(x)] != doc)]
        out.append((doc, len(parts), len(parts) - len(stay), "\n".join(stay)))
    return out


def line_rows():
    rng = random.Random(4)
    long = ["Licensed under the terms of example number %d of all" % i for i in range(12)] + ["É" * 40, "é" * 40, "x" * 39, "y" * 40, "ÀB" * 20]
    odd = lambda s: rng.choice(["", " ", "\t", "\r", "\x0b\x0c"]) + (s.upper() if rng.random() < 0.3 and s.isascii() else s) + rng.choice(["", "  ", "\r"])
    rows = [(i, "\n".join(odd(rng.choice(long)) if rng.random() < 0.5 else f"own line {i} {j}" + "z" * 40 for j in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, " " + "y" * 40), (104, "q" * 50), (105, "q" * 50 + "\n" + "Q" * 50), (106, "q" * 50), (107, "q" * 50)]
    rows += [(7, rows[7][1]), (7, "another text of the same id\n" + "y" * 40), (None, "q" * 50), (None, "q" * 50 + "\nrest"), (108, "\n".join(long * 700))]
    return rows


@pytest.mark.parametrize(("batches", "fan"), [(4, 3), (1, 3), (7, 2)])
def test_lines_against_plain(spark, monkeypatch, batches, fan):
    monkeypatch.setattr(line_dedup, "FAN", fan)
    monkeypatch.setattr(line_dedup.LineIndex.__init__, "__defaults__", (fan,))
    rows = line_rows()
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], DOCS + ", whole string, gone int, n_lines int").repartition(5)
    got = line_dedup.drop_repeated_lines(df, batches=batches)
    assert got.columns == ["doc_id", "text", "whole", "gone", "n_lines", "n_dropped"]
    order = lambda xs: sorted(map(repr, xs))
    assert order((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == order(lines_kept(rows))


def test_line_digest_and_plan(spark):
    rows = line_rows()
    digest = line_dedup.digest(spark.createDataFrame(rows, DOCS))
    want = sorted(repr((d, n, k, hashlib.sha256(t.encode()).hexdigest())) for d, n, k, t in lines_kept(rows))
    assert sorted(repr(tuple(r)) for r in digest.collect()) == want
    assert not re.search("Python|Arrow|Pandas", digest._jdf.queryExecution().toString())
    assert line_dedup.digest(spark.createDataFrame([], DOCS)).count() == 0


def test_line_runs_are_merged_without_a_shuffle(spark):
    lines = line_dedup.line_hashes(spark.createDataFrame(line_rows(), DOCS), batches=3)
    index = line_dedup.LineIndex(spark, fan=4)
    for b in range(3):
        index.add(lines.where(F.col("batch") == b))
    assert len(list(index.first)) == 3
    own = line_dedup.Runs(spark, index.first.buckets)
    own.add(line_dedup.own_run(lines.where("batch = 2")))
    plan = index.unseen(own.whole())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert index.unseen(own.whole()).count() == 0  # its batch has been added
    known = {(r.hash, r.check): r.n for r in line_dedup.own_run(lines).collect()}
    counts = Counter()
    for run in [*index.first, *index.later]:
        for r in run.collect():
            counts[r.hash, r.check] += r.n
    assert counts == known
    own.drop()
    index.drop()


def words_of(rows):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or len(a) == len(b) and a[i + 1 :] == b[i + 1 :]


def variants_of(rows):
    n = words_of(rows)
    near = defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in near}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]) if w in near else 0, n[form[w]] if w in form else None) for w in n}


def word_rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcÉéÿ×") for _ in range(rng.randrange(6, 10))) for _ in range(40)]
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "listens", "silents", "Silentz", "conducta", "conduct", "onducts", "a" * 3000 + "b", "a" * 3000 + "c"]
    rows = []
    for i in range(120):
        bag = []
        for _ in range(30):
            w = words[int(rng.paretovariate(0.6)) % len(words)]
            p = rng.randrange(len(w))
            bag.append(rng.choice([w, w, w, w.upper(), w[:p] + w[p + 1 :], w[:p] + "é" + w[p:], w[:p] + "b" + w[p + 1 :]]))
        rows.append((i, rng.choice(["-", " ", "1", "\n", "ſ", "ā"]).join(bag)))
    chain = ["startword"] * 2 + ["startwort"] * 60 + ["startworts"] * 700
    return [*rows, (200, " ".join(chain)), (201, None), (202, ""), (None, "without key words words"), (200, "startword twice twiceword"), (203, "1 2 3"), (204, "ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ àààààààà")]


def test_variants_against_plain(spark):
    rows = word_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", word string, n int").repartition(3)
    got = {tuple(r) for r in spelling.variants(df).collect()}
    assert got == variants_of(rows)
    assert any(f for _, f, *_ in got) and any(r not in (f, w) for w, f, r, *_ in got)
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "a b c")], DOCS)).count() == 0


def test_anagrams_share_a_key_and_few_places(spark):
    words = spark.createDataFrame([("listens", 2), ("silents", 3), ("listenz", 4)], "word string, n long")
    keys = {r.word: r.k for r in words.select("word", spelling.anagram_key(F.col("word")).alias("k")).collect()}
    assert keys["listens"] == keys["silents"] == sum(ord(c) ** 5 for c in "listens") != keys["listenz"]
    assert {(r.a, r.b) for r in spelling.near_pairs(words).collect()} == {("listens", "listenz")}
    assert max(r.m for r in spelling.listed(spark.createDataFrame([("ab" * 5000, 2)], "word string, n long")).groupBy("word").agg(F.count("*").alias("m")).collect()) <= 6


VECTORS = "vec_id bigint, embedding array<float>"


def whitened_plainly(rows, k=32):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[a * n - s for a, s in zip(v, sums, strict=True)] for v in x], float) / n
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    return [i for i, _ in kept], n, deviation, centred @ axes / np.sqrt(e), e / np.trace(v)


def vector_rows(n=300, d=40):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 3 + rng.normal(size=d) * 50
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    odd = [(1000, None), (1001, [None] + [1.0] * (d - 1)), (1002, [float("nan")] * d), (1003, [float("inf")] + [0.0] * (d - 1)), (1004, [0.0] * d), (None, [1.0] * d)]
    return rows + odd + [rows[3], rows[3]]


def test_whitening_against_plain(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], VECTORS + ", d int, whitened double").repartition(11)
    got = sorted(whitening.whiten(df).collect(), key=lambda r: (r.component, -1 if r.vec_id is None else r.vec_id))
    ids, n, deviation, white, explained = whitened_plainly(rows)
    assert len(got) == n * 32 and {r.n for r in got} == {n}
    order = sorted(range(n), key=lambda i: -1 if ids[i] is None else ids[i])
    mine = np.array([r.whitened for r in got]).reshape(32, n)
    theirs = white[order].T
    signs = np.sign((mine * theirs).sum(1, keepdims=True))
    assert np.abs(mine - signs * theirs).max() < 1e-8
    assert [r.deviation for r in got[:n]] == [deviation[i] for i in order]
    assert np.abs(np.array([r.explained for r in got]).reshape(32, n)[:, 0] / explained - 1).max() < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], VECTORS)).count() == 0
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], VECTORS)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(2, 0, 0.0, 0.0, 0.0)] * 4
    mixed = [(1, [1.0]), (2, [3.0]), (3, [1.0, 5.0]), (4, [2.0, 5.0]), (5, [1e38, 0.0, -1e38]), (6, [0.0, 1e38, 0.0])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(mixed, VECTORS)).collect()}
    assert len(got) == 2 + 4 + 6 and abs(got[1, 1].whitened) == pytest.approx(1) and got[3, 2].whitened == 0
    assert got[5, 1].deviation == (1 << 63) - 1 and got[1, 1].deviation == 128**2


def test_moments_merge_as_one_stream(monkeypatch):
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(200, 6)) * 100) + 1e6
    parts = []
    for cut in np.array_split(x, [0, 1, 50, 51, 130]):
        m = whitening.Moments(6)
        m.add_rows(cut)
        parts.append(m)
    whole = parts[0]
    for m in parts[1:]:
        whole.merge(m)
    assert whole.n == 200 and whole.total == [int(s) for s in x.sum(0)]
    assert np.abs(whole.covariance() - np.cov(x.T, bias=True)).max() < 1e-6


@pytest.mark.parametrize("matrix", ["random", "equal", "diagonal", "rank", "tiny", "one"])
def test_eigen_solve(matrix):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(50, 50))
    a = {"random": a @ a.T, "equal": np.eye(20) * 7, "diagonal": np.diag(np.arange(12.0)), "rank": a[:, :3] @ a[:, :3].T, "tiny": a @ a.T * 1e-200, "one": np.array([[4.0]])}[matrix]
    values, vectors = whitening.symmetric_eigen(a)
    scale = np.abs(a).max()
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-12 * scale * len(a)
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * scale * len(a)
