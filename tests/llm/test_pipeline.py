"""The corpus pipeline, stage by stage, against plain Python."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import quality, secrets, toxicity

from test_pairs import reach, shingle_set
from test_scans import matches


def fixture(spark, folder):
    """Documents with low quality, insults, copies and near copies, secrets, null and empty texts, repeated keys and rows, and clashing columns; their labels."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    rows, labels = [], []
    for i in range(500):
        w = [word() for _ in range(rng.randrange(25, 60))]
        junk, toxic = i % 6 == 0, i % 5 == 1
        if toxic:
            w[rng.randrange(len(w))] = "scummy"
        if i % 9 == 2:
            w += ["password=" + "a1b2" * 4, "token: 'zzzzzzzzz'"]
        rows.append((i, " ".join(x + "!!" if junk else x for x in w)))
        labels.append((i, int(not junk), int(toxic)))
    clean = [r for r in rows if r[0] % 6 and r[0] % 5 != 1]
    for k, (_, t) in enumerate(clean[:30]):  # exact and near copies, one word away at the end
        rows += [(1000 + k, t), (1100 + k, t + " " + word())]
    rows += [clean[40], clean[40], (clean[41][0], clean[42][1]), (clean[43][0], "another text under a key that is there already in this table"), (None, clean[44][1]), (2000, None), (2001, ""), (2001, ""), (2002, " \n")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), "x", 1) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, found string, node int")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs.columns


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_against_plain_python(spark, tmp_path):
    folder = str(tmp_path)
    names = fixture(spark, folder)
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def step(name, given):
        path = f"{folder}/{name}"
        stages[name](spark, given, folder).write.parquet(path)
        out = spark.read.parquet(path)
        return out, rows_of(given)

    good, given = step("quality_classifier", docs)
    ranking = quality.train(docs, labels, lambda k: ~quality.held_out(k, 5, 0))
    assert rows_of(good) == [r for r in given if ranking.score(np.array([quality.features(r[1] or "")]))[0] >= 0.3]
    assert good.columns == names
    kept = {r.doc_id for r in good.collect()}
    assert len(kept & {i for i in range(500) if i % 6 == 0}) <= 3 and len({i for i in range(500) if i % 6} - kept) <= 10

    calm, given = step("toxicity", good)
    model = toxicity.train(good, labels, lambda k: ~quality.held_out(k, 4, 2))
    assert rows_of(calm) == [r for r in given if model.score([r[1] or ""])[0] < 0.3]
    assert not any("scummy" in (r.text or "") for r in calm.collect()) and calm.count() > 0.7 * good.count()

    alone, given = step("ngram_jaccard_join", calm)
    sets = [shingle_set(r[1]) for r in given]
    links = [(a, b) for a, b in itertools.combinations(range(len(given)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = reach(range(len(given)), links)
    left = rows_of(alone)
    of_text = {r[1]: group[i] for i, r in enumerate(given) if sets[i]}
    assert all(r in given for r in left)
    with_key = [i for i, r in enumerate(given) if sets[i] and r[0] is not None]
    for g in {group[i] for i in with_key}:
        least = min(given[i][0] for i in with_key if group[i] == g)
        assert [r[0] for r in left if r[1] in of_text and of_text[r[1]] == g and r[0] is not None] == [least]
    assert sum(1 for r in left if not shingle_set(r[1])) == len({(r[0], r[1] or "") for r in given if not shingle_set(r[1])} - {(2001, "x")}) and alone.columns == names

    clean, given = step("secret_scans", alone)

    def redacted(text):
        merged = []
        for s, _, e in matches(text):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        for s, e in reversed(merged):
            text = text[:s] + "[SECRET]" + text[e:]
        return text

    want = [(r[0], t := None if r[1] is None else redacted(r[1]), *r[2:4], len(t or "") if t is not None else None, *r[5:]) for r in given]
    texts = lambda rows: sorted(((r[0], r[1] or "", *r[2:4], *r[5:]) for r in rows), key=repr)
    assert texts(clean.collect()) == texts(want) and clean.columns == names
    assert any("[SECRET]" in (r.text or "") for r in clean.collect()) and secrets.scan(clean).where("size(found) > 0").isEmpty()

    packed, given = step("packing", clean)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    assert sum(r.length for r in packed.collect()) == sum(len(ids(r[1])) for r in given)
    once = {k: ids(t) for k, t, *_ in given if k is not None and sum(r[0] == k for r in given) == 1}
    for r in packed.collect():
        if r.doc_id in once:
            assert r.ids_crc32 == zlib.crc32(once[r.doc_id][r.start : r.start + r.length].tobytes())

    run = corpus_pipeline.run(spark, folder)
    pieces = lambda df: {k: sum(r.length for r in rows) for k, rows in itertools.groupby(sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id)), key=lambda r: r.doc_id)}
    assert pieces(run) == pieces(packed)


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
