"""Gates, windows, joins, resampling, models, sources, sinks and streams."""

import datetime as dt
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.operators import checks, joins, metrics, ml, resampling, selection, splits, windows
from plumbline.sources import readers, writers
from plumbline.streaming import sessions


def test_gates(spark):
    twice = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(checks.GateError):
        checks.checked_join(twice, twice, ["k"], validate="many_to_one")
    with pytest.raises(checks.GateError):
        checks.assert_complete(spark.createDataFrame([(1, 2)], "k int, s int"), ["k"], "s", 3)
    with pytest.raises(PySparkException):
        checks.aligned(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 5)], "k int, v int"), ["k"]).collect()
    with pytest.raises(PySparkException):
        checks.encoded_labels(spark.createDataFrame([("odd",)], "s string"), "s", "positive", "negative").collect()


def test_sessions_merge_exact_gap(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t), (1, t + dt.timedelta(minutes=30)), (1, t + dt.timedelta(minutes=60, seconds=1)), (2, t)]
    df = spark.createDataFrame(rows, "k int, ts timestamp")
    got = sorted(r.session_id for r in windows.sessionize(df, "k", "ts", 30).collect())
    assert got == ["1_s0", "1_s0", "1_s1", "2_s0"]
    df.write.parquet(str(tmp_path / "in"))
    stream = sessions.streaming_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "ts", late="0 seconds")
    q = stream.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.k, r.n) for r in spark.table("closed").collect()} <= {(1, 2), (1, 1), (2, 1)}


def test_jaccard_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    sets = {i: [rng.choice("abcdefgh") for _ in range(rng.randrange(6))] for i in range(40)}
    df = spark.createDataFrame(list(sets.items()), "id int, words array<string>")
    for t in (0.5, 0.7, 1.0):
        got = {(r.a, r.b): round(r.jaccard, 9) for r in joins.jaccard_pairs(df, "id", "words", t).collect()}
        want = {}
        for a, b in itertools.combinations(sorted(sets), 2):
            x, y = set(sets[a]), set(sets[b])
            if x | y and len(x & y) / len(x | y) >= t:
                want[a, b] = round(len(x & y) / len(x | y), 9)
        assert got == want


def test_jaccard_pairs_of_large_sets_leave_out_chance_candidates(spark):
    rng = random.Random(4)
    words, sets = [f"w{i}" for i in range(900)], {}
    for i in range(120):
        size = rng.choice([3, 20, 60, 150, 300])
        sets[i] = rng.sample(words, size)
    for i in range(120, 240):  # parts of others, with other words
        old = sets[rng.randrange(120)]
        sets[i] = rng.sample(old, max(1, len(old) * rng.randrange(5, 11) // 10)) + rng.sample(words, len(old) * rng.randrange(4) // 10)
    df = spark.createDataFrame(list(sets.items()), "id int, words array<string>")
    for t in (0.3, 0.5, 0.8):
        want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(set(sets[a]) & set(sets[b])) >= t * len(set(sets[a]) | set(sets[b]))}
        assert {(r.a, r.b) for r in joins.jaccard_pairs(df, "id", "words", t).collect()} == want
    hashes = F.transform(F.array_distinct("words"), lambda w: F.xxhash64(w))
    met = {(r.a, r.b) for r in joins._candidates(df.select(F.col("id").alias("node"), hashes.alias("hashes")), 0.8).collect()}
    shared = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if set(sets[a]) & set(sets[b])}
    assert len(met) < 0.05 * len(shared)


def test_macro_f1_without_positives(spark):
    df = spark.createDataFrame([(1, 0, 0)], "g int, label int, predicted int")
    assert metrics.scored(df, ["g"]).first().macro_f1 == 0.5


def test_bootstrap_equals_row_resampling(spark):
    rng = np.random.default_rng(1)
    rows = [(g, c, int(rng.integers(2)), int(rng.integers(2))) for g in range(6) for _ in range(3) for c in ("x", "y")]
    df = spark.createDataFrame(rows, "g int, c string, label int, predicted int")
    got = {(r.iteration, r.c): r.score for r in resampling.bootstrap_scores(df, "g", "c", 5, 9).collect()}
    times = {(r.iteration, r.position): r.times for r in resampling.draws(spark, 6, 5, 9).collect()}
    for i in range(5):
        for c in ("x", "y"):
            drawn = [(y, p) for g, k, y, p in rows if k == c for _ in range(times.get((i, g), 0))]
            y, p = (np.array(z) for z in zip(*drawn, strict=True))
            assert abs(got[i, c] - ml.macro_f1(y, p)) < 1e-12


def test_thresholds_against_sweep(spark):
    rng = np.random.default_rng(5)
    rows = [(1, int(rng.integers(2)), round(float(rng.random()), 3)) for _ in range(60)]
    got = selection.best_thresholds(spark.createDataFrame(rows, "k int, y int, p double"), ["k"], "y", "p").first()
    y, p = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    scores = {t: round(ml.macro_f1(y, (np.floor(p * 1000) >= t).astype(int)), 12) for t in range(1001)}
    best = max(scores.values())
    tied = [t for t in scores if scores[t] == best]
    assert (got.t, got.ties) == (min(tied, key=lambda t: (abs(t - 500), t)), len(tied))


def test_folds_do_not_leak(spark):
    groups = spark.createDataFrame([(i, i % 2) for i in range(50)], "g long, label int")
    folds = splits.grouped_folds(groups, "g", "label")
    inner = splits.inner_validation(folds, "g", "label", share=0.2)
    assert all(r.passed for r in splits.leakage_checks(groups, folds, inner, "g", "label").collect())


def test_samples(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(40)], "i long, s int")
    assert windows.stratified_sample(df, "s", "i", 3, 1).groupBy("s").count().where("count = 3").count() == 2
    assert sorted(r.i for r in windows.stride_sample(df.where("s = 0"), "s", ["i"], 5).collect()) == [0, 8, 16, 24, 32]


def test_head_learns_and_counts(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8))
    y = (x[:, 0] > 0).astype(int)
    head = ml.Head(8, 32).fit(x[:200], y[:200], x[200:], y[200:], epochs=20)
    assert ml.macro_f1(y[200:], head.probabilities(x[200:]).argmax(1)) > 0.85
    assert ml.Head(768).parameters == 198_914


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "labels.csv").write_text(" Sentence_ID ,Text,Sentiment\n1,a,positive\n2,,negative\n")
    sheet = readers.read_labels(spark, str(tmp_path / "labels.csv"), "` Sentence_ID ` string, Text string, Sentiment string")
    assert sheet.columns == ["sentence_id", "text", "sentiment"] and sheet.where("text is null").count() == 1
    (tmp_path / "audio").mkdir()
    (tmp_path / "audio" / "12_ab.wav").write_bytes(b"x")
    (tmp_path / "audio" / "bad.txt").write_bytes(b"y")
    good, bad = readers.scan_folder(spark, str(tmp_path / "audio"), r"(\d+)_(\w+)\.", {"number": 1, "speaker": 2}, ["wav"], content=True)
    assert [(r.number, r.speaker, r.md5) for r in good.collect()] == [("12", "ab", "9dd4e461268c8034f5c8564e155c67a6")]
    assert [r.issue for r in bad.collect()] == ["extension"]
    (tmp_path / "audio" / "ab").mkdir()
    (tmp_path / "audio" / "ab" / "13_AB.wav").write_bytes(b"x")
    (tmp_path / "audio" / "ab" / "14_cd.wav").write_bytes(b"x")
    good, bad = readers.scan_folder(spark, str(tmp_path / "audio"), r"(\d+)_(\w+)\.", {"number": 1, "speaker": 2}, ["wav"], folder="speaker")
    assert [r.number for r in good.collect()] == ["13"]
    assert sorted((r.issue, r.number) for r in bad.collect()) == [("extension", ""), ("folder_mismatch", "12"), ("folder_mismatch", "14")]
    out = str(tmp_path / "table")
    assert writers.write_once(spark.range(3), out) is None
    with pytest.raises(FileExistsError):
        writers.write_once(spark.range(3), out)
    assert writers.write_once(spark.range(4), out, force=True) == f"{out}.archive1"
    assert spark.read.parquet(out).count() == 4
    assert writers.cached(spark, str(tmp_path / "kept"), lambda: spark.range(2)).count() == 2
    assert writers.markdown_table(spark.range(1)) == "| id |\n| - |\n| 0 |"


def test_encoder_gives_zeros_for_unseen(spark):
    rows = spark.createDataFrame([(1, 1.0, "a", True), (2, 3.0, "b", True), (3, None, "z", False)], "k int, x double, c string, training boolean")
    e = ml.train_only_encoder(rows, "training", ["x"], ["c"])
    got = {r.k: r.features for r in ml.encode(rows, e, "k", ["x"], ["c"], {"c": ["a", "b", "z"]}).collect()}
    assert got[3] == [0.0, 0.0, 0.0, 0.0]
    assert F is not None and abs(sum(v * v for v in got[1]) - 1) < 1e-9


def test_resamples_are_as_many_as_the_references(spark, monkeypatch):
    from plumbline.plans import evaluation

    asked = []
    whole = resampling.bootstrap_scores
    monkeypatch.setattr(resampling, "bootstrap_scores", lambda df, group, condition, iterations, seed: asked.append(iterations) or whole(df, group, condition, iterations, seed))
    evaluation.cluster_bootstrap(spark, "/root/testdata/sf0.001")
    assert asked == [10_000]
    rows = spark.createDataFrame([(i, i, int(i < 30), 100 if i < 30 else 1) for i in range(60)], "utterance_id int, group_id int, label int, n_words int")
    monkeypatch.setattr(evaluation.v, "recordings", lambda spark, d: rows)
    r = evaluation.permutation_null(spark, "").first()
    assert (r.exceed, r.p) == (0, round(1 / 1001, 9))


@pytest.mark.parametrize("most", [0, 100])
def test_bootstrap_limits(spark, monkeypatch, most):
    """Against draws dealt in plain Python, with a condition that some groups lack, broadcast or joined."""
    monkeypatch.setattr(resampling, "BROADCAST_GROUPS", most)
    monkeypatch.setattr(resampling, "DRAWS", 50)
    rng = random.Random(5)
    rows = [(g, c, rng.randrange(2), rng.randrange(2)) for g in range(7) for c in "xy" for _ in range(rng.randrange(1, 4)) if c == "x" or g < 2]
    got = {(r.iteration, r.c): r.score for r in resampling.bootstrap_scores(spark.createDataFrame(rows, "g int, c string, label int, predicted int"), "g", "c", 40, 3).collect()}
    want = {}
    for i in range(-1, 40):
        drawn = range(7) if i < 0 else [int(hashlib.md5(f"3|{i}|{k}".encode()).hexdigest()[:8], 16) % 7 for k in range(7)]
        for c in "xy":
            of = [(y, p) for g in drawn for h, d, y, p in rows if (h, d) == (g, c)]
            f1 = lambda a: 2 * of.count((a, a)) / max(1, 2 * of.count((a, a)) + of.count((a, 1 - a)) + of.count((1 - a, a)))  # noqa: E731, B023
            if of:
                want[i, c] = (f1(1) + f1(0)) / 2
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("hashed", [8, 1 << 15])
def test_bootstraps_of_two_frames_share_their_hashes(spark, monkeypatch, hashed):
    """Each frame against its own bootstrap by joined draws; hashes against hashlib, over one, two and three digits."""
    monkeypatch.setattr(resampling, "HASHED", hashed)
    texts = resampling._texts(20260807, 2, np.arange(120), 1)
    for at, x in ((9, b"4"), (10, b"7")):
        texts[at // 4, :, at % 4] = ord(x)
    assert resampling.md5_heads(texts.view(np.uint32)[..., 0]).tolist() == [int(hashlib.md5(f"20260807|47|{k}".encode()).hexdigest()[:8], 16) for k in range(120)]
    rng = random.Random(4)
    rows = [(g, c, rng.randrange(2), rng.randrange(2)) for g in range(23) for c in "xy"]
    df = spark.createDataFrame(rows, "g int, c string, label int, predicted int")
    frames = [df, df.where("g % 3 > 0")]
    said = lambda x: {(r.iteration, r.c): r.score for r in x.collect()}
    got = [said(x) for x in resampling.bootstrap_scores_each(frames, "g", "c", 120, 11)]
    monkeypatch.setattr(resampling, "BROADCAST_GROUPS", 0)
    assert got == [pytest.approx(said(resampling.bootstrap_scores(x, "g", "c", 120, 11)), abs=1e-12) for x in frames]


def test_bootstrap_counts_kinds_of_groups(spark, monkeypatch):
    """Beyond 100,000 groups no draw is joined as long as few kinds of counts differ, and sums equal those of joined draws, stretch by stretch."""
    df = spark.range(100_500).select(F.col("id").alias("g"), F.lit("x").alias("c"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 3 % 2).cast("int").alias("predicted"))
    said = lambda: {r.iteration: r.score for r in resampling.bootstrap_scores(df, "g", "c", 12, 20260807).collect()}
    want = []
    with monkeypatch.context() as m:
        m.setattr(resampling, "KINDS", 3)
        want.append(said())
    joined = []
    monkeypatch.setattr(resampling, "_joined", lambda *a: joined.append(a))
    monkeypatch.setattr(resampling, "CELLS", 12)
    assert [pytest.approx(x, abs=1e-12) for x in want] == [said()] and len(want[0]) == 13 and not joined
