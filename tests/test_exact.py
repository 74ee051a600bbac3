"""Exact quantiles, segmented scans, published numbers and problem logs against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import audit, checks, quantiles, windows


@pytest.mark.parametrize("bins", [1024, 3])
def test_quantiles_equal_sorting(spark, bins):
    r = random.Random(2)
    groups = {"a": [r.gauss(0, 1) for _ in range(301)], "b": [5.0] * 40, "c": [1e308, -1e308, 0.0, 1e-300], "d": [r.choice([1.0, 2.0, 1e9]) for _ in range(100)], None: [3.0, 1.0], "e": [7.5]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("a", None), ("a", float("nan")), ("none", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    qs = [0.0, 0.05, 1 / 3, 0.5, 0.99, 1.0]
    got = {(r.g, r.q): r.value for r in quantiles.exact_quantiles(df, ["g"], "x", qs, bins).collect()}
    assert {g for g, _ in got} == set(groups)
    for g, xs in groups.items():
        xs = sorted(xs)
        for q in qs:
            at = q * (len(xs) - 1)
            low, high = xs[math.floor(at)], xs[math.ceil(at)]
            assert got[g, q] == (low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
    whole = df.where("g = 'a' and not isnan(x)")
    assert quantiles.exact_quantiles(whole, [], "x", [0.25], bins).first().value == whole.agg(F.percentile("x", 0.25)).first()[0]
    assert quantiles.wide_quantiles(df.where("false"), [], "x", {"m": 0.5}).collect() == [(None,)]


def test_a_hot_speaker_is_many_stretches(spark):
    r = random.Random(3)
    events = [(1 if i % 10 else r.randrange(2, 9), r.randrange(0, 40 * 86400), i, r.randrange(2)) for i in range(4000)] + [(1, None, 9000, 1), (1, 5, 9001, 0), (1, 5, 9002, 1)]
    df = spark.createDataFrame(events, "k int, s long, id int, label int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = {r.id: (r.session_id, r.order_within_speaker) for r in windows.sessionize(df, "k", "ts", 45, tie="id", stretch_minutes=600).collect()}
    want = {}
    for k in {e[0] for e in events}:
        session, last = 0, None
        for n, (_, s, i, _) in enumerate(sorted((e for e in events if e[0] == k), key=lambda e: (e[1] is not None, e[1] or 0, e[2]))):
            if last is not None and s is not None and s - last > 45 * 60:
                session += 1
            last = s
            want[i] = (f"{k}_s{session}", n)
    assert got == want
    switched = {r.k: (r.n, r.switches) for r in windows.label_switches(df.where("ts is not null"), "k", ["ts", "id"], "label", F.to_date("ts")).collect()}
    plain = {r.k: (r.n, r.switches) for r in windows.label_switches(df.where("ts is not null"), "k", ["ts", "id"], "label").collect()}
    assert switched == plain
    stretch = F.floor(F.unix_micros("ts") / (600 * 60_000_000))
    assert df.groupBy("k", stretch).count().agg(F.max("count")).first()[0] < 0.1 * len(events)


def test_published_numbers(spark):
    registry = spark.createDataFrame([("f1", 0.667, 3, 0.0), ("n", 40.0, None, None), ("near", 1.0, 1, 0.1)], "key string, expected double, digits int, tolerance double")
    right = spark.createDataFrame([("f1", 2 / 3), ("n", 40.0), ("near", 1.08), ("other", 1.0)], "key string, value double")
    assert sorted(r.key for r in checks.assert_published(checks.published(right, registry)).collect()) == ["f1", "n", "near"]
    for wrong in ([("f1", 0.6674), ("n", 41.0), ("near", 1.0)], [("f1", 2 / 3), ("near", 1.0)]):
        with pytest.raises(checks.GateError, match="n: 40"):
            checks.assert_published(checks.published(spark.createDataFrame(wrong, "key string, value double"), registry))


def test_problems_and_observed_facts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None, 0), (2, "b", 1, 3), (3, None, None, 9)], "id int, who string, label int, n int")
    log = audit.problem_log(df, "id", "who", {"empty_text": (F.col("n") == 0, F.lit("x")), "missing_label": (F.col("label").isNull(), F.col("n"))})
    assert sorted((r.id, r.issue, r.kind, r.detail) for r in log.collect()) == [(1, "empty_text", "unusable", "x"), (1, "missing_label", "label", "0"), (3, "missing_label", "label", "9")]
    _, facts = audit.observed(df, {"rows": F.count("*"), "most": F.max("n")}, lambda x: x.write.parquet(str(tmp_path / "m")))
    assert facts == {"rows": 3, "most": 9}


def test_systems_without_errors_keep_their_bin(spark):
    from plumbline.operators import asr

    rows = spark.createDataFrame([("x", 0, 0.0), ("x", 0, 0.0), ("y", 1, 0.5), ("y", 2, 1.0), ("y", 0, 0.0)], "system string, errors int, wer double")
    got = sorted((r.system, r.bin) for r in asr.tertile_bins(rows).collect())
    assert got == [("x", "zero"), ("x", "zero"), ("y", "high"), ("y", "low"), ("y", "zero")] or [b for s, b in got if s == "x"] == ["zero", "zero"]


def test_decoding_audit(spark):
    from plumbline.operators import asr

    rows = spark.createDataFrame(
        [("s", ["a", "b"], ["a", "b"]), ("s", ["a"], ["a"] + ["c d e f".split()[i % 2] for i in range(8)]), ("s", ["a", "b", "c"], []), ("t", ["x"], ["y"])],
        "system string, gold array<string>, hyp array<string>",
    ).select("*", F.size("gold").alias("n_ref"), F.size("hyp").alias("n_hyp"))
    got = {r.system: r for r in asr.decoding_audit(asr.decoding_facts(rows, cap=9)).collect()}
    s = got["s"]
    assert (s.n, s.loops, s.flagged, s.long, s.latin, s.empty, s.capped, s.truncation_defect) == (3, 1, 1, 1, 2, 1, 1, True)
    assert s.insertion_rate == round(8 / 6, 9) and s.unflagged_insertion_rate == 0 and s.flagged_insertion_share == 1
    assert s.ratio_p100 == 9 and got["t"].truncation_defect is False and got["t"].flagged_insertion_share == 0
    assert np.isclose(s.ratio_p50, 1.0)
