"""Queries of inference: permutation nulls with a refit, joint holdout training, nested thresholds, gaps after canonical spelling, robustness and intervals."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from ..functions import canonical, numeric, text
from ..operators import holdout, metrics, permutation, resampling, selection
from ..operators.checks import GateError
from ..sources.writers import dropped, kept
from . import evaluation as ev
from . import features
from . import views as v
from .registry import register
from .views import table

#: Languages that get a column of their own at most; hash buckets of the content features.
LANGUAGES, BUCKETS = 64, 32


def acquisition_rows(spark, d):
    """(rows, width): utterance_id, key (its group), speaker_id, label, and x, what a text has besides its content: sizes, shares of kinds of letters, language.

    Rows are those of groups that agree on their label, as in the folds. A missing number counts as 0, a missing language has no column set."""
    docs = table(spark, d, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    levels = [r[0] for r in docs.where("lang is not null").select("lang").distinct().limit(LANGUAGES + 1).collect()]
    if len(levels) > LANGUAGES:
        raise GateError(f"over {LANGUAGES} languages")
    n = F.greatest(F.length("t"), F.lit(1))
    share = lambda pattern: F.regexp_count("t", F.lit(pattern)) / n
    words = F.size(text.tokens(F.col("t")))
    numeric = [F.log1p(F.length("t")), F.log1p(words), F.length("t") / F.greatest(words, F.lit(1)), F.log1p(F.regexp_count("t", F.lit("\n"))), share("[0-9]"), share("[A-Z]"), share("[^ -~\n]"), F.coalesce("n_chars", F.lit(0)) / 1000]
    dummies = [F.coalesce((F.col("lang") == x).cast("double"), F.lit(0.0)) for x in sorted(levels)]
    x = docs.select(F.col("doc_id").alias("utterance_id"), F.array(*(c.cast("double") for c in numeric), *dummies).alias("x"))
    rows = v.recordings(spark, d).join(ev.groups(spark, d), ["group_id", "label"]).join(x, "utterance_id")
    return rows.select("utterance_id", F.col("group_id").alias("key"), "speaker_id", "label", "x"), len(numeric) + len(dummies)


def content_rows(spark, d, words=None):
    """(rows, width) as above, x being the shares of a text's words (an array made from documents' columns) in BUCKETS buckets by hash."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-zà-ÿ0-9]+"), F.lit(0)) if words is None else words
    each = table(spark, d, "documents").select(F.col("doc_id").alias("utterance_id"), F.explode(words).alias("w")).select("utterance_id", F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).alias("b"))
    n = F.count("*")
    x = each.groupBy("utterance_id").agg(F.array(*((F.count_if(F.col("b") == i) / n) for i in range(BUCKETS))).alias("x"))
    rows = v.recordings(spark, d).join(ev.groups(spark, d), ["group_id", "label"]).join(x, "utterance_id", "left")
    return rows.select("utterance_id", F.col("group_id").alias("key"), "speaker_id", "label", F.coalesce("x", F.array(*[F.lit(0.0)] * BUCKETS)).alias("x")), BUCKETS


@register("permutation_refit")
def permutation_refit(spark, d):
    """One row: macro-F1 of the acquisition classifier on the true labels against 1,000 deals of labels between groups, each with folds made anew and models fitted again."""
    rows, width = acquisition_rows(spark, d)
    rows = kept(rows, "acquisition")
    groups = kept(rows.select("key", "label").distinct(), "acquisition-groups")
    pooled, mean = permutation.null_scores(rows, groups, width, ev.PERMUTATIONS)
    dropped(rows, groups)
    null = pooled[1:]
    exceed = int((null >= pooled[0]).sum())
    facts = {"observed_pooled": pooled[0], "observed_mean_fold": mean[0], "null_mean": null.mean(), "null_sd": null.std(ddof=1)}
    facts |= {f"null_q{name}": np.quantile(null, q) for name, q in (("025", 0.025), ("500", 0.5), ("975", 0.975), ("990", 0.99))} | {"null_max": null.max()}
    row = [round(float(x), 9) for x in facts.values()] + [exceed, len(null), (1 + exceed) / (1 + len(null))]
    return spark.createDataFrame([row], ", ".join(f"{k} double" for k in facts) + ", exceed bigint, n bigint, p double")


def holdout_said(spark, d):
    """{model: (rows, predictions)} of the acquisition and the content classifier under both protocols."""
    place = ev.folds(spark, d).select(F.col("group_id").alias("key"), "outer_fold")
    out = {}
    for name, made in (("acquisition", acquisition_rows), ("content", content_rows)):
        rows, width = made(spark, d)
        rows = kept(rows.join(place, "key"), f"holdout-{name}")
        out[name] = rows, kept(holdout.holdout_predictions(rows, "utterance_id", width), f"holdout-said-{name}")
    return out


@register("holdout_scores")
def holdout_scores(spark, d):
    """Macro-F1 and accuracy by model, protocol and speaker, and pooled, of exactly one prediction of every recording and protocol."""
    out = []
    for name, (rows, said) in holdout_said(spark, d).items():
        holdout.assert_one_prediction(rows, said, "utterance_id")
        called = said.withColumn("predicted", (F.col("prob") > 0.5).cast("int"))
        both = called.groupingSets([["protocol", "speaker_id"], ["protocol"]], "protocol", "speaker_id").agg(*metrics.confusion_counts())
        n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
        out.append(both.select(F.lit(name).alias("model"), "protocol", F.coalesce("speaker_id", F.lit("pooled")).alias("speaker_id"), F.round(metrics.macro_f1(), 6).alias("macro_f1"), F.round((F.col("tn") + F.col("tp")) / n, 6).alias("accuracy"), n.alias("n")))
    return v.union_all(out)


@register("holdout_gate", f"WITH {ev.FOLDS}, p AS (SELECT unnest(['joint', 'shared']) AS protocol) SELECT m AS model, protocol, count(*) AS recordings, count(*) AS predictions, CAST(1 AS BIGINT) AS least, CAST(1 AS BIGINT) AS most FROM rec JOIN fold USING (group_id, label) CROSS JOIN p CROSS JOIN (SELECT unnest(['acquisition', 'content']) AS m) GROUP BY ALL")
def holdout_gate(spark, d):
    """That joint holdout training, and the shared protocol beside it, give every recording one prediction each."""
    return v.union_all([holdout.assert_one_prediction(rows, said, "utterance_id").select(F.lit(name).alias("model"), "protocol", "recordings", "predictions", "least", "most") for name, (rows, said) in holdout_said(spark, d).items()])


# Thresholds chosen on inner validation rows, used on the fold's test rows.

_NESTED = (
    ev.INNER.replace(v.REC, v.ENS)
    + f", vpred AS (SELECT inr.outer_fold, condition, utterance_id, rec.label, round(avg(least(1.0, greatest(0.0, CAST(0.5 AS DOUBLE) + (rec.label - CAST(0.5 AS DOUBLE)) * strength + ({v.bucket_sql("concat_ws('|', CAST(utterance_id AS VARCHAR), condition, CAST(seed AS VARCHAR), CAST(inr.outer_fold AS VARCHAR))")} / CAST(4294967296 AS DOUBLE) - CAST(0.5 AS DOUBLE)) * CAST(0.8 AS DOUBLE)))), 9) AS prob FROM rec JOIN inr ON inr.group_id = rec.group_id AND inr.label = rec.label CROSS JOIN cond CROSS JOIN seeds WHERE is_inner_validation = 1 GROUP BY ALL)"
    + ", val AS (SELECT condition, outer_fold, label, CAST(floor(prob * 1000) AS INTEGER) AS b FROM vpred)"
    + ev._SWEEP[len(ev.VAL) :]
    + ", tst AS (SELECT ens.condition, fold.outer_fold, utterance_id, ens.label, round(prob, 9) AS prob, t, CAST(floor(round(prob, 9) * 1000) >= t AS INTEGER) AS predicted FROM ens JOIN fold USING (group_id, label) JOIN sel ON sel.condition = ens.condition AND sel.outer_fold = fold.outer_fold)"
)


def validation(spark, d):
    """(outer_fold, condition, utterance_id, label, prob): seed means of what each fold's model says of its inner validation rows."""
    inner = ev.splits.inner_validation(ev.folds(spark, d), "group_id", "label").where("is_inner_validation = 1").select("group_id", "label", "outer_fold")
    rows = v.recordings(spark, d).join(inner, ["group_id", "label"])
    grid = v.conditions(spark).crossJoin(spark.createDataFrame([(s,) for s in v.SEEDS], "seed int"))
    u = numeric.hash_uniform(F.concat_ws("|", F.col("utterance_id").cast("string"), "condition", F.col("seed").cast("string"), F.col("outer_fold").cast("string")))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + (F.col("label") - 0.5) * F.col("strength") + (u - 0.5) * 0.8))
    said = rows.crossJoin(F.broadcast(grid)).withColumn("prob", p)
    return said.groupBy("outer_fold", "condition", "utterance_id", "label").agg(F.round(F.avg("prob"), 9).alias("prob"))


def chosen(spark, d):
    rows = kept(validation(spark, d), "validation")
    half = rows.withColumn("predicted", (F.floor(F.col("prob") * 1000) >= 500).cast("int")).groupBy("condition", "outer_fold").agg(*metrics.confusion_counts(), F.count("*").alias("n_validation"))
    at_half = half.select("condition", "outer_fold", metrics.macro_f1().alias("half"), "n_validation")
    return selection.best_thresholds(rows, ["condition", "outer_fold"], "label", "prob").join(at_half, ["condition", "outer_fold"])


def tested(spark, d):
    """Each fold's test rows with the threshold that its condition and fold chose."""
    rows = v.ensemble(spark, d).join(ev.folds(spark, d), ["group_id", "label"]).withColumn("prob", F.round("prob", 9))
    return rows.join(F.broadcast(chosen(spark, d).select("condition", "outer_fold", "t")), ["condition", "outer_fold"]).withColumn("predicted", (F.floor(F.col("prob") * 1000) >= F.col("t")).cast("int"))


@register("nested_thresholds", f"WITH {_NESTED}, h AS (SELECT condition, outer_fold, {ev._MACRO} AS m, tn + fp + fn + tp AS n FROM (" + ev.counts_sql("(SELECT *, CAST(b >= 500 AS INTEGER) AS predicted FROM val)", "condition, outer_fold") + ")) SELECT condition, outer_fold, t / CAST(1000 AS DOUBLE) AS threshold, round(f, 9) AS validation_f1, round(m, 9) AS validation_f1_at_half, ties, n AS n_validation FROM sel JOIN h USING (condition, outer_fold)")
def nested_thresholds(spark, d):
    """By condition and fold: the best threshold on inner validation rows, its score there and that of a half, ties, and how many rows chose."""
    return chosen(spark, d).select("condition", "outer_fold", (F.col("t") / 1000).alias("threshold"), F.round("f", 9).alias("validation_f1"), F.round("half", 9).alias("validation_f1_at_half"), "ties", "n_validation")


@register("nested_threshold_predictions", f"WITH {_NESTED} SELECT condition, outer_fold, utterance_id, label, prob, t / CAST(1000 AS DOUBLE) AS threshold, predicted FROM tst")
def nested_threshold_predictions(spark, d):
    return tested(spark, d).select("condition", "outer_fold", "utterance_id", "label", "prob", (F.col("t") / 1000).alias("threshold"), "predicted")


@register(
    "nested_threshold_table",
    f"WITH {_NESTED}, a AS ({ev.counts_sql('tst', 'condition')}), b AS ({ev.counts_sql('(SELECT condition, label, CAST(prob >= 0.5 AS INTEGER) AS predicted FROM tst)', 'condition')}), s AS (SELECT condition, string_agg(printf('%.3f', t / CAST(1000 AS DOUBLE)), '/' ORDER BY outer_fold) AS thresholds FROM sel GROUP BY condition) "
    f"SELECT condition, thresholds, x.m AS threshold_f1, x.rate AS threshold_positive_rate, y.m AS default_f1, y.rate AS default_positive_rate, round(x.m - y.m, 9) AS gain, actual_positive_rate FROM (SELECT condition, round({ev._MACRO}, 9) AS m, round((tp + fp) / CAST(tn + fp + fn + tp AS DOUBLE), 9) AS rate, round((tp + fn) / CAST(tn + fp + fn + tp AS DOUBLE), 9) AS actual_positive_rate FROM a) x JOIN (SELECT condition, round({ev._MACRO}, 9) AS m, round((tp + fp) / CAST(tn + fp + fn + tp AS DOUBLE), 9) AS rate FROM b) y USING (condition) JOIN s USING (condition)",
)
def nested_threshold_table(spark, d):
    """By condition: the folds' thresholds, test macro-F1 and positive rate with them and with a half, and the gain."""
    rows = tested(spark, d)
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")

    def score(frame, name):
        return frame.groupBy("condition").agg(*metrics.confusion_counts()).select("condition", F.round(metrics.macro_f1(), 9).alias(f"{name}_f1"), F.round((F.col("tp") + F.col("fp")) / n, 9).alias(f"{name}_positive_rate"), F.round((F.col("tp") + F.col("fn")) / n, 9).alias("actual_positive_rate"))

    with_, without = score(rows, "threshold"), score(rows.withColumn("predicted", (F.col("prob") >= 0.5).cast("int")), "default").drop("actual_positive_rate")
    ordered = F.array_sort(F.collect_set(F.struct("outer_fold", "t")))  # a handful of folds
    told = rows.groupBy("condition").agg(F.array_join(F.transform(ordered, lambda x: F.format_string("%.3f", x["t"] / 1000)), "/").alias("thresholds"))
    return with_.join(without, "condition").join(told, "condition").withColumn("gain", F.round(F.col("threshold_f1") - F.col("default_f1"), 9))


# What canonical spelling explains of a gap.

#: Canonicalised condition, the one it is made of, how strongly predictions follow the label where the spelling changes.
ORTHOGRAPHIC = (("N2", "C2", 0.62), ("N3", "C3", 0.35), ("N4", "C4", 0.45))
ORTH_PAIRS = (("asr_a", "C2", "C3", "N2", "N3"), ("asr_b", "C2", "C4", "N2", "N4"))
_BASE = {c: s for c, _, _, s in v.CONDITIONS}

_ORTH = (
    v.ENS
    + ", alt AS (SELECT doc_id AS utterance_id, regexp_matches(coalesce(text, ''), '"
    + canonical.pattern_of([k for k, x in features.MAPPING.items() if k != x])
    + "') AS altered FROM documents), orth(name, base, new_strength, base_strength) AS (VALUES "
    + ", ".join(f"('{n}', '{b}', CAST({s} AS DOUBLE), CAST({_BASE[b]} AS DOUBLE))" for n, b, s in ORTHOGRAPHIC)
    + f"), npred AS (SELECT name AS condition, utterance_id, group_id, speaker_id, label, avg(least(1.0, greatest(0.0, CAST(0.5 AS DOUBLE) + (label - CAST(0.5 AS DOUBLE)) * CASE WHEN altered THEN new_strength ELSE base_strength END + ({v.bucket_sql("concat_ws('|', CAST(utterance_id AS VARCHAR), CASE WHEN altered THEN name ELSE base END, CAST(seed AS VARCHAR))")} / CAST(4294967296 AS DOUBLE) - CAST(0.5 AS DOUBLE)) * CAST(0.8 AS DOUBLE)))) AS prob FROM rec JOIN alt USING (utterance_id) CROSS JOIN orth CROSS JOIN seeds GROUP BY ALL)"
    + ", both_ AS (SELECT condition, utterance_id, group_id, speaker_id, label, predicted FROM ens WHERE condition IN ('C2', 'C3', 'C4') UNION ALL SELECT condition, utterance_id, group_id, speaker_id, label, CAST(round(prob, 9) >= 0.5 AS INTEGER) FROM npred)"
)


def altered(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("utterance_id"), canonical.is_altered(F.col("text"), features.MAPPING).alias("altered"))


def orthographic(spark, d):
    """(condition, utterance_id, group_id, label, predicted) of C2 to C4 and of their canonicalised counterparts, which differ where the spelling changes."""
    grid = spark.createDataFrame([(n, b, s, _BASE[b]) for n, b, s in ORTHOGRAPHIC], "name string, base string, new_strength double, base_strength double").crossJoin(spark.createDataFrame([(s,) for s in v.SEEDS], "seed int"))
    rows = v.recordings(spark, d).join(altered(spark, d), "utterance_id").crossJoin(F.broadcast(grid))
    u = numeric.hash_uniform(F.concat_ws("|", F.col("utterance_id").cast("string"), F.when(F.col("altered"), F.col("name")).otherwise(F.col("base")), F.col("seed").cast("string")))
    strength = F.when(F.col("altered"), F.col("new_strength")).otherwise(F.col("base_strength"))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + (F.col("label") - 0.5) * strength + (u - 0.5) * 0.8))
    new = rows.withColumn("prob", p).groupBy(F.col("name").alias("condition"), "utterance_id", "group_id", "label").agg((F.round(F.avg("prob"), 9) >= 0.5).cast("int").alias("predicted"))
    return v.ensemble(spark, d).where(F.col("condition").isin("C2", "C3", "C4")).select(new.columns).unionByName(new)


_R = {s: f"(({o} - {x}) - ({on} - {xn}))" for s, o, x, on, xn in ORTH_PAIRS}


def _orth_row(s, o, x, on, xn):
    now = lambda e: f"round(max(CASE WHEN iteration = -1 THEN {e} END), 9)"
    low, high = (f"round(quantile_cont({_R[s]}, {q}) FILTER (WHERE iteration >= 0), 9)" for q in (0.025, 0.975))
    return f"SELECT '{s}' AS system, {now(o)} AS oracle_f1, {now(x)} AS substituted_f1, {now(on)} AS canonical_oracle_f1, {now(xn)} AS canonical_substituted_f1, {now(f'{o} - {x}')} AS gap, {now(f'{on} - {xn}')} AS canonical_gap, {now(_R[s])} AS r_orth, {low} AS low, {high} AS high, {low} > 0 OR {high} < 0 AS excludes_zero, (SELECT count(*) FROM rec JOIN alt USING (utterance_id) WHERE altered) AS n_altered FROM w"


_ORTH_CONDS = ["C2", "C3", "C4", "N2", "N3", "N4"]


@register("r_orth_ci", f"WITH {ev.boot_sql('both_', _ORTH)}, w AS (SELECT iteration, " + ", ".join(f"max(CASE WHEN condition = '{c}' THEN score END) AS {c}" for c in _ORTH_CONDS) + " FROM sc GROUP BY iteration) " + " UNION ALL ".join(_orth_row(*p) for p in ORTH_PAIRS))
def r_orth_ci(spark, d):
    """By system: the gap to the oracle before and after canonical spelling, and the difference of the two gaps with its interval, both gaps taken within each draw."""
    scores = resampling.bootstrap_scores(orthographic(spark, d), "group_id", "condition", ev.ITERATIONS, ev.BOOT_SEED)
    w = scores.groupBy("iteration").pivot("condition", _ORTH_CONDS).agg(F.first("score"))
    rows = F.array(*(F.struct(F.lit(s).alias("system"), F.col(o).alias("o"), F.col(x).alias("x"), F.col(on).alias("on"), F.col(xn).alias("xn")) for s, o, x, on, xn in ORTH_PAIRS))
    long = w.select("iteration", F.explode(rows).alias("r")).select("iteration", "r.*").withColumn("r", (F.col("o") - F.col("x")) - (F.col("on") - F.col("xn")))
    now = lambda c: F.round(F.max(F.when(F.col("iteration") == -1, c)), 9)
    drawn = F.when(F.col("iteration") >= 0, F.col("r"))
    named = {"oracle_f1": F.col("o"), "substituted_f1": F.col("x"), "canonical_oracle_f1": F.col("on"), "canonical_substituted_f1": F.col("xn"), "gap": F.col("o") - F.col("x"), "canonical_gap": F.col("on") - F.col("xn"), "r_orth": F.col("r")}
    out = long.groupBy("system").agg(*(now(c).alias(k) for k, c in named.items()), F.round(F.percentile(drawn, 0.025), 9).alias("low"), F.round(F.percentile(drawn, 0.975), 9).alias("high"))
    n = v.recordings(spark, d).join(altered(spark, d), "utterance_id").agg(F.count_if("altered").alias("n_altered"))
    return out.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0)).crossJoin(F.broadcast(n))


# Robustness, seeds, the whole table of intervals.

_CROWD = ev._NEAR_TOKENS.replace(v.REC, v.ENS) + ", crowd AS (SELECT DISTINCT group_id FROM rec JOIN near ON (utterance_id = a OR utterance_id = b) WHERE round(j, 4) >= 0.7), kept_ AS (SELECT * FROM ens ANTI JOIN crowd USING (group_id))"


def _named_boot(source, base, tag):
    """boot_sql under names of its own, so that two resamples stand in one statement."""
    sql = ev.boot_sql(source, base)[len(base) :]
    for name in ("cnt", "pos", "drw", "tms", "sc", "g"):
        sql = re.sub(rf"(FROM|JOIN) {name}\b", rf"\1 {name}{tag}", sql)
        sql = re.sub(rf"(?<![\w.]){name}(?=\s+AS\s+\()", f"{name}{tag}", sql)
    return sql


@register("robust_bootstrap_change", f"WITH {_CROWD}{_named_boot('ens', v.ENS, '1')}{_named_boot('kept_', v.ENS, '2')}, f AS ({ev.diff_sql(ev.PAIRS).replace('FROM sc a JOIN sc b', 'FROM sc1 a JOIN sc1 b')}), r AS ({ev.diff_sql(ev.PAIRS).replace('FROM sc a JOIN sc b', 'FROM sc2 a JOIN sc2 b')}) SELECT comparison, f.gap AS gap_full, f.low AS low_full, f.high AS high_full, r.gap AS gap_filtered, r.low AS low_filtered, r.high AS high_filtered, round(r.gap - f.gap, 9) AS change, r.excludes_zero AS excludes_zero_filtered, (SELECT count(*) FROM crowd) AS groups_excluded FROM f JOIN r USING (comparison)")
def robust_bootstrap_change(spark, d):
    """Each comparison on all groups and again without the groups that hold a text of a near-duplicate pair (0.7 or more), and the change."""
    rows = kept(v.ensemble(spark, d), "ensemble")
    high = ev.near_pairs(spark, d).where(F.round("jaccard", 4) >= 0.7)
    ids = high.select(F.explode(F.array("a", "b")).alias("utterance_id")).distinct()
    crowd = kept(v.recordings(spark, d).join(ids, "utterance_id", "left_semi").select("group_id").distinct(), "near-duplicate-groups")

    def found(scores, tag):
        names = ("gap", "low", "high", "excludes_zero")
        return resampling.paired_differences(scores, "condition", ev.PAIRS).withColumnsRenamed({k: f"{k}_{tag}" for k in names})

    full, filtered = resampling.bootstrap_scores_each([rows, rows.join(crowd, "group_id", "left_anti")], "group_id", "condition", ev.ITERATIONS, ev.BOOT_SEED)
    both = found(full, "full").join(found(filtered, "filtered"), "comparison").drop("excludes_zero_full")
    return both.withColumn("change", F.round(F.col("gap_filtered") - F.col("gap_full"), 9)).crossJoin(crowd.agg(F.count("*").alias("groups_excluded")))


@register("seed_pairs", f"WITH {ev.SEED_F1}, pr AS (" + " UNION ALL ".join(f"SELECT '{n}' AS comparison, seed, a.m - b.m AS gap FROM sm a JOIN sm b USING (seed) WHERE a.condition = '{x}' AND b.condition = '{y}'" for n, x, y in ev.PAIRS) + ") SELECT comparison, " + ", ".join(f"round(max(gap) FILTER (WHERE seed = {s}), 9) AS seed_{s}" for s in v.SEEDS) + ", round(avg(gap), 9) AS mean, round(stddev_samp(gap), 9) AS sd, count(*) FILTER (WHERE gap > 0) AS seeds_above FROM pr GROUP BY comparison")
def seed_pairs(spark, d):
    """Differences of conditions within each seed, with their mean and deviation over the seeds."""
    rows = v.predictions(spark, d).withColumn("predicted", (F.col("prob") >= 0.5).cast("int"))
    per = rows.groupBy("condition", "seed").agg(*metrics.confusion_counts()).select("condition", "seed", metrics.macro_f1().alias("m"))
    w = per.groupBy("seed").pivot("condition", ev._CONDS).agg(F.first("m"))
    long = w.select("seed", F.explode(F.array(*(F.struct(F.lit(n).alias("comparison"), (F.col(x) - F.col(y)).alias("gap")) for n, x, y in ev.PAIRS))).alias("r")).select("seed", "r.*")
    each = [F.round(F.max(F.when(F.col("seed") == s, F.col("gap"))), 9).alias(f"seed_{s}") for s in v.SEEDS]
    return long.groupBy("comparison").agg(*each, F.round(F.avg("gap"), 9).alias("mean"), F.round(F.stddev_samp("gap"), 9).alias("sd"), F.count_if(F.col("gap") > 0).alias("seeds_above"))


#: Quantity, family, whether it was thought of after the results were seen, numerator, denominator (None: a difference).
QUANTITIES = tuple((n, "planned", False, f"{a} - {b}", None) for n, a, b in ev.PAIRS) + (
    ("adapted_systems", "between systems", True, "A1 - A2", None),
    ("substituted_systems", "between systems", True, "C3 - C4", None),
    ("recovery_a", "recovery", False, "A1 - C3", "C2 - C3"),
    ("recovery_b", "recovery", False, "A2 - C4", "C2 - C4"),
    ("fusion_share_a", "recovery", True, "C5 - C3", "C2 - C3"),
)


def _quantity_sql(name, family, late, a, b):
    e = f"(({a}) / ({b}))" if b else f"({a})"
    low, high = (f"round(quantile_cont({e}, {q}) FILTER (WHERE iteration >= 0), 9)" for q in (0.025, 0.975))
    least = f"round(min(abs({b})) FILTER (WHERE iteration >= 0), 9)" if b else "CAST(NULL AS DOUBLE)"
    return f"SELECT '{name}' AS quantity, '{family}' AS family, {str(late).lower()} AS post_hoc, '{'ratio' if b else 'difference'}' AS kind, round(max(CASE WHEN iteration = -1 THEN {e} END), 9) AS observed, {low} AS low, {high} AS high, {low} > 0 OR {high} < 0 AS excludes_zero, {least} AS least_denominator FROM w"


@register("interval_table", f"WITH {ev.boot_sql('ens', v.ENS)}, {ev._WIDE} " + " UNION ALL ".join(_quantity_sql(*q) for q in QUANTITIES))
def interval_table(spark, d):
    """All differences and ratios with intervals from one set of draws: family, post-hoc flag, and for ratios the least denominator that a draw had."""
    w = ev.wide(spark, d)
    rows = F.array(*(F.struct(F.lit(n).alias("quantity"), F.lit(f).alias("family"), F.lit(late).alias("post_hoc"), F.lit("ratio" if b else "difference").alias("kind"), F.expr(ev._quotient(f"({a}) / ({b})") if b else a).alias("e"), (F.abs(F.expr(b)) if b else F.lit(None).cast("double")).alias("below")) for n, f, late, a, b in QUANTITIES))
    long = w.select("iteration", F.explode(rows).alias("r")).select("iteration", "r.*")
    drawn = F.col("iteration") >= 0
    e = F.when(drawn, F.col("e"))
    out = long.groupBy("quantity", "family", "post_hoc", "kind").agg(F.round(F.max(F.when(~drawn, F.col("e"))), 9).alias("observed"), F.round(F.percentile(e, 0.025), 9).alias("low"), F.round(F.percentile(e, 0.975), 9).alias("high"), F.round(F.min(F.when(drawn, F.col("below"))), 9).alias("least_denominator"))
    return out.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))
