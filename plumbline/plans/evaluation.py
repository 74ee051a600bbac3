"""Queries over predictions, transcripts, splits and resamples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import asr, joins, metrics, resampling, selection, splits, windows
from ..sources.writers import kept
from . import views as v
from .registry import register
from .views import table

_F1P = "CASE WHEN 2 * tp + fn + fp > 0 THEN 2.0 * tp / CAST(2 * tp + fn + fp AS DOUBLE) ELSE 0 END"
_F1N = "CASE WHEN 2 * tn + fn + fp > 0 THEN 2.0 * tn / CAST(2 * tn + fn + fp AS DOUBLE) ELSE 0 END"
_MACRO = f"(({_F1P}) + ({_F1N})) / CAST(2 AS DOUBLE)"


def _share(a, b):
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0 END"


def counts_sql(source: str, keys: str, predicted: str = "predicted") -> str:
    cells = ", ".join(f"count(*) FILTER (WHERE label = {a} AND {predicted} = {b}) AS {n}" for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)))
    return f"SELECT {keys}, {cells} FROM {source} GROUP BY {keys}"


def scored_sql(counts: str, keys: str) -> str:
    n = "CAST(greatest(tn + fp + fn + tp, 1) AS DOUBLE)"
    cols = {"macro_f1": _MACRO, "accuracy": f"(tp + tn) / {n}", "f1_positive": _F1P, "f1_negative": _F1N, "precision_positive": _share("tp", "tp + fp"), "recall_positive": _share("tp", "tp + fn"), "precision_negative": _share("tn", "tn + fn"), "recall_negative": _share("tn", "tn + fp"), "predicted_positive_rate": f"(tp + fp) / {n}"}
    return f"SELECT {keys}, tn, fp, fn, tp, " + ", ".join(f"CAST(round({e}, 9) AS DOUBLE) AS {k}" for k, e in cols.items()) + f" FROM ({counts})"


@register("seed_average", f"WITH {v.ENS} SELECT condition, utterance_id, label, round(prob, 9) AS prob, predicted FROM ens")
def seed_average(spark, d):
    return v.ensemble(spark, d).select("condition", "utterance_id", "label", F.round("prob", 9).alias("prob"), "predicted")


@register("seed_completeness", f"WITH {v.PRED} SELECT condition, min(k) AS least, max(k) AS most, min(k) = 3 AND max(k) = 3 AS complete FROM (SELECT condition, utterance_id, count(DISTINCT seed) AS k FROM pred GROUP BY ALL) GROUP BY condition")
def seed_completeness(spark, d):
    per = v.predictions(spark, d).groupBy("condition", "utterance_id").agg(F.count_distinct("seed").alias("k"))
    return per.groupBy("condition").agg(F.min("k").alias("least"), F.max("k").alias("most"), ((F.min("k") == 3) & (F.max("k") == 3)).alias("complete"))


@register("condition_metrics", f"WITH {v.ENS} {scored_sql(counts_sql('ens', 'condition'), 'condition')}")
def condition_metrics(spark, d):
    return metrics.scored(v.ensemble(spark, d), ["condition"])


@register("confusion_metrics", f"WITH {v.PRED}, p AS (SELECT *, CAST(prob > 0.5 AS INTEGER) AS predicted FROM pred) {scored_sql(counts_sql('p', 'condition, seed'), 'condition, seed')}")
def confusion_metrics(spark, d):
    return metrics.scored(v.predictions(spark, d).withColumn("predicted", (F.col("prob") > 0.5).cast("int")), ["condition", "seed"])


@register("metrics_with_pooled", f"WITH {v.ENS}, c AS (SELECT condition, coalesce(speaker_id, 'pooled') AS speaker_id, " + ", ".join(f"count(*) FILTER (WHERE label = {a} AND predicted = {b}) AS {n}" for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))) + f" FROM ens GROUP BY GROUPING SETS ((condition, speaker_id), (condition))) SELECT condition, speaker_id, tn, fp, fn, tp, CAST(round({_MACRO}, 9) AS DOUBLE) AS macro_f1 FROM c")
def metrics_with_pooled(spark, d):
    both = v.ensemble(spark, d).groupingSets([["condition", "speaker_id"], ["condition"]], "condition", "speaker_id").agg(*metrics.confusion_counts())
    return both.select("condition", F.coalesce("speaker_id", F.lit("pooled")).alias("speaker_id"), *metrics.COUNTS, F.round(metrics.macro_f1(), 9).alias("macro_f1"))


@register("rate_by_pair", f"WITH {v.ENS} SELECT speaker_id, label, count(*) AS n, round(avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END), 9) AS correct FROM ens GROUP BY speaker_id, label")
def rate_by_pair(spark, d):
    return v.ensemble(spark, d).groupBy("speaker_id", "label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("predicted") == F.col("label")).cast("double")), 9).alias("correct"))


_CONDS = [c[0] for c in v.CONDITIONS]


@register("pivot_conditions", f"WITH {v.ENS} SELECT utterance_id, " + ", ".join(f"round(max(CASE WHEN condition = '{c}' THEN prob END), 9) AS {c}" for c in _CONDS) + " FROM ens GROUP BY utterance_id")
def pivot_conditions(spark, d):
    return v.ensemble(spark, d).groupBy("utterance_id").pivot("condition", _CONDS).agg(F.round(F.max("prob"), 9))


GROUPS = v.REC + ", grp AS (SELECT group_id, min(label) AS label FROM rec GROUP BY group_id HAVING min(label) = max(label))"
FOLDS = GROUPS + f", fold AS (SELECT group_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {v.bucket_sql('concat_ws(chr(124), 42, CAST(group_id AS VARCHAR))')}, group_id) - 1) % 5 AS INTEGER) AS outer_fold FROM grp)"
INNER = FOLDS + f", inr0 AS (SELECT f.outer_fold, group_id, label, row_number() OVER (PARTITION BY f.outer_fold, label ORDER BY {v.bucket_sql('concat_ws(chr(124), CAST(1000 + f.outer_fold AS VARCHAR), CAST(group_id AS VARCHAR))')}, group_id) AS k, count(*) OVER (PARTITION BY f.outer_fold, label) AS n FROM fold JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS outer_fold) f ON f.outer_fold <> fold.outer_fold), inr AS (SELECT outer_fold, group_id, label, CAST(k <= floor(n * CAST(0.1 AS DOUBLE)) AS INTEGER) AS is_inner_validation FROM inr0)"


def groups(spark, d):
    return splits.group_labels(v.recordings(spark, d), "group_id", "label")


def folds(spark, d):
    return splits.grouped_folds(groups(spark, d), "group_id", "label")


@register("grouped_folds", f"WITH {FOLDS} SELECT group_id, label, outer_fold FROM fold")
def grouped_folds(spark, d):
    return folds(spark, d)


@register("fold_report", f"WITH {FOLDS} SELECT outer_fold, count(*) AS groups, count(*) FILTER (WHERE label = 1) AS positive, round(avg(label), 6) AS positive_rate FROM fold GROUP BY outer_fold")
def fold_report(spark, d):
    return folds(spark, d).groupBy("outer_fold").agg(F.count("*").alias("groups"), F.count_if(F.col("label") == 1).alias("positive"), F.round(F.avg("label"), 6).alias("positive_rate"))


@register("inner_validation", f"WITH {INNER} SELECT outer_fold, group_id, label, is_inner_validation FROM inr")
def inner_validation(spark, d):
    return splits.inner_validation(folds(spark, d), "group_id", "label")


@register("leakage_checks", f"WITH {INNER}, i AS (SELECT inr.outer_fold, count(*) FILTER (WHERE f.outer_fold = inr.outer_fold) AS leaks, count(*) FILTER (WHERE is_inner_validation = 1) AS held, count(*) AS size, count(DISTINCT group_id) AS distinct_groups FROM inr JOIN fold f USING (group_id) GROUP BY inr.outer_fold), good AS (SELECT rec.* FROM rec JOIN grp USING (group_id)), placed AS (SELECT good.*, outer_fold FROM good JOIN fold USING (group_id)), gk AS (SELECT group_id, count(DISTINCT outer_fold) AS k FROM fold GROUP BY group_id), tk AS (SELECT token_key, count(DISTINCT outer_fold) AS k FROM placed GROUP BY token_key) SELECT 'groups_disjoint_' || outer_fold AS name, count(*) FILTER (WHERE k > 1) = 0 AS passed FROM fold JOIN gk USING (group_id) GROUP BY outer_fold UNION ALL SELECT 'texts_disjoint_' || outer_fold, count(*) FILTER (WHERE k > 1) = 0 FROM placed JOIN tk USING (token_key) GROUP BY outer_fold UNION ALL SELECT 'every_group_is_tested', min(n) >= 1 FROM (SELECT count(*) AS n FROM fold GROUP BY group_id) UNION ALL SELECT 'fold_counts_sum_to_all', (SELECT count(*) FROM placed) = count(*) FROM good UNION ALL SELECT 'utterances_unique', count(*) = count(DISTINCT utterance_id) FROM good UNION ALL SELECT 'one_fold_per_group' AS name, count(*) = count(DISTINCT group_id) AS passed FROM fold UNION ALL SELECT 'fold_count', count(DISTINCT outer_fold) = 5 FROM fold UNION ALL SELECT 'fold_range', min(outer_fold) = 0 AND max(outer_fold) = 4 FROM fold UNION ALL SELECT 'every_group_has_a_fold', count(*) = 0 FROM good WHERE group_id NOT IN (SELECT group_id FROM fold) UNION ALL SELECT 'no_unknown_group', count(*) = 0 FROM fold WHERE group_id NOT IN (SELECT group_id FROM good) UNION ALL SELECT 'groups_agree_on_label', count(*) = 0 FROM (SELECT group_id FROM good GROUP BY group_id HAVING count(DISTINCT label) > 1) UNION ALL SELECT 'inner_without_test_groups_' || outer_fold, leaks = 0 FROM i UNION ALL SELECT 'inner_has_validation_' || outer_fold, held > 0 FROM i UNION ALL SELECT 'inner_keeps_training_' || outer_fold, held < size FROM i UNION ALL SELECT 'inner_groups_once_' || outer_fold, size = distinct_groups FROM i UNION ALL SELECT 'balance_' || outer_fold, abs(avg(label) - (SELECT avg(label) FROM fold)) <= 0.1 FROM fold GROUP BY outer_fold")
def leakage_checks(spark, d):
    made = folds(spark, d)
    rows = v.recordings(spark, d).join(groups(spark, d).select("group_id"), "group_id", "left_semi")
    return splits.leakage_checks(rows, made, splits.inner_validation(made, "group_id", "label"), "group_id", "label", row_id="utterance_id", text="token_key")


@register("joint_holdout_split", f"WITH {FOLDS} SELECT s.held_speaker, f.held_fold, count(*) FILTER (WHERE speaker_id = s.held_speaker AND outer_fold = f.held_fold) AS test, count(*) FILTER (WHERE speaker_id <> s.held_speaker AND outer_fold <> f.held_fold) AS train FROM rec JOIN fold USING (group_id) CROSS JOIN (SELECT DISTINCT speaker_id AS held_speaker FROM rec) s CROSS JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS held_fold) f GROUP BY ALL")
def joint_holdout_split(spark, d):
    """From counts by speaker and fold: what both hold out is a cell, what neither touches is the total less its row and column."""
    rows = v.recordings(spark, d).join(folds(spark, d).select("group_id", "outer_fold"), "group_id")
    cell = rows.groupBy("speaker_id", "outer_fold").agg(F.count("*").alias("n"))
    grid = v.recordings(spark, d).select("speaker_id").distinct().crossJoin(F.broadcast(spark.range(5).select(F.col("id").cast("int").alias("outer_fold"))))
    full = grid.join(cell, ["speaker_id", "outer_fold"], "left").fillna({"n": 0})
    row, col, whole = (F.sum("n").over(Window.partitionBy(*k)) for k in (["speaker_id"], ["outer_fold"], [F.lit(0)]))
    return full.select(F.col("speaker_id").alias("held_speaker"), F.col("outer_fold").alias("held_fold"), F.col("n").alias("test"), (whole - row - col + F.col("n")).alias("train"))


@register("training_rows", f"WITH {FOLDS} SELECT 'group' AS level, outer_fold, count(DISTINCT group_id) AS n FROM rec JOIN fold USING (group_id) GROUP BY outer_fold UNION ALL SELECT 'recording', outer_fold, count(*) FROM rec JOIN fold USING (group_id) GROUP BY outer_fold")
def training_rows(spark, d):
    rows = v.recordings(spark, d).join(folds(spark, d).select("group_id", "outer_fold"), "group_id")
    by = rows.groupBy("outer_fold").agg(F.count_distinct("group_id").alias("group"), F.count("*").alias("recording"))
    return by.unpivot("outer_fold", ["group", "recording"], "level", "n").select("level", "outer_fold", "n")


FOLD_F1 = FOLDS.replace(v.REC, v.ENS) + ", fm AS (" + f"SELECT condition, outer_fold, {_MACRO} AS m FROM (" + counts_sql("ens JOIN fold USING (group_id, label)", "condition, outer_fold") + "))"


@register("pooled_scores", f"WITH {FOLD_F1}, pooled AS (SELECT condition, {_MACRO} AS m FROM (" + counts_sql("ens JOIN fold USING (group_id, label)", "condition") + ")) SELECT condition, round(pooled.m, 9) AS pooled, round(avg(fm.m), 9) AS fold_mean, round(pooled.m - avg(fm.m), 9) AS difference FROM pooled JOIN fm USING (condition) GROUP BY condition, pooled.m")
def pooled_scores(spark, d):
    """Macro-F1 of all folds' predictions together against the mean of the folds' own, from one table of counts."""
    rows = v.ensemble(spark, d).join(folds(spark, d), ["group_id", "label"])
    per = rows.groupBy("condition", "outer_fold").agg(*metrics.confusion_counts())
    mean = per.select("condition", metrics.macro_f1().alias("m")).groupBy("condition").agg(F.avg("m").alias("mean"))
    whole = per.groupBy("condition").agg(*(F.sum(k).alias(k) for k in metrics.COUNTS)).select("condition", metrics.macro_f1().alias("pooled"))
    return whole.join(mean, "condition").select("condition", F.round("pooled", 9).alias("pooled"), F.round("mean", 9).alias("fold_mean"), F.round(F.col("pooled") - F.col("mean"), 9).alias("difference"))


@register("fold_mean_sd", f"WITH {FOLD_F1} SELECT condition, round(avg(m), 9) AS mean, round(stddev_samp(m), 9) AS sd FROM fm GROUP BY condition")
def fold_mean_sd(spark, d):
    rows = v.ensemble(spark, d).join(folds(spark, d), ["group_id", "label"])
    per = rows.groupBy("condition", "outer_fold").agg(*metrics.confusion_counts()).select("condition", metrics.macro_f1().alias("m"))
    return per.groupBy("condition").agg(F.round(F.avg("m"), 9).alias("mean"), F.round(F.stddev_samp("m"), 9).alias("sd"))


SEED_F1 = v.PRED + f", p AS (SELECT *, CAST(prob >= 0.5 AS INTEGER) AS predicted FROM pred), sm AS (SELECT condition, seed, {_MACRO} AS m FROM ({counts_sql('p', 'condition, seed')}))"


@register("seed_variability", f"WITH {SEED_F1} SELECT condition, round(avg(m), 9) AS mean, round(stddev_samp(m), 9) AS sd, round(avg(m) - (SELECT avg(m) FROM sm WHERE condition = 'C2'), 9) AS gap_to_gold FROM sm GROUP BY condition")
def seed_variability(spark, d):
    rows = v.predictions(spark, d).withColumn("predicted", (F.col("prob") >= 0.5).cast("int"))
    per = rows.groupBy("condition", "seed").agg(*metrics.confusion_counts()).select("condition", "seed", metrics.macro_f1().alias("m"))
    gold = per.where(F.col("condition") == "C2").agg(F.avg("m").alias("gold"))
    return per.groupBy("condition").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd")).crossJoin(F.broadcast(gold)).select("condition", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), F.round(F.col("mean") - F.col("gold"), 9).alias("gap_to_gold"))


PAIRS = [("asr_a_loss", "C2", "C3"), ("asr_b_loss", "C2", "C4"), ("adapt_a", "A1", "C3"), ("adapt_b", "A2", "C4"), ("fusion", "C5", "C2")]
ITERATIONS, BOOT_SEED = 10_000, 20260807
PERMUTATIONS = 1_000


def boot_sql(source: str, base: str) -> str:
    return base + f""", cnt AS ({counts_sql(source, 'group_id, condition')}), pos AS (SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS position FROM (SELECT DISTINCT group_id FROM cnt)), g AS (SELECT count(*) AS n FROM pos),
drw AS (SELECT iteration, {v.bucket_sql(f"concat_ws('|', '{BOOT_SEED}', CAST(iteration AS VARCHAR), CAST(slot AS VARCHAR))")} % n AS position FROM (SELECT unnest(range({ITERATIONS})) AS iteration, n FROM g) i, LATERAL (SELECT unnest(range(i.n)) AS slot)),
tms AS (SELECT iteration, position, count(*) AS times FROM drw GROUP BY ALL UNION ALL SELECT -1, position, 1 FROM pos),
sc AS (SELECT iteration, condition, {_MACRO} AS score FROM (SELECT iteration, condition, sum(times * tn) AS tn, sum(times * fp) AS fp, sum(times * fn) AS fn, sum(times * tp) AS tp FROM tms JOIN pos USING (position) JOIN cnt USING (group_id) GROUP BY ALL))"""


def diff_sql(pairs) -> str:
    one = " UNION ALL ".join(f"SELECT '{n}' AS comparison, iteration, a.score - b.score AS gap FROM sc a JOIN sc b USING (iteration) WHERE a.condition = '{x}' AND b.condition = '{y}'" for n, x, y in pairs)
    low, high = (f"round(quantile_cont(gap, {q}) FILTER (WHERE iteration >= 0), 9)" for q in (0.025, 0.975))
    return f"SELECT comparison, round(max(gap) FILTER (WHERE iteration = -1), 9) AS gap, {low} AS low, {high} AS high, {low} > 0 OR {high} < 0 AS excludes_zero FROM ({one}) GROUP BY comparison"


def boot(spark, d, rows=None):
    return resampling.bootstrap_scores(v.ensemble(spark, d) if rows is None else rows, "group_id", "condition", ITERATIONS, BOOT_SEED)


@register("cluster_bootstrap", f"WITH {boot_sql('ens', v.ENS)} {diff_sql(PAIRS)}")
def cluster_bootstrap(spark, d):
    return resampling.paired_differences(boot(spark, d), "condition", PAIRS)


_WIDE = "w AS (SELECT iteration, " + ", ".join(f"max(CASE WHEN condition = '{c}' THEN score END) AS {c}" for c in _CONDS) + " FROM sc GROUP BY iteration)"


def wide(spark, d):
    return boot(spark, d).groupBy("iteration").pivot("condition", _CONDS).agg(F.first("score"))


@register("gap_decomposition", f"WITH {boot_sql('ens', v.ENS)}, {_WIDE} SELECT 'asr_a' AS system, round(C2 - C3, 9) AS total, round(A1 - C3, 9) AS recovered, round((A1 - C3) / (C2 - C3), 9) AS fraction, round(C2 - A1, 9) AS residual FROM w WHERE iteration = -1 UNION ALL SELECT 'asr_b', round(C2 - C4, 9), round(A2 - C4, 9), round((A2 - C4) / (C2 - C4), 9), round(C2 - A2, 9) FROM w WHERE iteration = -1")
def gap_decomposition(spark, d):
    w = metrics.scored(v.ensemble(spark, d), ["condition"], 15).select(F.lit(1).alias("k"), "condition", "macro_f1").groupBy("k").pivot("condition", _CONDS).agg(F.first("macro_f1"))
    parts = [("asr_a", "C3", "A1"), ("asr_b", "C4", "A2")]
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("system"), F.round(F.col("C2") - F.col(b), 9).alias("total"), F.round(F.col(a) - F.col(b), 9).alias("recovered"), F.round((F.col(a) - F.col(b)) / (F.col("C2") - F.col(b)), 9).alias("fraction"), F.round(F.col("C2") - F.col(a), 9).alias("residual")) for s, b, a in parts)))
    return w.select(rows.alias("x")).select("x.*")


def _ci_sql(e, name):
    return f"SELECT '{name}' AS name, round(max(CASE WHEN iteration = -1 THEN {e} END), 9) AS value, round(quantile_cont({e}, 0.025) FILTER (WHERE iteration >= 0), 9) AS low, round(quantile_cont({e}, 0.975) FILTER (WHERE iteration >= 0), 9) AS high FROM w"


def _quotient(e):
    """The expression a / b, where b may be 0, as IEEE has it: ratios are neither clipped nor filtered."""
    a, b = e.rsplit(" / ", 1)
    return f"CASE WHEN {b} <> 0 THEN {e} WHEN {a} > 0 THEN double('Infinity') WHEN {a} < 0 THEN double('-Infinity') ELSE double('NaN') END"


def _ci(w, named):
    """A row for each of the named ratios, from one pass over the resamples."""
    long = w.select("iteration", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.expr(_quotient(e)).alias("e")) for n, e in named.items()))).alias("x")).select("iteration", "x.*")
    drawn = F.when(F.col("iteration") >= 0, F.col("e"))
    return long.groupBy("name").agg(F.round(F.max(F.when(F.col("iteration") == -1, F.col("e"))), 9).alias("value"), F.round(F.percentile(drawn, 0.025), 9).alias("low"), F.round(F.percentile(drawn, 0.975), 9).alias("high"))


_RATIOS = {"recovery_a": "(A1 - C3) / (C2 - C3)", "recovery_b": "(A2 - C4) / (C2 - C4)"}


@register("recovery_ratio_ci", f"WITH {boot_sql('ens', v.ENS)}, {_WIDE} " + " UNION ALL ".join(_ci_sql(e, n) for n, e in _RATIOS.items()))
def recovery_ratio_ci(spark, d):
    return _ci(wide(spark, d), _RATIOS)


@register("gap_reduction_ci", f"WITH {boot_sql('ens', v.ENS)}, {_WIDE} " + _ci_sql("((C2 - C3) - (C2 - A1)) / (C2 - C3)", "reduction"))
def gap_reduction_ci(spark, d):
    return _ci(wide(spark, d), {"reduction": "((C2 - C3) - (C2 - A1)) / (C2 - C3)"})


@register("robust_bootstrap", f"WITH {boot_sql('kept', v.ENS + ', crowd AS (SELECT group_id FROM rec GROUP BY group_id HAVING count(*) > 1), kept AS (SELECT * FROM ens ANTI JOIN crowd USING (group_id))')} {diff_sql(PAIRS)}")
def robust_bootstrap(spark, d):
    rows = v.ensemble(spark, d)
    crowd = v.recordings(spark, d).groupBy("group_id").count().where("count > 1").select("group_id")
    return resampling.paired_differences(boot(spark, d, rows.join(crowd, "group_id", "left_anti")), "condition", PAIRS)


@register("permutation_null", f"WITH {GROUPS}, st AS (SELECT group_id, label, count(*) AS n, avg(n_words) AS x FROM rec JOIN grp USING (group_id, label) GROUP BY ALL), pm AS (SELECT r.replicate, st.*, row_number() OVER (PARTITION BY r.replicate ORDER BY {v.bucket_sql('concat_ws(chr(124), 20260922, CAST(r.replicate AS VARCHAR), CAST(group_id AS VARCHAR))')}, group_id) AS k, sum(label) OVER (PARTITION BY r.replicate) AS ones FROM st CROSS JOIN (SELECT unnest(range({PERMUTATIONS})) AS replicate) r), stat AS (SELECT replicate, avg(CASE WHEN k <= ones THEN x END) - avg(CASE WHEN k > ones THEN x END) AS s FROM pm GROUP BY replicate), obs AS (SELECT avg(CASE WHEN label = 1 THEN x END) - avg(CASE WHEN label = 0 THEN x END) AS o FROM st) SELECT round(max(o), 6) AS observed, round(avg(s), 6) AS null_mean, round(stddev_samp(s), 6) AS null_sd, CAST(count(*) FILTER (WHERE s >= o) AS BIGINT) AS exceed, round((1 + count(*) FILTER (WHERE s >= o)) / CAST(1 + count(*) AS DOUBLE), 9) AS p FROM stat CROSS JOIN obs")
def permutation_null(spark, d):
    rows = v.recordings(spark, d).join(groups(spark, d), ["group_id", "label"])
    st = rows.groupBy("group_id", "label").agg(F.avg("n_words").alias("x"))
    dealt = resampling.permuted_labels(st.select("group_id", "label"), "group_id", "label", PERMUTATIONS, 20260922).join(st.select("group_id", "x"), "group_id")
    gap = lambda c: F.avg(F.when(F.col(c) == 1, F.col("x"))) - F.avg(F.when(F.col(c) == 0, F.col("x")))
    stat = dealt.groupBy("replicate").agg(gap("permuted").alias("s"))
    both = stat.crossJoin(F.broadcast(st.agg(gap("label").alias("o"))))
    exceed = F.count_if(F.col("s") >= F.col("o"))
    return both.agg(F.round(F.max("o"), 6).alias("observed"), F.round(F.avg("s"), 6).alias("null_mean"), F.round(F.stddev_samp("s"), 6).alias("null_sd"), exceed.alias("exceed"), F.round((1 + exceed) / (1 + F.count("*")), 9).alias("p"))


VAL = FOLDS.replace(v.REC, v.ENS) + ", val AS (SELECT condition, outer_fold, label, CAST(floor(round(prob, 9) * 1000) AS INTEGER) AS b FROM ens JOIN fold USING (group_id, label))"
_SWEEP = VAL + f", ths AS (SELECT CAST(unnest(range(1001)) AS INTEGER) AS t), hist AS (SELECT condition, outer_fold, b, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM val GROUP BY ALL), tot AS (SELECT condition, outer_fold, sum(pos) AS p, sum(neg) AS n FROM hist GROUP BY ALL), swp AS (SELECT condition, outer_fold, t, {_MACRO} AS f FROM (SELECT tot.condition, tot.outer_fold, t, coalesce(sum(pos), 0) AS tp, coalesce(sum(neg), 0) AS fp, p - coalesce(sum(pos), 0) AS fn, n - coalesce(sum(neg), 0) AS tn FROM tot CROSS JOIN ths LEFT JOIN hist ON hist.condition = tot.condition AND hist.outer_fold = tot.outer_fold AND b >= t GROUP BY tot.condition, tot.outer_fold, t, p, n)), best AS (SELECT condition, outer_fold, max(round(f, 12)) AS f FROM swp GROUP BY ALL), sel AS (SELECT s.condition, s.outer_fold, arg_min(t, abs(t - 500) * 10000 + t) AS t, count(*) AS ties, max(best.f) AS f FROM swp s JOIN best ON s.condition = best.condition AND s.outer_fold = best.outer_fold AND round(s.f, 12) = best.f GROUP BY ALL)"


def selected(spark, d):
    rows = v.ensemble(spark, d).join(folds(spark, d), ["group_id", "label"]).withColumn("prob", F.round("prob", 9))
    return selection.best_thresholds(rows, ["condition", "outer_fold"], "label", "prob")


@register("threshold_selection", f"WITH {_SWEEP} SELECT condition, outer_fold, t / CAST(1000 AS DOUBLE) AS threshold, ties, round(f, 9) AS macro_f1 FROM sel")
def threshold_selection(spark, d):
    return selected(spark, d).select("condition", "outer_fold", (F.col("t") / 1000).alias("threshold"), "ties", F.round("f", 9).alias("macro_f1"))


@register("threshold_table", f"WITH {_SWEEP} SELECT condition, string_agg(CAST(t AS VARCHAR), '/' ORDER BY outer_fold) AS thresholds, round(avg(f), 9) AS mean_f1 FROM sel GROUP BY condition")
def threshold_table(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("outer_fold", "t")))
    return selected(spark, d).groupBy("condition").agg(F.array_join(F.transform(ordered, lambda x: x["t"].cast("string")), "/").alias("thresholds"), F.round(F.avg("f"), 9).alias("mean_f1"))


@register("verdict_band", f"WITH {v.ENS}, c AS ({counts_sql('ens', 'condition')}) SELECT condition, CASE WHEN {_MACRO} >= 0.9 THEN 'strong' WHEN {_MACRO} >= 0.7 THEN 'usable' ELSE 'weak' END AS verdict FROM c")
def verdict_band(spark, d):
    per = v.ensemble(spark, d).groupBy("condition").agg(*metrics.confusion_counts())
    m = metrics.macro_f1()
    return per.select("condition", F.when(m >= 0.9, "strong").when(m >= 0.7, "usable").otherwise("weak").alias("verdict"))


@register("printed_numbers", f"WITH {v.ENS}, c AS ({counts_sql('ens', 'condition')}) SELECT 'macro_f1.' || condition AS key, printf('%.3f', round({_MACRO}, 3)) AS printed FROM c UNION ALL SELECT 'rate.' || condition, printf('%.1f%%', round(100.0 * (tp + fp) / CAST(tn + fp + fn + tp AS DOUBLE), 1)) FROM c")
def printed_numbers(spark, d):
    per = v.ensemble(spark, d).groupBy("condition").agg(*metrics.confusion_counts())
    rate = 100.0 * (F.col("tp") + F.col("fp")) / (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    a = per.select(F.concat(F.lit("macro_f1."), "condition").alias("key"), F.format_string("%.3f", F.round(metrics.macro_f1(), 3)).alias("printed"))
    return a.unionByName(per.select(F.concat(F.lit("rate."), "condition").alias("key"), F.format_string("%.1f%%", F.round(rate, 1)).alias("printed")))


# Transcripts.


@register("edit_ops", f"WITH RECURSIVE {v.OPS} SELECT utterance_id, system, CAST(substitutions AS INTEGER) AS substitutions, CAST(deletions AS INTEGER) AS deletions, CAST(insertions AS INTEGER) AS insertions FROM ops")
def edit_ops(spark, d):
    rows = v.hypotheses(spark, d)
    return rows.select("utterance_id", "system", text.edit_operations("gold", "hyp").alias("e")).select("utterance_id", "system", "e.*")


@register("edit_distance", f"WITH {v.ASR} SELECT utterance_id, system, errors FROM asr")
def edit_distance(spark, d):
    return v.asr_errors(spark, d).select("utterance_id", "system", "errors")


@register("utterance_wer", f"WITH {v.ASR} SELECT utterance_id, system, n_ref, n_hyp, errors, round(errors / CAST(greatest(n_ref, 1) AS DOUBLE), 9) AS wer, n_hyp = 0 AS is_empty FROM asr")
def utterance_wer(spark, d):
    return asr.utterance_rates(v.asr_errors(spark, d)).select("utterance_id", "system", "n_ref", "n_hyp", "errors", F.round("wer", 9).alias("wer"), "is_empty")


@register("corpus_rates", f"WITH {v.ASR} SELECT system, coalesce(speaker_id, 'all') AS speaker_id, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(n_ref) AS BIGINT) AS n_ref, round(sum(errors) / sum(n_ref), 9) AS wer, count(*) FILTER (WHERE errors = 0) AS exact, quantile_cont(errors / CAST(greatest(n_ref, 1) AS DOUBLE), 0.5) AS median_wer FROM asr GROUP BY GROUPING SETS ((system, speaker_id), (system))")
def corpus_rates(spark, d):
    return asr.corpus_rates(asr.utterance_rates(v.asr_errors(spark, d)), "system", "speaker_id")


@register("utterance_cer", f"WITH {v.CER} SELECT utterance_id, system, n_chars, char_errors, round(char_errors / CAST(greatest(n_chars, 1) AS DOUBLE), 9) AS cer FROM cer")
def utterance_cer(spark, d):
    return v.char_errors(spark, d).select("utterance_id", "system", "n_chars", "char_errors", F.round(F.col("char_errors") / F.greatest("n_chars", F.lit(1)), 9).alias("cer"))


@register("corpus_cer", f"WITH {v.CER} SELECT system, coalesce(speaker_id, 'all') AS speaker_id, CAST(sum(char_errors) AS BIGINT) AS char_errors, CAST(sum(n_chars) AS BIGINT) AS n_chars, round(sum(char_errors) / sum(n_chars), 9) AS cer FROM cer GROUP BY GROUPING SETS ((system, speaker_id), (system))")
def corpus_cer(spark, d):
    return asr.corpus_char_rates(v.char_errors(spark, d), "system", "speaker_id")


@register("cer_class_gap", f"WITH {v.CER}, c AS (SELECT system, label, sum(char_errors) / sum(n_chars) AS cer FROM cer GROUP BY ALL) SELECT system, round(max(CASE WHEN label = 1 THEN cer END), 9) AS positive, round(max(CASE WHEN label = 0 THEN cer END), 9) AS negative, round(max(CASE WHEN label = 1 THEN cer END) - max(CASE WHEN label = 0 THEN cer END), 9) AS gap, abs(max(CASE WHEN label = 1 THEN cer END) - max(CASE WHEN label = 0 THEN cer END)) >= 0.05 AS clear FROM c GROUP BY system")
def cer_class_gap(spark, d):
    return asr.class_gap(v.char_errors(spark, d).withColumnsRenamed({"char_errors": "errors", "n_chars": "n_ref"}))


@register("operation_rates", f"WITH RECURSIVE {v.OPS} SELECT system, " + ", ".join(f"round(sum({k}) / sum(n), 9) AS {k}" for k in ("substitutions", "deletions", "insertions")) + " FROM ops GROUP BY system")
def operation_rates(spark, d):
    """Substitutions, deletions and insertions for each system over its reference words."""
    e = v.hypotheses(spark, d).select("system", F.size("gold").alias("n"), text.edit_operations("gold", "hyp").alias("e"))
    return e.groupBy("system").agg(*(F.round(F.sum(f"e.{k}") / F.sum("n"), 9).alias(k) for k in ("substitutions", "deletions", "insertions")))


@register("asr_score", f"WITH {v.ASR} SELECT system, round(sum(errors) / sum(n_ref), 9) AS wer, round(avg(CASE WHEN n_hyp = 0 THEN 1.0 ELSE 0.0 END), 9) AS empty_rate, round(avg(CASE WHEN regexp_matches(array_to_string(hyp, ' '), '[A-Za-z]') THEN 1.0 ELSE 0.0 END), 9) AS latin_rate FROM asr GROUP BY system")
def asr_score(spark, d):
    return asr.score(v.asr_errors(spark, d), ["system"])


@register("class_gap", f"WITH {v.ASR}, c AS (SELECT system, label, sum(errors) / sum(n_ref) AS wer FROM asr GROUP BY ALL) SELECT system, round(max(CASE WHEN label = 1 THEN wer END), 9) AS positive, round(max(CASE WHEN label = 0 THEN wer END), 9) AS negative, round(max(CASE WHEN label = 1 THEN wer END) - max(CASE WHEN label = 0 THEN wer END), 9) AS gap, abs(max(CASE WHEN label = 1 THEN wer END) - max(CASE WHEN label = 0 THEN wer END)) >= 0.05 AS clear FROM c GROUP BY system")
def class_gap(spark, d):
    return asr.class_gap(v.asr_errors(spark, d))


#: Words that a decoder may give at most in the audits; a row at it, or one short of it, is capped.
CAP = 24


@register("decoding_audit")
def decoding_audit(spark, d):
    """By system, rows flagged for loops or strong compression, what insertions they hold, caps and the truncation rule."""
    return asr.decoding_audit(kept(asr.decoding_facts(v.asr_errors(spark, d), cap=CAP), "decoding"))


_DEC = f"dec AS (SELECT system, n AS n_ref, m AS n_hyp, insertions, list_has_any([true], [{v.LOOP.replace('len(w)', 'len(hyp)').replace('w[', 'hyp[')}]) AS flagged, hyp, m / CAST(greatest(n, 1) AS DOUBLE) AS ratio FROM ops)"
_SHARE = "round(coalesce({0} / CAST(nullif({1}, 0) AS DOUBLE), 0), 9)"


@register(
    "decoding_loops",
    f"WITH RECURSIVE {v.OPS}, {_DEC} SELECT system, count(*) AS n, count(*) FILTER (WHERE flagged) AS loops, CAST(0 AS BIGINT) AS compressible, count(*) FILTER (WHERE flagged) AS flagged, count(*) FILTER (WHERE n_hyp > 1.5 * n_ref) AS long, "
    f"count(*) FILTER (WHERE regexp_matches(array_to_string(hyp, ' '), '[A-Za-z]')) AS latin, count(*) FILTER (WHERE n_hyp = 0) AS empty, count(*) FILTER (WHERE n_hyp >= {CAP - 1}) AS capped, "
    f"{_SHARE.format('sum(insertions)', 'sum(n_ref)')} AS insertion_rate, {_SHARE.format('sum(insertions) FILTER (WHERE NOT flagged)', 'sum(n_ref) FILTER (WHERE NOT flagged)')} AS unflagged_insertion_rate, "
    f"{_SHARE.format('coalesce(sum(insertions) FILTER (WHERE flagged), 0)', 'greatest(sum(insertions), 1)')} AS flagged_insertion_share, "
    + ", ".join(f"round(quantile_cont(ratio, {q}), 9) AS ratio_p{round(100 * q)}" for q in (0.5, 0.9, 0.99, 1.0))
    + f", count(*) FILTER (WHERE n_hyp >= {CAP - 1}) >= 0.01 * count(*) AS truncation_defect FROM dec GROUP BY system",
)
def decoding_loops(spark, d):
    """The decoding audit by loops alone, which other engines can repeat."""
    return asr.decoding_audit(kept(asr.decoding_facts(v.asr_errors(spark, d), compressed=None, cap=CAP), "decoding"))


@register("same_sample_rescore", f"WITH {v.ASR}, pick AS (SELECT utterance_id FROM (SELECT utterance_id, row_number() OVER (PARTITION BY speaker_id ORDER BY {v.bucket_sql('concat_ws(chr(124), 5, utterance_id)')}, utterance_id) AS k FROM sent) WHERE k <= 100) SELECT system, count(*) AS n, round(sum(errors) / sum(n_ref), 9) AS wer FROM asr SEMI JOIN pick USING (utterance_id) GROUP BY system")
def same_sample_rescore(spark, d):
    pick = windows.stratified_sample(v.sentences(spark, d).select("utterance_id", "speaker_id"), "speaker_id", "utterance_id", 100, 5).select("utterance_id")
    return v.asr_errors(spark, d).join(pick, "utterance_id", "left_semi").groupBy("system").agg(F.count("*").alias("n"), F.round(F.sum("errors") / F.sum("n_ref"), 9).alias("wer"))


_WER = "errors / CAST(greatest(n_ref, 1) AS DOUBLE)"


@register("wer_bins", f"WITH {v.ASR}, q AS (SELECT system, quantile_cont({_WER}, CAST(1 AS DOUBLE) / 3) AS e1, quantile_cont({_WER}, CAST(2 AS DOUBLE) / 3) AS e2 FROM asr WHERE errors > 0 GROUP BY system) SELECT system, CASE WHEN errors = 0 THEN 'zero' WHEN {_WER} <= e1 THEN 'low' WHEN {_WER} <= e2 THEN 'middle' ELSE 'high' END AS bin, count(*) AS n, round(avg(label), 9) AS positive_rate FROM asr LEFT JOIN q USING (system) GROUP BY ALL")
def wer_bins(spark, d):
    rows = kept(asr.utterance_rates(v.asr_errors(spark, d)).select("system", "label", "errors", "wer"), "rates")
    return asr.tertile_bins(rows).groupBy("system", "bin").agg(F.count("*").alias("n"), F.round(F.avg("label"), 9).alias("positive_rate"))


@register("speaker_table", f"WITH {v.ASR} SELECT speaker_id, round(sum(errors) FILTER (WHERE system = 'asr_a') / sum(n_ref) FILTER (WHERE system = 'asr_a'), 9) AS asr_a, round(sum(errors) FILTER (WHERE system = 'asr_b') / sum(n_ref) FILTER (WHERE system = 'asr_b'), 9) AS asr_b FROM asr GROUP BY speaker_id")
def speaker_table(spark, d):
    return v.asr_errors(spark, d).groupBy("speaker_id").pivot("system", list(v.SYSTEMS)).agg(F.round(F.sum("errors") / F.sum("n_ref"), 9))


@register("edit_description")
def edit_description(spark, d):
    return v.hypotheses(spark, d).select("utterance_id", "system", text.described_edits("gold", "hyp").alias("x")).select("utterance_id", "system", "x.edits")


@register("flip_signals")
def flip_signals(spark, d):
    return v.hypotheses(spark, d).select("utterance_id", "system", text.described_edits("gold", "hyp").alias("x")).select("utterance_id", "system", "x.signals")


@register("sentiment_flips", f"WITH {v.ENS} SELECT utterance_id, a.label, round(a.prob, 9) AS gold_prob, round(b.prob, 9) AS asr_prob, b.condition FROM ens a JOIN ens b USING (utterance_id) WHERE a.condition = 'C2' AND b.condition IN ('C3', 'C4') AND a.predicted = a.label AND b.predicted <> b.label")
def sentiment_flips(spark, d):
    e = v.ensemble(spark, d)
    gold = e.where((F.col("condition") == "C2") & (F.col("predicted") == F.col("label"))).select("utterance_id", "label", F.round("prob", 9).alias("gold_prob"))
    wrong = e.where(F.col("condition").isin("C3", "C4") & (F.col("predicted") != F.col("label"))).select("utterance_id", "condition", F.round("prob", 9).alias("asr_prob"))
    return gold.join(wrong, "utterance_id").select("utterance_id", "label", "gold_prob", "asr_prob", "condition")


# Audit.

_NEAR_TOKENS = v.REC + ", near0 AS (SELECT utterance_id AS id, label, list_distinct(words) AS words FROM rec0), tok AS (SELECT id, label, len(words) AS n, unnest(words) AS w FROM near0), inter AS (SELECT x.id AS a, y.id AS b, x.n + y.n AS nn, x.label AS la, y.label AS lb, count(*) AS k FROM tok x JOIN tok y ON x.w = y.w AND x.id < y.id GROUP BY ALL), near AS (SELECT a, b, k / CAST(nn - k AS DOUBLE) AS j, la = lb AS same_label FROM inter WHERE k / CAST(nn - k AS DOUBLE) >= 0.5)"


def near_pairs(spark, d):
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-zà-ÿ0-9]+"), F.lit(0))
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), words.alias("words"))
    near = joins.jaccard_pairs(rows, "id", "words", 0.5)
    a, b = rows.select(F.col("id").alias("a"), F.col("label").alias("la")), rows.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    return near.join(a, "a").join(b, "b").select("a", "b", "jaccard", (F.col("la") == F.col("lb")).alias("same_label"))


@register("near_dup_jaccard", f"WITH {_NEAR_TOKENS} SELECT a, b, round(j, 4) AS jaccard, same_label FROM near")
def near_dup_jaccard(spark, d):
    return near_pairs(spark, d).select("a", "b", F.round("jaccard", 4).alias("jaccard"), "same_label")


@register("near_dup_summary", f"WITH {_NEAR_TOKENS} SELECT count(*) AS at_half, count(*) FILTER (WHERE round(j, 4) >= 0.7) AS at_seventy, count(*) FILTER (WHERE NOT same_label) AS other_label FROM near")
def near_dup_summary(spark, d):
    return near_pairs(spark, d).agg(F.count("*").alias("at_half"), F.count_if(F.round("jaccard", 4) >= 0.7).alias("at_seventy"), F.count_if(~F.col("same_label")).alias("other_label"))


_MANIFEST = v.REC + ", fh AS (SELECT doc_id AS utterance_id, md5(coalesce(text, '')) AS file_hash FROM documents), amb AS (SELECT file_hash FROM fh JOIN rec USING (utterance_id) GROUP BY file_hash HAVING count(DISTINCT speaker_id) > 1), man AS (SELECT rec.*, file_hash FROM rec JOIN fh USING (utterance_id) WHERE file_hash NOT IN (SELECT file_hash FROM amb)), man2 AS (SELECT *, min(utterance_id) OVER (PARTITION BY token_key) AS sentence_group_id FROM man)"


def manifest(spark, d):
    hashed = table(spark, d, "documents").select(F.col("doc_id").alias("utterance_id"), F.md5(F.coalesce("text", F.lit(""))).alias("file_hash"))
    rows = v.recordings(spark, d).join(hashed, "utterance_id")
    ambiguous = rows.groupBy("file_hash").agg(F.count_distinct("speaker_id").alias("k")).where("k > 1").select("file_hash")
    return v.grouped(rows.join(ambiguous, "file_hash", "left_anti"), "token_key", "utterance_id", "sentence_group_id")


@register("build_manifest", f"WITH {_MANIFEST} SELECT utterance_id, speaker_id, label, sentence_group_id, file_hash FROM man2")
def build_manifest(spark, d):
    return manifest(spark, d).select("utterance_id", "speaker_id", "label", "sentence_group_id", "file_hash")


@register("audit_summary", f"WITH {_MANIFEST} SELECT (SELECT count(*) FROM rec) AS recordings, (SELECT count(*) FROM man2) AS kept, (SELECT count(DISTINCT sentence_group_id) FROM man2) AS groups, (SELECT count(DISTINCT speaker_id) FROM man2) AS speakers, (SELECT count(*) FILTER (WHERE label = 1) FROM man2) AS positive, (SELECT count(*) - count(DISTINCT file_hash) FROM man2) AS surplus, (SELECT CAST(sum(n_words) AS BIGINT) FROM man2) AS words")
def audit_summary(spark, d):
    m = manifest(spark, d).agg(F.count("*").alias("kept"), F.count_distinct("sentence_group_id").alias("groups"), F.count_distinct("speaker_id").alias("speakers"), F.count_if(F.col("label") == 1).alias("positive"), (F.count("*") - F.count_distinct("file_hash")).alias("surplus"), F.sum("n_words").alias("words"))
    return v.recordings(spark, d).agg(F.count("*").alias("recordings")).crossJoin(m)


