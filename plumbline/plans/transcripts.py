"""Predictions on recognised speech beside its word errors: accuracy by bins of errors and by speaker, flips with their edits, printed intervals, one head on several sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical, numeric, text
from ..operators import asr, holdout, many_models, metrics
from ..sources.writers import dropped, kept
from . import evaluation as ev
from . import features, inference
from . import views as v
from .registry import ORACLES, register
from .views import table

_HEARD = f"""wr AS (SELECT *, errors / CAST(greatest(n_ref, 1) AS DOUBLE) AS wer FROM asr),
said AS (SELECT *, round(CAST(0.5 AS DOUBLE) + (label - CAST(0.5 AS DOUBLE)) * CAST(0.7 AS DOUBLE) + ({v.bucket_sql("concat_ws('|', utterance_id, 'gold')")} / CAST(4294967296 AS DOUBLE) - CAST(0.5 AS DOUBLE)) * CAST(0.6 AS DOUBLE), 9) AS gold_prob,
round(CAST(0.5 AS DOUBLE) + (label - CAST(0.5 AS DOUBLE)) * CAST(0.7 AS DOUBLE) * (1 - least(wer, 1)) + ({v.bucket_sql("concat_ws('|', utterance_id, system)")} / CAST(4294967296 AS DOUBLE) - CAST(0.5 AS DOUBLE)) * CAST(0.6 AS DOUBLE), 9) AS asr_prob FROM wr),
called AS (SELECT *, CAST(gold_prob >= 0.5 AS INTEGER) AS gold_predicted, CAST(asr_prob >= 0.5 AS INTEGER) AS predicted FROM said)"""


def called(spark, d):
    """By utterance and system: rates, texts, and what a head says of the gold and of the recognised text, the latter the nearer to a guess the more words are wrong."""
    rows = asr.utterance_rates(v.asr_errors(spark, d))
    noise = lambda name: (numeric.hash_uniform(F.concat_ws("|", "utterance_id", name)) - 0.5) * 0.6
    way = (F.col("label") - 0.5) * 0.7
    said = rows.withColumn("gold_prob", F.round(0.5 + way + noise(F.lit("gold")), 9)).withColumn("asr_prob", F.round(0.5 + way * (1 - F.least("wer", F.lit(1))) + noise(F.col("system")), 9))
    return said.withColumn("gold_predicted", (F.col("gold_prob") >= 0.5).cast("int")).withColumn("predicted", (F.col("asr_prob") >= 0.5).cast("int"))


_RIGHT = "round(avg(CASE WHEN {0} = label THEN 1.0 ELSE 0.0 END), 9)"
_BIN = "CASE WHEN errors = 0 THEN 'zero' WHEN wer <= e1 THEN 'low' WHEN wer <= e2 THEN 'middle' ELSE 'high' END"


@register(
    "wer_bin_accuracy",
    f"WITH {v.ASR}, {_HEARD}, q AS (SELECT system, quantile_cont(wer, CAST(1 AS DOUBLE) / 3) AS e1, quantile_cont(wer, CAST(2 AS DOUBLE) / 3) AS e2 FROM wr WHERE errors > 0 GROUP BY system), b AS (SELECT called.*, {_BIN} AS bin FROM called LEFT JOIN q USING (system)), "
    f"c AS ({ev.counts_sql('b', 'system, bin')}) SELECT system, bin, n, range, accuracy, gold_accuracy, round({ev._MACRO}, 9) AS macro_f1 FROM c JOIN (SELECT system, bin, count(*) AS n, printf('%.3f-%.3f', min(wer), max(wer)) AS range, {_RIGHT.format('predicted')} AS accuracy, {_RIGHT.format('gold_predicted')} AS gold_accuracy FROM b GROUP BY ALL) USING (system, bin)",
)
def wer_bin_accuracy(spark, d):
    """By system and bin of word errors: rows, the bin's printed range, accuracy of the gold and of the recognised text, macro-F1."""
    rows = asr.tertile_bins(kept(called(spark, d).drop("gold", "hyp"), "called"))
    right = lambda c: F.round(F.avg((F.col(c) == F.col("label")).cast("double")), 9)
    per = rows.groupBy("system", "bin").agg(*metrics.confusion_counts(), F.count("*").alias("n"), F.format_string("%.3f-%.3f", F.min("wer"), F.max("wer")).alias("range"), right("predicted").alias("accuracy"), right("gold_predicted").alias("gold_accuracy"))
    return per.select("system", "bin", "n", "range", "accuracy", "gold_accuracy", F.round(metrics.macro_f1(), 9).alias("macro_f1"))


@register("speaker_accuracy", f"WITH {v.ASR}, {_HEARD} SELECT coalesce(speaker_id, 'all') AS speaker_id, system, count(*) AS n, round(sum(errors) / sum(n_ref), 9) AS wer, {_RIGHT.format('predicted')} AS accuracy, {_RIGHT.format('gold_predicted')} AS gold_accuracy, round(avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN gold_predicted = label THEN 1.0 ELSE 0.0 END), 9) AS change FROM called GROUP BY GROUPING SETS ((speaker_id, system), (system))")
def speaker_accuracy(spark, d):
    """By speaker and system, and by system for all: word error rate, accuracy of both texts and its change."""
    right = lambda c: F.avg((F.col(c) == F.col("label")).cast("double"))
    both = called(spark, d).groupingSets([["speaker_id", "system"], ["system"]], "speaker_id", "system").agg(
        F.count("*").alias("n"), F.round(F.sum("errors") / F.sum("n_ref"), 9).alias("wer"), F.round(right("predicted"), 9).alias("accuracy"), F.round(right("gold_predicted"), 9).alias("gold_accuracy"), F.round(right("predicted") - right("gold_predicted"), 9).alias("change")
    )
    return both.withColumn("speaker_id", F.coalesce("speaker_id", F.lit("all")))


@register("flip_table", f"WITH RECURSIVE {v.OPS}, {v.ASR[len(v.HYP) + 2 :]}, {_HEARD} SELECT utterance_id, system, label, array_to_string(called.gold, ' ') AS gold_text, array_to_string(called.hyp, ' ') AS hyp_text, gold_prob, asr_prob, round(wer, 9) AS wer, CAST(substitutions AS INTEGER) AS substitutions, CAST(deletions AS INTEGER) AS deletions, CAST(insertions AS INTEGER) AS insertions, array_to_string(list_sort(list_filter(list_distinct(called.gold), lambda t: NOT list_contains(called.hyp, t))), ' ') AS lost, array_to_string(list_sort(list_filter(list_distinct(called.hyp), lambda t: NOT list_contains(called.gold, t))), ' ') AS gained FROM called JOIN ops USING (utterance_id, system) WHERE gold_predicted = label AND predicted <> label")
def flip_table(spark, d):
    """Utterances that the gold text gets right and the recognised one wrong: both texts, rates, probabilities, edit counts, and the words that were lost and gained."""
    rows = called(spark, d).where((F.col("gold_predicted") == F.col("label")) & (F.col("predicted") != F.col("label")))
    told = rows.withColumn("e", text.edit_operations("gold", "hyp"))
    less = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), " ")
    return told.select("utterance_id", "system", "label", F.array_join("gold", " ").alias("gold_text"), F.array_join("hyp", " ").alias("hyp_text"), "gold_prob", "asr_prob", F.round("wer", 9).alias("wer"), "e.*", less("gold", "hyp").alias("lost"), less("hyp", "gold").alias("gained"))


_TRIPLE = " || '/' || ".join(f"printf('%.3f', max(round(m, 3)) FILTER (WHERE seed = {s}))" for s in v.SEEDS)


@register("printed_seed_triples", f"WITH {ev.SEED_F1} SELECT 'seeds.' || condition AS key, {_TRIPLE} AS printed FROM sm GROUP BY condition")
def printed_seed_triples(spark, d):
    """Each condition's scores of all seeds as they are printed, in the seeds' order."""
    rows = v.predictions(spark, d).withColumn("predicted", (F.col("prob") >= 0.5).cast("int"))
    per = rows.groupBy("condition", "seed").agg(*metrics.confusion_counts()).select("condition", "seed", F.round(metrics.macro_f1(), 3).alias("m"))
    each = [F.format_string("%.3f", F.max(F.when(F.col("seed") == s, F.col("m")))) for s in v.SEEDS]
    return per.groupBy("condition").agg(F.concat_ws("/", *each).alias("printed")).select(F.concat(F.lit("seeds."), "condition").alias("key"), "printed")


@register("printed_intervals", f"WITH t AS ({ORACLES['interval_table']}) SELECT kind || '.' || quantity AS key, printf('%.3f [%.3f, %.3f]', round(observed, 3), round(low, 3), round(high, 3)) || CASE WHEN post_hoc THEN ' (post hoc)' ELSE '' END AS printed FROM t")
def printed_intervals(spark, d):
    """Every quantity of the table of intervals as it is printed."""
    t = inference.interval_table(spark, d)
    shown = F.format_string("%.3f [%.3f, %.3f]", *(F.round(c, 3) for c in ("observed", "low", "high")))
    return t.select(F.concat_ws(".", "kind", "quantity").alias("key"), F.concat(shown, F.when(F.col("post_hoc"), " (post hoc)").otherwise("")).alias("printed"))


@register("embedding_checks", "WITH x AS (SELECT vec_id, len(embedding) AS d, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS s FROM embeddings) SELECT count(*) AS vectors, count(DISTINCT vec_id) AS ids, min(d) AS least_width, max(d) AS most_width, count(*) FILTER (WHERE NOT coalesce(isfinite(s), false)) AS not_finite, count(*) FILTER (WHERE sqrt(s) < 1e-9) AS zero_norm FROM x")
def embedding_checks(spark, d):
    """Counts that an encoder's output must pass: one width, one row an id, no vector that isn't finite or has norm zero."""
    s = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("d"), s.alias("s"))
    finite = F.coalesce(~F.isnan("s") & (F.col("s") < float("inf")), F.lit(False))
    return rows.agg(F.count("*").alias("vectors"), F.count_distinct("vec_id").alias("ids"), F.min("d").alias("least_width"), F.max("d").alias("most_width"), F.count_if(~finite).alias("not_finite"), F.count_if(finite & (F.sqrt("s") < 1e-9)).alias("zero_norm"))


@register("epoch_times", "SELECT event_id, strftime(to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at, CAST(CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS BIGINT) AS day FROM events")
def epoch_times(spark, d):
    """Times kept as seconds since 1970, made into timestamps again, and their day numbers."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss").alias("at"), F.floor(seconds / 86400).alias("day"))


@register("head_on_sources")
def head_on_sources(spark, d):
    """Heads trained once for each fold on the given texts and used on several sources of the test rows: the texts, their canonical spelling, and each text with its words reversed in spelling.

    By source: pooled macro-F1, mean of the folds' and accuracy. A source is features of the same rows, so nothing is fitted again."""
    place = ev.folds(spark, d).select(F.col("group_id").alias("key"), "outer_fold")
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-zà-ÿ0-9]+"), F.lit(0))
    sources = {"gold": words, "canonical": F.transform(words, lambda w: canonical.replaced(w, features.MAPPING)), "garbled": F.transform(words, F.reverse)}
    design, fits, out = holdout.Holdout(0, 5), None, []
    for name, spoken in sources.items():
        rows, width = inference.content_rows(spark, d, spoken)
        rows = kept(rows.join(place, "key").withColumns({"speaker": F.lit(0), "fold": F.col("outer_fold")}), f"source-{name}")
        fits = fits or many_models.fit(rows, width, design)
        counts = many_models.tested_counts(rows, fits, design)
        dropped(rows)
        f1 = many_models.macro_f1
        total = counts.sum(0)
        out.append((name, int(total.sum()), round(float(f1(total)), 9), round(float(f1(counts).mean()), 9), round(float((total[0] + total[3]) / max(1, total.sum())), 9)))
    return spark.createDataFrame(out, "source string, n bigint, pooled double, fold_mean double, accuracy double")


@register("pooled_acquisition")
def pooled_acquisition(spark, d):
    """Pooled macro-F1 of the acquisition classifier's out-of-fold predictions, the mean of its folds', and their difference."""
    rows, width = inference.acquisition_rows(spark, d)
    place = ev.folds(spark, d).select(F.col("group_id").alias("key"), "outer_fold")
    rows = kept(rows.join(place, "key").withColumns({"speaker": F.lit(0), "fold": F.col("outer_fold")}), "acquisition-folds")
    design = holdout.Holdout(0, 5)
    counts = many_models.tested_counts(rows, many_models.fit(rows, width, design), design)
    dropped(rows)
    pooled, mean = float(many_models.macro_f1(counts.sum(0))), float(many_models.macro_f1(counts).mean())
    return spark.createDataFrame([(int(counts.sum()), round(pooled, 9), round(mean, 9), round(pooled - mean, 9))], "n bigint, pooled double, fold_mean double, difference double")
