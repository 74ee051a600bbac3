"""The corpus audit in full, and published numbers against a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, checks, metrics, quantiles
from ..sources.writers import kept
from . import evaluation as ev
from . import views as v
from .registry import register
from .views import table

#: Words below which a text is short.
SHORT = 8

_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-zà-ÿ0-9]+')"
_AUD = f"""aud0 AS (SELECT doc_id AS utterance_id, source AS speaker_id, lang, quality AS label, md5(coalesce(text, '')) AS file_hash, text IS NULL AS missing, {_WORDS} AS words, regexp_matches(lower(coalesce(text, '')), '[a-zà-ÿ]') AS letters FROM documents LEFT JOIN labels USING (doc_id)),
aud1 AS (SELECT *, CAST(len(words) AS BIGINT) AS n_words, md5(array_to_string(list_sort(words), ' ')) AS token_key FROM aud0),
hsh AS (SELECT file_hash, count(*) AS copies, count(DISTINCT speaker_id) AS of_speakers FROM aud1 GROUP BY file_hash),
grp_ AS (SELECT token_key, min(utterance_id) AS sentence_group_id, count(DISTINCT label) AS of_labels FROM aud1 GROUP BY token_key),
aud AS (SELECT aud1.*, copies, of_speakers, sentence_group_id, of_labels FROM aud1 JOIN hsh USING (file_hash) JOIN grp_ USING (token_key)),
kpt AS (SELECT * FROM aud WHERE label IS NOT NULL AND of_speakers = 1)"""
_PLAIN = {
    "texts": "SELECT count(*) FROM aud",
    "labelled": "SELECT count(label) FROM aud",
    "missing_texts": "SELECT count(*) FILTER (WHERE missing) FROM aud",
    "empty_texts": "SELECT count(*) FILTER (WHERE n_words = 0) FROM aud",
    "short_texts": f"SELECT count(*) FILTER (WHERE n_words > 0 AND n_words < {SHORT}) FROM aud",
    "texts_without_letters": "SELECT count(*) FILTER (WHERE NOT letters) FROM aud",
    "ambiguous_copies": "SELECT count(*) FILTER (WHERE of_speakers > 1) FROM aud",
    "rows_in_label_conflicts": "SELECT count(*) FILTER (WHERE of_labels > 1) FROM aud",
    "positive": "SELECT count(*) FILTER (WHERE label = 1) FROM aud",
    "negative": "SELECT count(*) FILTER (WHERE label = 0) FROM aud",
    "kept": "SELECT count(*) FROM kpt",
    "words_kept": "SELECT sum(n_words) FROM kpt",
    "least_words": "SELECT min(n_words) FROM kpt",
    "most_words": "SELECT max(n_words) FROM kpt",
    "unique_ids": "SELECT count(DISTINCT utterance_id) FROM aud",
    "hashes_of_several_texts": "SELECT count(*) FILTER (WHERE copies > 1) FROM hsh",
    "redundant_copies": "SELECT sum(copies - 1) FROM hsh",
    "groups": "SELECT count(*) FROM grp_",
    "groups_with_label_conflicts": "SELECT count(*) FILTER (WHERE of_labels > 1) FROM grp_",
    "texts_of_repeated_words": "SELECT count(*) - (SELECT count(*) FROM grp_) FROM aud",
    "speakers": "SELECT count(DISTINCT speaker_id) FROM aud",
    "groups_kept": "SELECT count(DISTINCT sentence_group_id) FROM kpt",
    "p05_words": "SELECT round(quantile_cont(n_words, 0.05), 6) FROM kpt",
    "median_words": "SELECT round(quantile_cont(n_words, 0.5), 6) FROM kpt",
    "p95_words": "SELECT round(quantile_cont(n_words, 0.95), 6) FROM kpt",
}


def audited(spark, d):
    """Every document with its label, if any, and what the audit asks of it; copies and groups are counted by aggregates that a join brings back, so a hot text is split."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-zà-ÿ0-9]+"), F.lit(0))
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left")
    rows = rows.select(
        F.col("doc_id").alias("utterance_id"), F.col("source").alias("speaker_id"), "lang", "label", F.md5(F.coalesce("text", F.lit(""))).alias("file_hash"), F.col("text").isNull().alias("missing"),
        F.size(words).cast("long").alias("n_words"), F.md5(F.array_join(F.array_sort(words), " ")).alias("token_key"), F.lower(F.coalesce("text", F.lit(""))).rlike("[a-zà-ÿ]").alias("letters"),
    )
    rows = kept(rows, "audited")
    copies = rows.groupBy("file_hash").agg(F.count("*").alias("copies"), F.count_distinct("speaker_id").alias("of_speakers"))
    groups = rows.groupBy("token_key").agg(F.min("utterance_id").alias("sentence_group_id"), F.count_distinct("label").alias("of_labels"))
    return rows, copies, groups, rows.join(copies, "file_hash").join(groups, "token_key")


def _usable():
    return F.col("label").isNotNull() & (F.col("of_speakers") == 1)


@register(
    "audit_facts",
    f"WITH {_AUD} " + " UNION ALL ".join(f"SELECT '{k}' AS fact, '' AS key, CAST(({q}) AS DOUBLE) AS value" for k, q in _PLAIN.items())
    + " UNION ALL SELECT 'texts_by_speaker', coalesce(speaker_id, ''), CAST(count(*) AS DOUBLE) FROM aud GROUP BY speaker_id UNION ALL SELECT 'kept_by_speaker', coalesce(speaker_id, ''), CAST(count(*) AS DOUBLE) FROM kpt GROUP BY speaker_id"
    + " UNION ALL SELECT 'texts_by_language', coalesce(lang, ''), CAST(count(*) AS DOUBLE) FROM aud GROUP BY lang UNION ALL SELECT 'groups_by_size', CAST(k AS VARCHAR), CAST(count(*) AS DOUBLE) FROM (SELECT count(*) AS k FROM aud GROUP BY token_key) GROUP BY k",
)
def audit_facts(spark, d):
    """(fact, key, value): some 25 single facts and four tables of counts. Plain counts are observed while the manifest is written; only what needs distinct keys or ranks reads it again."""
    rows, copies, groups, whole = audited(spark, d)
    usable = _usable()
    n = lambda c: F.count_if(c)
    plain = {
        "texts": F.count("*"), "labelled": F.count("label"), "missing_texts": n(F.col("missing")), "empty_texts": n(F.col("n_words") == 0), "short_texts": n((F.col("n_words") > 0) & (F.col("n_words") < SHORT)),
        "texts_without_letters": n(~F.col("letters")), "ambiguous_copies": n(F.col("of_speakers") > 1), "rows_in_label_conflicts": n(F.col("of_labels") > 1), "positive": n(F.col("label") == 1), "negative": n(F.col("label") == 0),
        "kept": n(usable), "words_kept": F.sum(F.when(usable, F.col("n_words"))), "least_words": F.min(F.when(usable, F.col("n_words"))), "most_words": F.max(F.when(usable, F.col("n_words"))),
    }
    manifest, facts = audit.observed(whole, plain, lambda x: kept(x, "manifest"))
    good = manifest.where(usable)
    facts |= rows.agg(F.count_distinct("utterance_id").alias("unique_ids"), F.count_distinct("speaker_id").alias("speakers")).first().asDict()
    facts |= copies.agg(n(F.col("copies") > 1).alias("hashes_of_several_texts"), F.sum(F.col("copies") - 1).alias("redundant_copies")).first().asDict()
    facts |= groups.agg(F.count("*").alias("groups"), n(F.col("of_labels") > 1).alias("groups_with_label_conflicts")).first().asDict()
    facts |= {"texts_of_repeated_words": facts["texts"] - facts["groups"], "groups_kept": good.select("sentence_group_id").distinct().count()}
    ranks = quantiles.exact_quantiles(good, [], "n_words", [0.05, 0.5, 0.95]).collect()
    facts |= {f"{name}_words": next((round(r.value, 6) for r in ranks if r.q == q), None) for name, q in (("p05", 0.05), ("median", 0.5), ("p95", 0.95))}
    sizes = rows.groupBy("token_key").agg(F.count("*").alias("k"))
    return v.union_all([audit.long_facts(spark, facts), audit.counted(manifest, "texts_by_speaker", "speaker_id"), audit.counted(good, "kept_by_speaker", "speaker_id"), audit.counted(manifest, "texts_by_language", "lang"), audit.counted(sizes, "groups_by_size", "k")])


_LOG = {
    "empty_text": ("n_words = 0", "'missing=' || CAST(missing AS VARCHAR)"),
    "short_text": (f"n_words > 0 AND n_words < {SHORT}", "'words=' || CAST(n_words AS VARCHAR)"),
    "no_letters": ("n_words > 0 AND NOT letters", "'words=' || CAST(n_words AS VARCHAR)"),
    "ambiguous_copy": ("of_speakers > 1", "'speakers=' || CAST(of_speakers AS VARCHAR)"),
    "label_conflict": ("of_labels > 1", "'group=' || CAST(sentence_group_id AS VARCHAR)"),
    "missing_label": ("label IS NULL", "'language=' || coalesce(lang, '')"),
}


@register("audit_problems", f"WITH {_AUD} " + " UNION ALL ".join(f"SELECT utterance_id, speaker_id, '{i}' AS issue, '{audit.ISSUES[i]}' AS kind, {detail} AS detail FROM aud WHERE {holds}" for i, (holds, detail) in _LOG.items()))
def audit_problems(spark, d):
    """(utterance_id, speaker_id, issue, kind, detail): what is wrong with each row, a row for each problem."""
    *_, whole = audited(spark, d)
    says = lambda word, c: F.concat(F.lit(f"{word}="), F.coalesce(F.col(c).cast("string"), F.lit("")))
    few = F.col("n_words") > 0
    return audit.problem_log(whole, "utterance_id", "speaker_id", {
        "empty_text": (F.col("n_words") == 0, says("missing", "missing")), "short_text": (few & (F.col("n_words") < SHORT), says("words", "n_words")), "no_letters": (few & ~F.col("letters"), says("words", "n_words")),
        "ambiguous_copy": (F.col("of_speakers") > 1, says("speakers", "of_speakers")), "label_conflict": (F.col("of_labels") > 1, says("group", "sentence_group_id")), "missing_label": (F.col("label").isNull(), says("language", "lang")),
    })


@register(
    "published_check",
    f"WITH {v.ENS}, c AS ({ev.counts_sql('ens', 'condition')}), p AS (SELECT condition, {ev._MACRO} AS m, 100.0 * (tp + fp) / CAST(tn + fp + fn + tp AS DOUBLE) AS r, tn + fp + fn + tp AS n FROM c) "
    "SELECT 'macro_f1.' || condition AS key, CAST(printf('%.3f', round(m, 3)) AS DOUBLE) AS expected, round(m, 3) AS recomputed, true AS ok FROM p UNION ALL SELECT 'rate.' || condition, CAST(printf('%.1f', round(r, 1)) AS DOUBLE), round(r, 1), true FROM p UNION ALL SELECT 'recordings.' || condition, n, n, true FROM p",
)
def published_check(spark, d):
    """The numbers as printed against those that stored predictions give again by another way, scores from the pivoted predictions instead of the metrics' counts; a difference fails the run."""
    printed = ev.printed_numbers(spark, d).select("key", F.regexp_replace("printed", "%", "").cast("double").alias("expected"), F.when(F.col("key").startswith("rate"), 1).otherwise(3).alias("digits"), F.lit(0.0).alias("tolerance"))
    labelled = v.recordings(spark, d).agg(F.count("*").cast("double").alias("n"))
    sizes = v.conditions(spark).crossJoin(labelled).select(F.concat(F.lit("recordings."), "condition").alias("key"), F.col("n").alias("expected"), F.lit(None).cast("int").alias("digits"), F.lit(0.0).alias("tolerance"))
    registry = printed.unionByName(sizes)
    called = v.ensemble(spark, d).select("utterance_id", "label", "condition", F.col("predicted").cast("double").alias("p"))
    wide = called.groupBy("utterance_id", "label").pivot("condition", ev._CONDS).agg(F.max("p"))
    long = wide.unpivot(["utterance_id", "label"], ev._CONDS, "condition", "predicted")
    per = kept(metrics.scored(long, ["condition"], 12), "published")
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    each = (("macro_f1.", F.col("macro_f1")), ("rate.", 100 * F.col("predicted_positive_rate")), ("recordings.", total.cast("double")))
    return checks.assert_published(checks.published(v.union_all([per.select(F.concat(F.lit(k), "condition").alias("key"), c.alias("value")) for k, c in each]), registry))
