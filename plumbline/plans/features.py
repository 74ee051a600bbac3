"""Queries over texts, vectors and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical, numeric, text
from ..operators import lexical, metrics, ml, quantiles, vectors
from ..sources.writers import kept
from . import evaluation as ev
from . import views as v
from .registry import register
from .views import table

# Texts. Composition is left out in SQL-checked queries where the texts are composed already; normalize_text has it.

_PUNCT = text.PUNCTUATION.replace("'", "''")
_N = "trim(regexp_replace(translate(translate(regexp_replace(regexp_replace({0}, '<\\|[^|]*\\||<[a-zA-Z_]{{1,16}}>', ' ', 'g'), '[\\[({{][^\\])}}]{{0,40}}[\\])}}]', ' ', 'g'), '" + text.ZERO_WIDTH + "', ''), '" + text.BENGALI_DIGITS + _PUNCT + "', '0123456789" + " " * len(text.PUNCTUATION) + "'), '[\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))"
NORMAL = _N.replace("{{", "{").replace("}}", "}").replace("<\\|[^|]*\\||", "<\\|[^|]*\\|>|")
DOCS_N = "norm AS (SELECT doc_id, " + NORMAL.replace("{0}", "nfc_normalize(coalesce(text, ''))") + " AS t FROM documents)"


@register("normalize_text", f"WITH {DOCS_N} SELECT doc_id, md5(t) AS normal_md5, length(t) AS n FROM norm")
def normalize_text(spark, d):
    n = table(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("t"))
    return n.select("doc_id", F.md5("t").alias("normal_md5"), F.length("t").cast("long").alias("n"))


@register("token_stats", f"WITH {DOCS_N}, w AS (SELECT doc_id, list_filter(string_split(t, ' '), lambda x: x <> '') AS words FROM norm) SELECT doc_id, CAST(len(words) AS BIGINT) AS words, CAST(len(list_distinct(words)) AS BIGINT) AS distinct_words FROM w")
def token_stats(spark, d):
    words = text.tokens(text.normalize(F.col("text")))
    return table(spark, d, "documents").select("doc_id", words.alias("w")).select("doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("distinct_words"))


@register("grapheme_count")
def grapheme_count(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.graphemes(text.normalize(F.col("text")))).cast("long").alias("graphemes"))


@register("token_multiset_groups", f"WITH {v.REC} SELECT token_key, count(*) AS n, min(utterance_id) AS first_id, max(utterance_id) AS last_id FROM rec GROUP BY token_key HAVING count(*) > 1")
def token_multiset_groups(spark, d):
    return v.recordings(spark, d).groupBy("token_key").agg(F.count("*").alias("n"), F.min("utterance_id").alias("first_id"), F.max("utterance_id").alias("last_id")).where("n > 1")


_LOOP = v.LOOP


@register("repetition_loops", f"WITH x AS (SELECT conv_id, turn, list_filter(string_split(lower(coalesce(text, '')), ' '), lambda t: t <> '') AS w FROM conversations) SELECT conv_id, turn, {_LOOP} AS has_loop FROM x")
def repetition_loops(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.tokens(F.lower(F.coalesce("text", F.lit("")))).alias("w"))
    return rows.select("conv_id", "turn", text.has_repetition_loop(F.col("w")).alias("has_loop"))


@register("compression_flags")
def compression_flags(spark, d):
    ratio = text.compression_ratio(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.round(ratio, 6).alias("ratio")).withColumn("flagged", F.col("ratio") > 2.4)


#: A small example map; callers pass their own.
#: Marked letters by rule, and sequences of two and three letters, longest first.
MAPPING = canonical.latin_map() | {"qu": "k", "que": "ke", "ung": "ing"}


@register("canonicalize_text")
def canonicalize_text(spark, d):
    """The compatibility form, the map and the frozen normal form of whole texts; DuckDB has no such form."""
    return table(spark, d, "documents").select("doc_id", F.md5(canonical.canonical(F.col("text"), MAPPING)).alias("canonical_md5"))


_MAP = "MAP {" + ", ".join(f"'{k}': '{x}'" for k, x in sorted(MAPPING.items())) + "}"
_KEYS = canonical.pattern_of(list(MAPPING))


@register(
    "replace_by_map",
    f"WITH mp AS (SELECT {_MAP} AS m), x AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{_KEYS}') AS gaps, regexp_extract_all(coalesce(text, ''), '{_KEYS}') AS hits FROM documents) "
    "SELECT doc_id, len(hits) AS n_replaced, md5(array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(m[hits[i]], '')), '')) AS replaced_md5 FROM x CROSS JOIN mp",
)
def replace_by_map(spark, d):
    """Whole texts with the longest key of the map replaced wherever one stands, and how many were."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.regexp_count(t, F.lit(_KEYS)).cast("long").alias("n_replaced"), F.md5(canonical.replaced(t, MAPPING)).alias("replaced_md5"))


# Vectors.


@register("l2_normalize", "SELECT vec_id, pos, round(CAST(embedding[pos] AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 1e-9), 9) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)")
def l2_normalize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(numeric.l2_normalized(F.col("embedding"))).alias("pos", "x")).select("vec_id", (F.col("pos") + 1).cast("long").alias("pos"), F.round("x", 9).alias("x"))


@register("vector_concat", "SELECT a.vec_id, CAST(len(a.embedding) + len(b.embedding) AS BIGINT) AS width, round(CAST(a.embedding[1] AS DOUBLE), 6) AS head, round(CAST(b.embedding[len(b.embedding)] AS DOUBLE), 6) AS tail FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_concat(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id").select("vec_id", F.concat("embedding", "next").alias("x"))
    return both.select("vec_id", F.size("x").cast("long").alias("width"), F.round(F.element_at("x", 1).cast("double"), 6).alias("head"), F.round(F.element_at("x", -1).cast("double"), 6).alias("tail"))


_LONG = "lng AS (SELECT label, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@register("mean_pool", f"WITH {_LONG} SELECT label, dim, round(avg(x), 8) AS mean FROM lng GROUP BY ALL")
def mean_pool(spark, d):
    return vectors.pooled(table(spark, d, "embeddings"), "label", "embedding").select("label", "dim", F.round("mean", 8).alias("mean"))


@register("mean_std_pool", f"WITH {_LONG} SELECT label, dim, round(avg(x), 8) AS mean, round(sqrt(greatest(var_pop(x), 1e-10)), 8) AS std FROM lng GROUP BY ALL")
def mean_std_pool(spark, d):
    return vectors.pooled(table(spark, d, "embeddings"), "label", "embedding").select("label", "dim", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


def _ms(e):
    return f"sqrt(list_avg(list_transform({e}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


_TAIL = "embedding[len(embedding) - 7:len(embedding)]"


def _p10(e):
    s = f"list_sort(list_transform({e}, lambda x: abs(CAST(x AS DOUBLE))))"
    at = f"(len({e}) - 1) * CAST(0.1 AS DOUBLE)"
    low, high = (f"({s})[1 + CAST({f}({at}) AS INTEGER)]" for f in ("floor", "ceil"))
    return f"({low} + ({high} - {low}) * ({at} - floor({at})))"


@register("signal_stats", f"SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: CASE WHEN abs(x) >= 0.99 THEN 1.0 ELSE 0.0 END)), 8) AS clipping_fraction, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 8) AS dc_offset, round({_ms('embedding[1:8]')}, 8) AS leading_rms, round({_ms(_TAIL)}, 8) AS trailing_rms, round({_ms('embedding')}, 8) AS full_rms, round({_p10('embedding[1:8]')}, 8) AS leading_noise_floor, round({_p10(_TAIL)}, 8) AS trailing_noise_floor FROM embeddings")
def signal_stats(spark, d):
    stats = numeric.signal_stats(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", *(F.round(c, 8).alias(k) for k, c in stats.items()))


_WAVE = "list_sum(list_transform(range(0, len(e)), lambda i: e[i + 1] * {0}(2 * pi() * k * i / len(e))))"


@register(
    "spectral_centroid",
    f"WITH x AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT vec_id, len(e) AS n, k, sqrt(pow({_WAVE.format('cos')}, 2) + pow({_WAVE.format('sin')}, 2)) AS m FROM (SELECT vec_id, e, unnest(range(0, len(e) // 2 + 1)) AS k FROM x)) "
    "SELECT vec_id, round(sum(m * k * 16000 / n) / greatest(sum(m), 1e-9), 4) AS centroid FROM s GROUP BY vec_id",
)
def spectral_centroid(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(numeric.spectral_centroid()("embedding"), 4).alias("centroid"))


@register("db_levels", f"WITH x AS (SELECT vec_id, 20 * log10(greatest({_ms('embedding[1:8]')}, 1e-12) / greatest({_ms('embedding')}, 1e-12)) AS db FROM embeddings) SELECT count(*) AS n, round(quantile_cont(db, 0.5), 6) AS median, round(quantile_cont(db, 0.95), 6) AS p95, round(avg(CASE WHEN db > -10 THEN 1.0 ELSE 0.0 END), 6) AS above_10, round(avg(CASE WHEN db > -20 THEN 1.0 ELSE 0.0 END), 6) AS above_20 FROM x")
def db_levels(spark, d):
    stats = numeric.signal_stats(F.col("embedding"))
    x = table(spark, d, "embeddings").select(numeric.decibels(stats["leading_rms"], stats["full_rms"]).alias("db"))
    share = lambda t: F.round(F.avg((F.col("db") > t).cast("double")), 6)
    ranks = {"median": 0.5, "p95": 0.95}
    found = quantiles.wide_quantiles(x, [], "db", ranks).select(*(F.round(k, 6).alias(k) for k in ranks))
    return x.agg(F.count("*").alias("n"), share(-10).alias("above_10"), share(-20).alias("above_20")).crossJoin(F.broadcast(found))


# Models.

_TERMS = "tt0 AS (SELECT conv_id * 100 + turn AS id, list_filter(string_split(lower(coalesce(text, '')), ' '), lambda t: t <> '') AS w FROM conversations), tt AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM tt0 UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM tt0) GROUP BY ALL), ww AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM tt0)) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tt JOIN (SELECT term, count(*) AS df FROM tt GROUP BY term) USING (term))"


@register("tfidf", f"WITH {_TERMS} SELECT id, term, round(w / n, 8) AS weight FROM ww JOIN (SELECT id, sqrt(sum(w * w)) AS n FROM ww GROUP BY id) USING (id)")
def tfidf(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), text.tokens(F.lower(F.coalesce("text", F.lit("")))).alias("w"))
    return ml.tfidf(rows, "id", "w").select("id", "term", F.round("weight", 8).alias("weight"))


@register("lexical_baseline")
def lexical_baseline(spark, d):
    """Out-of-fold metrics of a logistic regression on TF-IDF of all words and word pairs of the training folds, its c of a grid by validation macro-F1."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    words = docs.select(F.col("doc_id").alias("utterance_id"), text.tokens(F.lower(F.coalesce("text", F.lit("")))).alias("words"))
    rows = v.recordings(spark, d).select("utterance_id", "group_id", "label").join(ev.folds(spark, d), ["group_id", "label"]).join(words, "utterance_id")
    rows = kept(rows, "lexical")

    scored = lexical.lexical_folds(rows, "utterance_id", "words", "outer_fold", "label", list(range(5)), grid=(0.1, 1.0, 10.0))
    return metrics.scored(scored.withColumn("predicted", (F.col("prob") >= 0.5).cast("int")), ["outer_fold"], 6)


_NUMERIC, _CATEGORICAL = ["l_quantity", "l_extendedprice", "l_tax"], ["l_returnflag", "l_linestatus"]
_LEVELS = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]}


def acquisition(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *_NUMERIC, *_CATEGORICAL, (F.col("l_discount") > 0.05).cast("int").alias("label"))
    fold = numeric.hash_bucket(F.concat_ws("|", F.col("l_orderkey").cast("string"))) % 5
    return rows.withColumn("fold", fold.cast("int")).withColumn("training", F.col("fold") != 0)


_ACQ = f"acq AS (SELECT *, {v.bucket_sql('CAST(l_orderkey AS VARCHAR)')} % 5 <> 0 AS training FROM lineitem)"


@register("train_only_encode", f"WITH {_ACQ}, st AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in _NUMERIC) + " FROM acq WHERE training), f AS (SELECT training, " + ", ".join(f"({c} - {c}_m) / CASE WHEN {c}_s > 0 THEN {c}_s ELSE 1 END AS x{i}" for i, c in enumerate(_NUMERIC)) + ", " + ", ".join(f"CASE WHEN {c} = '{x}' THEN 1.0 ELSE 0.0 END AS d{i}" for i, (c, x) in enumerate((c, x) for c in _CATEGORICAL for x in _LEVELS[c])) + " FROM acq CROSS JOIN st), n AS (SELECT *, greatest(sqrt(x0 * x0 + x1 * x1 + x2 * x2 + d0 + d1 + d2 + d3 + d4), 1e-9) AS norm FROM f) SELECT training, count(*) AS n, " + ", ".join(f"round(avg(x{i} / norm), 6) AS mean{i}" for i in range(3)) + " FROM n GROUP BY training")
def train_only_encode(spark, d):
    rows = acquisition(spark, d)
    encoder = ml.train_only_encoder(rows, "training", _NUMERIC, _CATEGORICAL)
    coded = ml.encode(rows, encoder, "training", _NUMERIC, _CATEGORICAL, _LEVELS)
    return coded.groupBy("training").agg(F.count("*").alias("n"), *(F.round(F.avg(F.col("features")[i]), 6).alias(f"mean{i}") for i in range(3)))


@register("encoder_checks", f"WITH {_ACQ} SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_missing, stddev_pop({c}) FILTER (WHERE training) = 0 AS {c}_constant" for c in _NUMERIC) + ", " + ", ".join(f"count(*) FILTER (WHERE NOT training AND {c} NOT IN (SELECT {c} FROM acq WHERE training)) AS {c}_unseen" for c in _CATEGORICAL) + " FROM acq")
def encoder_checks(spark, d):
    rows = acquisition(spark, d)
    levels = rows.where("training").agg(*(F.collect_set(c).alias(f"{c}_levels") for c in _CATEGORICAL))
    both = rows.crossJoin(F.broadcast(levels))
    facts = [c for x in _NUMERIC for c in (F.count_if(F.col(x).isNull()).alias(f"{x}_missing"), (F.stddev_pop(F.when(F.col("training"), F.col(x))) == 0).alias(f"{x}_constant"))]
    return both.agg(*facts, *(F.count_if(~F.col("training") & ~F.array_contains(F.col(f"{x}_levels"), F.col(x))).alias(f"{x}_unseen") for x in _CATEGORICAL))


@register("nuisance_classifier")
def nuisance_classifier(spark, d):
    """Fold metrics of a logistic regression on what should carry no signal; about chance is right."""
    scored = ml.encoded_logistic_folds(acquisition(spark, d), "fold", "label", _NUMERIC, _CATEGORICAL, _LEVELS, list(range(5)))
    return metrics.scored(scored.withColumn("predicted", (F.col("prob") > 0.5).cast("int")), ["fold"], 6)


@register("mlp_heads")
def mlp_heads(spark, d):
    """Out-of-fold probabilities of heads on embeddings, label: the lower half of the ten classes."""
    e = table(spark, d, "embeddings").where("label is not null")
    fold = (numeric.hash_bucket(F.col("vec_id").cast("string")) % 5).cast("int")
    inner = (numeric.hash_bucket(F.concat(F.lit("i"), F.col("vec_id").cast("string"))) % 10 == 0).cast("int")
    rows = e.select(F.col("vec_id").alias("id"), numeric.l2_normalized(F.col("embedding")).alias("features"), (F.col("label") < 5).cast("int").alias("label"), fold.alias("fold"), inner.alias("inner"))
    return ml.train_heads(rows, [(s, k) for s in (13, 42, 87) for k in range(5)])
