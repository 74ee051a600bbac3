"""Domain views over the driver's tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, text

#: Condition, head, text source, how strongly its predictions follow the label.
CONDITIONS = (("A1", "adapted", "asr_a", 0.45), ("A2", "adapted", "asr_b", 0.5), ("C2", "gold", "gold", 0.6), ("C3", "gold", "asr_a", 0.1), ("C4", "gold", "asr_b", 0.3), ("C5", "fused", "gold", 0.65))
SEEDS = (13, 42, 2026)
SYSTEMS = ("asr_a", "asr_b")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def recordings(spark: SparkSession, d: str) -> DataFrame:
    """utterance_id, speaker_id, label, words (whole text), token_key, group_id (least id of an equal token multiset)."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-zà-ÿ0-9]+"), F.lit(0))
    rows = docs.join(labels, "doc_id").select(F.col("doc_id").alias("utterance_id"), F.col("source").alias("speaker_id"), F.col("quality").alias("label"), words.alias("words"))
    keyed = rows.select("utterance_id", "speaker_id", "label", F.md5(text.token_key(F.col("words"))).alias("token_key"), F.size("words").cast("long").alias("n_words"))
    return grouped(keyed, "token_key", "utterance_id", "group_id")


def grouped(rows: DataFrame, key: str, least: str, out: str) -> DataFrame:
    """rows with the least value among those of the same key. An aggregate joined back, so the rows of a hot key can be split, which those of a window can't."""
    of = rows.groupBy(key).agg(F.min(least).alias(out))
    return rows.join(of, key).select(*rows.columns, out)


REC = """rec0 AS (SELECT doc_id AS utterance_id, source AS speaker_id, quality AS label, regexp_extract_all(lower(coalesce(text, '')), '[a-zà-ÿ0-9]+') AS words FROM documents JOIN labels USING (doc_id)),
rec AS (SELECT utterance_id, speaker_id, label, token_key, n_words, min(utterance_id) OVER (PARTITION BY token_key) AS group_id FROM (SELECT utterance_id, speaker_id, label, md5(array_to_string(list_sort(words), ' ')) AS token_key, CAST(len(words) AS BIGINT) AS n_words FROM rec0))"""


def conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONDITIONS, "condition string, head string, text_source string, strength double")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """One row for each recording, condition and seed; the catalogue is a handful of rows."""
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "seed int")
    grid = conditions(spark).crossJoin(seeds)
    u = numeric.hash_uniform(F.concat_ws("|", F.col("utterance_id").cast("string"), "condition", F.col("seed").cast("string")))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + (F.col("label") - 0.5) * F.col("strength") + (u - 0.5) * 0.8))
    rows = recordings(spark, d).crossJoin(F.broadcast(grid))
    return rows.select("utterance_id", "group_id", "speaker_id", "label", "condition", "head", "text_source", "seed", p.alias("prob"))


def bucket_sql(e: str) -> str:
    return f"CAST('0x' || substr(md5({e}), 1, 8) AS BIGINT)"


PRED = (
    REC
    + ", cond(condition, head, text_source, strength) AS (VALUES "
    + ", ".join(f"('{a}', '{b}', '{c}', CAST({s} AS DOUBLE))" for a, b, c, s in CONDITIONS)
    + "), seeds(seed) AS (VALUES "
    + ", ".join(f"(CAST({s} AS INTEGER))" for s in SEEDS)
    + f"), pred AS (SELECT utterance_id, group_id, speaker_id, label, condition, head, text_source, seed, least(1.0, greatest(0.0, CAST(0.5 AS DOUBLE) + (label - CAST(0.5 AS DOUBLE)) * strength + ({bucket_sql("concat_ws('|', CAST(utterance_id AS VARCHAR), condition, CAST(seed AS VARCHAR))")} / CAST(4294967296 AS DOUBLE) - CAST(0.5 AS DOUBLE)) * CAST(0.8 AS DOUBLE))) AS prob FROM rec CROSS JOIN cond CROSS JOIN seeds)"
)


def ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Seed means and the decision mean >= 0.5, by condition and recording."""
    keys = ["condition", "utterance_id", "group_id", "speaker_id", "label"]
    return predictions(spark, d).groupBy(*keys).agg(F.avg("prob").alias("prob")).withColumn("predicted", (F.round("prob", 9) >= 0.5).cast("int"))


ENS = PRED + ", ens AS (SELECT condition, utterance_id, group_id, speaker_id, label, avg(prob) AS prob, CAST(round(avg(prob), 9) >= 0.5 AS INTEGER) AS predicted FROM pred GROUP BY ALL)"


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every turn of conversations as an utterance: utterance_id, speaker_id (role), label, gold (tokens)."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"[.\n]+", -1)).alias("at", "piece"))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower("piece"), "[,;:!?\"']", " "), " +", " "))
    uid = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("at").cast("string"))
    rows = turns.select(uid.alias("utterance_id"), F.col("role").alias("speaker_id"), text.tokens(clean).alias("gold")).where(F.size("gold") > 0)
    return rows.withColumn("label", (numeric.hash_bucket(F.col("utterance_id")) % 2).cast("int"))


SENT = f"""sent0 AS (SELECT conv_id, turn, role, unnest(string_split_regex(coalesce(text, ''), '[.\\n]+')) AS piece, unnest(range(len(string_split_regex(coalesce(text, ''), '[.\\n]+')))) AS place FROM conversations),
sent1 AS (SELECT concat_ws('_', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), CAST(place AS VARCHAR)) AS utterance_id, role AS speaker_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(piece), '[,;:!?"'']', ' ', 'g'), ' +', ' ', 'g'), ' '), ' '), lambda t: t <> '') AS gold FROM sent0),
sent AS (SELECT *, CAST({bucket_sql('utterance_id')} % 2 AS INTEGER) AS label FROM sent1 WHERE len(gold) > 0)"""


def hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """For each system every sentence with tokens dropped, reversed or doubled by their hash: adds system, hyp."""
    systems = spark.createDataFrame([("asr_a", 20), ("asr_b", 60)], "system string, one_in int")
    rows = sentences(spark, d).crossJoin(F.broadcast(systems))

    def heard(t, i):
        u = numeric.hash_bucket(F.concat_ws("|", "utterance_id", i.cast("string"), "system")) % F.col("one_in")
        return F.when(u == 0, F.array().cast("array<string>")).when(u == 1, F.array(F.reverse(t))).when(u == 2, F.array(t, t)).otherwise(F.array(t))

    return rows.withColumn("hyp", F.flatten(F.transform("gold", heard)))


HYP = (
    SENT
    + ", sys(system, one_in) AS (VALUES ('asr_a', 20), ('asr_b', 60)), hyp AS (SELECT utterance_id, speaker_id, label, gold, system, flatten(list_transform(gold, lambda t, i: CASE "
    + " ".join(f"WHEN {bucket_sql('concat_ws(chr(124), utterance_id, CAST(i - 1 AS VARCHAR), system)')} % one_in = {k} THEN {v}" for k, v in ((0, "CAST([] AS VARCHAR[])"), (1, "[reverse(t)]"), (2, "[t, t]")))
    + " ELSE [t] END)) AS hyp FROM sent CROSS JOIN sys)"
)
_CODE = "array_to_string(list_transform({0}, lambda t: chr(CAST(32 + list_position(list_distinct(list_concat(gold, hyp)), t) AS INTEGER))), '')"
ASR = (
    HYP
    + f", asr AS (SELECT utterance_id, speaker_id, label, system, CAST(len(gold) AS BIGINT) AS n_ref, CAST(len(hyp) AS BIGINT) AS n_hyp, CAST(levenshtein({_CODE.format('gold')}, {_CODE.format('hyp')}) AS BIGINT) AS errors, gold, hyp FROM hyp)"
)


def asr_errors(spark: SparkSession, d: str) -> DataFrame:
    """By system and utterance: n_ref, n_hyp, errors (edit distance in words), gold, hyp."""
    rows = hypotheses(spark, d)
    return rows.select("utterance_id", "speaker_id", "label", "system", F.size("gold").cast("long").alias("n_ref"), F.size("hyp").cast("long").alias("n_hyp"), text.coded_distance(F.col("gold"), F.col("hyp")).cast("long").alias("errors"), "gold", "hyp")


_CHARS = "array_to_string(list_transform(string_split(array_to_string({0}, ''), ''), lambda t: chr(CAST(32 + list_position(list_distinct(list_concat(string_split(array_to_string(gold, ''), ''), string_split(array_to_string(hyp, ''), ''))), t) AS INTEGER))), '')"
#: Characters here are composed letters, one grapheme each, of which a pair has far fewer than the 94 codes.
CER = HYP + f", cer AS (SELECT utterance_id, speaker_id, label, system, CAST(length(array_to_string(gold, '')) AS BIGINT) AS n_chars, CAST(CASE WHEN len(hyp) = 0 THEN length(array_to_string(gold, '')) ELSE levenshtein({_CHARS.format('gold')}, {_CHARS.format('hyp')}) END AS BIGINT) AS char_errors FROM hyp)"


def char_errors(spark: SparkSession, d: str) -> DataFrame:
    """By system and utterance: n_chars and char_errors, both in grapheme clusters without spaces."""
    chars = lambda c: text.graphemes(F.array_join(c, ""))
    rows = hypotheses(spark, d).withColumn("x", chars("gold")).withColumn("y", chars("hyp"))
    return rows.select("utterance_id", "speaker_id", "label", "system", F.size("x").cast("long").alias("n_chars"), text.coded_distance(F.col("x"), F.col("y")).cast("long").alias("char_errors"))

#: Whether the list w holds one to four words three times back to back.
LOOP = " OR ".join(f"list_has_any([true], list_transform(range(1, greatest(len(w) - {3 * n} + 2, 1)), lambda s: w[s:s + {n - 1}] = w[s + {n}:s + {2 * n - 1}] AND w[s:s + {n - 1}] = w[s + {2 * n}:s + {3 * n - 1}]))" for n in range(1, 5))

#: Cells of the table of edit operations by anti-diagonals, as structs: cost, substitutions, deletions, insertions.
_CELL = "CAST({{'c': {0}, 's': {1}, 'd': {2}, 'x': {3}}} AS STRUCT(c BIGINT, s BIGINT, d BIGINT, x BIGINT))"
_DIAG, _UP, _LEFT = "b[i - greatest(0, k - 1 - m)]", "a[i - greatest(0, k - m)]", "a[i - greatest(0, k - m) + 1]"
OPS = (
    HYP
    + f""", ed(utterance_id, system, gold, hyp, n, m, k, a, b) AS (SELECT utterance_id, system, gold, hyp, len(gold), len(hyp), 0, [{_CELL.format(0, 0, 0, 0)}], CAST([] AS STRUCT(c BIGINT, s BIGINT, d BIGINT, x BIGINT)[]) FROM hyp
UNION ALL SELECT utterance_id, system, gold, hyp, n, m, k + 1, list_transform(range(greatest(0, k + 1 - m), least(n, k + 1) + 1), lambda i: CASE
WHEN i = 0 THEN {_CELL.format("k + 1", 0, 0, "k + 1")} WHEN k + 1 - i = 0 THEN {_CELL.format("i", 0, "i", 0)} WHEN gold[i] = hyp[k + 1 - i] THEN {_DIAG}
WHEN {_DIAG}.c <= least({_UP}.c, {_LEFT}.c) THEN {_CELL.format(f"{_DIAG}.c + 1", f"{_DIAG}.s + 1", f"{_DIAG}.d", f"{_DIAG}.x")}
WHEN {_UP}.c <= {_LEFT}.c THEN {_CELL.format(f"{_UP}.c + 1", f"{_UP}.s", f"{_UP}.d + 1", f"{_UP}.x")}
ELSE {_CELL.format(f"{_LEFT}.c + 1", f"{_LEFT}.s", f"{_LEFT}.d", f"{_LEFT}.x + 1")} END), a FROM ed WHERE k < n + m),
ops AS (SELECT utterance_id, system, n, m, hyp, a[1].s AS substitutions, a[1].d AS deletions, a[1].x AS insertions FROM ed WHERE k = n + m)"""
)


def sessions(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.windows import sessionize

    events = table(spark, d, "events").select(F.col("user_id").alias("speaker_id"), F.col("ts").cast("timestamp").alias("created_at"), "event_id", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"), "value")
    return sessionize(events, "speaker_id", "created_at", 720, tie="event_id")


SESS = """ev AS (SELECT user_id AS speaker_id, ts AS created_at, event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label, value FROM events),
gap AS (SELECT *, CASE WHEN date_diff('microsecond', lag(created_at) OVER w, created_at) > 43200000000 THEN 1 ELSE 0 END AS opens FROM ev WINDOW w AS (PARTITION BY speaker_id ORDER BY created_at, event_id)),
sess0 AS (SELECT *, sum(opens) OVER (PARTITION BY speaker_id ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING) AS k FROM gap),
sess AS (SELECT speaker_id, created_at, event_id, label, value, CAST(speaker_id AS VARCHAR) || '_s' || CAST(k AS BIGINT) AS session_id, CAST(row_number() OVER (PARTITION BY speaker_id ORDER BY created_at, event_id) - 1 AS BIGINT) AS order_within_speaker FROM sess0)"""


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
