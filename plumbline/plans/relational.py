"""Queries over sources, projections, joins, aggregates, windows and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import checks, joins, quantiles, windows
from . import views as v
from .registry import register
from .views import table


@register("distinct_projection", "SELECT DISTINCT lang, source FROM documents")
def distinct_projection(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


_URL = r"^(https?)://([^/?#]+)(/[^?#]*)?"


@register("parse_paths", f"SELECT page_id, regexp_extract(url, '{_URL}', 1) AS scheme, regexp_extract(url, '{_URL}', 2) AS host, regexp_extract(url, '/([a-z]{{2}})/', 1) AS lang_part, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS number, regexp_matches(url, '{_URL}') AS accepted FROM pages")
def parse_paths(spark, d):
    url = F.col("url")
    part = lambda p, k: F.regexp_extract(url, p, k)
    return table(spark, d, "pages").select("page_id", part(_URL, 1).alias("scheme"), part(_URL, 2).alias("host"), part("/([a-z]{2})/", 1).alias("lang_part"), F.nullif(part("/([0-9]+)", 1), F.lit("")).cast("long").alias("number"), url.rlike(_URL).alias("accepted"))


FILES = "files AS (SELECT doc_id, source, text, md5(coalesce(text, '')) AS file_hash FROM documents)"


def files(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("file_hash"))


@register("content_hash_dups", f"WITH {FILES} SELECT file_hash, count(*) AS n, count(DISTINCT source) AS sources, min(doc_id) AS first_id FROM files GROUP BY file_hash HAVING count(*) > 1")
def content_hash_dups(spark, d):
    return files(spark, d).groupBy("file_hash").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first_id")).where("n > 1")


@register("text_sha256", "SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def text_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))


@register("json_props", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS largest FROM events GROUP BY event_type")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("largest"))


@register("run_summary", "SELECT source, count(*) AS n, count(*) FILTER (WHERE length(coalesce(text, '')) < 300) AS short, coalesce(array_to_string(list_sort(list(doc_id) FILTER (WHERE length(coalesce(text, '')) < 300))[1:50], ','), '') AS first_short FROM documents GROUP BY source")
def run_summary(spark, d):
    short = F.length(F.coalesce("text", F.lit(""))) < 300
    docs = table(spark, d, "documents").select("doc_id", "source", short.alias("short"))
    # the ids shown are numbered and cut first, so no list of all of them is made
    shown = windows.numbered(docs.where("short"), ["source"], F.floor(F.col("doc_id") / 65_536), ["doc_id"], keep=F.col("before_") < 50).where("rank_ < 50")
    ids = F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string"))
    listed = shown.groupBy("source").agg(F.array_join(ids, ",").alias("first_short")).withColumnRenamed("source", "of")
    counted = docs.groupBy("source").agg(F.count("*").alias("n"), F.count_if("short").alias("short"))
    return counted.join(listed, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "n", "short", F.coalesce("first_short", F.lit("")).alias("first_short"))


@register("label_encode", "SELECT event_id, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS label FROM events")
def label_encode(spark, d):
    named = table(spark, d, "events").select("event_id", F.when(F.col("value") >= 50, " Positive").otherwise("negative").alias("sentiment"))
    return checks.encoded_labels(named, "sentiment", "positive", "negative").select("event_id", "label")


@register("composite_key", "SELECT conv_id, turn, conv_id || '__' || role AS composite, 'si_' || lpad(CAST(conv_id AS VARCHAR), 6, '0') AS padded, CAST(substr('si_' || lpad(CAST(conv_id AS VARCHAR), 6, '0'), 4) AS BIGINT) AS number, split_part(conv_id || '__' || role, '__', 2) AS speaker FROM conversations")
def composite_key(spark, d):
    key = F.concat_ws("__", F.col("conv_id").cast("string"), "role")
    padded = F.concat(F.lit("si_"), F.lpad(F.col("conv_id").cast("string"), 6, "0"))
    return table(spark, d, "conversations").select("conv_id", "turn", key.alias("composite"), padded.alias("padded"), F.substring(padded, 4, 20).cast("long").alias("number"), F.element_at(F.split(key, "__"), 2).alias("speaker"))


@register("label_map", "SELECT doc_id, CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END AS name FROM labels")
def label_map(spark, d):
    names = F.create_map(F.lit(1), F.lit("positive"), F.lit(0), F.lit("negative"))
    return table(spark, d, "labels").select("doc_id", names[F.col("quality")].alias("name"))


@register("impute_median", "WITH x AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events) SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM x)), 6) AS value FROM x")
def impute_median(spark, d):
    x = table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    median = quantiles.wide_quantiles(x, [], "value", {"median": 0.5})
    return x.crossJoin(F.broadcast(median)).select("event_id", F.round(F.coalesce("value", "median"), 6).alias("value"))


@register("script_flags", "SELECT doc_id, regexp_matches(coalesce(text, ''), '[\\x{0980}-\\x{09FF}]') AS bengali, regexp_matches(coalesce(text, ''), '[A-Za-z]') AS latin, length(coalesce(text, '')) AS n FROM documents")
def script_flags(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", t.rlike(r"[ঀ-৿]").alias("bengali"), t.rlike("[A-Za-z]").alias("latin"), F.length(t).cast("long").alias("n"))


@register("degenerate_rows", "SELECT doc_id, string_agg(issue, ',' ORDER BY issue) AS issues FROM (SELECT doc_id, 'short' AS issue FROM documents WHERE length(coalesce(text, '')) < 200 UNION ALL SELECT doc_id, 'silent' FROM documents WHERE trim(coalesce(text, '')) = '' UNION ALL SELECT doc_id, 'no_final_stop' FROM documents WHERE NOT coalesce(text, '') LIKE '%.') GROUP BY doc_id")
def degenerate_rows(spark, d):
    t = F.coalesce("text", F.lit(""))
    flags = F.array_compact(F.array(F.when(F.length(t) < 200, "short"), F.when(F.trim(t) == "", "silent"), F.when(~t.endswith("."), "no_final_stop")))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(flags), ",").alias("issues")).where("issues <> ''")


@register("left_join_m1", "SELECT doc_id, lang, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def left_join_m1(spark, d):
    return checks.checked_join(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"], "left", "many_to_one").fillna({"quality": -1})


@register("inner_join_11", "SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def inner_join_11(spark, d):
    return checks.checked_join(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"], "inner", "one_to_one")


@register("rerun_diff", f"WITH {v.PRED}, b AS (SELECT utterance_id, condition, seed, CASE WHEN utterance_id % 97 = 0 THEN prob + 0.001 ELSE prob END AS prob FROM pred) SELECT condition, count(*) AS n, count(*) FILTER (WHERE a.prob <> b.prob) AS changed, round(max(abs(a.prob - b.prob)), 6) AS largest FROM pred a JOIN b USING (utterance_id, condition, seed) GROUP BY condition")
def rerun_diff(spark, d):
    a = v.predictions(spark, d).select("utterance_id", "condition", "seed", "prob")
    b = a.withColumn("other", F.when(F.col("utterance_id") % 97 == 0, F.col("prob") + 0.001).otherwise(F.col("prob"))).drop("prob")
    gap = F.abs(F.col("prob") - F.col("other"))
    return a.join(b, ["utterance_id", "condition", "seed"]).groupBy("condition").agg(F.count("*").alias("n"), F.count_if(F.col("prob") != F.col("other")).alias("changed"), F.round(F.max(gap), 6).alias("largest"))


@register("fold_lookup", "SELECT o_orderkey, c_mktsegment, coalesce(n_name, 'none') AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def fold_lookup(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    found = orders.join(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey", "left")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return joins.lookup(found, F.broadcast(nations), ["c_nationkey"], {"nation": "none"}).select("o_orderkey", "c_mktsegment", "nation")


@register("aligned_conditions", f"WITH {v.ENS} SELECT a.utterance_id, round(a.prob, 9) AS gold_prob, round(b.prob, 9) AS asr_prob FROM ens a JOIN ens b USING (utterance_id) WHERE a.condition = 'C2' AND b.condition = 'C3'")
def aligned_conditions(spark, d):
    e = v.ensemble(spark, d)
    one = lambda c, name: e.where(F.col("condition") == c).select("utterance_id", F.round("prob", 9).alias(name))
    return checks.aligned(one("C2", "gold_prob"), one("C3", "asr_prob"), ["utterance_id"])


@register("shared_hash_partners", f"WITH {FILES} SELECT file_hash, doc_id, n - 1 AS partners FROM (SELECT file_hash, doc_id, count(*) OVER (PARTITION BY file_hash) AS n FROM files) WHERE n > 1")
def shared_hash_partners(spark, d):
    return joins.hash_partners(files(spark, d), "doc_id", "file_hash")


@register("semi_join", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@register("anti_join", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


MISSING = "SELECT g.c_nationkey, g.c_mktsegment FROM (SELECT n_nationkey AS c_nationkey, c_mktsegment FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer)) g ANTI JOIN (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 450000) s USING (c_nationkey, c_mktsegment)"


@register("missing_pairs", MISSING)
def missing_pairs(spark, d):
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    seen = table(spark, d, "orders").where("o_totalprice > 450000").select("o_custkey").join(customer, "o_custkey")
    return joins.missing_pairs(seen, table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey")), customer.select("c_mktsegment").distinct())


@register("metric_attach", f"WITH {v.PRED}, {v.ASR}, m AS (SELECT system, speaker_id, sum(errors) / sum(n_ref) AS wer FROM asr GROUP BY ALL) SELECT condition, seed, utterance_id, coalesce(round(wer, 9), -1) AS wer FROM pred LEFT JOIN (SELECT system, max(wer) AS wer FROM m GROUP BY system) q ON q.system = pred.text_source")
def metric_attach(spark, d):
    m = v.asr_errors(spark, d).groupBy("system", "speaker_id").agg((F.sum("errors") / F.sum("n_ref")).alias("wer")).groupBy("system").agg(F.round(F.max("wer"), 9).alias("wer"))
    return joins.lookup(v.predictions(spark, d), m.withColumnRenamed("system", "text_source"), ["text_source"], {"wer": -1.0}).select("condition", "seed", "utterance_id", "wer")


@register("oof_grid_gate", f"WITH {v.PRED} SELECT condition, seed, count(*) AS n, count(DISTINCT utterance_id) AS utterances, count(*) = (SELECT count(*) FROM rec) AS complete FROM pred GROUP BY condition, seed")
def oof_grid_gate(spark, d):
    whole = v.recordings(spark, d).agg(F.count("*").alias("whole"))
    counted = v.predictions(spark, d).groupBy("condition", "seed").agg(F.count("*").alias("n"), F.count_distinct("utterance_id").alias("utterances"))
    return counted.crossJoin(F.broadcast(whole)).select("condition", "seed", "n", "utterances", (F.col("n") == F.col("whole")).alias("complete"))


@register("count_histogram", "SELECT n AS orders, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n")
def count_histogram(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders")).groupBy("orders").agg(F.count("*").alias("customers"))


@register("label_conflicts", f"WITH {v.REC} SELECT group_id, count(*) AS n, count(DISTINCT label) AS labels FROM rec GROUP BY group_id")
def label_conflicts(spark, d):
    return v.recordings(spark, d).groupBy("group_id").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"))


@register("dup_members", f"WITH {FILES} SELECT file_hash, min(doc_id) OVER (PARTITION BY file_hash) AS representative, doc_id AS member, count(*) OVER (PARTITION BY file_hash) AS copies FROM files QUALIFY copies > 1")
def dup_members(spark, d):
    """A row for each member of a hash that several files have, with the class's least member and size: a class of any size is no list in one row."""
    rows = files(spark, d).select("file_hash", F.col("doc_id").alias("member"))
    of = rows.groupBy("file_hash").agg(F.min("member").alias("representative"), F.count("*").alias("copies")).where("copies > 1")
    return rows.join(of, "file_hash").select("file_hash", "representative", "member", "copies")


@register("surplus_duplicates", f"WITH {FILES}, g AS (SELECT file_hash, count(*) AS n FROM files GROUP BY 1) SELECT n, count(*) AS hashes, CAST(sum(n - 1) AS BIGINT) AS surplus FROM g GROUP BY n")
def surplus_duplicates(spark, d):
    return files(spark, d).groupBy("file_hash").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("hashes"), F.sum(F.col("n") - 1).alias("surplus"))


@register("label_balance", "SELECT source, count(*) FILTER (WHERE quality = 1) AS positive, count(*) FILTER (WHERE quality = 0) AS negative, count(*) FILTER (WHERE toxic = 1) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source")
def label_balance(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("positive"), F.count_if(F.col("quality") == 0).alias("negative"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@register("duration_profile", "SELECT lang, CAST(min(n_chars) AS DOUBLE) AS least, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.05), 6) AS p05, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.5), 6) AS median, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.95), 6) AS p95, CAST(max(n_chars) AS DOUBLE) AS most, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY lang")
def duration_profile(spark, d):
    rows = table(spark, d, "documents").select("lang", "n_chars")
    x = F.col("n_chars").cast("double")
    ranks = {"p05": 0.05, "median": 0.5, "p95": 0.95}
    found = quantiles.wide_quantiles(rows, ["lang"], "n_chars", ranks).select(F.col("lang").alias("of_"), *(F.round(k, 6).alias(k) for k in ranks))
    whole = rows.groupBy("lang").agg(F.min(x).alias("least"), F.max(x).alias("most"), F.sum("n_chars").alias("total"))
    return whole.join(F.broadcast(found), F.col("lang").eqNullSafe(F.col("of_")), "left").drop("of_")


@register("feature_label_crosstab", " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, count(*) FILTER (WHERE l_quantity <= 25) AS negative, count(*) FILTER (WHERE l_quantity > 25) AS positive, round(avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END), 4) AS positive_rate FROM lineitem GROUP BY {c}" for c in ("l_returnflag", "l_linestatus")))
def feature_label_crosstab(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_quantity") > 25).cast("int").alias("label"))
    long = rows.unpivot("label", ["l_returnflag", "l_linestatus"], "feature", "value")
    return long.groupBy("feature", "value").agg(F.count_if(F.col("label") == 0).alias("negative"), F.count_if(F.col("label") == 1).alias("positive"), F.round(F.avg("label"), 4).alias("positive_rate"))


@register("group_table", f"WITH {v.REC} SELECT group_id, min(label) AS label, string_agg(DISTINCT speaker_id, '|' ORDER BY speaker_id) AS speakers, count(*) AS n FROM rec GROUP BY group_id")
def group_table(spark, d):
    return v.recordings(spark, d).groupBy("group_id").agg(F.min("label").alias("label"), F.array_join(F.array_sort(F.collect_set("speaker_id")), "|").alias("speakers"), F.count("*").alias("n"))


@register("signal_counts", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(coalesce(text, '')), ' ')) AS word FROM conversations) WHERE word <> '' GROUP BY word")
def signal_counts(spark, d):
    words = F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), " ", -1)).alias("word")
    return table(spark, d, "conversations").select(words).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


@register("canonical_copy", "WITH f AS (SELECT doc_id, source, lang, md5(coalesce(text, '')) AS file_hash FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY file_hash, doc_id) AS k, min(file_hash) OVER w = max(file_hash) OVER w AS equal, count(*) OVER w AS copies FROM f WINDOW w AS (PARTITION BY source, lang)) SELECT doc_id, source, lang, copies, equal FROM r WHERE k = 1")
def canonical_copy(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("file_hash"))
    first = F.min_by("doc_id", F.struct("file_hash", "doc_id"))
    return rows.groupBy("source", "lang").agg(first.alias("doc_id"), F.count("*").alias("copies"), (F.min("file_hash") == F.max("file_hash")).alias("equal")).select("doc_id", "source", "lang", "copies", "equal")


@register("group_representative", f"WITH {v.REC} SELECT utterance_id, group_id, speaker_id, label FROM rec WHERE utterance_id = group_id")
def group_representative(spark, d):
    rows = v.recordings(spark, d).select("utterance_id", "group_id", "speaker_id", "label")
    return windows.first_by(rows, ["group_id"], ["utterance_id"]).select("utterance_id", "group_id", "speaker_id", "label")


@register("sessionize", f"WITH {v.SESS} SELECT event_id, session_id, order_within_speaker FROM sess")
def sessionize(spark, d):
    return v.sessions(spark, d).select("event_id", "session_id", "order_within_speaker")


@register("session_summary", f"WITH {v.SESS} SELECT session_id, min(speaker_id) AS speaker_id, count(*) AS n, round(avg(label), 3) AS positive_rate, min(created_at) AS first_at, max(created_at) AS last_at, round(avg(label), 3) IN (0, 1) AS pure FROM sess GROUP BY session_id")
def session_summary(spark, d):
    rate = F.round(F.avg("label"), 3)
    return v.sessions(spark, d).groupBy("session_id").agg(F.min("speaker_id").alias("speaker_id"), F.count("*").alias("n"), rate.alias("positive_rate"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), rate.isin(0.0, 1.0).alias("pure"))


@register("session_span", f"WITH {v.SESS} SELECT session_id, round(date_diff('microsecond', min(created_at), max(created_at)) / CAST(3600000000 AS DOUBLE), 2) AS hours, strftime(min(created_at), '%Y-%m-%d %H:%M') AS started FROM sess GROUP BY session_id")
def session_span(spark, d):
    first, last = F.min("created_at"), F.max("created_at")
    hours = (F.unix_micros(last) - F.unix_micros(first)) / F.lit(3.6e9)
    return v.sessions(spark, d).groupBy("session_id").agg(F.round(hours, 2).alias("hours"), F.date_format(first, "yyyy-MM-dd HH:mm").alias("started"))


@register("label_switches", f"WITH {v.SESS}, x AS (SELECT speaker_id, label, lag(label) OVER (PARTITION BY speaker_id ORDER BY created_at, event_id) AS before FROM sess) SELECT speaker_id, count(*) AS n, count(*) FILTER (WHERE before <> label) AS switches FROM x GROUP BY speaker_id")
def label_switches(spark, d):
    rows = v.sessions(spark, d)
    return windows.label_switches(rows, "speaker_id", ["created_at", "event_id"], "label", F.to_date("created_at"))


@register("order_label_corr", f"WITH {v.SESS} SELECT speaker_id, round(corr(order_within_speaker, label), 6) AS r FROM sess GROUP BY speaker_id HAVING min(label) <> max(label)")
def order_label_corr(spark, d):
    return v.sessions(spark, d).groupBy("speaker_id").agg(F.round(F.corr("order_within_speaker", F.col("label").cast("double")), 6).alias("r"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("speaker_id", "r")


@register("bitrate_bins", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'nan' WHEN value <= 20 THEN '<=20' WHEN value <= 50 THEN '20-50' WHEN value <= 100 THEN '50-100' ELSE '>100' END AS bin FROM events")
def bitrate_bins(spark, d):
    x = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, d, "events").select("event_id", numeric.right_closed_bins(x, [20, 50, 100], ["<=20", "20-50", "50-100", ">100"]).alias("bin"))


@register("topk_worst", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20")
def topk_worst(spark, d):
    return windows.top_k(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"), [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 20).drop("l_partkey")


@register("stratified_sample", f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {v.bucket_sql('concat_ws(chr(124), 7, CAST(doc_id AS VARCHAR))')}, doc_id) AS k FROM documents) WHERE k <= 15")
def stratified_sample(spark, d):
    return windows.stratified_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 15, 7)


@register("stride_sample", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS k, greatest(1, count(*) OVER (PARTITION BY source) // 15) AS stride FROM documents) WHERE k % stride = 0 AND k < stride * 15")
def stride_sample(spark, d):
    return windows.stride_sample(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", ["n_chars", "doc_id"], 15).select("doc_id", "source")


@register("duration_batches", "SELECT doc_id, CAST((row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 16 AS BIGINT) AS batch FROM documents")
def duration_batches(spark, d):
    """Batches of 16 rows of like length, so that padding is little: rows are numbered by length, value by value."""
    ranked = windows.numbered(table(spark, d, "documents").select("doc_id", "n_chars"), [], F.col("n_chars"), ["n_chars", "doc_id"])
    return ranked.select("doc_id", F.floor(F.col("rank_") / 16).cast("long").alias("batch"))


@register("union_systems", f"WITH {v.ASR} SELECT utterance_id, system, n_hyp FROM asr")
def union_systems(spark, d):
    rows = v.asr_errors(spark, d).select("utterance_id", "system", "n_hyp")
    return v.union_all([rows.where(F.col("system") == s) for s in v.SYSTEMS])


@register("union_ragged", "SELECT doc_id, 'label' AS issue, CAST(quality AS VARCHAR) AS detail, CAST(NULL AS VARCHAR) AS path FROM labels WHERE toxic = 1 UNION ALL SELECT page_id, 'page', NULL, url FROM pages")
def union_ragged(spark, d):
    a = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("label").alias("issue"), F.col("quality").cast("string").alias("detail"))
    b = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit("page").alias("issue"), F.col("url").alias("path"))
    return a.unionByName(b, allowMissingColumns=True)


@register("set_operations", "SELECT 'common' AS what, count(*) AS n FROM (SELECT DISTINCT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'only_left', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'either', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)")
def set_operations(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    counted = lambda df, name: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    return v.union_all([counted(a.intersect(b), "common"), counted(a.subtract(b), "only_left"), counted(a.union(b).distinct(), "either")])


@register("multi_key_sort", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment NULLS FIRST, c_acctbal DESC NULLS LAST, c_custkey) AS place FROM customer")
def multi_key_sort(spark, d):
    """A global order numbered without one task for all rows: stretches of the order are sorted apart, then offset by the counts before them. Null segments come first, null balances last."""
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    last = F.lit(1 << 62)
    stretch = F.struct("c_mktsegment", F.coalesce(F.floor(-F.col("c_acctbal") / 100).cast("long"), last).alias("balance"))
    ranked = windows.numbered(rows, [], stretch, [F.asc_nulls_first("c_mktsegment"), F.desc_nulls_last("c_acctbal"), "c_custkey"])
    return ranked.select("c_custkey", (F.col("rank_") + 1).alias("place"))


@register("fallback_chain", "SELECT conv_id, turn, coalesce(nullif(trim(role), ''), nullif(text, ''), '') AS first_of FROM conversations")
def fallback_chain(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.nullif("text", F.lit("")), F.lit("")).alias("first_of"))

