"""Repeated lines over a whole corpus, by levelled sorted runs of line hashes, in DataFrame functions only.

A run is a table (hash, check, n, last) bucketed and sorted by its 128-bit line hash: in how many documents of
its batch a line is, and the largest of them. A new batch is merge-joined with the runs bucket by bucket, without a shuffle: lines that no
run holds become the batch's own run, the counts of the others a run of a second, smaller ladder. FAN runs of a
level are compacted into one of the next, so a batch meets few runs however many came before.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_names, shared_dir, written

#: White space stripped at a line's ends; least code points of a key and documents of a repeated one (fixed values of the contract).
BLANK, LEAST_CHARS, LEAST_DOCS = "\t\n\x0b\x0c\r ", 40, 5
#: Batches that a whole table is added in; runs of a level that are compacted into one.
BATCHES, FAN = 4, 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["hash", "check"]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; translate, which goes character by character, only sees texts that aren't ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_hashes(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, batches: int = BATCHES) -> DataFrame:
    """(doc, whole, at, hash, check, batch) of every line whose key has at least least_chars code points.

    whole is the text's hash, as rows may share a doc_id; at is the line's position from 0. All rows of a
    doc_id fall into one batch."""
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("whole_text"))
    lines = rows.select("doc", F.xxhash64("whole_text").alias("whole"), F.posexplode(F.split("whole_text", "\n")).alias("at", "line"))
    bare = lines.select("doc", "whole", "at", F.btrim("line", F.lit(BLANK)).alias("line")).where(F.length("line") >= least_chars)
    low = bare.select("doc", "whole", "at", ascii_lower(F.col("line")).alias("line"))
    return low.select("doc", "whole", "at", F.xxhash64("line").alias("hash"), F.xxhash64(F.lit(1), "line").alias("check"), F.pmod(F.xxhash64(F.lit(2), "doc"), F.lit(batches)).cast("int").alias("batch"))


def own_run(lines: DataFrame) -> DataFrame:
    """(hash, check, n, last) of a batch's lines: n distinct documents (those without a doc_id are one), last the largest.

    First one row for each document and line, then counts combined before their shuffle: a hot line is no hot task."""
    return lines.select(*_KEY, "doc").distinct().groupBy(*_KEY).agg(F.count("*").alias("n"), F.max("doc").alias("last"))


class Runs:
    """Levels of sorted runs with the same buckets; what is added to a level beyond fan runs moves, merged, to the next."""

    def __init__(self, spark: SparkSession, buckets: int, fan: int = FAN):
        self.spark, self.buckets, self.fan = spark, buckets, fan
        self.levels: list[list[DataFrame]] = []

    def __iter__(self):
        return (run for level in self.levels for run in level)

    def add(self, run: DataFrame) -> None:
        """run, whose (hash, check) are unique, becomes a run of the first level."""
        self._put(0, self._sorted(run))

    def whole(self) -> DataFrame | None:
        """All runs as one; None if there are none."""
        runs = list(self)
        if len(runs) > 1:
            self.levels = [[self._merged(runs)]]
        return next(iter(self), None)

    def drop(self) -> None:
        for run in self:
            _gone(run)
        self.levels = []

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merged(full))

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        # read as plain files: Spark 4.1 takes a union of bucketed tables for bucketed too, and would sum a line's rows apart
        rows = reduce(DataFrame.unionByName, (self.spark.read.schema(run.schema).parquet(run._plumbline_path) for run in runs))
        out = self._sorted(rows.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last")))
        for run in runs:
            _gone(run)
        return out

    def _sorted(self, run: DataFrame) -> DataFrame:
        """run as a table of its own in the shared folder, bucketed as all are and sorted in each bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        run.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out._plumbline_path, out._plumbline_table = path, name
        return out


def _gone(run: DataFrame) -> None:
    run.sparkSession.sql(f"DROP TABLE IF EXISTS {run._plumbline_table}")
    discard(run)


class LineIndex:
    """Two ladders of runs: lines by the batch that first held them, and what later batches add to their counts."""

    def __init__(self, spark: SparkSession, fan: int = FAN):
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.first, self.later = Runs(spark, buckets, fan), Runs(spark, buckets, fan)

    def unseen(self, run: DataFrame) -> DataFrame:
        """The rows of an own_run() whose line no batch before held: run is anti-joined with each run, by merging sorted buckets."""
        return reduce(lambda left, held: left.join(held.select(_KEY).hint("merge"), _KEY, "left_anti"), self.first, run)

    def add(self, lines: DataFrame) -> None:
        """Adds a batch of line_hashes(). Batches must not share documents."""
        own = Runs(self.first.spark, self.first.buckets)
        own.add(own_run(lines))
        mine, held = own.whole(), [run.select(_KEY).hint("merge") for run in self.first]
        if held:
            self.later.add(reduce(DataFrame.unionByName, (mine.join(run, _KEY, "left_semi") for run in held)))
        self.first.add(self.unseen(mine))
        own.drop()

    def repeated(self, least_docs: int = LEAST_DOCS) -> DataFrame:
        """(hash, check, last) of lines in at least least_docs documents: each run merges with the counts of later batches."""
        later = self.later.whole()
        found = []
        for run in self.first:
            if later is not None:
                more = later.select(*_KEY, F.col("n").alias("more"), F.col("last").alias("after")).hint("merge")
                run = run.join(more, _KEY, "left").select(*_KEY, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("last", "after").alias("last"))
            found.append(run.where(F.col("n") >= least_docs).select(*_KEY, "last"))
        return reduce(DataFrame.unionByName, found)

    def drop(self) -> None:
        self.first.drop()
        self.later.drop()


def repeated_lines(lines: DataFrame, batches: int = BATCHES, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc, whole, gone): positions of each text's lines that a larger doc_id holds too and least_docs documents have."""
    index = LineIndex(lines.sparkSession)
    for b in range(batches):
        index.add(lines.where(F.col("batch") == b))
    hot = written(index.repeated(least_docs), "line-repeated")
    index.drop()
    # plain tables on both sides, so a hot line's partition is split
    return lines.join(hot.hint("merge"), _KEY).where(~F.col("doc").eqNullSafe(F.col("last"))).groupBy("doc", "whole").agg(F.collect_set("at").alias("gone"))


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, n_lines: str = "n_lines", n_dropped: str = "n_dropped"
) -> DataFrame:
    """docs without the lines that at least least_docs documents hold, except in the largest doc_id that holds one, and the columns n_lines (before) and n_dropped.

    A line's key is the line stripped of white space at both ends with A-Z lower-cased; shorter keys than least_chars
    code points stay. Null and empty texts are one empty line, and a text of which nothing is left is empty.
    Rows that share a doc_id are one document, those without a doc_id too, and that one is the smallest; exact repeats of a row lose the same lines.
    Other columns stay, but for columns named n_lines or n_dropped, which give way.
    Whole texts are shuffled once, to meet their lost lines; these travel as positions."""
    lines = written(line_hashes(docs, key, text, least_chars, batches), "line-hashes")
    gone = written(repeated_lines(lines, batches, least_docs), "line-positions")
    discard(lines)
    whole, doc, other, lost = free_names(docs.columns, "whole", "doc", "other", "gone")
    side = gone.toDF(doc, other, lost).hint("shuffle_hash")
    kept = docs.withColumn(whole, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    met = kept.join(side, kept[key].eqNullSafe(side[doc]) & (kept[whole] == side[other]), "left")
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lost))
    # the lines are bound to a name once, not split again for each
    left = F.flatten(F.transform(F.array(parts), lambda lines: F.transform(stay, lambda i: F.get(lines, i))))
    clean = F.when(F.col(lost).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(left, "\n"))
    own = [c for c in docs.columns if c.lower() not in (n_lines.lower(), n_dropped.lower())]
    return met.select(
        *(clean.alias(c) if c == text else F.col(c) for c in own),
        F.size(parts).cast("long").alias(n_lines),
        F.coalesce(F.size(F.col(lost)), F.lit(0)).cast("long").alias(n_dropped),
    )


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_lines, n_dropped, kept_sha256) of drop_repeated_lines()."""
    rows = drop_repeated_lines(docs.select(key, text), key, text)
    return rows.select(key, "n_lines", "n_dropped", F.sha2(F.col(text), 256).alias("kept_sha256"))


def digest_sql() -> str:
    """DuckDB SQL for digest() over documents: every line by its key itself."""
    blank = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT rid, doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM docs),
keyed AS (SELECT rid, doc_id, pos, line, translate(trim(line, {blank}), '{UPPER}', '{LOWER}') AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) + CAST(count(*) > count(doc_id) AS INT) >= {LEAST_DOCS}),
marked AS (SELECT rid, doc_id, pos, line, coalesce(hot.k IS NOT NULL AND doc_id IS DISTINCT FROM last, false) AS gone FROM keyed LEFT JOIN hot ON keyed.k = hot.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY rid"""
