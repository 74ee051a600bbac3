"""Sessions, representatives, samples and other ordered operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import hash_bucket


#: Minutes of a stretch of time within which a key's rows are ordered by one task.
STRETCH = 7 * 24 * 60


def _placed(df: DataFrame, keys: list[str], side: DataFrame) -> DataFrame:
    """df joined with side on keys, null with null; side's own columns are added."""
    renamed = side.withColumnsRenamed({k: f"{k}of_" for k in keys})
    return df.join(renamed, [F.col(k).eqNullSafe(F.col(f"{k}of_")) for k in keys]).drop(*(f"{k}of_" for k in keys))


def sessionize(df: DataFrame, key: str, ts: str, gap_minutes: float, tie: str | None = None, out: str = "session_id", stretch_minutes: int = STRETCH) -> DataFrame:
    """A new session where the gap to the key's previous row is longer than gap_minutes; ids are key_s0, key_s1 and so on.

    Adds order_within_speaker, from 0. Rows of equal time are ordered by tie. A segmented scan: each stretch of time of a key is scanned
    by itself, and a second scan over stretches, one row each, carries the last time, sessions and rows on, so a key with most rows is many tasks."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    marked = df.withColumn("stretch_", F.floor(micros / (stretch_minutes * 60_000_000)))
    w = Window.partitionBy(key, "stretch_").orderBy(ts, *([tie] if tie else []))
    longer = lambda a, b: F.when(a - b > int(gap_minutes * 60_000_000), 1).otherwise(0)
    inner = marked.withColumn("micros_", micros).withColumn("opens_", longer(F.col("micros_"), F.lag("micros_").over(w))).withColumn("at_", F.sum("opens_").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("row_", F.row_number().over(w))
    of = inner.groupBy(key, "stretch_").agg(F.min("micros_").alias("first_"), F.max("micros_").alias("last_"), F.sum("opens_").alias("inside_"), F.count("*").alias("rows_"))
    over = Window.partitionBy(key).orderBy("stretch_")
    upto = over.rowsBetween(Window.unboundedPreceding, -1)
    opened = of.withColumn("joint_", longer(F.col("first_"), F.lag("last_").over(over)))
    carried = opened.select(key, "stretch_", (F.coalesce(F.sum(F.col("inside_") + F.col("joint_")).over(upto), F.lit(0)) + F.col("joint_")).alias("sessions_"), F.coalesce(F.sum("rows_").over(upto), F.lit(0)).alias("before_"))
    joined = _placed(inner, [key, "stretch_"], carried)
    number = (F.col("sessions_") + F.col("at_")).cast("string")
    return joined.select(*df.columns, F.concat(F.col(key).cast("string"), F.lit("_s"), number).alias(out), (F.col("before_") + F.col("row_") - 1).cast("long").alias("order_within_speaker"))


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row of each key, the first in an explicit order. min_by combines before the shuffle, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row_")).select(*keys, *(F.col(f"row_.{c}").alias(c) for c in rest))


def label_switches(df: DataFrame, key: str, order: list[str], label: str, stretch: Column | None = None) -> DataFrame:
    """By key: rows and changes of the label from one row to the next. stretch, a function that never falls along the order, cuts a key into parts that are
    scanned apart; their first and last labels meet in a second scan."""
    marked = df.withColumn("stretch_", F.lit(0) if stretch is None else stretch)
    changed = lambda a, b: F.count_if(a.isNotNull() & (a != b))
    before = F.lag(label).over(Window.partitionBy(key, "stretch_").orderBy(*order))
    at = F.struct(*order)
    of = marked.withColumn("before_", before).groupBy(key, "stretch_").agg(F.count("*").alias("n_"), changed(F.col("before_"), F.col(label)).alias("inside_"), F.min_by(label, at).alias("first_"), F.max_by(label, at).alias("last_"))
    joint = of.withColumn("left_", F.lag("last_").over(Window.partitionBy(key).orderBy("stretch_")))
    return joint.groupBy(key).agg(F.sum("n_").alias("n"), (F.sum("inside_") + changed(F.col("left_"), F.col("first_"))).alias("switches"))


#: Hashes below 2**32 that share a bucket of numbered().
HASHES = 1 << 20


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], keep: Column | None = None) -> DataFrame:
    """Adds rank_, from 0 in the key's order, and total_, the key's rows. bucket is a function that never falls along the order.

    Rows are numbered within their bucket and offset by the sizes of the buckets before, so a key with very many rows is no hot task; only
    the sizes, one for each bucket that there is, meet by key. keep: a condition on before_ (the least rank of a bucket) and total_ by which buckets are left out first."""
    marked = df.withColumn("bucket_", bucket)
    sizes = marked.groupBy(*keys, "bucket_").agg(F.count("*").alias("n_"))
    w, names = Window.partitionBy(*keys), [*keys, "bucket_"]
    before = F.sum("n_").over(w.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_")
    placed = sizes.select(*(F.col(k).alias(f"of_{i}_") for i, k in enumerate(names)), before.alias("before_"), F.sum("n_").over(w).alias("total_"))
    same = [F.col(k).eqNullSafe(F.col(f"of_{i}_")) for i, k in enumerate(names)]
    joined = marked.join(placed, same).drop(*(f"of_{i}_" for i in range(len(names))))
    within = F.row_number().over(Window.partitionBy(*names).orderBy(*order)) - 1
    return (joined if keep is None else joined.where(keep)).withColumn("rank_", F.col("before_") + within).drop("bucket_", "before_")


def by_hash(df: DataFrame, keys: list[str], text: Column, tie: str, hashes: int = HASHES, keep: Column | None = None) -> DataFrame:
    """numbered() in the order of a hash of text, then tie."""
    marked = df.withColumn("hash_", hash_bucket(text))
    return numbered(marked, keys, F.floor(F.col("hash_") / hashes), ["hash_", tie], keep).drop("hash_")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each stratum in the order of a hash of seed and key."""
    ranked = by_hash(df, [stratum], F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), key, keep=F.col("before_") < n)
    return ranked.where(F.col("rank_") < n).drop("rank_", "total_")


def stride_sample(df: DataFrame, stratum: str, order: list[str], n: int) -> DataFrame:
    """Every max(1, size // n)-th row of each stratum from the first on, n at most. Rows are numbered by the first column of the order, value by value."""
    ranked = numbered(df, [stratum], F.col(order[0]), order).withColumn("stride_", F.greatest(F.lit(1), F.floor(F.col("total_") / n)))
    return ranked.where((F.col("rank_") % F.col("stride_") == 0) & (F.col("rank_") < F.col("stride_") * n)).drop("rank_", "total_", "stride_")


def top_k(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)
