"""Choice of thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import macro_f1


def best_thresholds(df: DataFrame, keys: list[str], label: str, prob: str, grid: int = 1000) -> DataFrame:
    """(keys, t, ties, f): the threshold t / grid with the best macro-F1 of prob >= t / grid; of ties the nearest to a half, then the smaller.

    One histogram and one reverse running sum for each key, so rows are read once and not joined with the grid."""
    hist = df.groupBy(*keys, F.floor(F.col(prob) * grid).cast("int").alias("b")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    spine = df.select(*keys).distinct().crossJoin(F.broadcast(df.sparkSession.range(grid + 1).select(F.col("id").cast("int").alias("b"))))
    full = spine.join(hist, [*keys, "b"], "left").fillna({"pos": 0, "neg": 0})
    above = Window.partitionBy(*keys).orderBy(F.desc("b"))
    whole = Window.partitionBy(*keys)
    swept = full.select(*keys, F.col("b").alias("t"), F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(whole).alias("p_"), F.sum("neg").over(whole).alias("n_"))
    scored = swept.withColumn("fn", F.col("p_") - F.col("tp")).withColumn("tn", F.col("n_") - F.col("fp")).withColumn("f", F.round(macro_f1(), 12))
    best = scored.withColumn("best", F.max("f").over(whole)).where(F.col("f") == F.col("best"))
    return best.groupBy(*keys).agg(F.min_by("t", F.struct(F.abs(F.col("t") - grid // 2), "t")).alias("t"), F.count("*").alias("ties"), F.max("f").alias("f"))
