"""Exact quantiles of few groups without gathering a group in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins that a stretch of values is cut into in a round; groups at most, as their state is held by the driver.
BINS, GROUPS = 1024, 4096


def exact_quantiles(df: DataFrame, keys: list[str], value: Column | str, qs: list[float], bins: int = BINS) -> DataFrame:
    """(keys, q, value): linear interpolation between the two neighbours of q * (n - 1), as percentile() has it, of each group's finite values.

    A wanted rank lies in a stretch of values, at first the group's whole range. Each round counts a stretch's values in bins, combined
    before they are shuffled, and goes on with the least and the largest value of the bin that holds the rank, until
    they are equal. So a round moves bins, not values, whatever the number of rows or of equal ones. Groups without values have no row; df should be
    stored where its values are dear, as each of the few rounds reads it."""
    spark = df.sparkSession
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, value.cast("double").alias("value_")).where(F.col("value_").isNotNull() & ~F.isnan("value_") & (F.abs("value_") < float("inf")))
    group = F.struct(*keys) if keys else F.lit(0)
    spans = rows.groupBy(*keys).agg(F.count("*").alias("n_"), F.min("value_").alias("low_"), F.max("value_").alias("high_")).where("n_ > 0").limit(GROUPS + 1).collect()
    if len(spans) > GROUPS:
        raise ValueError(f"over {GROUPS} groups")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    wanted = {}  # (group number, rank): [rank within the stretch, low, high]
    for g, r in enumerate(spans):
        for q in qs:
            for rank in {math.floor(q * (r.n_ - 1)), math.ceil(q * (r.n_ - 1))}:
                wanted[g, rank] = [rank, r.low_, r.high_]
    while True:
        stretches = sorted({(g, w[1], w[2]) for (g, _), w in wanted.items() if w[1] < w[2]})
        if not stretches:
            break
        number = {s: i for i, s in enumerate(stretches)}
        ddl = ", ".join(["at_ int", *(f"of_{i}_ {kinds[k]}" for i, k in enumerate(keys)), "from_ double", "to_ double"])
        side = F.broadcast(spark.createDataFrame([(i, *(spans[g][k] for k in keys), a, b) for (g, a, b), i in number.items()], ddl))
        same = F.col("value_").between(F.col("from_"), F.col("to_"))
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"of_{i}_"))
        # halves, so that the width of no stretch overflows
        share = (F.col("value_") / 2 - F.col("from_") / 2) / (F.col("to_") / 2 - F.col("from_") / 2)
        binned = rows.join(side, same).withColumn("bin_", F.least(F.floor(share * bins), F.lit(bins - 1)))
        counts = binned.groupBy("at_", "bin_").agg(F.count("*").alias("n_"), F.min("value_").alias("low_"), F.max("value_").alias("high_"))
        held: dict[int, list] = {}
        for r in counts.orderBy("at_", "bin_").toLocalIterator():
            held.setdefault(r.at_, []).append(r)
        for (g, _), w in wanted.items():
            for r in held.get(number.get((g, w[1], w[2]), -1), []):
                if w[0] < r.n_:
                    w[1:] = r.low_, r.high_
                    break
                w[0] -= r.n_
    out = []
    for g, r in enumerate(spans):
        for q in qs:
            at = q * (r.n_ - 1)
            low, high = math.floor(at), math.ceil(at)
            a, b = wanted[g, low][1], wanted[g, high][1]
            out.append((*(r[k] for k in keys), float(q), a if low == high or a == b else (high - at) * a + (at - low) * b))
    return spark.createDataFrame(out, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "q double", "value double"]))


def wide_quantiles(df: DataFrame, keys: list[str], value: Column | str, named: dict[str, float]) -> DataFrame:
    """(keys, one column for each name): exact_quantiles() with a row for each group; one row of nulls if there are no keys and no values."""
    long = exact_quantiles(df, keys, value, list(named.values()))
    return long.groupBy(*keys).agg(*(F.max(F.when(F.col("q") == q, F.col("value"))).alias(name) for name, q in named.items()))
