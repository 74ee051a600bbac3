"""Gates: conditions on data that fail a job instead of passing wrong rows on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A gate's condition does not hold."""


def assert_unique(df: DataFrame, keys: list[str], what: str = "rows") -> DataFrame:
    """df, if no key occurs twice. Stops at the first repeated key that Spark finds."""
    again = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if again:
        raise GateError(f"{what}: {again[0].asDict()} is not unique")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """A join whose sides are unique in the keys as validate says: one_to_one, one_to_many, many_to_one or many_to_many."""
    one_left, one_right = {"one_to_one": (1, 1), "one_to_many": (1, 0), "many_to_one": (0, 1), "many_to_many": (0, 0)}[validate]
    if one_left:
        assert_unique(left, on, "left side")
    if one_right:
        assert_unique(right, on, "right side")
    return left.join(right, on, how)


def assert_count(df: DataFrame, expected: int, what: str = "rows") -> DataFrame:
    found = df.count()
    if found != expected:
        raise GateError(f"{what}: {found} instead of {expected}")
    return df


def assert_complete(df: DataFrame, keys: list[str], member: str, expected: int) -> DataFrame:
    """df, if every key has expected distinct members (such as three seeds)."""
    bad = df.groupBy(*keys).agg(F.count_distinct(member).alias("n")).where(F.col("n") != expected).limit(1).collect()
    if bad:
        raise GateError(f"{bad[0].asDict()}: {expected} {member} values are expected")
    return df


def aligned(spine: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """other's columns on the spine's keys; a key that other lacks is an error raised by the job itself."""
    marked = other.withColumn("here_", F.lit(True))
    joined = spine.join(marked, on, "left")
    held = F.when(F.col("here_").isNull(), F.raise_error(F.concat(F.lit("missing key "), F.concat_ws(",", *(F.col(c).cast("string") for c in on))))).otherwise(F.col(on[0]))
    return joined.select(held.alias(on[0]), *(c for c in joined.columns if c not in (on[0], "here_")))


def required_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df with trimmed, lower-cased column names, if it has those that are required."""
    out = df.toDF(*(c.strip().lower() for c in df.columns))
    if missing := [n for n in names if n not in out.columns]:
        raise GateError(f"missing columns: {missing}")
    return out


def encoded_labels(df: DataFrame, column: str, positive: str, negative: str, out: str = "label") -> DataFrame:
    """1 and 0 for the two names; any other fails the job."""
    name = F.lower(F.trim(column))
    return df.withColumn(out, F.when(name == positive, 1).when(name == negative, 0).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(column), F.lit("null"))))).cast("int"))


def published(values: DataFrame, registry: DataFrame) -> DataFrame:
    """(key, expected, recomputed, ok): what a registry (key, expected, digits, tolerance) says against values (key, value).

    A value counts as recomputed once it is rounded to digits (null: as it is); it may then differ by tolerance (null: not at all). A key without a value is not ok."""
    met = registry.join(values.select(F.col("key").alias("of_"), F.col("value").cast("double").alias("value_")), F.col("key") == F.col("of_"), "left")
    # a column can't be round()'s second argument: scaled, rounded and scaled back
    scale = F.pow(F.lit(10.0), F.col("digits"))
    rounded = F.when(F.col("digits").isNull(), F.col("value_")).otherwise(F.round(F.col("value_") * scale) / scale)
    ok = F.coalesce(F.abs(rounded - F.col("expected")) <= F.coalesce("tolerance", F.lit(0.0)) + 1e-12, F.lit(False))
    return met.select("key", "expected", rounded.alias("recomputed"), ok.alias("ok"))


def assert_published(checked: DataFrame) -> DataFrame:
    """checked, if all of published() is ok; else an error that names up to ten keys with both numbers."""
    bad = checked.where("not ok").orderBy("key").limit(10).collect()
    if bad:
        raise GateError("published numbers are not reproduced: " + "; ".join(f"{r.key}: {r.expected}, recomputed {r.recomputed}" for r in bad))
    return checked
