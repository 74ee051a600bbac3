"""The audit of a corpus: facts about what a manifest keeps, and a log of what is wrong with its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Issues of the log with what each is a kind of.
ISSUES = {"empty_text": "unusable", "short_text": "unusable", "no_letters": "content", "ambiguous_copy": "identity", "label_conflict": "label", "missing_label": "label"}


def problem_log(rows: DataFrame, key: str, speaker: str, conditions: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(key, speaker, issue, kind, detail): a row for each condition, issue: (holds, detail), that a row meets, all in one pass."""
    met = [F.when(holds, F.struct(F.lit(i).alias("issue"), F.lit(ISSUES[i]).alias("kind"), detail.cast("string").alias("detail"))) for i, (holds, detail) in conditions.items()]
    return rows.select(key, speaker, F.explode(F.array_compact(F.array(*met))).alias("x")).select(key, speaker, "x.*")


def observed(rows: DataFrame, facts: dict[str, Column], write) -> tuple[DataFrame, dict]:
    """What write(rows) returns, and the facts (plain aggregates) of all rows, gathered while they are written. A job that runs again counts again, so write must run one job over rows."""
    seen = Observation()
    out = write(rows.observe(seen, *(c.alias(k) for k, c in facts.items())))
    return out, seen.get


def long_facts(spark, facts: dict[str, float | None]) -> DataFrame:
    return spark.createDataFrame([(k, "", None if x is None else float(x)) for k, x in facts.items()], "fact string, key string, value double")


def counted(rows: DataFrame, fact: str, by: str) -> DataFrame:
    """(fact, key, value): rows by a column, null as ''."""
    return rows.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit(fact).alias("fact"), "key", "value")
