"""Confusion counts and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("tn", "fp", "fn", "tp")


def confusion_counts(label: Column | str = "label", predicted: Column | str = "predicted") -> list[Column]:
    y, p = (F.col(c) if isinstance(c, str) else c for c in (label, predicted))
    return [F.count_if((y == a) & (p == b)).alias(name) for name, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]


def f1(hits: Column, missed: Column, false: Column) -> Column:
    """2 hits / (2 hits + missed + false); 0 if there is nothing to find and nothing found."""
    below = 2 * hits + missed + false
    return F.when(below > 0, 2.0 * hits / below).otherwise(F.lit(0.0))


def macro_f1(prefix: str = "") -> Column:
    tn, fp, fn, tp = (F.col(prefix + c) for c in COUNTS)
    return (f1(tp, fn, fp) + f1(tn, fp, fn)) / 2


def full_metrics() -> dict[str, Column]:
    tn, fp, fn, tp = map(F.col, COUNTS)
    n = F.greatest(tn + fp + fn + tp, F.lit(1))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "macro_f1": macro_f1(),
        "accuracy": (tp + tn) / n,
        "f1_positive": f1(tp, fn, fp),
        "f1_negative": f1(tn, fp, fn),
        "precision_positive": share(tp, tp + fp),
        "recall_positive": share(tp, tp + fn),
        "precision_negative": share(tn, tn + fn),
        "recall_negative": share(tn, tn + fp),
        "predicted_positive_rate": (tp + fp) / n,
    }


def scored(df: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """Counts and all metrics by keys, rounded."""
    counted = df.groupBy(*keys).agg(*confusion_counts())
    return counted.select(*keys, *COUNTS, *(F.round(c, digits).alias(k) for k, c in full_metrics().items()))
