"""Numbers, binnings and vectors as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def hash_bucket(text: Column) -> Column:
    """A number below 2**32 from the md5 of a text; any engine can draw the same."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_uniform(text: Column) -> Column:
    return hash_bucket(text) / F.lit(4294967296.0)


def ratio(a: Column, b: Column, floor: float = 1.0) -> Column:
    """a / b, the denominator at least floor."""
    return a / F.greatest(b.cast("double"), F.lit(floor))


def decibels(edge: Column, full: Column) -> Column:
    return F.lit(20.0) * F.log10(F.greatest(edge, F.lit(1e-12)) / F.greatest(full, F.lit(1e-12)))


def right_closed_bins(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the first edge that x does not exceed; the last label beyond; 'nan' for null."""
    out = F.when(x.isNull() | F.isnan(x), "nan")
    for e, name in zip(edges, labels, strict=False):
        out = out.when(x <= e, name)
    return out.otherwise(labels[-1])


def l2_normalized(v: Column, floor: float = 1e-9) -> Column:
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(floor))
    return F.transform(v, lambda x: x.cast("double") / norm)


def signal_stats(v: Column, edge: int = 8, clip: float = 0.99) -> dict[str, Column]:
    """Clipping share, offset, levels and noise floors (the tenth percentile of the absolute edge) of a signal; zeros for an empty one."""
    n = F.size(v)
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(F.lit(0.0))
    squares = lambda a: F.transform(a, lambda x: x.cast("double") * x.cast("double"))
    head, tail = F.slice(v, 1, edge), F.slice(v, F.greatest(n - edge + 1, F.lit(1)), edge)

    def floor(a):
        sizes = F.array_sort(F.transform(a, lambda x: F.abs(x.cast("double"))))
        at = (F.size(a) - 1) * 0.1
        low, high = (F.get(sizes, f(at).cast("int")) for f in (F.floor, F.ceil))
        return F.when(F.size(a) > 0, low + (high - low) * (at - F.floor(at))).otherwise(F.lit(0.0))

    return {
        "clipping_fraction": mean(F.transform(v, lambda x: F.when(F.abs(x) >= clip, 1.0).otherwise(0.0))),
        "dc_offset": mean(F.transform(v, lambda x: x.cast("double"))),
        "leading_rms": F.sqrt(mean(squares(head))),
        "trailing_rms": F.sqrt(mean(squares(tail))),
        "full_rms": F.sqrt(mean(squares(v))),
        "leading_noise_floor": floor(head),
        "trailing_noise_floor": floor(tail),
    }


def spectral_centroid(rate: int = 16_000):
    """A function of an array column: the mean frequency of a signal's spectrum by magnitude; 0 for an empty or null one. Signals of equal length go through one transform."""
    @pandas_udf("double")
    def centroid(signals: pd.Series) -> pd.Series:
        out = np.zeros(len(signals))
        sizes = np.array([0 if s is None else len(s) for s in signals])
        for n in set(sizes.tolist()) - {0}:
            which = np.flatnonzero(sizes == n)
            size = np.abs(np.fft.rfft(np.array([signals.iloc[i] for i in which], float)))
            out[which] = size @ np.fft.rfftfreq(n, 1 / rate) / np.maximum(size.sum(1), 1e-9)
        return pd.Series(out)

    return centroid
