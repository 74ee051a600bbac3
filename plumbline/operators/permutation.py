"""Permutation nulls of a whole pipeline: labels dealt between groups, folds made anew, models fitted again, for each replicate.

A deal needs no table of groups by replicates. Each group has a hash for every replicate, a bijection of its key, and
a group is positive if its hash is below the replicate's cut-off, the one that leaves as many positive groups as there are; folds are
cut off likewise within each label. Cut-offs are selected by histograms that are refined around the wanted ranks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .many_models import CELLS, fit, macro_f1, tested_counts

#: Bits of a histogram's bins at most; values that are left around all wanted ranks before they are looked at one by one.
BITS, VALUES = 12, 1 << 19
_MAX = np.uint64((1 << 64) - 1)


def mixed(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that looks random (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def hashes(keys: np.ndarray, seed: int, use: int, replicates: np.ndarray) -> np.ndarray:
    """(keys, replicates) hashes: for each replicate and use one that gives different keys different values."""
    with np.errstate(over="ignore"):
        stream = mixed(replicates.astype(np.uint64) * np.uint64(2) + np.uint64(use) + mixed(np.array([seed], np.uint64)))
        return mixed(mixed(keys.astype(np.int64).view(np.uint64))[:, None] + stream[None])


def cut_offs(groups: DataFrame, size: int, targets: np.ndarray, ranks: np.ndarray, of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """For each wanted (target, rank) the hash that so many of the target's hashes are below; the largest of all where there are no more.

    of(batch) gives (rows, width) hashes and whether a row belongs to the target. Each round counts, in the bin that holds a rank, by finer
    bins; counts meet in Spark by bin, and one row for each wanted rank reaches the driver."""
    spark = groups.sparkSession
    prefix, rest, used = np.zeros(len(ranks), np.uint64), ranks.astype(np.int64), 0
    left = np.full(len(ranks), size)
    while left.sum() > VALUES and used < 60 or not used:
        bits = min(BITS, max(1, int(np.log2(max(2, left.max() / 8)))), 64 - used)
        cells, cell_of = np.unique(np.column_stack([targets.astype(np.uint64), prefix]), axis=0, return_inverse=True)
        cell_of = cell_of.reshape(-1)

        def counted(batches, cells=cells, bits=bits, used=used):
            held: dict[int, int] = {}
            for c, v in _matching(batches, of, cells, used, width):
                flat, n = np.unique(c << bits | (v >> np.uint64(64 - used - bits) & np.uint64((1 << bits) - 1)).astype(np.int64), return_counts=True)
                for k, x in zip(flat.tolist(), n.tolist(), strict=True):
                    held[k] = held.get(k, 0) + x
            if held:
                flat = np.fromiter(held, np.int64)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(flat >> bits, pa.int64()), "bin": pa.array(flat & ((1 << bits) - 1), pa.int64()), "n": pa.array(np.fromiter(held.values(), np.int64))})

        bins = groups.mapInArrow(counted, "cell bigint, bin bigint, n bigint").groupBy("cell", "bin").agg(F.sum("n").alias("n"))
        upto = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("cell").orderBy("bin")))
        wanted = spark.createDataFrame([(int(c), int(r), i) for i, (c, r) in enumerate(zip(cell_of, rest, strict=True))], "cell long, rank long, at int")
        met = upto.join(F.broadcast(wanted), "cell").where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        found = {r["at"]: r for r in met.collect()}
        for i in range(len(ranks)):
            r = found.get(i)
            if r is None:  # a rank beyond the target's rows
                left[i], rest[i] = 0, -1
            else:
                prefix[i] = np.uint64(int(prefix[i]) << bits | r["bin"])
                rest[i] -= r["upto"] - r["n"]
                left[i] = r["n"]
        used += bits
    cells, cell_of = np.unique(np.column_stack([targets.astype(np.uint64), prefix]), axis=0, return_inverse=True)
    cell_of = cell_of.reshape(-1)

    def listed(batches):
        for c, v in _matching(batches, of, cells, used, width):
            yield pa.RecordBatch.from_pydict({"cell": pa.array(c, pa.int64()), "value": pa.array(v.view(np.int64))})

    values: dict[int, list[int]] = {}
    for r in groups.mapInArrow(listed, "cell bigint, value bigint").toLocalIterator():
        values.setdefault(r.cell, []).append(r.value % (1 << 64))
    ordered = {c: np.sort(np.array(v, np.uint64)) for c, v in values.items()}
    return np.array([ordered[c][r] if r >= 0 else _MAX for c, r in zip(cell_of.tolist(), rest.tolist(), strict=True)], np.uint64)


def _matching(batches, of, cells, used, width):
    """(cells, hashes) of the rows' hashes that lie in cells (target, prefix of used bits)."""
    target, prefix = cells[:, 0].astype(np.int64), cells[:, 1]
    step = max(1, CELLS // max(width, len(cells)))
    for batch in batches:
        for s in range(0, batch.num_rows, step):
            cut = batch.slice(s, step)
            value, member = of(cut)
            v, inside = value[:, target], member[:, target]
            if used:
                inside = inside & (v >> np.uint64(64 - used) == prefix)
            _, c = np.nonzero(inside)
            yield c, v[inside]


@dataclass(frozen=True)
class Deals:
    """A design of many_models: labels and folds of rows (key: the group's, label) in replicates from start on; replicate 0 is the labels as they are.

    positive: a cut-off for each replicate; edges: (replicates, label, folds - 1) of them."""

    folds: int
    seed: int
    positive: np.ndarray
    edges: np.ndarray
    start: int = 0

    @property
    def models(self) -> int:
        return len(self.positive) * self.folds

    def part(self, start: int, stop: int) -> Deals:
        return Deals(self.folds, self.seed, self.positive[start:stop], self.edges[start:stop], start)

    def dealt(self, batch: pa.RecordBatch) -> np.ndarray:
        """(rows, replicates): whether the row's group is positive."""
        out = self._hashes(batch, 0) < self.positive
        if self.start == 0:
            out[:, 0] = batch.column("label").to_numpy() == 1
        return out

    def _hashes(self, batch, use):
        return hashes(batch.column("key").to_numpy(), self.seed, use, np.arange(self.start, self.start + len(self.positive)))

    def fold(self, batch: pa.RecordBatch) -> np.ndarray:
        edges = np.where(self.dealt(batch)[..., None], self.edges[:, 1], self.edges[:, 0])
        return (self._hashes(batch, 1)[..., None] >= edges).sum(-1)

    def labels(self, batch):
        return np.repeat(self.dealt(batch), self.folds, 1).astype(float)

    def tested(self, batch):
        return (self.fold(batch)[..., None] == np.arange(self.folds)).reshape(batch.num_rows, -1)

    def training(self, batch):
        return ~self.tested(batch)


def deals(groups: DataFrame, replicates: int, folds: int, seed: int) -> Deals:
    """The deals of replicates permutations, and before them that of the true labels, over groups (key: distinct integers, label).

    As many groups are positive in each as there are; folds are whole groups, within each label of equal size to within one."""
    size, ones = (int(x or 0) for x in groups.agg(F.count("*"), F.sum("label")).first())
    n = replicates + 1
    plain = Deals(folds, seed, np.full(n, _MAX), np.zeros((n, 2, folds - 1), np.uint64))
    all_of = lambda batch: (plain._hashes(batch, 0), np.ones((batch.num_rows, n), bool))
    plain = Deals(folds, seed, cut_offs(groups, size, np.arange(n), np.full(n, ones), all_of, n), plain.edges)

    def by_label(batch):
        h, up = plain._hashes(batch, 1), plain.dealt(batch)
        return np.repeat(h, 2, 1), np.stack([~up, up], 2).reshape(len(h), -1)

    ranks = np.array([round(k * f / folds) for k in (size - ones, ones) for f in range(1, folds)])
    edges = cut_offs(groups, size, np.repeat(np.arange(2 * n), folds - 1), np.tile(ranks, n), by_label, 2 * n)
    return Deals(folds, seed, plain.positive, edges.reshape(n, 2, folds - 1))


def null_scores(rows: DataFrame, groups: DataFrame, width: int, replicates: int, folds: int = 5, seed: int = 20260922, at_once: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(pooled, mean of folds) macro-F1 of the true labels and then of each replicate: each makes folds anew and fits its folds' models again.

    rows (key, label, x: array of width doubles) are read some ten times for every at_once replicates."""
    deal, pooled, mean = deals(groups, replicates, folds, seed), [], []
    for s in range(0, replicates + 1, at_once):
        some = deal.part(s, s + at_once)
        counts = tested_counts(rows, fit(rows, width, some), some).reshape(-1, folds, 4)
        pooled.append(macro_f1(counts.sum(1)))
        mean.append(macro_f1(counts).mean(1))
    return np.concatenate(pooled), np.concatenate(mean)
