"""Resampling inference over groups by sufficient statistics.

A cluster bootstrap needs each group's confusion counts only: a resample is how often each group is drawn times its counts. Draws
come from md5 hashes of (seed, iteration, position), so any engine repeats them; all conditions share them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import hash_bucket
from ..sources.writers import dropped, kept
from .metrics import COUNTS, confusion_counts, macro_f1
from .windows import by_hash

#: Groups that are broadcast (four bytes each at most), and kinds of them (some 200 bytes each); draws a task makes; draws hashed at once; cells (iterations x kinds) counted at once.
BROADCAST_GROUPS, KINDS, DRAWS, HASHED, CELLS = 1 << 24, 100_000, 32_000_000, 1 << 16, 1 << 22

_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_PLACES = (lambda k: k, lambda k: (5 * k + 1) % 16, lambda k: (3 * k + 5) % 16, lambda k: 7 * k % 16)
_SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def group_positions(df: DataFrame, group: str, width: int = 1 << 16) -> DataFrame:
    """(group, position): groups numbered from 0 in order.

    Integer groups are numbered within buckets of width ids and offset by the buckets before, so only bucket sizes meet in one task."""
    groups = df.select(group).distinct()
    bucket = F.floor(F.col(group) / width) if dict(groups.dtypes)[group] in ("int", "bigint") else F.substring(F.col(group).cast("string"), 1, 2)
    marked = groups.withColumn("bucket_", bucket)
    sizes = marked.groupBy("bucket_").agg(F.count("*").alias("n_"))
    before = sizes.withColumn("before_", F.sum("n_").over(Window.orderBy("bucket_")) - F.col("n_")).drop("n_")
    within = F.row_number().over(Window.partitionBy("bucket_").orderBy(group)) - 1
    return marked.withColumn("at_", within).join(before, "bucket_").select(group, (F.col("at_") + F.col("before_")).cast("long").alias("position"))


def slots(spark: SparkSession, n_groups: int, iterations: int, seed: int) -> DataFrame:
    """(iteration, position): a row for each draw, n_groups draws with replacement an iteration; a task has a stretch of iterations."""
    total = iterations * n_groups
    rows = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, total // DRAWS + 1))
    rows = rows.select(F.floor(F.col("id") / n_groups).alias("iteration"), (F.col("id") % n_groups).alias("slot"))
    position = hash_bucket(F.concat_ws("|", F.lit(str(seed)), F.col("iteration").cast("string"), F.col("slot").cast("string"))) % n_groups
    return rows.select("iteration", position.alias("position"))


def draws(spark: SparkSession, n_groups: int, iterations: int, seed: int) -> DataFrame:
    """(iteration, position, times): how often each iteration draws each group, n_groups draws with replacement."""
    return slots(spark, n_groups, iterations, seed).groupBy("iteration", "position").agg(F.count("*").alias("times"))


def md5_heads(words: Sequence[np.ndarray | int]) -> np.ndarray:
    """The first four bytes of the md5 of padded one-block texts, as numbers; words: 16, each an array of uint32 or a number that all texts share.

    These bytes are made in the last step but three."""
    a, b, c, d = (np.full(max(np.size(w) for w in words), x, np.uint32) for x in _START)
    t, spare = np.empty_like(a), np.empty_like(a)
    for k in range(61):
        turn, word, f = k // 16, words[_PLACES[k // 16](k)], spare
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if isinstance(word, np.ndarray):
            f += word
            word = 0
        f += np.uint32((_SINES[k] + word) & 0xFFFFFFFF)
        shift = _TURNS[turn][k % 4]
        np.left_shift(f, np.uint32(shift), out=t)
        f >>= np.uint32(32 - shift)
        f |= t
        f += b
        a, b, c, d, spare = d, f, b, c, a
    b += np.uint32(_START[0])
    return b.byteswap(inplace=True)


def _texts(seed: int, digits: int, slots: np.ndarray, times: int) -> np.ndarray:
    """Padded texts seed|iteration|slot as bytes (16, times * slots, 4), the iteration's digits left open."""
    head = f"{seed}|{'0' * digits}|".encode()
    text = np.array([head + b"%d" % k + b"\x80" for k in slots.tolist()], "S56").view(np.uint8).reshape(len(slots), 56)
    block = np.zeros((len(slots), 64), np.uint8)
    block[:, :56] = text
    bits = 8 * (len(head) + np.char.str_len(slots.astype(str)))
    block[:, 56], block[:, 57] = bits & 255, bits >> 8
    return np.ascontiguousarray(np.tile(block, (times, 1)).reshape(-1, 16, 4).transpose(1, 0, 2))


def _stretch(seed: int, digits: int, slots: np.ndarray) -> list[np.ndarray | int]:
    """Words of _texts() for md5_heads(), where all slots share one as a number."""
    return [int(w[0]) if (w == w[0]).all() else w for w in _texts(seed, digits, slots, 1).view(np.uint32)[..., 0]]


def _of_iteration(words: list, seed: int, iteration: int) -> list:
    """Words of _stretch() with the iteration's digits, which were 0."""
    out = list(words)
    for at, digit in enumerate(str(iteration), len(str(seed)) + 1):
        x = int(digit) << 8 * (at % 4)
        out[at // 4] = out[at // 4] + (np.uint32(x) if isinstance(out[at // 4], np.ndarray) else x)
    return out


def _resampled(spark: SparkSession, frames: list[tuple[np.ndarray, np.ndarray]], iterations: int, seed: int) -> DataFrame:
    """(frame, iteration, sums): sums of each frame's counts over the draws of slots(); iteration -1 takes each position once.

    A frame is the kind of each position and the counts of each kind. A draw's hash does not depend on the number of groups, so it is made
    once for all frames; a task counts how often an iteration draws each kind."""
    most = max(len(of) for of, _ in frames)
    shipped = spark.sparkContext.broadcast(frames)
    out = pa.schema([pa.field("frame", pa.int32()), pa.field("iteration", pa.int64()), pa.field("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        at_once = max(1, CELLS // max(len(c) for _, c in held))
        for batch in batches:
            ids = np.sort(batch.column(0).to_numpy())
            rows = [(f, -1, np.bincount(of, minlength=len(c)) @ c) for f, (of, c) in enumerate(held) if len(ids) and ids[0] < 0]
            ids = ids[ids >= 0]
            length = np.char.str_len(ids.astype(str))
            for digits in np.unique(length).tolist():
                own = ids[length == digits].tolist()
                for some in (own[i : i + at_once] for i in range(0, len(own), at_once)):
                    times = [np.zeros((len(some), len(c)), np.int64) for _, c in held]
                    for first in range(0, most, HASHED):
                        words = _stretch(seed, digits, np.arange(first, min(most, first + HASHED)))
                        for i, k in enumerate(some):
                            hashed = md5_heads(_of_iteration(words, seed, k))
                            for (of, c), n in zip(held, times, strict=True):
                                h, size = hashed[: max(0, len(of) - first)], np.uint32(len(of))
                                n[i] += np.bincount(of.take(h - h // size * size), minlength=len(c))
                    for f, ((_, c), n) in enumerate(zip(held, times, strict=True)):
                        rows += [(f, k, x) for k, x in zip(some, n @ c, strict=True)]
            if rows:
                frame, iteration, sums = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(frame, pa.int32()), pa.array(iteration, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], schema=out)

    tasks = max(spark.sparkContext.defaultParallelism, iterations * most // DRAWS + 1)
    return spark.range(-1, iterations, 1, min(tasks, iterations + 1)).mapInArrow(run, "frame int, iteration bigint, sums array<bigint>")


def _kinds(placed: DataFrame, n: int, columns: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
    """The kind of each of n positions and the counts of each kind, groups of a kind having the same counts; None beyond KINDS. A position without a row has no counts."""
    kinds = placed.select(*columns).distinct().limit(KINDS + 1).toArrow()
    if kinds.num_rows > KINDS:
        return None
    counts = np.zeros((kinds.num_rows + 1, len(columns)), np.int64)
    counts[1:] = np.column_stack([kinds.column(k).to_numpy() for k in columns])
    numbered = placed.sparkSession.createDataFrame(kinds.append_column("kind_", pa.array(range(1, len(counts)), pa.int32())))
    got = placed.join(F.broadcast(numbered), columns).select("position", "kind_").toArrow()
    of = np.zeros(n, np.uint16 if len(counts) <= 1 << 16 else np.int32)
    of[got.column("position").to_numpy()] = got.column("kind_").to_numpy()
    return of, counts


def bootstrap_scores(df: DataFrame, group: str, condition: str, iterations: int, seed: int) -> DataFrame:
    """(iteration, condition, score): macro-F1 of each resample; iteration -1 is the sample itself."""
    return bootstrap_scores_each([df], group, condition, iterations, seed)[0]


def bootstrap_scores_each(frames: list[DataFrame], group: str, condition: str, iterations: int, seed: int) -> list[DataFrame]:
    """bootstrap_scores() of each frame, from one set of hashes.

    Up to BROADCAST_GROUPS groups of up to KINDS different counts, the kind of each group is broadcast, and a task counts how often an iteration draws
    each kind and multiplies; beyond that draws are joined by position. Only sums of iterations are shuffled."""
    spark = frames[0].sparkSession
    made = []
    for df in frames:
        counts = kept(df.groupBy(group, condition).agg(*confusion_counts()), "group-counts")
        place = group_positions(counts, group)
        names = sorted(r[0] for r in counts.select(condition).distinct().collect())
        columns = {(c, k): f"{k}_{i}" for i, c in enumerate(names) for k in COUNTS}
        wide = counts.groupBy(group).agg(*(F.coalesce(F.sum(F.when(F.col(condition) == c, F.col(k))), F.lit(0)).alias(name) for (c, k), name in columns.items()))
        made.append((place.count(), names, columns, kept(wide.join(place, group).drop(group), "placed-counts")))
        dropped(counts)
    held = [_kinds(placed, n, list(columns.values())) if 0 < n <= BROADCAST_GROUPS else None for n, _, columns, placed in made]
    if all(h is not None for h in held):
        dropped(*(placed for *_, placed in made))
        both = _resampled(spark, held, iterations, seed)
        both = kept(both, "resampled") if len(frames) > 1 else both
        summed = [both.where(F.col("frame") == f).select("iteration", *(F.col("sums")[k].alias(name) for k, name in enumerate(columns.values()))) for f, (_, _, columns, _) in enumerate(made)]
    else:
        summed = [_joined(spark, placed, n, list(columns.values()), iterations, seed) for n, _, columns, placed in made]
    return [_scores(x, condition, names, columns) for x, (_, names, columns, _) in zip(summed, made, strict=True)]


def _joined(spark: SparkSession, placed: DataFrame, n: int, columns: list[str], iterations: int, seed: int) -> DataFrame:
    """Sums of the columns by iteration; draws are joined with positions."""
    sums = [F.sum(name).alias(name) for name in columns]
    drawn = slots(spark, n, iterations, seed).join(placed.hint("merge"), "position")
    return drawn.groupBy("iteration").agg(*sums).unionByName(placed.groupBy(F.lit(-1).cast("long").alias("iteration")).agg(*sums))


def _scores(summed: DataFrame, condition: str, names: list[str], columns: dict) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(c).alias(condition), *(F.col(columns[c, k]).alias(k) for k in COUNTS)) for c in names))
    return summed.select("iteration", F.explode(rows).alias("x")).select("iteration", "x.*").where(" + ".join(COUNTS) + " > 0").select("iteration", condition, macro_f1().alias("score"))


def interval(values: str, digits: int = 9) -> list:
    """Columns low and high: the 2.5th and 97.5th percentile, linear."""
    return [F.round(F.percentile(values, q), digits).alias(name) for name, q in (("low", 0.025), ("high", 0.975))]


def paired_differences(scores: DataFrame, condition: str, pairs: list[tuple[str, str, str]], digits: int = 9) -> DataFrame:
    """(comparison, gap, low, high, excludes_zero) of score(better) - score(worse) for (comparison, better, worse)."""
    wide = scores.groupBy("iteration").pivot(condition, sorted({c for _, a, b in pairs for c in (a, b)})).agg(F.first("score"))
    long = wide.select("iteration", F.explode(F.array(*(F.struct(F.lit(name).alias("comparison"), (F.col(a) - F.col(b)).alias("gap")) for name, a, b in pairs))).alias("x")).select("iteration", "x.*")
    out = long.groupBy("comparison").agg(F.round(F.max(F.when(F.col("iteration") == -1, F.col("gap"))), digits).alias("gap"), *(c for c in _interval_of(long, digits)))
    return out.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


def _interval_of(_, digits):
    drawn = F.when(F.col("iteration") >= 0, F.col("gap"))
    return [F.round(F.percentile(drawn, q), digits).alias(name) for name, q in (("low", 0.025), ("high", 0.975))]


def permuted_labels(groups: DataFrame, group: str, label: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, group, label, permuted): labels dealt anew between groups, as many of each as there were."""
    grid = groups.crossJoin(F.broadcast(groups.sparkSession.range(replicates).withColumnRenamed("id", "replicate")))
    ones = groups.agg(F.sum(label).alias("ones_"))
    ranked = by_hash(grid, ["replicate"], F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(group).cast("string")), group, hashes=1 << 26)
    return ranked.crossJoin(F.broadcast(ones)).select("replicate", group, label, F.when(F.col("rank_") < F.col("ones_"), 1).otherwise(0).alias("permuted"))
