"""Near-duplicate embeddings with randomised-rotation binary codes.

Vectors are scaled to length one and rotated at random; the code of a vector is the signs of its rotated components, packed into bits, and taken as
a unit vector. Stored with it is f, the inner product of the vector with its code. Two codes differ in a share of bits that has the pair's angle over pi as its
mean, so a count of differing bits far above that of the threshold's angle rules a pair out. For what is left, <code, q> / f
estimates <vector, q> without bias, with an error below bound * sqrt((1 - f^2) / (f^2 (d - 1))) but with tiny
probability. Only pairs whose estimate plus that error reaches the threshold are computed again in double precision.

Pairs to estimate come from tables keyed by sign bits of further random rotations: a pair at the threshold
shares a bucket of one of the tables with probability at least RECALL (nearer ones more often). Every bucket is compared in
full, in blocks, so hot buckets are spread over tasks; a pair counts in the first table where it meets only.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hold, trimmed, written
from .components import components

#: Chance that a pair just at the threshold meets; vectors a bucket has on average; rows of a block; error bound in standard units; seed of the rotations.
RECALL, BUCKET, BLOCK, BOUND, SEED = 0.9995, 256, 1024, 6.0, 20_240_601


@lru_cache(64)
def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows as doubles of length one; the largest component is divided out first, so nothing overflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def plan(n: int, threshold: float, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits of a key, tables) so that buckets have about bucket of n vectors and a pair at the threshold meets with probability recall."""
    bits = max(1, min(40, round(math.log2(max(2, n) / bucket))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same))) if same < 1 else 1


def keys_of(unit: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables) integers of sign bits; each rotation gives as many disjoint keys as it has components for."""
    d, out = unit.shape[1], []
    while len(out) < tables:
        planes = np.vstack([rotation(d, seed + 1 + 1000 * len(out) + k) for k in range(-(-bits // d))])
        signs = (unit @ planes.T > 0).astype(np.int64)
        for s in range(0, signs.shape[1] - bits + 1, bits):
            out.append(signs[:, s : s + bits] @ (1 << np.arange(bits, dtype=np.int64)))
    return np.stack(out[:tables], 1)


class Codes:
    """Binary codes of unit vectors (rows) with their correction factors; packed and factor are taken from there where they are stored."""

    def __init__(self, unit: np.ndarray, packed: np.ndarray | None = None, factor: np.ndarray | None = None, seed: int = SEED):
        self.unit, self.d = unit, unit.shape[1]
        self.rotated = (unit @ rotation(self.d, seed).T).astype(np.float32)
        self.packed = np.packbits(self.rotated > 0, 1) if packed is None else packed
        self.code = (np.unpackbits(self.packed, 1, self.d).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(self.d))
        self.factor = np.einsum("ij,ij->i", self.code, self.rotated) if factor is None else factor

    def differing(self, other: Codes) -> np.ndarray:
        """Differing bits of each own code and each of other's."""
        out = np.zeros((len(self.packed), len(other.packed)), np.uint16)
        words = lambda c: np.pad(c.packed, ((0, 0), (0, -c.packed.shape[1] % 8))).view(np.uint64)
        for x, y in zip(words(self).T, words(other).T, strict=True):
            out += np.bitwise_count(x[:, None] ^ y[None])
        return out

    def error(self, bound: float = BOUND) -> tuple[np.ndarray, np.ndarray]:
        f = np.maximum(self.factor, 1e-6)
        return f, bound * np.sqrt(np.maximum(0, 1 - f * f) / (f * f * max(1, self.d - 1)))

    def upper(self, other: Codes, bound: float = BOUND) -> np.ndarray:
        """Upper confidence bounds of the inner products of own vectors (by their codes) with other's."""
        f, e = self.error(bound)
        return self.code @ other.rotated.T / f[:, None] + e[:, None]

    def upper_of(self, i: np.ndarray, other: Codes, j: np.ndarray) -> np.ndarray:
        """The same for pairs of positions."""
        f, e = self.error()
        return np.einsum("ij,ij->i", self.code[i], other.rotated[j]) / f[i] + e[i]


def most_differing(d: int, threshold: float, bound: float = BOUND) -> int:
    """Bits of d that codes of a pair at the threshold differ in, but with tiny probability, at most."""
    p = math.acos(threshold) / math.pi
    return math.ceil(d * p + bound * math.sqrt(d * p * (1 - p)))


def linked_pairs(a: Codes, b: Codes | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of pairs with cosine >= threshold: between a and b, or within a (i < j) if b is None."""
    may = a.differing(b or a) <= most_differing(a.d, threshold)
    if b is None:
        may &= np.tri(len(a.unit), k=-1, dtype=bool).T
        b = a
    i, j = np.nonzero(may)
    kept = [np.zeros(0, int)]
    for s in range(0, len(i), 65536):
        x, y = i[s : s + 65536], j[s : s + 65536]
        near = np.flatnonzero(a.upper_of(x, b, y) >= threshold - 1e-4)
        kept.append(s + near[np.einsum("ij,ij->i", a.unit[x[near]], b.unit[y[near]]) >= threshold])
    ok = np.concatenate(kept)
    return i[ok], j[ok]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[int]:
    """Which of the edges make a spanning forest of the block."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            parent[x] = y
            kept.append(k)
            if len(kept) == n - 1:
                break
    return kept


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, recall: float = RECALL) -> DataFrame:
    """(key, n_links, component_id, kept) for every row: links are other rows with cosine >= threshold, in double precision.

    Null, empty and zero vectors and those with null or non-finite components link with nothing; vectors of
    different lengths don't link. Equal vectors are one class with a count, so a hot vector costs one comparison. A repeated key is
    as many vectors, each of which counts as another's link; a null key's component is its class's least key. The pairs of a
    table's bucket are worked block by block: nothing but counts per row and a spanning forest per block leaves a task.
    """
    spark = vectors.sparkSession
    finite = F.forall(F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"  # then its components travel as such
    kind = "float" if single else "double"
    rows = vectors.select(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast(kind) + F.lit(0.0).cast(kind)).alias("vector"))
    good = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    marked = rows.select("key", F.when(good, F.col("vector")).alias("vector"))
    classes = written(marked.where("vector is not null").groupBy("vector").agg(F.min("key").alias("first"), F.count("*").alias("n")).withColumn("class", F.xxhash64("vector", "first")), "vector-classes")
    count = classes.count()
    bits, tables = plan(count, threshold, recall)

    out = pa.schema([pa.field("table", pa.int32()), pa.field("d", pa.int32()), pa.field("bucket", pa.int64()), pa.field("class", pa.int64()), pa.field("n", pa.int64()), pa.field("keys", pa.binary()), pa.field("code", pa.binary()), pa.field("factor", pa.float32()), pa.field("raw", pa.binary())])

    def keyed(batches):
        hold("embedding_dedup")
        for batch in batches:
            by_length: dict[int, list[int]] = {}
            flat = batch.column(0).to_pylist()
            for i, v in enumerate(flat):
                by_length.setdefault(len(v), []).append(i)
            ids, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for d, at in by_length.items():
                x = np.array([flat[i] for i in at], np.float32 if single else np.float64)
                unit = scaled(x)
                keys, codes = keys_of(unit, bits, tables), Codes(unit)
                narrow = keys.astype(np.int32 if bits < 32 else np.int64)
                raw, code = [u.tobytes() for u in x], [c.tobytes() for c in codes.packed]
                for t in range(tables):
                    # the length d is a column of the bucket, so only equal ones meet
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(at), pa.int32()), pa.array([d] * len(at), pa.int32()), pa.array(keys[:, t]), pa.array(ids[at]), pa.array(n[at]), pa.array([k[:t].tobytes() for k in narrow], pa.binary()), pa.array(code, pa.binary()), pa.array(codes.factor, pa.float32()), pa.array(raw, pa.binary())], schema=out)

    entries = written(classes.select("vector", "class", "n").mapInArrow(trimmed(keyed), "table int, d int, bucket bigint, class bigint, n bigint, keys binary, code binary, factor float, raw binary"), "vector-buckets")
    sizes = entries.groupBy("table", "d", "bucket").agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    part = F.pmod(F.xxhash64("class"), F.col("blocks"))
    # a row joins its own block with every other: cell (low, high) is worked by the task that gets it
    cells = (
        entries.join(sizes.drop("size"), ["table", "d", "bucket"])
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("table", "d", "bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "class", "n", "keys", "code", "factor", "raw")
    )
    found = pa.schema([pa.field("class", pa.int64()), pa.field("links", pa.int64()), pa.field("to", pa.int64())])

    def compared(key_, rows_):
        t, _, _, low, high = (k.as_py() for k in key_)
        ids, n = rows_.column("class").to_numpy(), rows_.column("n").to_numpy()
        # the keys of the tables before this one: a pair counts in the first table where it meets
        keys = np.frombuffer(b"".join(rows_.column("keys").to_pylist()), np.int32 if bits < 32 else np.int64).reshape(len(ids), t)
        unit = scaled(np.frombuffer(b"".join(rows_.column("raw").to_pylist()), np.float32 if single else np.float64).reshape(len(ids), -1))
        packed = np.frombuffer(b"".join(rows_.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        factor = rows_.column("factor").to_numpy()
        codes = lambda at: Codes(unit[at], packed[at], factor[at])
        side = rows_.column("part").to_numpy() == low
        if low == high:
            i, j = linked_pairs(codes(slice(None)), None, threshold)
        else:
            left, right = np.flatnonzero(side), np.flatnonzero(~side)
            i, j = linked_pairs(codes(left), codes(right), threshold)
            i, j = left[i], right[j]
        first = ~(keys[i] == keys[j]).any(1)
        i, j = i[first], j[first]
        links = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
        some = np.flatnonzero(links)
        kept = _forest(i, j, len(ids))
        a, b = ids[i[kept]], ids[j[kept]]
        return pa.table([pa.array(np.concatenate([ids[some], a])), pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(len(a), np.int64)])), pa.array(np.concatenate([np.full(len(some), 0, np.int64), b]), mask=np.arange(len(some) + len(a)) < len(some))], schema=found)

    results = written(cells.groupBy("table", "d", "bucket", "low", "high").applyInArrow(compared, "class bigint, links bigint, to bigint"), "vector-links")
    linked = results.groupBy("class").agg(F.sum("links").alias("links"))
    group = components(results.where("to is not null").select(F.col("class").alias("a"), F.col("to").alias("b")))
    of = classes.select("class", "vector", "first", "n").join(linked, "class", "left").join(group.withColumnRenamed("node", "class"), "class", "left")
    of = of.select("vector", "class", "first", F.coalesce("component", "class").alias("group"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    of = written(of, "vector-groups")
    least = written(of.groupBy("group").agg(F.min("first").alias("component_id")), "vector-least")
    of = written(of.join(least, "group").select("vector", "n_links", "component_id"), "vector-results")  # plain tables on both sides of a join: then a hot key's partition is split
    discard(entries, results, classes)
    valid = marked.where("vector is not null").join(of, "vector").select("key", "n_links", "component_id")
    alone = marked.where("vector is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return valid.unionByName(alone).select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))


def near_duplicates_sql() -> str:
    """DuckDB SQL for near_duplicates() over embeddings: the cosine of all pairs in doubles; components by a recursion."""
    return """WITH RECURSIVE vectors AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT vec_id, e FROM vectors WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reached(x, y) AS (SELECT vec_id, vec_id FROM vectors UNION SELECT reached.x, links.y FROM reached JOIN links ON links.x = reached.y),
least AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x), degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM vectors JOIN least ON least.x = vec_id LEFT JOIN degree ON degree.x = vec_id"""
