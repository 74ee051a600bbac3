"""Exact n-gram Jaccard self-join by adaptive multi-match prefixes.

A document's set is its distinct 5-word shingles as 64-bit hashes, ordered rare ones first. Two sets of n and m tokens with a Jaccard
similarity of at least t share needed = ceil(t / (1 + t) (n + m)) tokens. Each document's prefix is its first n - ceil(t n) + l tokens; l is
chosen by document: where the prefix holds frequent tokens, the estimated cost of the candidates they bring is weighed against a longer
prefix, of which more tokens must be shared. What is common to a pair beyond the prefix that ends first is at most ceil(t n) - l, so a pair is
a candidate only if its prefixes share needed - max(ceil(t n) - l, ceil(t m) - l') tokens, which is min(l, l') at least and many more where sizes are alike.

Documents with equal sets are one node, and tokens whose posting lists have the same members are one list with a weight. Only components
are asked for, so a group of near copies is not expanded into all its pairs: neighbours in the lists are verified first, then stars around the nodes with
the most links; what links is merged, and only pairs of different components are counted, list by list inside a task, so that no row is made for a token that a pair shares. Of the
candidates each node's best are verified, then all that are still in different components. So every candidate is either verified or within a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hold, slices, trimmed, written
from .components import components

#: Words of a shingle; the similarity as a fraction.
WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Frequent shingles in the order's broadcast table (12 bytes each; the others are ordered by hash); shingles of a task counted at once; the count from which such a stretch surely reports a shingle; one over the chance by which it reports others; the chance reports from which these count.
FREQUENT, COUNTED, SURE, RATE, REPORTS = 1 << 19, 1 << 21, 3, 64, 3
#: Longest prefix extension; costs of a posting and of verifying a shingle against looking at a candidate; candidates that a token not known as frequent brings.
MOST_MATCHES, POSTING, VERIFY, RARE = 32, 4, 1 / 8, 0.1
#: Postings of a hot token in one sublist; rows of a list held at once; rows of a list compared at once; lists of a node that travel with it.
SUBLIST, RUN, BLOCK, LONG = 2000, 1 << 16, 512, 1024
#: Star rounds; candidates of a node that are verified before the rest, and how often; members a pivot's chunk has; rows broadcast at most.
STARS, BEST, PASSES, CHUNK, BROADCAST_ROWS = 2, 4, 1, 512, 200_000
#: Shingles of sets that a verifying task keeps at hand.
RECENT = 3_000_000

_M = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WORDS)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 300_000:
                self.clear()
            self[word] = h
        return h


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of the text, letters A-Z lowered, words cut at ASCII white space.

    With fewer words, one hash of them all; without words, none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    if n < WORDS:
        return _mix(np.array([sum(int(x) * m for x, m in zip(h, _M, strict=False)) + n * 0xA0761D6478BD642F & (1 << 64) - 1], np.uint64))
    total = h[: n - WORDS + 1] * np.uint64(_M[0])
    for k in range(1, WORDS):
        total = total + h[k : n - WORDS + 1 + k] * np.uint64(_M[k])
    return np.unique(_mix(total))


def node_of(s: np.ndarray) -> int:
    """A 64-bit name of the set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def least_overlap(n: int) -> int:
    return -(-n * NUMERATOR // DENOMINATOR)


def prefix(s: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """(tokens, l): the prefix of a set. frequent: sorted hashes; counts: their estimated document counts."""
    n = len(s)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        hot = frequent[at] == s
        order = np.argsort(counts[at[hot]], kind="stable")
        tokens = np.concatenate([s[~hot], s[hot][order]])
        weight = np.concatenate([np.full(n - len(order), RARE), counts[at[hot]][order]])
    else:
        tokens, weight = s, np.full(n, RARE)
    first = n - least_overlap(n) + 1
    most = min(MOST_MATCHES, least_overlap(n))
    scanned = np.cumsum(weight)[first - 1 : first - 1 + most]
    l = np.arange(1, len(scanned) + 1)
    best = int(np.argmin(POSTING * l + scanned * (1 + VERIFY * n / l))) + 1
    return tokens[: first - 1 + best], best


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _facts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of kind 0: (key, node, size) for each document; of kinds 1 and 2: (null, token, count), by which tokens' counts are estimated.

    Each stretch of a task reports a token that it holds c times: from SURE times on as c (kind 1), else with the probability c / RATE as RATE (kind 2). The sum of the
    reports is an unbiased estimate of the count over all documents, however thinly a token is spread and however rows are dealt to tasks."""
    out = pa.schema([pa.field("kind", pa.int8()), pa.field("key", pa.int64()), pa.field("node", pa.int64()), pa.field("n", pa.int64())])

    def run(batches):
        hold("jaccard_join", _hashes.clear)
        held, size = [], 0
        seen: set[int] = set()

        def report():
            salt, token = held[0][:1].copy(), np.concatenate(held)
            held.clear()
            token.sort()
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            token, count = token[first], np.diff(np.append(first, len(token)))
            chance = _mix(token ^ salt) % np.uint64(RATE)  # differently in each stretch
            sure = count >= SURE
            often = sure | (chance < count)
            k = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.array(2 - sure[often].astype(np.int8)), pa.nulls(k, pa.int64()), pa.array(_signed(token[often])), pa.array(np.where(sure, count, RATE)[often])], schema=out)

        for batch in batches:
            for cols, texts in slices(batch, "text"):
                nodes, sizes = [], []
                for t in texts:
                    s = shingles(t)
                    nodes.append(node_of(s))
                    sizes.append(len(s))
                    if len(s) and nodes[-1] not in seen:
                        seen.add(nodes[-1])
                        held.append(s)
                        size += len(s)
                        if size >= COUNTED:
                            yield report()
                            seen.clear()
                            size = 0
                k = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int8)), cols[0].cast(pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64())], schema=out)
        if held:
            yield report()

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(trimmed(run), "kind tinyint, key bigint, node bigint, n bigint")


def _postings(docs: DataFrame, text: str, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(token, part, node, n, matches): the prefixes, once for each set that a stretch of a task holds. part splits hot tokens' lists, from 1; it is 0 where a list is whole."""
    shipped = docs.sparkSession.sparkContext.broadcast((frequent.tobytes(), counts.astype(np.float32).tobytes()))
    names = ("token", "part", "node", "n", "matches")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int8())
    out = pa.schema([pa.field(a, b) for a, b in zip(names, kinds, strict=True)])

    def run(batches):
        hold("jaccard_join", _hashes.clear)
        hot, often = (np.frombuffer(x, k) for x, k in zip(shipped.value, (np.uint64, np.float32), strict=True))
        seen: set[int] = set()
        for batch in batches:
            for _, texts in slices(batch, "text"):
                rows = []
                for t in texts:
                    s = shingles(t)
                    node = node_of(s)
                    if not len(s) or node in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(node)
                    rows.append((*prefix(s, hot, often), node, len(s)))
                if not rows:
                    continue
                sizes = [len(r[0]) for r in rows]
                token = np.concatenate([r[0] for r in rows])
                spread = lambda k, kind: np.repeat(np.array([r[k] for r in rows], kind), sizes)  # noqa: E731, B023
                node = spread(2, np.int64)
                own = node.view(np.uint64)
                part = np.zeros(len(token), np.int32)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                    parts = np.where(hot[at] == token, np.ceil(often[at] / SUBLIST), 1).astype(np.uint64)
                    part = np.where(parts > 1, _mix(own + np.uint64(7)) % parts + np.uint64(1), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (_signed(token), part, node, spread(3, np.int32), spread(1, np.int8))], schema=out)

    return docs.select(F.col(text).alias("text")).mapInArrow(trimmed(run), "token bigint, part int, node bigint, n int, matches tinyint")


def _lists(postings: DataFrame) -> DataFrame:
    """(list, node, n, matches, pivot, pivot_n, weight): posting lists of two nodes or more (all of split ones, as other parts hold partners), each row with the node before it as pivot.

    Lists with the same members are one, named by the sum of their nodes' hashes; weight is how many tokens it stands for. Partitions
    sorted by token and node are passed through, holding one list at a time: a split list, and one of over RUN rows, keeps the token's own name and is streamed.
    """
    names = ("list", "node", "n", "matches", "pivot", "pivot_n")
    kinds = (np.int64, np.int64, np.int32, np.int8, np.int64, np.int32)
    out = pa.schema([pa.field(a, pa.from_numpy_dtype(b)) for a, b in zip(names, kinds, strict=True)])

    def run(batches):
        held, streamed = None, False  # rows of the last list; streamed: its rows before the only one held are given out already

        def give(c, own_name, first):
            """The rows of whole lists, or of a part of one under its own name; own_name: bool, by row; first: how many rows are given already."""
            new = np.ones(len(c["token"]), bool)
            new[1:] = (c["token"][1:] != c["token"][:-1]) | (c["part"][1:] != c["part"][:-1])
            starts = np.flatnonzero(new)
            size = np.diff(np.append(starts, len(new)))
            total = np.add.reduceat(_mix(c["node"].view(np.uint64)), starts).view(np.int64)
            own_name |= c["part"] > 0
            name = np.where(own_name, c["token"], np.repeat(total, size))
            keep = own_name | np.repeat(size > 1, size)
            keep[:first] = False
            before = [np.where(new, c[f], np.roll(c[f], 1)) for f in ("node", "n")]
            cols = (name, c["node"], c["n"], c["matches"], *before)
            return pa.RecordBatch.from_arrays([pa.array(x[keep].astype(k)) for x, k in zip(cols, kinds, strict=True)], schema=out)

        for batch in batches:
            if not batch.num_rows:
                continue
            c = {f: batch.column(f).to_numpy(zero_copy_only=False) for f in ("token", "part", "node", "n", "matches")}
            if held is not None:
                c = {f: np.concatenate([held[f], x]) for f, x in c.items()}
            once = np.ones(len(c["token"]), bool)  # a set that several tasks have met stands next to itself
            once[1:] = (c["token"][1:] != c["token"][:-1]) | (c["node"][1:] != c["node"][:-1])
            c = {f: x[once] for f, x in c.items()}
            other = np.flatnonzero((c["token"] != c["token"][-1]) | (c["part"] != c["part"][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            own_name = (c["token"] == c["token"][0]) & (c["part"] == c["part"][0]) & streamed
            if cut:
                yield give({f: x[:cut] for f, x in c.items()}, own_name[:cut], int(streamed))
                streamed = False
            held = {f: x[cut:] for f, x in c.items()}
            k = len(held["token"])
            if k > RUN:
                yield give(held, np.ones(k, bool), int(streamed))
                held, streamed = {f: x[-1:] for f, x in held.items()}, True
        if held is not None:
            yield give(held, np.full(len(held["token"]), streamed), int(streamed))

    near = postings.repartition("token", "part").sortWithinPartitions("token", "part", "node")
    rows = near.mapInArrow(trimmed(run), "list bigint, node bigint, n int, matches tinyint, pivot bigint, pivot_n int")
    return rows.groupBy("list", "node").agg(*(F.first(f).alias(f) for f in ("n", "matches", "pivot", "pivot_n")), F.count("*").alias("weight"))


def _needed(a: str, b: str):
    """The overlap that sets of these sizes need: ceil(t / (1 + t) (a + b))."""
    both = NUMERATOR + DENOMINATOR
    return F.expr(f"({NUMERATOR} * ({a} + {b}) + {both - 1}) div {both}")


def _overlap(n: str):
    return F.expr(f"({NUMERATOR} * {n} + {DENOMINATOR - 1}) div {DENOMINATOR}")


def _least_common(n: str, matches: str, m: str, more: str):
    """The tokens that the prefixes of sets of n and m must share: beyond the prefix that ends first, a set has ceil(t n) - l."""
    return _needed(n, m) - F.greatest(_overlap(n) - F.expr(matches), _overlap(m) - F.expr(more))


def _fits(a: str, b: str):
    """Sizes that allow the similarity."""
    return F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR


def _verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, written.

    a is a pivot whose members go to chunks. Texts travel, as they are smaller than sets: one of each member goes
    to its chunk, one of the pivot to each, where it comes first and the members stream past it. Where texts go is
    broadcast if it is few rows, else joined by key."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    members = pairs.join(many, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), F.lit(1).alias("turn"))
    pivots = many.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("turn"))
    roles = members.union(pivots)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    source = written(nodes.join(wanted, "node", "left_semi").select("node", F.col("first").alias("key_")), "verify-sources")
    places = written(roles.join(_few(source), "node"), "verify-places")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    sent = rows.join(_few(places), F.col("key").eqNullSafe(F.col("key_"))).select("a", "chunk", "turn", "node", "text")
    out = pa.schema([pa.field("a", pa.int64()), pa.field("b", pa.int64())])

    def run(batches):
        hold("jaccard_join", _hashes.clear)
        pivot, own = None, None
        known: dict[int, np.ndarray] = {}  # sets met before, RECENT shingles at most
        size = 0
        for batch in batches:
            for cols, texts in slices(batch, "text"):
                a_, b_ = [], []
                for a, turn, b, t in zip(cols[0].to_pylist(), cols[1].to_pylist(), cols[2].to_pylist(), texts, strict=True):
                    if turn and a != pivot:
                        continue
                    s = known.get(b)
                    if s is None:
                        s = shingles(t)
                        if node_of(s) != b:  # another text under a repeated key
                            continue
                        size += len(s)
                        if size > RECENT:
                            known.clear()
                            size = len(s)
                        known[b] = s
                    if not turn:
                        pivot, own = a, s
                    elif _common(own, s) * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (len(own) + len(s)):
                        a_.append(a)
                        b_.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], schema=out)

    near = sent.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "turn").select("a", "turn", "node", "text")
    out_ = written(near.mapInArrow(trimmed(run), "a bigint, b bigint"), "similar-pairs")
    discard(source, places)
    return out_


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum())


def _few(df: DataFrame) -> DataFrame:
    """A written frame, to be broadcast where it has BROADCAST_ROWS at most, else to be joined by key."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


def _labelled(lists: DataFrame, label: DataFrame) -> DataFrame:
    """Lists with the component of each row's node."""
    return lists.join(_few(label), "node", "left").withColumn("component", F.coalesce("component", "node"))


def similarity_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for every row: component_id is the least key that links of similarity 0.8 or more reach.

    A null or empty text, or one without words, has no shingles, links with nothing and is its own component. Rows with equal sets link; repeated keys
    are documents of their own that share a name. Null keys pass, with the least key of their component. Very long texts are worked whole.
    """
    return _linked(docs, key, text).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


class _Found:
    """The pairs verified so far, those of them that link, and the components they make."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, key: str, text: str):
        self.docs, self.nodes, self.key, self.text = docs, nodes, key, text
        self.tried: list[DataFrame] = []
        self.links: list[DataFrame] = []
        self.label: DataFrame | None = None

    def verify(self, pairs: DataFrame) -> None:
        """Verifies pairs (a, b), a having most partners, but those already tried."""
        pairs = pairs.select("a", "b", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        if self.tried:
            tried = _union([t.select("x", "y") for t in self.tried])
            few = sum(t.count() for t in self.tried) <= BROADCAST_ROWS
            pairs = pairs.join(F.broadcast(tried) if few else tried.hint("merge"), ["x", "y"], "left_anti")
        pairs = written(pairs, "pairs")
        self.tried.append(pairs)
        self.links.append(_verify(self.docs, self.nodes, pairs.select("a", "b"), self.key, self.text))
        # a written label stands for all links before it
        old = [] if self.label is None else [self.label.select(F.col("node").alias("a"), F.col("component").alias("b"))]
        label = written(components(_union([self.links[-1], *old])), "labels")
        if self.label is not None:
            discard(self.label)
        self.label = label

    def close(self) -> None:
        discard(*self.tried, *self.links)


def _best(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b, c) that are among the most best, by c, of one of their nodes."""
    one = pairs.select(F.col("a").alias("node"), "a", "b", "c").union(pairs.select(F.col("b").alias("node"), "a", "b", "c"))
    best = one.groupBy("node").agg(*(F.max_by(F.struct("a", "b"), F.struct("c", F.xxhash64("a", "b", F.lit(k)))).alias(f"p{k}") for k in range(most)))
    return best.select(F.explode(F.array(*(f"p{k}" for k in range(most)))).alias("p")).select("p.a", "p.b").distinct()


def _shares(c, share: float):
    """c counts share of the tokens that a candidate needs, at least (those with fewer come up again when pairs are enumerated)."""
    return c >= share * _least_common("first(n)", "first(matches)", "first(pivot_n)", "1")


def _least_common_of(n: np.ndarray, matches: np.ndarray, m: np.ndarray, more: np.ndarray) -> np.ndarray:
    """_least_common for arrays."""
    both, beyond = NUMERATOR + DENOMINATOR, lambda k, l: -(-k * NUMERATOR // DENOMINATOR) - l
    return -(-(n + m) * NUMERATOR // both) - np.maximum(beyond(n, matches), beyond(m, more))


def _sent(lists: DataFrame) -> DataFrame:
    """(node, n, matches, component, at, list, weight, of, of_weight): the rows that go to their lists; of: all lists of the node in order, at: how many come before this one."""
    entry = F.struct("size", F.col("name").alias("list"), F.col("weight").cast("int").alias("weight"), "least")
    sets = lists.groupBy("node").agg(*(F.first(f).alias(f) for f in ("n", "matches", "component")), F.array_sort(F.collect_list(entry)).alias("of"))
    rows = sets.select("node", "n", "matches", "component", "of", (F.size("of") <= LONG).alias("whole"), F.posexplode("of").alias("at", "l"))
    after = F.aggregate(F.slice("of", F.col("at") + 1, F.size("of")), F.lit(0), lambda s, x: s + x["weight"])
    rows = rows.withColumn("of", F.when(F.col("whole"), F.col("of")))
    meets_long = F.col("n") > (LONG - MOST_MATCHES) * NUMERATOR // (DENOMINATOR - NUMERATOR)
    rows = rows.where(~F.col("whole") | meets_long | (after >= F.col("l.least")))
    return rows.select("node", "n", "matches", "component", "at", F.col("l.list").alias("list"), F.col("l.weight").alias("weight"), F.col("of.list").alias("of"), F.col("of.weight").alias("of_weight"))


def _candidates(lists: DataFrame) -> DataFrame:
    """(a, b, c): pairs a < b of different components whose prefixes share as many tokens as they need; c: the similarity of the prefixes.

    lists: rows (name, node, n, matches, weight, component, least, size); least: the smallest matches in the list, size: its rows. Every row goes to its list
    with all lists of its node in one order, short ones first, so that a task counts what the pairs of a list share without a row for each, and gives a
    pair out once: in the first list that both are in, and only if it is a candidate. A pair shares min(matches) tokens at least, so a row whose
    list and those after it hold fewer than the least of that list meets nobody first there and stays at home. Lists of over BLOCK rows are compared
    block by block. Nodes in over LONG lists come without these; their pairs are given out by list, and counted after, so nodes large enough to meet one send all their rows.
    """
    rows = _sent(lists)
    blocks = written(rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1"), "list-blocks")
    rows = rows.join(_few(blocks), "list", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("list", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "n", "matches", "component", "weight", "at", "of", "of_weight")
    names = ("a", "b", "c", "n_x", "matches_x", "n_y", "matches_y", "both")
    out = pa.schema([pa.field(f, pa.int64()) for f in names])

    def pairs(c: dict, of: list, low: int, high: int) -> list[np.ndarray]:
        """The pairs of one cell; its columns, its nodes' lists as (names, weights) or None. at: how many lists of a row's node come before this one."""
        m = len(of)
        side = c["part"] == low
        i, j = np.nonzero(np.tri(m, k=-1, dtype=bool).T if low == high else side[:, None] & ~side[None])
        n, matches = c["n"], c["matches"]
        fit = (c["component"][i] != c["component"][j]) & (np.minimum(n[i], n[j]) * DENOMINATOR >= np.maximum(n[i], n[j]) * NUMERATOR)
        i, j = i[fit], j[fit]
        if not len(i):
            return []
        whole = np.array([x is not None for x in of])
        names_ = np.concatenate([x[0] for x in of if x is not None] or [np.zeros(0, np.int32)])
        _, place, seen = np.unique(names_, return_inverse=True, return_counts=True)
        row = np.repeat(np.flatnonzero(whole), [len(x[0]) for x in of if x is not None])
        met = seen[place] > 1  # what only one of the nodes is in, no pair shares
        fresh = np.cumsum(seen > 1) - 1
        weight = np.zeros((m, int((seen > 1).sum())), np.float32)
        if met.any():
            np.add.at(weight, (row[met], fresh[place[met]]), np.concatenate([x[1] for x in of if x is not None])[met])
        held, before = weight > 0, np.zeros(weight.shape, bool)
        if met.any():
            early = np.concatenate([np.arange(len(x[0])) < k for x, k in zip(of, c["at"], strict=True) if x is not None])[met]
            before[row[met][early], fresh[place[met]][early]] = True
        both = whole[i] & whole[j]
        count = np.where(both, np.minimum(c["weight"][i], c["weight"][j]), 0)
        good = ~both
        x, y = i[both], j[both]
        for s in range(0, len(x), 4096):
            p, q = x[s : s + 4096], y[s : s + 4096]
            common = held[p] & held[q]
            k = (weight[p] * common).sum(1).astype(np.int64)
            ok = ~(before[p] & before[q]).any(1) & (k >= _least_common_of(n[p], matches[p], n[q], matches[q]))
            where = np.flatnonzero(both)[s : s + 4096]
            good[where], count[where] = ok, k
        count[~both] = np.maximum(c["weight"][i], c["weight"][j])[~both]
        i, j, count, both = i[good], j[good], count[good], both[good]
        first = c["node"][i] < c["node"][j]
        a, b = np.where(first, i, j), np.where(first, j, i)
        return [c["node"][a], c["node"][b], count, n[a], matches[a], n[b], matches[b], both]

    def run(batches):
        hold("jaccard_join", _hashes.clear)
        cell, held = None, []  # rows of the cell that is not complete yet

        def done():
            c = {f: np.array([h[k] for h in held], np.int64) for k, f in enumerate(("part", "node", "n", "matches", "component", "weight", "at"))}
            return pairs(c, [h[7] for h in held], *cell[1:]) if len(held) > 1 else []

        for batch in batches:
            found: list[list[np.ndarray]] = []
            col = {f: batch.column(f).to_numpy(zero_copy_only=False).tolist() for f in ("list", "low", "high", "part", "node", "n", "matches", "component", "weight", "at")}
            of, of_weight = batch.column("of"), batch.column("of_weight")
            valid, ends, weight_ends = of.is_valid().to_pylist(), of.offsets.to_numpy(), of_weight.offsets.to_numpy()
            flat_names, flat_weights = (x.values.to_numpy(zero_copy_only=False) for x in (of, of_weight))
            for k in range(batch.num_rows):
                own = col["list"][k], col["low"][k], col["high"][k]
                if own != cell:
                    if got := done():
                        found.append(got)
                    cell = own
                    held.clear()
                mine = flat_names[ends[k] : ends[k + 1]], flat_weights[weight_ends[k] : weight_ends[k + 1]]
                held.append((*(col[f][k] for f in ("part", "node", "n", "matches", "component", "weight", "at")), mine if valid[k] else None))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], schema=out)
        if got := done():
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in got], schema=out)

    near = rows.repartition("list", "low", "high").sortWithinPartitions("list", "low", "high")
    counted = near.mapInArrow(trimmed(run), ", ".join(f"{f} bigint" for f in names)).groupBy("a", "b").agg(F.when(F.min("both") > 0, F.max("c")).otherwise(F.sum("c")).alias("c"), *(F.first(f).alias(f) for f in names[3:7]))
    alike = F.expr("c / (" + " + ".join(f"n_{s} - ({NUMERATOR} * n_{s} + {DENOMINATOR - 1}) div {DENOMINATOR} + matches_{s}" for s in "xy") + " - c)")
    return counted.where(F.col("c") >= _least_common("n_x", "matches_x", "n_y", "matches_y")).select("a", "b", alike.alias("c"))


def _linked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node, n, component_id, stays) for every row; stays: the row's key and node are those that stand for its component."""
    facts = written(_facts(docs, key, text), "shingle-facts")
    by_chance = F.count_if(F.col("kind") == 2) >= REPORTS
    often = facts.where("kind > 0").groupBy("node").agg(F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("sure"), F.when(by_chance, F.sum(F.when(F.col("kind") == 2, F.col("n")))).alias("thin"))
    often = often.where("sure is not null or thin is not null").select("node", (F.coalesce("sure", F.lit(0)) + F.coalesce("thin", F.lit(0))).alias("n")).orderBy(F.desc("n"), "node").limit(FREQUENT).toPandas()
    hot = often.node.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    order = np.argsort(hot)
    lists = written(_lists(_postings(docs, text, hot[order], often.n.to_numpy(np.float64)[order])), "posting-lists")
    rows = facts.where("kind = 0").select("key", "node", "n")
    nodes = written(rows.where("n > 0").groupBy("node").agg(F.min("key").alias("first"), F.count("*").alias("rows")), "nodes")  # each set and a row that has it
    found = _Found(docs, nodes, key, text)
    # neighbours: for each node the one that most of its lists agree on
    near = lists.where("node <> pivot").where(_fits("n", "pivot_n")).groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.sum("weight").alias("c"), _shares(F.sum("weight"), 0.2).alias("enough"))
    found.verify(near.where("enough").groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b"))
    lists_, lists = lists, lists.drop("pivot", "pivot_n")
    more_than_one = F.min("component") != F.max("component")
    for turn in range(1, STARS + 1):
        own = _labelled(lists, found.label)
        degree = written(_union(found.links).select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree")), "degrees")
        ranked = own.join(_few(degree), "node", "left").withColumn("rank", F.struct(F.coalesce("degree", F.lit(0)).alias("d"), F.xxhash64("node", F.lit(turn)).alias("h")))
        pivots = ranked.groupBy("list").agg(more_than_one.alias("open"), F.max_by(F.struct("node", "n", "component"), "rank").alias("p"))
        pivots = written(pivots.where("open").select("list", "p"), "pivots")
        star = own.join(_few(pivots), "list").where("component <> p.component").withColumn("pivot_n", F.col("p.n")).where(_fits("n", "pivot_n"))
        met = star.groupBy(F.col("p.node").alias("a"), F.col("node").alias("b")).agg(F.sum("weight").alias("c"), _shares(F.sum("weight"), 0.5).alias("enough"))
        found.verify(met.where("enough").groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b"))
        discard(degree, pivots)
    own = _labelled(lists, found.label).withColumn("name", F.shiftright("list", 32).cast("int")).drop("list")  # lists whose names share this half are compared as one
    open_lists = written(own.groupBy("name").agg(more_than_one.alias("open"), F.min("matches").alias("least"), F.count("*").alias("size")).where("open").drop("open"), "open-names")
    now = written(own.join(_few(open_lists), "name"), "open-lists")
    rest = written(_candidates(now), "candidates")
    discard(lists_, open_lists, now)
    for turn in range(PASSES + 1):
        found.verify(_best(rest, BEST) if turn < PASSES else rest.select("a", "b"))
        if turn < PASSES:
            of = lambda side: _few(found.label.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")))
            left = rest.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b", "c")
            left = written(left.join(_few(found.tried[-1].select("a", "b")), ["a", "b"], "left_anti"), "candidates")
            discard(rest)
            rest = left
    found.close()
    discard(rest)
    # sets of several rows or with links; all other rows are their own component
    several = nodes.join(_few(found.label), "node", "left").where("rows > 1 or component is not null")
    least = written(several.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min(F.when(F.col("first").isNotNull(), F.struct("first", "node"))).alias("least")), "least")
    named = written(several.select("node", F.coalesce("component", "node").alias("component")).join(_few(least), "component").select("node", "least"), "named")
    discard(least, nodes)
    joined = rows.join(_few(named), "node", "left").withColumn("stays", F.coalesce(F.struct("key", "node") == F.col("least"), F.col("least").isNull()))
    return joined.select("key", "node", "n", F.when(F.col("least").isNull(), F.col("key")).otherwise(F.col("least.first")).alias("component_id"), "stays")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component, that of the least key; all columns stay.

    What goes is found first and written: as many keys as BROADCAST_ROWS are broadcast, beyond that the join is by key. Rows
    that share a key are told apart by their sets; of those with equal sets one stays. Rows with a null key stay.
    """
    gone, node = (_free(n, docs) for n in ("gone_key_", "near_node_"))
    found = written(_linked(docs, key, text).where("key is not null").select(F.col("key").alias(gone), F.col("node").alias(node), F.col("stays").alias("stays")), "near-copies")
    out = _without(docs, found.where("not stays").select(gone).distinct(), key, gone)
    again = found.groupBy(gone).count().where("count > 1").select(gone)
    if again.isEmpty():
        return out
    name = F.udf(lambda t: node_of(shingles(t or "")), "bigint")
    repeated = docs.join(again, docs[key] == again[gone], "left_semi").withColumn(node, name(docs[text]))
    stay = found.where("stays").select(gone, F.col(node).alias("stays_")).distinct()
    own = repeated.join(stay, (repeated[key] == stay[gone]) & (repeated[node] == stay["stays_"]), "left_semi").dropDuplicates([key, node])
    return _without(out, again, key, gone).unionByName(own.drop(node))


def _free(name: str, docs: DataFrame) -> str:
    """The name, with a mark added where docs has such a column."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def _without(docs: DataFrame, keys: DataFrame, key: str, gone: str) -> DataFrame:
    return docs.join(_few(keys), docs[key] == keys[gone], "left_anti")


def components_sql() -> str:
    """DuckDB SQL for similarity_components() over documents: all pairs that share a shingle, counted; components by a recursion."""
    return r"""WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS MATERIALIZED (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM docs),
shingles AS (SELECT rid, unnest(s) AS g FROM sets),
sizes AS (SELECT rid, doc_id, len(s) AS n FROM sets),
common AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
near AS (SELECT x, y FROM common JOIN sizes p ON p.rid = x JOIN sizes q ON q.rid = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
links AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reached(x, y) AS (SELECT rid, rid FROM sizes UNION SELECT reached.x, links.y FROM reached JOIN links ON links.x = reached.y)
SELECT p.doc_id, CAST(p.n AS BIGINT) AS n_shingles, min(q.doc_id) AS component_id FROM reached JOIN sizes p ON p.rid = x JOIN sizes q ON q.rid = y GROUP BY p.rid, p.doc_id, p.n"""
