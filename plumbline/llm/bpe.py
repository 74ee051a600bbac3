"""Byte-level BPE encoding and decoding with segment trees over byte positions.

Each piece (a match of the split pattern) has a segment tree whose leaves are its byte positions.
A leaf holds rank * leaves + position of the pair that starts there, an inner node the smaller of
its children, so the root is the leftmost pair of lowest rank. A merge rewrites three leaves (the
pair's own, the one swallowed and the left neighbour's) and the paths above them: O(log n) each.
Pieces of equal tree size are merged side by side in NumPy arrays; long pieces get a scalar tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import WHITE, hold, map_texts

#: Trees with more leaves are worked one by one; leaves that are merged side by side at once.
WIDEST, SIDE_BY_SIDE = 256, 1 << 19
#: Runs kept in a worker's cache, and runs of one text held at once.
CACHED, HELD = 700_000, 400_000
#: Characters of a run that stays in the cache after its slice of texts, so that CACHED bounds bytes too.
KEPT = 64
#: A run is a stretch that no match of the split pattern crosses: at most one space and what follows
#: up to white space, or white space.
RUNS = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

_NONE = np.int64(1) << 62


def runs(text: str) -> Iterator[list[str]]:
    """The runs of a text, some hundred thousand at a time."""
    if len(text) <= 4 * HELD:
        yield RUNS.findall(text)
        return
    held = []
    for m in RUNS.finditer(text):
        held.append(m[0])
        if len(held) >= HELD:
            yield held
            held = []
    yield held


class SegmentTreeBPE:
    """Encoder and decoder for a rank file (lines: base64 token, rank), where a token's id is its rank."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for t, i in self.ranks.items():
            for k in range(1, len(t)):
                left, right = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.cache: dict[str, bytes] = {}
        self.long: list[str] = []

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id (and so the rank) that each pair merges into; negative where none. Negative sides have none."""
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], -1)

    def _side_by_side(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        rows, n = len(pieces), leaves
        size = np.fromiter(map(len, pieces), np.int64, rows)
        place = np.arange(n)
        inside = place < size[:, None]
        tok = np.full((rows, n + 1), -1, np.int64)  # column n stays -1: beyond the end
        tok[:, :n][inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.minimum(np.broadcast_to(place + 1, (rows, n)), size[:, None])
        after = np.where(after >= size[:, None], n, after)
        before = np.broadcast_to(place - 1, (rows, n)).copy()
        tree = np.full((rows, 2 * n), _NONE, np.int64)
        rank = self._lookup(tok[:, :-1].ravel(), np.take_along_axis(tok, after, 1).ravel()).reshape(rows, n)
        tree[:, n:] = np.where(rank >= 0, rank * n + place, _NONE)
        h = n // 2
        while h:
            tree[:, h : 2 * h] = np.minimum(tree[:, 2 * h : 4 * h : 2], tree[:, 2 * h + 1 : 4 * h : 2])
            h //= 2
        live = np.arange(rows)
        while True:
            root = tree[live, 1]
            going = root < _NONE
            live, root = live[going], root[going]
            if not len(live):
                break
            a, new = root % n, root // n
            b = after[live, a]
            c = after[live, b]
            p = before[live, a]
            tok[live, a], tok[live, b] = new, -1
            after[live, a] = c
            on = c < n
            before[live[on], c[on]] = a[on]
            tree[live, n + b] = _NONE
            r = self._lookup(new, tok[live, c])
            tree[live, n + a] = np.where(r >= 0, r * n + a, _NONE)
            has = p >= 0
            lp, pp = live[has], p[has]
            r = self._lookup(tok[lp, pp], new[has])
            tree[lp, n + pp] = np.where(r >= 0, r * n + pp, _NONE)
            for row, leaf in ((live, b), (live, a), (lp, pp)):
                node = n + leaf
                while node.size and node[0] > 1:
                    node = node >> 1
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        kept = tok[:, :n] >= 0
        flat, ends = tok[:, :n][kept].astype("<u4").tobytes(), np.cumsum(kept.sum(1)) * 4
        return [flat[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _alone(self, piece: bytes) -> bytes:
        size = len(piece)
        n = 1 << (size - 1).bit_length()
        none = 1 << 62
        tok = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        pairs, tree = self.pairs, [none] * (2 * n)
        for i in range(size - 1):
            r = pairs.get(tok[i] << 20 | tok[i + 1])
            if r is not None:
                tree[n + i] = r * n + i
        for i in range(n - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(leaf: int, value: int) -> None:
            i = n + leaf
            tree[i] = value
            while i > 1:
                i >>= 1
                x = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == x:
                    return
                tree[i] = x

        while tree[1] < none:
            new, a = divmod(tree[1], n)
            b = after[a]
            c, p = after[b], before[a]
            tok[a], tok[b] = new, -1
            after[a] = c
            put(b, none)
            r = pairs.get(new << 20 | tok[c]) if c < size else None
            if c < size:
                before[c] = a
            put(a, none if r is None else r * n + a)
            if p >= 0:
                r = pairs.get(tok[p] << 20 | new)
                put(p, none if r is None else r * n + p)
        return np.array([t for t in tok if t >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each piece, in order; empty pieces have none."""
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif p:
                by_size.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
        for n, which in by_size.items():
            if n > WIDEST:
                for i in which:
                    out[i] = self._alone(pieces[i])
                continue
            step = max(1, SIDE_BY_SIDE // n)
            for s in range(0, len(which), step):
                part = which[s : s + step]
                for i, ids in zip(part, self._side_by_side([pieces[i] for i in part], n), strict=True):
                    out[i] = ids
        return out

    def learn(self, wanted: set[str]) -> dict[str, bytes]:
        """The cache after it has got all wanted runs; what it held beyond CACHED goes first."""
        cache = self.cache
        if len(cache) + len(wanted) > CACHED:
            cache = self.cache = {k: cache[k] for k in wanted if k in cache}
        missing = [w for w in wanted if w not in cache]
        split = [self.split.findall(w) for w in missing]
        pieces = list({p for s in split for p in s})
        ids = dict(zip(pieces, self.encode_pieces([p.encode() for p in pieces]), strict=True))
        for w, s in zip(missing, split, strict=True):
            cache[w] = ids[s[0]] if len(s) == 1 else b"".join(map(ids.__getitem__, s))
        self.long += [w for w in missing if len(w) > KEPT]
        return cache

    def forget(self, start: int = 0) -> None:
        """Takes the long runs learnt since start out of the cache again."""
        for w in self.long[start:]:
            self.cache.pop(w, None)
        del self.long[start:]

    def ids(self, text: str) -> Iterator[bytes]:
        """The ids of one text, in parts of bounded size."""
        for part in runs(text):
            start = len(self.long)
            yield b"".join(map(self.learn(set(part)).__getitem__, part))
            self.forget(start)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _worker(rank_file, pattern):
    """The encoder of this worker process, made once for each rank file."""
    key = hash((rank_file, pattern))
    if _made.get("key") != key:
        _made.update(key=key, bpe=SegmentTreeBPE(rank_file, pattern))
    return _made["bpe"]


_made: dict = {}


def encode_documents(df: DataFrame, rank_file: bytes, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: (key, n_tokens, ids_sha256, decoded_sha256[, ids]).

    Equals tiktoken's encode_ordinary over whole texts; there are no special tokens. A null or empty
    text has no tokens and the digests of nothing. Rows, repeated ones too, stay as they are; other
    columns are not carried. with_ids adds the ids as binary (little-endian unsigned 32-bit).
    Narrow: no shuffle. The rank file (under 1 MB) is broadcast; a worker keeps one encoder and a
    cache of at most CACHED runs of KEPT characters at most, plus those of one slice of texts.
    """
    shipped = df.sparkSession.sparkContext.broadcast(rank_file)

    def work():
        hold("bpe", _made.clear)
        bpe = _worker(shipped.value, pattern)

        def run(texts):
            n, enc, dec, raw = [], [], [], []
            cut = [RUNS.findall(t) if len(t) <= 4 * HELD else None for t in texts]
            bpe.learn({r for c in cut if c for r in c})
            known = bpe.cache
            for t, c in zip(texts, cut, strict=True):
                a, b, k, whole = hashlib.sha256(), hashlib.sha256(), 0, []
                for ids in bpe.ids(t) if c is None else [b"".join(map(known.__getitem__, c))]:
                    a.update(ids)
                    b.update(bpe.decode(ids))
                    k += len(ids) // 4
                    if with_ids:
                        whole.append(ids)
                n.append(k)
                enc.append(a.hexdigest())
                dec.append(b.hexdigest())
                raw.append(b"".join(whole))
            bpe.forget()
            return [n, enc, dec, raw] if with_ids else [n, enc, dec]

        return run

    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields.append(pa.field("ids", pa.binary()))
        schema += ", ids binary"
    return map_texts(df, key, text, work, schema, fields).withColumnRenamed("key", key)
