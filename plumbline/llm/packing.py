"""Online packing of token ids into windows by the sum-of-squares rule.

A document's ids fill whole windows first; the rest, shorter than a window, is one item. A level
array counts the open windows of each fill. An item goes to the level (an empty window is level 0)
for which the sum of the squared counts grows least: moving a window from level h to h + s changes
it by 2 * (count[h + s] - count[h] + 1), and a window that gets full leaves the array. What the rule has placed
stays where it is, but for the emptiest windows: at a task's end (and one by one while more windows are open than memory is meant for) their items top up the
fullest ones, one of them cut for each. What is left is less than a window and is cut at powers of two, at which nothing needs padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, slices, trimmed
from .token_counts import _tokenizer

WINDOW, OPEN_LIMIT, CACHED, PIECES = 2048, 4096, 450_000, 50_000

_made: dict = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level letters: printable Latin-1 bytes stand for themselves, the others for 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids of white-space separated words by the library, cached; a bounded cache for each worker.

    For a tokenizer whose normalizer lowers letters and whose split pattern drops white space, so that words
    are independent. Words of Latin-1 characters, which NFC leaves alone, skip the normalizer: their
    pieces go straight to the library's model.
    """

    #: The tokenizer's own split pattern is read from its file.
    def __init__(self, content: str):
        self.tok = _tokenizer(content)
        spec = json.loads(content)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = [a["content"] for a in spec["added_tokens"]]
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.long: list[str] = []
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is not None:
            return ids
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        at = piece.encode().decode("latin-1").translate(self.letters)
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.tok.model.tokenize(at)])
        if len(piece) <= 256 and not piece.isalpha():  # letters are kept as words
            self.pieces[piece] = ids
        return ids

    def learn(self, wanted: set[str]) -> dict[str, bytes]:
        """The cache after it has got all wanted words; what it held beyond CACHED goes first."""
        words, split, piece = self.words, self.pattern.findall, self._piece
        for w in self.long:
            words.pop(w, None)
        self.long = [w for w in wanted if len(w) > 256]  # held for these texts only: the cache is bounded in bytes, too
        if len(words) + len(wanted) > CACHED:
            words = self.words = {k: words[k] for k in wanted if k in words}
        for w in wanted:
            if w in words:
                continue
            if w.isascii() or max(w) < "Ā":
                low = w.lower()
                if low.isalpha():  # one piece; letters of the apostrophe endings come after an apostrophe only
                    words[w] = (words.get(low) if low != w else None) or piece(low)
                    continue
                if not any(map(w.__contains__, self.special)):
                    words[w] = b"".join([(words.get(p) if p.isalpha() else None) or piece(p) for p in split(low)])
                    continue
            words[w] = np.array(self.tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        return words


#: White space that str.split takes and the tokenizer's pattern does not (fixed values).
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


def _split(text: str) -> list[str]:
    if any(c in text for c in _ODD):
        return regex.findall(r"\S+", text)
    return text.split()


class Packer:
    """The state of one task. add() gives finished pieces, close() the rest; both as tuples
    (key, start, length, crc32, tokens of the document, sequence, offset)."""

    def __init__(self, first_sequence: int, window: int = WINDOW, open_limit: int = OPEN_LIMIT):
        self.window, self.limit, self.next = window, open_limit, first_sequence
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.n_open = self.moved = self.cut = 0  # open windows; items that left their window for another, and those of them that were cut

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def _level(self, size: int) -> int:
        """The level h that has a window, h + size <= window, with the least growth of the sum of squares; the fullest of equals."""
        top = self.window - size
        count = self.count
        growth = 2 * (count[size : top + size + 1] - count[: top + 1] + 1)
        growth[0] = 2 * count[size] + 1  # a new window opens
        growth[top] = 1 - 2 * count[top]  # the window gets full and leaves the array
        growth[1:][count[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(growth[::-1]))

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        for start in range(0, total - self.window + 1, self.window):
            yield key, start, self.window, zlib.crc32(ids[4 * start : 4 * (start + self.window)]), total, self._sequence(), 0
        size = total % self.window
        if not size:
            return
        item = (key, total - size, total, ids[4 * (total - size) :])
        h = self._level(size)
        if h:
            items = self.open[h].pop()
            self.count[h] -= 1
            self.n_open -= 1
        else:
            items = []
        items.append(item)
        if h + size == self.window:
            yield from self._whole(items)
            return
        self.open[h + size].append(items)
        self.count[h + size] += 1
        self.n_open += 1
        while self.n_open > self.limit:
            yield from self._top_up()

    def _whole(self, items: Iterable[tuple]) -> Iterator[tuple]:
        seq, at = self._sequence(), 0
        for key, start, total, ids in items:
            yield key, start, len(ids) // 4, zlib.crc32(ids), total, seq, at
            at += len(ids) // 4

    def _fullest(self) -> list:
        level = int(np.flatnonzero(self.count)[-1])
        self.count[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _top_up(self) -> Iterator[tuple]:
        """Takes the fullest window and fills it with items of the emptiest one, until that is used up or the window is full."""
        window = self._fullest()
        gap = self.window - sum(len(i[3]) // 4 for i in window)
        level = int(np.flatnonzero(self.count)[0])
        rest, left = self.open[level].pop(), level
        self.count[level] -= 1
        self.n_open -= 1
        while gap and rest:
            key, start, total, ids = rest.pop()
            n = min(gap, len(ids) // 4)
            window.append((key, start, total, ids[: 4 * n]))
            if 4 * n < len(ids):
                rest.append((key, start + n, total, ids[4 * n :]))
                self.cut += 1
            self.moved += 1
            gap, left = gap - n, left - n
        if gap:
            rest, left = window, self.window - gap
        else:
            yield from self._whole(window)
        if rest:
            self.open[left].append(rest)
            self.count[left] += 1
            self.n_open += 1

    def close(self) -> Iterator[tuple]:
        while self.n_open > 1:
            yield from self._top_up()
        if self.n_open:
            items = self._fullest()
            left, room, piece = sum(len(i[3]) // 4 for i in items), 0, []
            for key, start, total, ids in items:
                while ids:
                    if not room:
                        room = 1 << (left.bit_length() - 1)
                    n = min(room, len(ids) // 4)
                    piece.append((key, start, total, ids[: 4 * n]))
                    start, ids, room, left = start + n, ids[4 * n :], room - n, left - n
                    if not room:
                        yield from self._whole(piece)
                        piece = []


_OUT = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _check(tokenizer_json: str) -> None:
    """Refuses tokenizers of which WordIds would not give the library's ids."""
    spec = json.loads(tokenizer_json)
    normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    shape = [(x["type"], x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in split]
    if normal != ["NFC", "Replace", "Lowercase"] or shape != [("Split", "Removed", True, None, None), ("ByteLevel", None, None, False, False)]:
        raise ValueError("a tokenizer is needed that lowers letters, splits words by a pattern and encodes their bytes")
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or a["content"] != a["content"].strip() or len(a["content"].split()) > 1 for a in spec["added_tokens"]):
        raise ValueError("added tokens that take in their surroundings or hold white space aren't supported")


def pack(df: DataFrame, tokenizer_json: str, key: str = "doc_id", text: str = "text", end_id: int = 1, window: int = WINDOW, open_limit: int = OPEN_LIMIT) -> DataFrame:
    """Pack every document (its ids, then end_id) into sequences of at most window ids.

    One row per piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset). Every id lies in
    exactly one piece, offsets are gapless from 0, and every sequence is full or a power of two long.
    A null or empty text is end_id alone; repeated rows are packed as often; other columns are not carried;
    an empty table gives no rows. Each task packs its own rows (sequence ids carry the partition's
    number), so nothing is shuffled and a repeated task gives the same rows. Memory: one slice of texts and
    at most open_limit windows of ids; long documents are encoded part by part.
    """
    _check(tokenizer_json)
    shipped = df.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        hold("packing", _made.clear)
        content = shipped.value
        if _made.get("key") != hash(content):
            _made.update(key=hash(content), words=WordIds(content))
        words = _made["words"]
        packer = Packer(TaskContext.get().partitionId() << 40, window, open_limit)
        end = int(end_id).to_bytes(4, "little")

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [[]] * 7, _OUT, strict=True)], schema=_OUT)

        for batch in batches:
            for cols, texts in slices(batch, "text"):
                split = [_split(t) for t in texts]
                known = words.learn({w for s in split for w in s})
                found = []
                for k, s in zip(cols[0].to_pylist(), split, strict=True):
                    found.extend(packer.add(k, b"".join(map(known.__getitem__, s)) + end))
                yield rows(found)
        yield rows(list(packer.close()))

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(trimmed(run), "key bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("key", key)
