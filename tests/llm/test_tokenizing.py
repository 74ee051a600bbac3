"""Encoding, counting and packing against the libraries, on odd inputs."""

import base64
import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from plumbline.llm import bpe, packing, token_counts

RANKS = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
BYTE_JSON = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
WORD_JSON = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()


def texts():
    rng = random.Random(2)
    odd = "ab \n\t　é🎉'sl1.\x1e\x1c\x85 ßİΣ<|>"
    yield from [None, "", " ", "\n\n  \n", "it's  he'll\r\n", "x" * 3000, "ab" * 900 + " y", "日本語🎉 test", "a<|endoftext|>b <|endoftext|> c", "<|startoftext|>x", "ΑΣ Σ. İstanbul ﬁne é"]
    yield from ("".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(150))
    yield "".join(rng.choice("abcdefgh") for _ in range(20_000))
    yield " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(40_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    rows += [(3, rows[3][1], "again"), (None, "no key", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")  # a column that clashes with a result's


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_tiktoken(docs):
    enc, given = encoding(), docs.collect()
    want = sorted((r.doc_id or -1, len(i := enc.encode_ordinary(r.text or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in given)
    got = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_trees_agree(spark):
    b, rng = bpe.SegmentTreeBPE(RANKS, public_tokenizers.PATTERN), random.Random(1)
    for n in (2, 3, 5, 31, 64, 65, 250):
        pieces = [bytes(rng.randrange(97, 105) for _ in range(n)) for _ in range(20)]
        assert b._side_by_side(pieces, max(4, 1 << (n - 1).bit_length())) == [b._alone(p) for p in pieces]


def test_caches_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 50)
    b, enc = bpe.SegmentTreeBPE(RANKS, public_tokenizers.PATTERN), encoding()
    for k in range(20):
        t = " ".join(f"w{k}x{i}" for i in range(30))
        assert np.frombuffer(b"".join(b.ids(t)), "<u4").tolist() == enc.encode_ordinary(t)
    assert len(b.cache) <= 80


def test_long_runs_leave_the_caches(spark):
    rng = random.Random(9)
    b, enc = bpe.SegmentTreeBPE(RANKS, public_tokenizers.PATTERN), encoding()
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(3000)) for _ in range(30))
    assert np.frombuffer(b"".join(b.ids(long)), "<u4").tolist() == enc.encode_ordinary(long)
    assert not b.long and sum(map(len, b.cache)) <= bpe.KEPT * len(b.cache) and max(map(len, b.cache), default=0) <= bpe.KEPT
    # texts beyond what is cut at once, whose parts go through the caches one by one, beside short ones of the same slice
    words = [("w%d" % (i % 977)) + ("z" * 90 + str(i) if i % 5000 == 0 else "") for i in range(450_000)]
    texts = ["short " + words[0], " ".join(words), "again " + " ".join(words[:3]), words[5000] + " " + words[5000]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: r for r in bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN).collect()}
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, BYTE_JSON).collect()}
    assert len(texts[1]) > 2_000_000
    for i, t in enumerate(texts):
        ids = np.array(enc.encode_ordinary(t), "<u4")
        assert got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and got[i].n_tokens == len(ids)
        assert counts[i] == len(Tokenizer.from_str(BYTE_JSON).encode(t, add_special_tokens=False).ids)


def test_counts_equal_library(docs):
    tok = Tokenizer.from_str(BYTE_JSON)
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), n := len(tok.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in docs.collect())
    for keep in (1 << 16, 3):
        got = token_counts.count_tokens(docs, BYTE_JSON, keep=keep).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_counts_refuse_other_tokenizers(docs):
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, WORD_JSON)


@pytest.mark.parametrize("limit", [4096, 5])
def test_packing_holds_every_id_once(spark, docs, limit):
    tok = Tokenizer.from_str(WORD_JSON)
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {r.doc_id: np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in unique.collect()}
    rows = packing.pack(unique, WORD_JSON, open_limit=limit).collect()
    at, seq = dict.fromkeys(ids, 0), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {k: len(v) for k, v in ids.items()}
    for parts in seq.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 2048 and end & (end - 1) == 0  # 2048 is a power of two


def test_sum_of_squares_choice():
    p, rng = packing.Packer(0, window=12), random.Random(3)
    for _ in range(300):
        size, before = rng.randrange(1, 12), p.count.copy()
        h = p._level(size)

        def total(level):
            c = before.copy()
            if level:
                c[level] -= 1
            if level + size < 12:
                c[level + size] += 1
            return int((c**2).sum())

        options = [x for x in range(12 - size + 1) if x == 0 or before[x]]
        assert h in options and total(h) == min(map(total, options))
        list(p.add(0, b"\0\0\0\0" * size))


def test_packing_leaves_most_items_where_the_rule_puts_them():
    """Of 8,000 documents in a task and of 32 tasks with 250 each."""
    rng = np.random.default_rng(5)
    sizes = np.minimum(30_000, (np.exp(rng.normal(5.6, 1.0, 8000)) + 1).astype(int))
    for tasks, most in ((1, 0.05), (32, 0.25)):
        moved = cut = tokens = 0
        for part in np.array_split(sizes, tasks):
            p = packing.Packer(0)
            out = [r for k, n in enumerate(part) for r in p.add(k, b"\0\0\0\0" * int(n))] + list(p.close())
            assert sum(r[2] for r in out) == part.sum()
            filled = np.bincount([r[5] for r in out], [r[2] for r in out])
            assert (filled == 2048).sum() == part.sum() // 2048 and all(n.bit_count() == 1 for n in filled.astype(int).tolist())
            moved, cut, tokens = moved + p.moved, cut + p.cut, tokens + int(part.sum())
        print(tasks, moved / len(sizes), cut / len(sizes))
        assert moved <= most * len(sizes) and cut <= moved


def test_packing_refuses_other_tokenizers(docs):
    with pytest.raises(ValueError):
        packing.pack(docs, BYTE_JSON)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.count_tokens(none, BYTE_JSON).count() == 0
    assert packing.pack(none, WORD_JSON).count() == 0
