"""Token counts by a map-side two-tier lookup.

Tier one is a table of the most frequent runs (a space and what follows up to white space; no
match of the tokenizer's split pattern crosses a run's border) with their token counts. It is made
from summaries of all documents and broadcast; its size has a fixed bound. Tier two is a cache in
each Python worker for what tier one lacks, filled by the library. No run is ever shuffled: only
the summaries are, and they have at most SUMMARY rows for each slice of the input.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import runs
from .common import hold, map_texts, slices

#: Rows of the broadcast table (about 20 bytes each); runs a task's summary keeps; runs in a worker's cache.
FREQUENT, SUMMARY, CACHED = 1 << 16, 1 << 12, 900_000
#: Characters of a run that stays in the cache after its slice of texts, so that CACHED bounds bytes too.
KEPT = 64

_made: dict = {}


def _tokenizer(content: str):
    """The library's tokenizer of this worker process. Threads would only contend with Spark's tasks."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hash(content)
    if _made.get("key") != key:
        _made.update(key=key, tokenizer=Tokenizer.from_str(content), cache={}, long=[])
    return _made["tokenizer"]


def _segments(text: str, special: list[str]) -> list[str]:
    """The text cut at special strings, which the library finds before it splits; each counts as one token."""
    parts = [text]
    for s in special:
        if s in text:
            parts = [q for p in parts for q in p.split(s)]
    return parts


def frequent_runs(df: DataFrame, text: str = "text", keep: int = FREQUENT) -> list[str]:
    """The runs with the largest counts over all documents, by summaries.

    Every task counts all its runs, and keeps lossy counts: whenever its table is 64 times SUMMARY, it goes on
    with the 16 * SUMMARY most frequent ones; in the end it reports the SUMMARY most frequent that it has met twice.
    Which runs are found decides about speed only, never about a result.
    """

    def summary(batches):
        total: Counter = Counter()
        for batch in batches:
            for _, texts in slices(batch, "text"):
                for t in texts:
                    for part in runs(t):
                        total.update(part)
                if len(total) > 64 * SUMMARY:
                    total = Counter(dict(total.most_common(16 * SUMMARY)))
        best = [x for x in total.most_common(SUMMARY) if x[1] > 1]
        yield pa.RecordBatch.from_pydict({"run": [a for a, _ in best], "n": [b for _, b in best]}, schema=pa.schema([("run", pa.string()), ("n", pa.int64())]))

    counts = df.select(F.col(text).alias("text")).mapInArrow(summary, "run string, n bigint")
    top = counts.groupBy("run").agg(F.sum("n").alias("n")).where(F.length("run") <= 64).orderBy(F.desc("n"), "run").limit(keep)
    return [r.run for r in top.collect()]  # at most keep rows of 64 characters


def count_tokens(df: DataFrame, tokenizer_json: str, key: str = "doc_id", text: str = "text", limit: int = 512, keep: int = FREQUENT) -> DataFrame:
    """Count every text's tokens: (key, n_bytes, n_tokens, over_limit).

    Equals len(Tokenizer.encode(text, add_special_tokens=False)) for a byte-level tokenizer without
    normalizer and prefix space; special strings inside a text count as the library's default has it.
    A null or empty text has 0 bytes and 0 tokens; repeated rows stay; other columns are not carried;
    over_limit is n_tokens > limit.
    """
    import json

    from tokenizers import Tokenizer

    spec = json.loads(tokenizer_json)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
        raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"]):
        raise ValueError("added tokens that take in their surroundings aren't supported")
    special = [a["content"] for a in spec["added_tokens"]]
    common = [r for r in frequent_runs(df, text, keep) if not any(s in r for s in special)]
    lengths = [len(e.ids) for e in Tokenizer.from_str(tokenizer_json).encode_batch_fast(common, add_special_tokens=False)]
    sc = df.sparkSession.sparkContext
    tier_one, tier_name = sc.broadcast((common, np.array(lengths, np.uint16).tobytes())), uuid.uuid4().hex
    shipped = sc.broadcast(tokenizer_json)

    def work():
        hold("token_counts", _made.clear)
        tok = _tokenizer(shipped.value)
        if _made.get("tier_one") != tier_name:
            names, packed = tier_one.value
            _made.update(tier_one=tier_name, frequent=dict(zip(names, np.frombuffer(packed, np.uint16).tolist(), strict=True)), cache={}, long=[])
        frequent = _made["frequent"]

        def learnt(wanted):
            cache = _made["cache"]
            if len(cache) + len(wanted) > CACHED:
                cache = _made["cache"] = {k: cache[k] for k in wanted if k in cache}
            for w in wanted:
                if w in frequent:
                    cache[w] = frequent[w]
            missing = [w for w in wanted if w not in cache]
            for w, e in zip(missing, tok.encode_batch_fast(missing, add_special_tokens=False), strict=True):
                cache[w] = len(e)
            _made["long"] += [w for w in missing if len(w) > KEPT]
            return cache

        def forget(start=0):
            """Takes the long runs learnt since start out of the cache again."""
            for w in _made["long"][start:]:
                _made["cache"].pop(w, None)
            del _made["long"][start:]

        def in_parts(p):
            """Tokens of a very long segment, part by part."""
            for part in runs(p):
                start = len(_made["long"])
                yield sum(map(learnt(set(part)).__getitem__, part))
                forget(start)

        def run(texts):
            cut = []
            for t in texts:
                parts = _segments(t, special)
                cut.append((len(parts) - 1, [next(runs(p)) for p in parts]) if len(t) < 1_000_000 else None)
            known = learnt({r for c in cut if c for part in c[1] for r in part})
            n = []
            for t, c in zip(texts, cut, strict=True):
                if c:
                    n.append(c[0] + sum(sum(map(known.__getitem__, part)) for part in c[1]))
                else:
                    parts = _segments(t, special)
                    n.append(len(parts) - 1 + sum(k for p in parts for k in in_parts(p)))
            forget()
            return [[len(t.encode()) for t in texts], n, [x > limit for x in n]]

        return run

    fields = [pa.field("n_bytes", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("over_limit", pa.bool_())]
    return map_texts(df, key, text, work, "n_bytes bigint, n_tokens bigint, over_limit boolean", fields).withColumnRenamed("key", key)
