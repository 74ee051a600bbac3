"""Quality by Bradley-Terry pairwise ranking.

A document's strength is linear in its features. Preference pairs (a label 1 over a label 0) are made
of all labelled documents, and the weights minimise the logistic loss on feature differences. The threshold is
the quantile of all labelled documents' scores that the labels' share of 0 names.

Up to POOL labelled documents are fitted at once. More are dealt to pools, each of which pairs all its documents; tasks give the
sums of a Newton step by pool, and only these meet in the driver, in the pools' order.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hold, map_texts, slices, trimmed, written

#: Labelled documents of a pool; preference pairs of one; ridge; the score at the threshold.
POOL, PAIRS, RIDGE, CUT = 8000, 100_000, 1e-3, 0.3
#: Labels broadcast at most; the share of a pool that the rarer label has at least; bins of scores, and scores from which ranks are taken in the driver.
BROADCAST_LABELS, LEAST_SHARE, BINS, FEW = 200_000, 8, 4096, 10_000

_LETTER, _UPPER, _DIGIT = np.zeros(256), np.zeros(256), np.zeros(256)
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = 1
_DIGIT[48:58] = 1
_MARKS = "!|#$%&*@<>{}[]=+_~^\\/"
_ENDS = re.compile(r"[^\w\s]{2,}(?:\s|$)")
NAMES = ("log_words", "upper", "digit", "mark", "bang", "bar", "other_ascii", "word_length", "distinct", "repeats", "ends", "line_length", "line_repeats", "top_line_words", "capital_words", "short_words")


def features(text: str) -> list[float]:
    """Scale-free figures of a whole text; zeros for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size, n = len(text), len(words)
    letters = max(1.0, float(raw @ _LETTER))
    marks = sum(int(raw[ord(c)]) for c in _MARKS)
    other = int(raw[33:127].sum() - raw @ _LETTER - raw @ _DIGIT) - marks
    lines = [x for x in text.split("\n") if x]
    seen = len(set(words))
    return [
        np.log1p(n),
        float(raw @ _UPPER) / letters,
        float(raw @ _DIGIT) / size,
        marks / size,
        int(raw[33]) / n,
        int(raw[124]) / n,
        other / n,
        min(40.0, (size - n) / n),
        np.log1p(seen) / np.log1p(n),
        sum(map(eq, words, words[1:])) / n,
        len(_ENDS.findall(text)) / n,
        np.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(max((x.count(" ") for x in lines), default=0)),
        sum(map(str.istitle, words)) / n,
        sum(1 for w in words if len(w) < 3) / n,
    ]


class Ranking:
    """Weights, standardisation and threshold; score() is 1 / (1 + e^-x), CUT at the threshold and rising with strength."""

    def __init__(self, mean, scale, weights, threshold, spread):
        self.mean, self.scale, self.weights, self.threshold, self.spread = mean, scale, weights, threshold, spread

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, np.abs(z)])

    def score(self, x: np.ndarray) -> np.ndarray:
        s = (self.expand(x) @ self.weights - self.threshold) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def fit(x: np.ndarray, label: np.ndarray, share_low: float, seed: int = 8) -> Ranking:
    """x: features by row; label: 0 or 1; share_low: the share of 0 among all labels. One label alone gives a constant score of 0.5 or above for 1, 0 for 0."""
    width = 2 * len(NAMES)
    plain = Ranking(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(width), -1.0 if share_low < 1 else 1.0, 1.0)
    if not len(x) or label.min() == label.max():
        return plain
    plain.mean, plain.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z, rng = plain.expand(x), np.random.default_rng(seed)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w = _newton(lambda w: _sums(d, w), width)
    s = z @ w
    weight = np.where(label == 1, (1 - share_low) / len(good), share_low / len(bad))
    order = np.argsort(s, kind="stable")
    cum = np.cumsum(weight[order])
    k = min(len(s) - 1, int(np.searchsorted(cum, share_low)))
    threshold = (s[order[k]] + s[order[min(k + 1, len(s) - 1)]]) / 2
    return Ranking(plain.mean, plain.scale, w, float(threshold), float(max(1e-6, s.std() / 4)))


def _sums(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Gradient and Hessian of the sum of log(1 + e^-dw), and the pairs."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
    return -(d * p[:, None]).sum(0), (d * (p * (1 - p))[:, None]).T @ d, len(d)


def _newton(sums, width: int) -> np.ndarray:
    """The least of the mean of log(1 + e^-dw) + RIDGE / 2 * |w|^2."""
    w = np.zeros(width)
    for _ in range(40):
        grad, hess, n = sums(w)
        step = np.linalg.solve(hess / n + RIDGE * np.eye(width), grad / n + RIDGE * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


class _Pools:
    """Features of all labelled documents, a row for each pool: (pool, label, own, x), all three arrays; own: the document isn't a copy of one of another pool."""

    def __init__(self, rows: DataFrame, sizes: dict[int, int], pool: int):
        """rows: (key, label, x); sizes: how many rows a label has. The rarer label goes to several pools where it would have too few rows in each."""
        n = -(-sum(sizes.values()) // pool)
        copies = {v: min(n, max(1, -(-pool * n // (LEAST_SHARE * sizes[v])))) for v in (0, 1)}
        times = F.when(F.col("label") == 1, copies[1]).otherwise(copies[0])
        at = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1))).withColumn("pool", F.pmod(F.xxhash64("key") + F.col("copy"), F.lit(n)).cast("int"))
        member = F.array_sort(F.collect_list(F.struct("label", F.col("copy").alias("copy"), "x")))
        got = at.groupBy("pool").agg(member.alias("m")).select("pool", F.col("m.label").alias("label"), F.transform("m.copy", lambda c: c == 0).alias("own"), F.flatten("m.x").alias("x"))
        self.table = written(got, "quality-pools")

    def run(self, work) -> list[np.ndarray]:
        """work(pool, label, own, x) of each pool, an array, in the pools' order."""
        out = pa.schema([pa.field("pool", pa.int32()), pa.field("got", pa.list_(pa.float64()))])

        def of(batches):
            hold("quality")
            for batch in batches:
                for r in range(batch.num_rows):
                    pool, label, own, x = (batch.column(c)[r] for c in ("pool", "label", "own", "x"))
                    flat = lambda c: c.values.to_numpy(zero_copy_only=False)
                    got = work(pool.as_py(), flat(label), flat(own).astype(bool), flat(x).reshape(-1, len(NAMES)))
                    yield pa.RecordBatch.from_arrays([pa.array([pool.as_py()], pa.int32()), pa.array([got], pa.list_(pa.float64()))], schema=out)

        found = self.table.mapInArrow(trimmed(of), "pool int, got array<double>").collect()
        return [np.array(r.got, float) for r in sorted(found, key=lambda r: r.pool)]


def _fit_pools(pools: _Pools, share_low: float, seed: int = 8) -> Ranking:
    """fit() over pools; every labelled document is in pairs, in the moments and in the threshold."""
    k, width = len(NAMES), 2 * len(NAMES)
    first = sum(pools.run(lambda pool, label, own, x: np.append(x[own].sum(0), [(label[own] == 0).sum(), (label[own] == 1).sum()])))
    of = first[k:]
    mean = first[:k] / of.sum()
    scale = np.maximum(np.sqrt(sum(pools.run(lambda pool, label, own, x: ((x[own] - mean) ** 2).sum(0))) / of.sum()), 1e-9)
    model = Ranking(mean, scale, np.zeros(width), 0.0, 1.0)

    def step(w):
        def work(pool, label, own, x):
            z, rng = model.expand(x), np.random.default_rng([seed, pool])
            good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
            if not len(good) or not len(bad):
                return np.zeros(width + width * width + 1)
            # each document in its turn, the turns in an order of their own for each label
            turns = max(PAIRS, len(good), len(bad))
            d = z[np.resize(rng.permutation(good), turns)] - z[np.concatenate([rng.permutation(bad) for _ in range(-(-turns // len(bad)))])[:turns]]
            g, h, n = _sums(d, w)
            return np.concatenate([g, h.ravel(), [n]])

        total = sum(pools.run(work))
        return total[:width], total[width:-1].reshape(width, width), total[-1]

    model.weights = w = _newton(step, width)
    score = lambda own, x: model.expand(x[own]) @ w
    facts = pools.run(lambda pool, label, own, x: (lambda s: np.array([s.sum(), s.min(), s.max()]))(score(own, x)) if own.any() else np.array([0.0, np.inf, -np.inf]))
    middle, low, high = sum(f[0] for f in facts) / of.sum(), min(f[1] for f in facts), max(f[2] for f in facts)
    spread = np.sqrt(sum(f[0] for f in pools.run(lambda pool, label, own, x: np.array([((score(own, x) - middle) ** 2).sum()]))) / of.sum())
    weight = np.array([share_low / of[0], (1 - share_low) / of[1]])
    below = np.zeros(2)  # documents of each label under low
    while True:  # the bin of the wanted rank, refined until its documents are few or of one score
        edges = np.linspace(low, high, BINS + 1)

        def binned(pool, label, own, x, low=low, high=high, edges=edges):
            s, y = score(own, x), label[own]
            at = np.where((s >= low) & (s <= high), np.clip(np.searchsorted(edges, s, "right") - 1, 0, BINS - 1), BINS)
            return np.bincount(y * (BINS + 1) + at, minlength=2 * (BINS + 1)).astype(float)

        n = sum(pools.run(binned)).reshape(2, BINS + 1)[:, :BINS]
        cum = weight @ (below[:, None] + np.cumsum(n, 1))
        at = min(int(np.searchsorted(cum, share_low - 1e-12)), int(np.flatnonzero(n.sum(0))[-1]))
        below = below + n[:, :at].sum(1)
        width_before, (low, high) = high - low, edges[at : at + 2]
        if n[:, at].sum() <= FEW or high - low >= width_before or not low < (low + high) / 2 < high:
            break
    def inside(pool, label, own, x):
        s, y = score(own, x), label[own]
        near = (s >= low) & (s <= high)
        values, place = np.unique(s[near], return_inverse=True)
        n = np.stack([np.bincount(place[y[near] == v], minlength=len(values)) for v in (0, 1)], 1) if len(values) else np.zeros((0, 2))
        above = s[s > high]
        return np.concatenate([[above.min() if len(above) else np.inf], np.column_stack([values, n]).ravel()])

    got = pools.run(inside)
    above = min(g[0] for g in got)
    rows = np.concatenate([g[1:].reshape(-1, 3) for g in got])
    values, place = np.unique(rows[:, 0], return_inverse=True)
    n = np.stack([np.bincount(place, rows[:, v], len(values)) for v in (1, 2)], 1)
    cum = weight @ below + np.cumsum(n @ weight)
    at = min(int(np.searchsorted(cum, share_low - 1e-12)), len(values) - 1)
    last = cum[at] - weight[1 if n[at, 1] else 0] < share_low - 1e-12 or n[at].sum() == 1  # of equal scores, those of label 0 come first
    following = values[at] if not last else values[at + 1] if at + 1 < len(values) else above
    model.threshold = float((values[at] + (following if np.isfinite(following) else values[at])) / 2)
    model.spread = float(max(1e-6, spread / 4))
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, per_label: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """At most per_label labelled documents of each label, by a hash of the key, and all labels' counts.

    usable is a condition on the key column. The sample's keys (2 * per_label at most) are broadcast to the documents."""
    rows = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("key").isNotNull()).where(usable(F.col("key")))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    order = F.xxhash64("key"), F.col("key")
    picked = [rows.where(F.col("label") == v).dropDuplicates(["key"]).orderBy(*order).limit(per_label) for v in (0, 1)]
    keys = F.broadcast(picked[0].unionByName(picked[1]))
    return docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).join(keys, "key"), counts


def train(docs: DataFrame, labels: DataFrame, usable, pool: int = POOL, key: str = "doc_id", text: str = "text") -> Ranking:
    """Fit on all labelled documents whose key is usable; no other column than text is a feature. What reaches the driver is pool rows of features, or the sums of each pool."""
    rows = labels.select(F.col(key).cast("long").alias("key"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("key").isNotNull()).where(usable(F.col("key")))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(counts.values())
    share = counts.get(0, 0) / total if total else 0.0
    few = total <= BROADCAST_LABELS
    marks = F.broadcast(rows.distinct()) if few else rows.distinct()
    plain = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    # many labels meet features, which are shorter than texts
    wanted = plain.join(F.broadcast(rows.select("key").distinct()), "key", "left_semi") if few else plain.where("key is not null")
    got = written(_featured(wanted, extra="key").join(marks, "key"), "quality-features")
    sizes = {r["label"]: r["count"] for r in got.groupBy("label").count().collect()}
    if sum(sizes.values()) <= pool or len(sizes) < 2:
        # one label alone is known from one row
        some = got.select("label", "x") if len(sizes) > 1 else got.select("label", "x").limit(1)
        held = sorted((r.label, tuple(r.x)) for r in some.collect())
        model = fit(np.array([x for _, x in held]).reshape(-1, len(NAMES)), np.array([y for y, _ in held]), share)
    else:
        pools = _Pools(got, sizes, pool)
        model = _fit_pools(pools, share)
        discard(pools.table)
    discard(got)
    return model


def _featured(rows: DataFrame, extra: str) -> DataFrame:
    def work():
        return lambda texts: [[features(t) for t in texts]]

    return map_texts(rows, extra, "text", work, "x array<double>", [pa.field("x", pa.list_(pa.float64()))]).withColumnRenamed("key", extra)


def score(docs: DataFrame, model: Ranking, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) for every row of docs; predicted is 1 if score >= CUT.

    A null or empty text has zero features and the score those get; repeated rows stay; null keys pass; other columns are
    not carried; narrow, nothing is shuffled."""

    def work():
        hold("quality")

        def run(texts):
            s = model.score(np.array([features(t) for t in texts]).reshape(len(texts), -1))
            return [s.tolist(), (s >= CUT).astype(int).tolist()]

        return run

    return map_texts(docs, key, text, work, "score double, predicted int", [pa.field("score", pa.float64()), pa.field("predicted", pa.int32())]).withColumnRenamed("key", key)


def held_out(key, folds: int, fold: int):
    """crc32 of the key as text, modulo folds, is fold."""
    return F.crc32(key.cast("string")) % folds == fold


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted), the model fitted on labelled keys that are not held out (crc32 mod 5 = 0)."""
    model = train(docs, labels, lambda k: ~held_out(k, 5, 0), key=key, text=text)
    return score(docs, model, key, text).select(key, held_out(F.col(key), 5, 0).alias("held_out"), "score", "predicted")


def filter_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those whose text scores below CUT; all columns stay. Decisions are made row by row inside one narrow map, so repeated keys keep their own."""
    model = train(docs, labels, lambda k: ~held_out(k, 5, 0), key=key, text=text)
    return keep_where(docs, text, lambda texts: model.score(np.array([features(t) for t in texts]).reshape(len(texts), -1)) >= CUT)


def keep_where(docs: DataFrame, text: str, decide) -> DataFrame:
    """The rows of docs for whose texts (null as '') decide gives True; no shuffle, all columns as they are."""
    def run(batches):
        hold("filter")
        for batch in batches:
            for cols, texts in slices(batch, text):
                yield pa.RecordBatch.from_arrays(cols, schema=batch.schema).filter(pa.array(np.asarray(decide(texts), bool)))

    return docs.mapInArrow(trimmed(run), docs.schema)
