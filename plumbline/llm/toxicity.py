"""Toxicity by a logistic classifier that is regularised with counterfactuals.

Features are words and beginnings of words, by the number of times a text holds them up to seven. For labelled sentences that name a group,
the group's term is swapped for others; where a document names none, a term is put into a copy of one of its sentences, and
swapped there. The squared change of the sentence's logit is part of the loss; so neutral mentions of groups, and the beginnings that their names
share with other words, gain no weight of their own. The terms are features whether the labelled documents hold them or not.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hold, map_texts, written
from .quality import held_out, keep_where, labelled_sample

#: Documents of each label in the fit at most; features in the model; documents a feature must be in; ridge; weight of the counterfactual term; the least score that counts as toxic.
PER_LABEL, WORDS, LEAST, RIDGE, PENALTY, CUT = 4000, 1024, 8, 1e-3, 1.0, 0.3

#: Group terms; those of a line can stand for each other.
IDENTITY = (
    ("muslim", "jewish", "christian", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "jews", "christians", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("women", "men", "immigrants", "refugees", "foreigners", "natives"),
    ("woman", "man", "immigrant", "refugee", "foreigner", "native"),
    ("musulman", "juif", "chrétien", "noir", "blanc", "arabe"),
    ("muslimisch", "jüdisch", "christlich", "schwarz", "weiß", "türkisch"),
    ("musulmán", "judío", "cristiano", "negro", "blanco", "gitano"),
)
_GROUP = {w: line for line in IDENTITY for w in line}
_WORD = re.compile(r"[^\W_]+")
#: Counterfactual pairs of a labelled document at most.
PAIRS = 4
#: Lengths of the beginnings of longer words that are features, and feature values by count.
BEGINNINGS, VALUE, MOST = range(3, 8), np.log2(1 + np.arange(8)), 7
_SENTENCE = re.compile(r"[^.!?\n]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def parts(word: str) -> list[str]:
    """The features that a word counts for."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


def swaps(sentence: list[str]) -> list[list[str]]:
    """The sentence with all its group terms replaced by the next, the one after and so on of their lines; none without such terms."""
    if not any(w in _GROUP for w in sentence):
        return []
    most = max(len(_GROUP[w]) for w in sentence if w in _GROUP)
    turn = lambda w, k: _GROUP[w][(_GROUP[w].index(w) + k) % len(_GROUP[w])] if w in _GROUP else w
    return [[turn(w, k) for w in sentence] for k in range(1, most)]


def counterfactuals(text: str) -> list[tuple[list[str], list[str]]]:
    """Pairs of sentences, as words, that differ in group terms only: PAIRS at most, of the text's sentences that name a group; else of one
    sentence with a term put in, where all choices go by a hash of the text."""
    sentences = [w for w in map(words, _SENTENCE.findall(text)) if w]
    naming = [s for s in sentences if not _GROUP.keys().isdisjoint(s)]
    h = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    if naming:
        start = h % len(naming)
        return [(s, x) for s in (naming[start:] + naming[:start])[:PAIRS] for x in swaps(s)][:PAIRS]
    if not sentences:
        return []
    s, line = sentences[h % len(sentences)], IDENTITY[h // 7 % len(IDENTITY)]
    a, b = (line[(h // 77 + k) % len(line)] for k in (0, 1))
    at = h // 777 % (len(s) + 1)
    return [(s, [*s[:at], a, *s[at:]]), ([*s[:at], a, *s[at:]], [*s[:at], b, *s[at:]])]


class Toxicity:
    """Weights by feature. Words are looked up in a cache of the positions they count for."""

    def __init__(self, vocabulary: list[str], weights: np.ndarray, bias: float):
        self.at = {w: i for i, w in enumerate(vocabulary)}
        self.weights, self.bias, self.known = weights, bias, {}

    def positions(self, word: str) -> tuple[int, ...]:
        found = tuple(self.at[p] for p in parts(word) if p in self.at)
        if len(word) <= 64:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = found
        return found

    def counts(self, tokens: list[str]) -> dict[int, int]:
        """Positions held and how often, MOST at most."""
        known, held = self.known, {}
        for w, n in Counter(tokens).items():
            at = known.get(w)
            for i in self.positions(w) if at is None else at:
                held[i] = held.get(i, 0) + n
        return {i: min(n, MOST) for i, n in held.items()}

    def logit(self, tokens: list[str]) -> float:
        return self.bias + float(sum(self.weights[i] * VALUE[n] for i, n in self.counts(tokens).items()))

    def score(self, texts: list[str]) -> np.ndarray:
        s = np.array([self.logit(words(t)) for t in texts])
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def train_rows(held: list[dict[int, int]], label: np.ndarray, size: int, pairs: list[tuple[dict[int, int], dict[int, int]]], share_toxic: float, penalty: float = PENALTY, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Weights and bias. held: positions of the features of each document and their counts; pairs: those of a sentence and of its counterfactual.

    The loss is the log loss weighted to share_toxic, a ridge, and penalty times the mean squared difference of the pairs' logits;
    accelerated gradient steps."""
    n = len(held)
    x = np.zeros((n, size), np.float32)
    for i, at in enumerate(held):
        x[i, list(at)] = VALUE[list(at.values())]
    gram = np.zeros((size, size))  # the mean of the outer products of the pairs' differences
    for start in range(0, len(pairs), 1024):
        part = pairs[start : start + 1024]
        diff = np.zeros((len(part), size), np.float32)
        for i, (a, b) in enumerate(part):
            diff[i, list(a)] += VALUE[list(a.values())]
            diff[i, list(b)] -= VALUE[list(b.values())]
        gram += diff.T @ diff
    gram = (penalty / max(1, len(pairs)) * gram).astype(np.float32)
    toxic, clean = label == 1, label == 0
    if not toxic.any() or not clean.any():
        return np.zeros(size), 20.0 if toxic.any() else -20.0
    weight = np.where(toxic, share_toxic / toxic.sum(), (1 - share_toxic) / clean.sum()).astype(np.float32)
    w, b = np.zeros(size), float(np.log(share_toxic / (1 - share_toxic)))
    vw, vb = np.zeros(size), 0.0
    # the step is one over a bound of the curvature, by the power method
    u, top = np.ones(size + 1), 1.0
    for _ in range(30):
        u = u / np.linalg.norm(u)
        t = weight * (x @ u[:-1].astype(np.float32) + np.float32(u[-1])) / 4
        g = np.append(t @ x + RIDGE * share_toxic * u[:-1], t.sum())
        if len(pairs):
            g[:-1] += gram @ u[:-1].astype(np.float32)
        top, u = float(np.linalg.norm(g)), g
    rate = 1 / (1.1 * max(top, 1e-6))
    for t in range(rounds):
        m = t / (t + 3)
        lw, lb = w + m * vw, b + m * vb
        p = 1 / (1 + np.exp(-np.clip(x @ lw.astype(np.float32) + lb, -60, 60)))
        err = weight * (p - label)
        gw, gb = err @ x + RIDGE * share_toxic * lw, float(err.sum())
        if len(pairs):
            gw = gw + gram @ lw.astype(np.float32)
        nw, nb = lw - rate * gw, lb - rate * gb
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w, b


def train(docs: DataFrame, labels: DataFrame, usable, per_label: int = PER_LABEL, key: str = "doc_id", text: str = "text", penalty: float = PENALTY) -> Toxicity:
    """Fit on at most per_label labelled documents of each label with a usable key; only their words are used.

    The sample is written once (2 * per_label texts); its words' document counts are made by Spark, and the driver gets the WORDS
    that tell most and their positions in each document."""
    rows, counts = labelled_sample(docs, labels, "toxic", usable, per_label, key, text)
    # equal texts are one, toxic if any of their labels says so
    sample = written(rows.groupBy("text").agg(F.max("label").alias("label")).select("label", "text"), "toxicity-sample")

    def distinct():
        return lambda texts: [[sorted({p for w in set(words(t)) for p in parts(w)}) for t in texts]]

    listed = map_texts(sample, "label", "text", distinct, "held array<string>", [pa.field("held", pa.list_(pa.string()))])
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    by_word = listed.select("key", F.explode("held").alias("word")).groupBy("word").agg(F.count_if(F.col("key") == 1).alias("a"), F.count_if(F.col("key") == 0).alias("b")).where(F.col("a") + F.col("b") >= LEAST)
    # log odds of a word among toxic and among clean documents over their standard error
    a, b, na, nb = F.col("a") + 0.5, F.col("b") + 0.5, n.get(1, 0) + 1.0, n.get(0, 0) + 1.0
    z = (F.log(a / (na - a + 0.5)) - F.log(b / (nb - b + 0.5))) / F.sqrt(1 / a + 1 / b)
    telling = by_word.orderBy(F.abs(z).desc(), "word").limit(WORDS)
    vocabulary = sorted({r.word for r in telling.select("word").collect()} | _GROUP.keys())
    lookup = Toxicity(vocabulary, np.zeros(0), 0.0)

    def placed():
        place = lambda tokens: list(lookup.counts(tokens).items())

        def run(texts):
            held, pairs = [], []
            for t in texts:
                held.append(place(words(t)))
                pairs.append([{"a": place(s), "b": place(x)} for s, x in counterfactuals(t)])
            return [held, pairs]

        return run

    count = pa.map_(pa.int32(), pa.int32())
    fields = [pa.field("held", count), pa.field("pairs", pa.list_(pa.struct([("a", count), ("b", count)])))]
    got = map_texts(sample, "label", "text", placed, "held map<int,int>, pairs array<struct<a:map<int,int>,b:map<int,int>>>", fields)
    rows = sorted(((r.key, sorted(r.held.items()), [(p.a, p.b) for p in r.pairs]) for r in got.collect()), key=lambda r: r[:2])
    total = sum(counts.values())
    share = min(0.99, max(0.01, counts.get(1, 0) / total)) if total else 0.01
    w, bias = train_rows([dict(h) for _, h, _ in rows], np.array([y for y, _, _ in rows], int), len(vocabulary), [q for *_, p in rows for q in p], share, penalty)
    discard(sample)
    keep = np.abs(w) > 1e-4
    return Toxicity([v for v, k in zip(vocabulary, keep, strict=True) if k], w[keep], bias)


def score(docs: DataFrame, model: Toxicity, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) for every row; predicted is 1 if score >= CUT. A null or empty text scores as one without known words;
    repeated rows and null keys pass; other columns are not carried; nothing is shuffled."""

    def work():
        hold("toxicity")

        def run(texts):
            s = model.score(texts)
            return [s.tolist(), (s >= CUT).astype(int).tolist()]

        return run

    return map_texts(docs, key, text, work, "score double, predicted int", [pa.field("score", pa.float64()), pa.field("predicted", pa.int32())]).withColumnRenamed("key", key)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted), the model fitted on labelled keys that are not held out (crc32 mod 4 = 2)."""
    model = train(docs, labels, lambda k: ~held_out(k, 4, 2), key=key, text=text)
    return score(docs, model, key, text).select(key, held_out(F.col(key), 4, 2).alias("held_out"), "score", "predicted")


def filter_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that score CUT or more; all columns stay."""
    model = train(docs, labels, lambda k: ~held_out(k, 4, 2), key=key, text=text)
    return keep_where(docs, text, lambda texts: model.score(texts) < CUT)
