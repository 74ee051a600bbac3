"""Models: relational TF-IDF, logistic regression, train-only encoders, and a small neural head trained in parallel tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.writers import kept
from . import many_models
from .quantiles import exact_quantiles


def terms(words):
    """An array of words, and of neighbours joined by a space."""
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def tfidf(df: DataFrame, key: str, words: str) -> DataFrame:
    """(key, term, weight) of unigrams and bigrams: tf * (ln((1 + n) / (1 + df)) + 1), each document of length one."""
    each = df.select(key, F.explode(terms(F.col(words))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    seen = each.groupBy("term").agg(F.count("*").alias("df"))
    n = df.agg(F.count("*").alias("n"))
    raw = each.join(seen, "term").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf_vectors(df: DataFrame, terms: str, training) -> DataFrame:
    """df with vector_: TF-IDF of the array of terms, of length one, over every term of the training rows; terms that these lack play no part.

    The vocabulary is exact, no term is hashed into another's place; the driver holds it, as it holds a weight for each term in what is fitted on it."""
    from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    counted = CountVectorizer(inputCol=terms, outputCol="tf_", vocabSize=(1 << 31) - 1, minDF=1.0).fit(df.where(training)).transform(df)
    idf = IDF(inputCol="tf_", outputCol="x_").fit(counted.where(training)).idf.toArray() + 1
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf_", outputCol="raw_").transform(counted)
    return Normalizer(p=2.0, inputCol="raw_", outputCol="vector_").transform(scaled).drop("tf_", "raw_")


def train_only_encoder(df: DataFrame, training: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """One row of statistics made from rows whose training flag is set: medians, means and population deviations, and the levels of each categorical."""
    rows = df.where(F.col(training))
    long = rows.unpivot([], numeric, "feature_", "value_")  # one selection for all of them
    medians = exact_quantiles(long, ["feature_"], "value_", [0.5]).agg(*(F.max(F.when(F.col("feature_") == c, F.col("value"))).alias(f"{c}_median") for c in numeric))
    filled = rows.crossJoin(F.broadcast(medians)).select(*categorical, *(F.coalesce(c, F.col(f"{c}_median")).alias(c) for c in numeric))
    stats = filled.agg(
        *(F.avg(c).alias(f"{c}_mean") for c in numeric), *(F.stddev_pop(c).alias(f"{c}_sd") for c in numeric), *(F.array_sort(F.collect_set(c)).alias(f"{c}_levels") for c in categorical)
    )
    return medians.crossJoin(stats)


def encode(df: DataFrame, encoder: DataFrame, key: str | list[str], numeric: list[str], categorical: list[str], levels: dict[str, list[str]]) -> DataFrame:
    """(key or keys, features): scaled numerics and dummies of length one; a level unseen in training gives zeros only."""
    both = df.crossJoin(F.broadcast(encoder))
    scaled = [(F.coalesce(c, F.col(f"{c}_median")) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_sd") > 0, F.col(f"{c}_sd")).otherwise(F.lit(1.0)) for c in numeric]
    dummies = [F.when((F.col(c) == x) & F.array_contains(f"{c}_levels", x), 1.0).otherwise(0.0) for c in categorical for x in levels[c]]
    raw = F.array(*scaled, *dummies)
    norm = F.greatest(F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-9))
    return both.select(*([key] if isinstance(key, str) else key), F.transform(raw, lambda x: x / norm).alias("features"))


def logistic_folds(df: DataFrame, fold: str, label: str, features, folds: list[int], grid: tuple[float, ...] = (1.0,)) -> DataFrame:
    """Out-of-fold probabilities of MLlib's logistic regression, its regularisation 1 / (c n): (all columns, c, prob).

    features names a vector column, or makes (all columns, vector_) of rows and the fold to be tested, so that nothing is
    fitted on rows under test. Of a grid of c, the one with the best macro-F1 on the fold after the tested one is taken, the smallest of equals; its
    model is fitted on the remaining folds."""
    from functools import reduce

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    sizes = {r[fold]: r["count"] for r in df.groupBy(fold).count().collect()}
    out = []
    for at, k in enumerate(folds):
        rows = (df.withColumn("vector_", F.col(features)) if isinstance(features, str) else features(df, k)).persist()  # every iteration reads it
        held = {k, folds[(at + 1) % len(folds)]} if len(grid) > 1 else {k}
        train = rows.where(~F.col(fold).isin(*held))
        n = max(1, sum(v for f, v in sizes.items() if f not in held))
        fit = lambda c: LogisticRegression(featuresCol="vector_", labelCol=label, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=60).fit(train)  # noqa: B023, E731
        models = {c: fit(c) for c in sorted(grid)}

        def validated(c):
            said = models[c].transform(rows.where(F.col(fold) == folds[(at + 1) % len(folds)])).groupBy(label, "prediction").count().collect()  # noqa: B023
            n = {(int(r[label]), int(r["prediction"])): r["count"] for r in said}
            return sum(2 * n.get((y, y), 0) / max(1, 2 * n.get((y, y), 0) + n.get((y, 1 - y), 0) + n.get((1 - y, y), 0)) for y in (0, 1))

        best = max(sorted(grid), key=validated) if len(grid) > 1 else grid[0]  # the first of equals is the smallest
        test = models[best].transform(rows.where(F.col(fold) == k))
        out.append(test.select(*df.columns, F.lit(best).alias("c"), vector_to_array("probability")[1].alias("prob")))
        rows.unpersist()
    return reduce(DataFrame.unionByName, out)


def fold_encoders(df: DataFrame, fold: str, folds: list[int], numeric: list[str], categorical: list[str]) -> list[dict]:
    """train_only_encoder() of the rows outside each fold, from one pass over df: medians, means, sds (arrays), levels (sets).

    Medians are made of columns that lack values only, as nothing else reads them. A column without values in training is 0 everywhere once it is filled."""
    facts = [f(c).alias(f"{name}_{c}") for c in numeric for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop), ("low", F.min), ("high", F.max))]
    got = df.where(F.col(fold).isNotNull()).groupBy(fold).agg(F.count("*").alias("rows_"), *facts, *(F.collect_set(c).alias(f"levels_{c}") for c in categorical)).collect()
    lacking = [c for c in numeric if any(r[f"n_{c}"] < r["rows_"] for r in got)]
    out = []
    for k in folds:
        rest, median = [r for r in got if r[fold] != k], dict.fromkeys(numeric, 0.0)
        if lacking:
            long = df.where(F.col(fold) != k).unpivot([], lacking, "feature_", "value_")
            median |= {r["feature_"]: r["value"] for r in exact_quantiles(long, ["feature_"], "value_", [0.5]).collect()}
        mean, sd = [], []
        for c in numeric:
            some = [r for r in rest if r[f"n_{c}"]]
            parts = np.array([(r[f"n_{c}"], r[f"mean_{c}"], r[f"var_{c}"]) for r in some] + [(sum(r["rows_"] - r[f"n_{c}"] for r in rest), median[c], 0.0)], float)
            n = max(parts[:, 0].sum(), 1)
            mean.append(parts[:, 0] @ parts[:, 1] / n)
            varies = some and min(r[f"low_{c}"] for r in some) < max(r[f"high_{c}"] for r in some)
            sd.append(np.sqrt(parts[:, 0] @ (parts[:, 2] + (parts[:, 1] - mean[-1]) ** 2) / n) if varies else 1.0)
        out.append({"median": np.array([median[c] for c in numeric]), "mean": np.array(mean), "sd": np.array(sd), "levels": {c: {x for r in rest for x in r[f"levels_{c}"]} for c in categorical}})
    return out


def encoded_logistic_folds(df: DataFrame, fold: str, label: str, numeric: list[str], categorical: list[str], levels: dict[str, list[str]], folds: list[int], c: float = 1.0) -> DataFrame:
    """(fold, label, prob): out-of-fold probabilities of logistic regressions on encode()'s features, each fold's encoder and model made of the other folds' rows.

    All folds are fitted together, to the minimum of log loss plus squared weights / (2 c): a Newton step of all of them is one pass, whose tasks encode their rows
    for each fold and add up. Rows without a label train no model."""
    rows = kept(df.select(F.col(fold).cast("int").alias(fold), F.col(label).cast("int").alias(label), *(F.col(x).cast("double").alias(x) for x in numeric), *categorical), "encoded-folds")
    coders = fold_encoders(rows, fold, folds, numeric, categorical)
    m, k = len(folds), len(numeric) + sum(len(levels[x]) for x in categorical) + 1
    upper = np.triu_indices(k)

    def columns(batch):
        raw = [batch.column(x) for x in numeric]
        lacks = np.column_stack([x.is_null().to_numpy(zero_copy_only=False) for x in raw])
        dummies = np.column_stack([pc.fill_null(pc.equal(batch.column(x), v), False).to_numpy(zero_copy_only=False) for x in categorical for v in levels[x]]).astype(float)
        return np.column_stack([x.to_numpy(zero_copy_only=False) for x in raw]), lacks, dummies

    def features(i, values, lacks, dummies):
        e = coders[i]
        x = np.ones((len(values), k))
        x[:, : len(numeric)] = (np.where(lacks, e["median"], values) - e["mean"]) / e["sd"]
        x[:, len(numeric) : -1] = dummies * [v in e["levels"][c] for c in categorical for v in levels[c]]
        x[:, :-1] /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x[:, :-1], x[:, :-1])), 1e-9)[:, None]
        return x

    def number(batch, name):
        return batch.column(name).fill_null(-1).to_numpy()

    def step_sums(weights):
        def of(batch):
            parts, at, y, out = columns(batch), number(batch, fold), number(batch, label), np.zeros((m, 1 + k + len(upper[0])))
            for i, f in enumerate(folds):
                use = (at != f) & (at >= 0) & (y >= 0)
                x, said = features(i, *(p[use] for p in parts)), y[use]
                z = x @ weights[i]
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                out[i] = np.r_[(np.logaddexp(0, z) - said * z).sum(), x.T @ (p - said), (x.T @ (x * (p * (1 - p))[:, None]))[upper]]
            return out

        got = c * many_models.summed(rows, m * (1 + k + len(upper[0])), of, m).reshape(m, -1)
        h = np.zeros((m, k, k))
        h[:, upper[0], upper[1]] = h[:, upper[1], upper[0]] = got[:, 1 + k :]
        penalty = np.r_[np.ones(k - 1), 0.0]
        h[:, range(k), range(k)] += penalty
        return got[:, 0] + (penalty * weights**2).sum(1) / 2, got[:, 1 : 1 + k] + penalty * weights, h

    weights, _ = many_models.newton(step_sums, m, k)

    def tested(batches):
        for batch in batches:
            parts, at = columns(batch), number(batch, fold)
            for i, f in enumerate(folds):
                own = at == f
                z = features(i, *(p[own] for p in parts)) @ weights[i]
                prob = pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))
                yield pa.RecordBatch.from_arrays([*(batch.column(x).filter(pa.array(own)) for x in (fold, label)), prob], names=[fold, label, "prob"])

    return rows.mapInArrow(tested, f"{fold} int, {label} int, prob double")


class Head:
    """Layer norm, a hidden layer with GELU and dropout, two outputs; AdamW with early stopping on validation macro-F1."""

    def __init__(self, width: int, hidden: int = 256, dropout: float = 0.2, seed: int = 13):
        r = np.random.default_rng(seed)
        bound = lambda n: 1 / np.sqrt(n)
        self.p = {"g": np.ones(width), "b": np.zeros(width), "w1": r.uniform(-bound(width), bound(width), (width, hidden)), "b1": np.zeros(hidden), "w2": r.uniform(-bound(hidden), bound(hidden), (hidden, 2)), "b2": np.zeros(2)}
        self.dropout, self.rng = dropout, r

    @property
    def parameters(self) -> int:
        return sum(x.size for x in self.p.values())

    @staticmethod
    def _phi(x):
        """GELU and its derivative, by the normal distribution (erf within 2e-7, a rational approximation)."""
        z = np.abs(x) / np.sqrt(2)
        t = 1 / (1 + 0.3275911 * z)
        tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
        below = 0.5 * (1 + np.sign(x) * (1 - tail))
        return x * below, below + x * np.exp(-x * x / 2) / np.sqrt(2 * np.pi)

    def _forward(self, x, train=False):
        p = self.p
        mu, sd = x.mean(1, keepdims=True), np.sqrt(x.var(1, keepdims=True) + 1e-5)
        z = (x - mu) / sd
        h = (z * p["g"] + p["b"]) @ p["w1"] + p["b1"]
        a, da = self._phi(h)
        mask = (self.rng.random(a.shape) >= self.dropout) / (1 - self.dropout) if train else 1.0
        o = (a * mask) @ p["w2"] + p["b2"]
        e = np.exp(o - o.max(1, keepdims=True))
        return z, a, da, mask, e / e.sum(1, keepdims=True)

    def probabilities(self, x):
        return self._forward(x)[-1]

    def fit(self, x, y, vx, vy, epochs=60, patience=8, batch=64, rate=1e-3, decay=1e-4):
        from copy import deepcopy

        m, s, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        best, kept, waited = -1.0, deepcopy(self.p), 0
        for _ in range(epochs):
            order = self.rng.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                z, a, da, mask, prob = self._forward(x[at], True)
                d = prob.copy()
                d[np.arange(len(at)), y[at]] -= 1
                d /= len(at)
                g = {"w2": (a * mask).T @ d, "b2": d.sum(0)}
                dh = (d @ self.p["w2"].T) * mask * da
                n = z * self.p["g"] + self.p["b"]
                g |= {"w1": n.T @ dh, "b1": dh.sum(0)}
                dn = dh @ self.p["w1"].T
                g |= {"g": (dn * z).sum(0), "b": dn.sum(0)}
                step += 1
                for k, grad in g.items():
                    self.p[k] *= 1 - rate * decay
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    s[k] = 0.999 * s[k] + 0.001 * grad * grad
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
            score = macro_f1(vy, self.probabilities(vx).argmax(1)) if len(vx) else 0.0
            if score > best:
                best, kept, waited = score, deepcopy(self.p), 0
            else:
                waited += 1
                if waited >= patience:
                    break
        self.p = kept
        return self


def macro_f1(y, p) -> float:
    out = []
    for c in (0, 1):
        tp, wrong = int(((y == c) & (p == c)).sum()), int(((y == c) != (p == c)).sum())
        out.append(2 * tp / (2 * tp + wrong) if tp or wrong else 0.0)
    return sum(out) / 2


def train_heads(rows: DataFrame, jobs: list[tuple[int, int]], key: str = "id", hidden: int = 256) -> DataFrame:
    """Out-of-fold probabilities of a head for each (seed, fold): one task trains one head on rows with columns key, features, label, fold, inner.

    rows is the labelled training set, which each task takes whole: its size bounds a task's memory."""
    spark = rows.sparkSession
    catalogue = spark.createDataFrame(jobs, "seed int, test_fold int")
    grid = rows.crossJoin(F.broadcast(catalogue))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, fold = int(pdf.seed.iloc[0]), int(pdf.test_fold.iloc[0])
        pdf = pdf.sort_values(key, ignore_index=True)
        x, y = np.array(pdf.features.tolist(), float), pdf.label.to_numpy(int)
        test, inner = (pdf.fold == fold).to_numpy(), (pdf.inner == 1).to_numpy()
        fit = ~test & ~inner
        head = Head(x.shape[1], hidden, seed=seed).fit(x[fit], y[fit], x[~test & inner], y[~test & inner])
        prob = head.probabilities(x[test])
        return pd.DataFrame({key: pdf[key][test].to_numpy(), "seed": seed, "fold": fold, "label": y[test], "prob_negative": prob[:, 0], "prob_positive": prob[:, 1], "predicted": prob.argmax(1)})

    return grid.groupBy("seed", "test_fold").applyInPandas(train, f"{key} bigint, seed int, fold int, label int, prob_negative double, prob_positive double, predicted int")
