"""The models on small tables: they learn what is there, and nothing of the rows under test."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import lexical, ml
from plumbline.plans import features, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["lexical_baseline", "nuisance_classifier", "mlp_heads"])
def test_models_run(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0 and not got.isna().any().any()


def test_heads_give_each_row_once_a_seed(spark):
    got = registry.QUERIES["mlp_heads"](spark, SF).groupBy("id").agg(F.count_distinct("seed").alias("seeds"), F.count("*").alias("n")).collect()
    assert all(r.seeds == r.n == 3 for r in got)


def test_gelu_and_its_derivative():
    from math import erf

    x = np.linspace(-6, 6, 241)
    value, slope = ml.Head._phi(x)
    assert np.abs(value - [0.5 * t * (1 + erf(t / 2**0.5)) for t in x]).max() < 1e-6
    assert np.abs(slope - np.gradient(value, x))[1:-1].max() < 1e-3


def test_grid_takes_the_smallest_of_equals_and_sees_no_test_row(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 200)
    rows = [(i, i % 5, int(c), [float(c * 2 - 1 + e), float(e)]) for i, (c, e) in enumerate(zip(y, rng.normal(0, 0.1, 200), strict=True))]
    df = spark.createDataFrame(rows, "id int, fold int, label int, raw array<double>")
    seen = []

    def coded(data, k):
        from pyspark.ml.functions import array_to_vector

        seen.append(k)
        mean = data.where(F.col("fold") != k).agg(F.avg(F.col("raw")[0])).first()[0]
        return data.withColumn("vector_", array_to_vector(F.transform("raw", lambda x: x - mean)))

    got = ml.logistic_folds(df, "fold", "label", coded, list(range(5)), grid=(10.0, 0.1, 1.0)).collect()
    assert seen == list(range(5)) and len(got) == 200
    assert {r.c for r in got} == {0.1} and all((r.prob > 0.5) == r.label for r in got)


def test_tfidf_vectors_hold_every_training_term(spark):
    """Against weights worked out term by term, and a fit on them against one of the same loss by Newton steps."""
    from pyspark.ml.functions import vector_to_array

    rng = np.random.default_rng(6)
    docs = []
    for i in range(60):
        w = [f"w{k}" for k in rng.integers(0, 25, rng.integers(1, 12))] + ["yes" if i % 2 else "no"] * int(rng.integers(0, 3)) + (["onlytest"] if i % 5 == 0 else [])
        docs.append((i, w, i % 5, i % 2))
    df = spark.createDataFrame(docs, "id int, terms array<string>, fold int, label int")
    got = {r.id: np.array(r.v) for r in ml.tfidf_vectors(df, "terms", F.col("fold") != 0).select("id", vector_to_array("vector_").alias("v")).collect()}
    train = [d for d in docs if d[2] != 0]
    seen = Counter(t for d in train for t in set(d[1]))
    weight = {t: math.log((len(train) + 1) / (n + 1)) + 1 for t, n in seen.items()}
    assert "onlytest" not in weight and len(got[0]) == len(weight)
    plain = {}
    for i, w, *_ in docs:
        x = {t: k * weight[t] for t, k in Counter(w).items() if t in weight}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
        plain[i] = {t: v / norm for t, v in x.items()}
        assert sorted(got[i][got[i] > 0].round(9)) == pytest.approx(sorted(round(v / norm, 9) for v in x.values()), abs=1e-8)
    said = {r.id: r.prob for r in ml.logistic_folds(df, "fold", "label", lambda data, k: ml.tfidf_vectors(data, "terms", F.col("fold") != k), [0]).collect()}
    names = sorted(weight)
    x = np.array([[plain[i].get(t, 0.0) for t in names] + [1.0] for i, *_ in docs])
    y, fit = np.array([d[3] for d in docs]), np.array([d[2] != 0 for d in docs])
    w, ridge = np.zeros(len(names) + 1), np.r_[np.ones(len(names)), 0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-x[fit] @ w))
        w -= np.linalg.solve((x[fit] * (p * (1 - p))[:, None]).T @ x[fit] + np.diag(ridge + 1e-12), x[fit].T @ (p - y[fit]) + ridge * w)
    assert max(abs(said[i] - 1 / (1 + np.exp(-x[i] @ w))) for i in said) < 1e-3


def test_lexical_baseline_holds_no_vocabulary_in_the_driver(spark, monkeypatch):
    from pyspark.ml.feature import CountVectorizer

    def refused(*_):
        raise MemoryError("a vocabulary in the driver")

    monkeypatch.setattr(CountVectorizer, "fit", refused)
    assert registry.QUERIES["lexical_baseline"](spark, SF).count() == 5


@pytest.mark.parametrize("near", [64, 2])
def test_lexical_folds_are_the_minima(spark, near):
    """Against fits by Newton steps on plain arrays, in one range of documents and in several; a copy, an empty text and terms of the tested fold only are there."""
    rng = np.random.default_rng(4)
    docs = []
    for i in range(90):
        w = [f"w{k}" for k in rng.integers(0, 25, rng.integers(1, 12))] + ["yes" if i % 2 else "no"] * int(rng.integers(0, 3)) + (["onlytest"] if i % 5 == 0 else [])
        docs.append((i, w, i % 5, (i + i // 45) % 2))
    docs[7] = (7, docs[1][1], 2, 1)
    docs[8] = (8, [], 3, 0)
    df = spark.createDataFrame(docs, "id int, words array<string>, fold int, label int")
    grid = (10.0, 0.1, 1.0)
    got = {r.id: r for r in lexical.lexical_folds(df, "id", "words", "fold", "label", list(range(5)), grid, docs=20, near=near).collect()}
    assert len(got) == 90
    counts = [Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]) for _, w, *_ in docs]
    fold, y = (np.array([d[j] for d in docs]) for j in (2, 3))
    for k in range(5):
        others, fit, after = fold != k, ~np.isin(fold, [k, (k + 1) % 5]), fold == (k + 1) % 5
        seen = Counter(t for i in np.flatnonzero(others) for t in counts[i])
        x = np.array([[c[t] * (math.log((others.sum() + 1) / (n + 1)) + 1) for t, n in sorted(seen.items())] for c in counts])
        x = np.column_stack([x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), np.ones(len(x))])
        score, ridge = {}, np.r_[np.ones(len(seen)), 0]
        for c in sorted(grid):
            w = np.zeros(len(seen) + 1)
            for _ in range(40):
                p = 1 / (1 + np.exp(-x[fit] @ w))
                w -= np.linalg.solve(c * (x[fit] * (p * (1 - p))[:, None]).T @ x[fit] + np.diag(ridge), c * x[fit].T @ (p - y[fit]) + ridge * w)
            score[c] = x @ w
        best = max(sorted(grid), key=lambda c: ml.macro_f1(y[after], (score[c][after] > 0).astype(int)))  # noqa: B023
        for i in np.flatnonzero(fold == k):
            assert got[i].c == best and got[i].prob == pytest.approx(1 / (1 + np.exp(-score[best][i])), abs=1e-3)


def test_encoded_folds_are_fitted_together(spark, monkeypatch):
    """The query fits no fold of its own; against encoders and Newton fits fold by fold, with missing values, a level that one fold alone has, and a constant column."""
    monkeypatch.delattr(ml, "logistic_folds")
    assert {r.fold for r in registry.QUERIES["nuisance_classifier"](spark, SF).collect()} == set(range(5))
    rng = np.random.default_rng(8)
    rows = [(i % 3, int(rng.integers(2)), None if i % 7 == 0 else float(rng.normal()), 0.1, "z" if i % 3 == 0 and i < 9 else "xy"[i % 2]) for i in range(90)]
    df = spark.createDataFrame(rows, "fold int, label int, a double, b double, s string")
    got = ml.encoded_logistic_folds(df, "fold", "label", ["a", "b"], ["s"], {"s": ["x", "y", "z"]}, [0, 1, 2]).collect()
    for k in range(3):
        coder = ml.train_only_encoder(df.withColumn("training", F.col("fold") != k), "training", ["a", "b"], ["s"])
        coded = ml.encode(df, coder, ["fold", "label"], ["a", "b"], ["s"], {"s": ["x", "y", "z"]}).collect()
        x, y, train = np.array([[*r.features, 1.0] for r in coded]), np.array([r.label for r in coded]), np.array([r.fold != k for r in coded])
        w, ridge = np.zeros(6), np.r_[np.ones(5), 0]
        for _ in range(30):
            p = 1 / (1 + np.exp(-x[train] @ w))
            w -= np.linalg.solve((x[train].T * (p * (1 - p))) @ x[train] + np.diag(ridge + 1e-12), x[train].T @ (p - y[train]) + ridge * w)
        want = 1 / (1 + np.exp(-x[~train] @ w))
        assert sorted(r.prob for r in got if r.fold == k) == pytest.approx(sorted(want), abs=1e-9)
