"""The classifiers' fits against plain solvers of the same losses, and whole very long texts."""

import numpy as np
import pytest

from plumbline.llm import quality, toxicity


def newton(gradient, hessian, w, rounds=200):
    for _ in range(rounds):
        step = np.linalg.solve(hessian(w), gradient(w))
        w = w - step
        if np.abs(step).max() < 1e-12:
            break
    return w


def test_pairwise_weights_minimise_their_loss():
    rng = np.random.default_rng(3)
    k = len(quality.NAMES)
    label = (rng.random(300) < 0.6).astype(int)
    x = rng.normal(size=(300, k)) + label[:, None] * np.linspace(-1, 1, k)
    model = quality.fit(x, label, 0.4)
    # the preference pairs that the seed draws, fitted by plain gradient descent with a line search
    z, draw = model.expand(x), np.random.default_rng(8)
    d = z[draw.choice(np.flatnonzero(label == 1), quality.PAIRS)] - z[draw.choice(np.flatnonzero(label == 0), quality.PAIRS)]
    loss = lambda w: np.logaddexp(0, -(d @ w)).mean() + quality.RIDGE / 2 * w @ w
    gradient = lambda w: -(d / (1 + np.exp(d @ w))[:, None]).mean(0) + quality.RIDGE * w
    w, rate = np.zeros(2 * k), 1.0
    for _ in range(20_000):
        g = gradient(w)
        while loss(w - rate * g) > loss(w) - rate / 2 * g @ g and rate > 1e-12:
            rate /= 2
        w, rate = w - rate * g, rate * 1.5
        if np.abs(g).max() < 1e-9:
            break
    assert loss(model.weights) <= loss(w) + 1e-9 and np.abs(gradient(model.weights)).max() < 1e-7
    # the threshold cuts off the share of labels 0, weighted as all labels are
    s, weight = z @ model.weights, np.where(label == 1, 0.6 / (label == 1).sum(), 0.4 / (label == 0).sum())
    assert abs(weight[s < model.threshold].sum() - 0.4) <= weight.max() + 1e-12


def test_every_labelled_document_is_in_the_fit(spark, monkeypatch):
    rng = np.random.default_rng(6)
    docs, marks = [], []
    for i in range(1500):
        good = int(rng.random() < 0.7)
        docs.append((i, " ".join(("w" * int(rng.integers(2, 9)) if rng.random() < 0.6 + 0.3 * good else "BAD!!") for _ in range(int(rng.integers(5, 60))))))
        marks.append((i, good))
    df, labels = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int")
    use = lambda k: k % 10 != 0
    few, whole = quality.train(df, labels, use, 100), quality.train(df, labels, use)
    x, y = np.array([quality.features(t) for i, t in docs if i % 10]), np.array([q for i, q in marks if i % 10])
    for model in (few, whole):
        assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-9))
        s = model.expand(x) @ model.weights
        assert abs((s < model.threshold).sum() - (y == 0).sum()) <= 1 and np.isclose(model.spread, s.std() / 4)
    assert np.corrcoef(few.expand(x) @ few.weights, whole.expand(x) @ whole.weights)[0, 1] > 0.99
    again = quality.train(df.repartition(5), labels.repartition(3), use, 100)
    assert np.array_equal(again.weights, few.weights) and again.threshold == few.threshold
    monkeypatch.setattr(quality, "BROADCAST_LABELS", 10)  # beyond these, labels meet features by a join
    assert np.array_equal(quality.train(df, labels, use, 100).weights, few.weights)
    # a label of a handful of rows goes to every pool
    rare = quality.train(df, labels.where("quality = 1 or doc_id < 30"), use, 100)
    assert np.isfinite(rare.weights).all() and np.abs(rare.weights).max() > 0


@pytest.mark.parametrize("penalty", [0.0, toxicity.PENALTY])
def test_penalised_weights_minimise_their_loss(penalty):
    rng = np.random.default_rng(4)
    size, n, share = 12, 160, 0.2
    label = (rng.random(n) < 0.4).astype(int)
    held = [{int(i): int(rng.integers(1, toxicity.MOST + 1)) for i in rng.choice(size, 4, replace=False)} | ({0: 1} if y and rng.random() < 0.8 else {}) for y in label]
    pairs = [({1: 1, int(i): 1}, {2: 1, int(i): 1}) for i in rng.integers(3, size, 40)]
    w, b = toxicity.train_rows(held, label, size, pairs, share, penalty, rounds=6000)

    x = np.zeros((n, size + 1))
    x[:, -1] = 1
    for i, at in enumerate(held):
        for k, c in at.items():
            x[i, k] = toxicity.VALUE[c]
    diff = np.zeros((len(pairs), size + 1))
    for i, (p, q) in enumerate(pairs):
        for k, c in p.items():
            diff[i, k] += toxicity.VALUE[c]
        for k, c in q.items():
            diff[i, k] -= toxicity.VALUE[c]
    weight = np.where(label == 1, share / label.sum(), (1 - share) / (n - label.sum()))
    fixed = penalty / len(pairs) * diff.T @ diff + np.diag([toxicity.RIDGE * share] * size + [0.0])
    p = lambda v: 1 / (1 + np.exp(-x @ v))
    plain = newton(lambda v: x.T @ (weight * (p(v) - label)) + fixed @ v, lambda v: (x * (weight * p(v) * (1 - p(v)))[:, None]).T @ x + fixed + 1e-12 * np.eye(size + 1), np.zeros(size + 1))
    loss = lambda v: (weight * (np.logaddexp(0, x @ v) - label * (x @ v))).sum() + v @ fixed @ v / 2
    assert loss(np.append(w, b)) <= loss(plain) + 1e-5
    if penalty:
        free, _ = toxicity.train_rows(held, label, size, pairs, share, 0.0, rounds=6000)
        assert abs(w[1] - w[2]) <= abs(free[1] - free[2]) + 1e-6


def test_very_long_texts_are_scored_whole(spark):
    docs, labels = [], []
    for i in range(80):
        bad = i % 2
        docs.append((i, " ".join(("vile scum !!" if bad else "calm words here.").split()[j % 3] + f" w{(i * 7 + j) % 50}" for j in range(40))))
        labels.append((i, 1 - bad, bad))
    end = "calm words here. " * 60_000
    docs += [(100, end + "vile scum " * 2000), (101, end), (102, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.classify(df, marks).collect()}
    assert len(docs[80][1]) > 1_000_000 and got[100] > 100 * got[101] and set(got) == {i for i, _ in docs}
    seen = {r.doc_id: r.score for r in quality.classify(df, marks).collect()}
    assert set(seen) == set(got) and all(0 <= s <= 1 for s in seen.values())
