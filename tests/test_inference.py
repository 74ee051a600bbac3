"""Many models at once against one at a time; deals and folds of permutations; joint holdout."""

import numpy as np
import pytest

from plumbline.operators import holdout, many_models, permutation
from plumbline.operators.checks import GateError


def plain_logistic(x, y, c=1.0):
    """Standardise, then minimise c * log loss + half the squared weights, by Newton steps."""
    sd = x.std(0)
    z = np.column_stack([(x - x.mean(0)) / np.where(sd > 1e-7, sd, 1), np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.r_[np.ones(x.shape[1]), 0]
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        h = c * (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-12)
        step = np.linalg.solve(h, c * z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-12:
            break
    return lambda t: np.column_stack([(t - x.mean(0)) / np.where(sd > 1e-7, sd, 1), np.ones(len(t))]) @ w


def sample(n=240, groups=80, seed=3):
    r = np.random.default_rng(seed)
    key = r.integers(0, groups, n) * 7 + 5
    label = (key % 3 == 0).astype(int)
    x = np.column_stack([r.normal(size=n) * 1000 + 1e5, r.normal(size=n) + label, np.full(n, 3.0), r.integers(0, 2, n)])
    return [(i, int(k), f"s{i % 4}", int(y), [float(v) for v in row]) for i, (k, y, row) in enumerate(zip(key, label, x, strict=True))]


ROWS = "utterance_id bigint, key bigint, speaker_id string, label int, x array<double>"


def test_permutations_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(many_models, "BLOCK", 64)
    monkeypatch.setattr(many_models, "FAN", 2)
    given = sample()
    rows = spark.createDataFrame(given, ROWS).repartition(5)
    groups = rows.select("key", "label").distinct()
    pooled, mean = permutation.null_scores(rows, groups, 4, 6, at_once=4)
    deal = permutation.deals(groups, 6, 5, 20260922)
    keys = np.array(sorted({(g[1], g[3]) for g in given}))
    key, label, x = (np.array([g[i] for g in given]) for i in (1, 3, 4))
    for r in range(7):
        up = permutation.hashes(keys[:, 0], 20260922, 0, np.array([r]))[:, 0]
        positive = keys[:, 1] == 1 if r == 0 else np.isin(np.arange(len(keys)), np.argsort(up)[: keys[:, 1].sum()])
        second = permutation.hashes(keys[:, 0], 20260922, 1, np.array([r]))[:, 0]
        fold = np.zeros(len(keys), int)
        for side in (positive, ~positive):
            at = np.flatnonzero(side)[np.argsort(second[side])]
            fold[at] = np.searchsorted([round(len(at) * f / 5) for f in range(1, 5)], np.arange(len(at)), "right")
        to = {k: (int(p), f) for (k, _), p, f in zip(keys.tolist(), positive, fold, strict=True)}
        y, f = np.array([to[k] for k in key.tolist()]).T
        counts = np.zeros((5, 4))
        for k in range(5):
            said = plain_logistic(x[f != k], y[f != k])(x[f == k]) > 0
            counts[k] = [((y[f == k] == a) & (said == b)).sum() for a, b in ((0, 0), (0, 1), (1, 0), (1, 1))]
        assert pooled[r] == pytest.approx(many_models.macro_f1(counts.sum(0)), abs=1e-12)
        assert mean[r] == pytest.approx(many_models.macro_f1(counts).mean(), abs=1e-12)
    assert len(set(pooled.tolist())) > 3 and deal.models == 35


def test_cut_offs_are_ranks(spark, monkeypatch):
    monkeypatch.setattr(permutation, "VALUES", 50)
    keys = np.random.default_rng(1).permutation(5000)[:3000]
    groups = spark.createDataFrame([(int(k), int(i % 5 == 0)) for i, k in enumerate(keys)], "key bigint, label int").repartition(3)
    deal = permutation.deals(groups, 3, 5, 7)
    for r in range(4):
        h = np.sort(permutation.hashes(keys, 7, 0, np.array([r]))[:, 0])
        assert deal.positive[r] == h[600]
    none = permutation.deals(groups.where("label = 0"), 2, 5, 7)
    assert (permutation.hashes(keys, 7, 0, np.arange(3)) < none.positive).sum() == 0 or none.positive.min() > 0
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"key": pa.array(keys), "label": pa.array([int(i % 5 == 0) for i in range(len(keys))])})
    up, fold = deal.dealt(batch), deal.fold(batch)
    assert (up.sum(0) == 600).all()
    for r in range(4):
        for side, n in ((up[:, r], 600), (~up[:, r], 2400)):
            assert np.bincount(fold[side, r], minlength=5).tolist() == [n // 5] * 5


def test_joint_holdout_against_a_loop(spark):
    given = [(*g, g[1] % 5) for g in sample(seed=8)]
    rows = spark.createDataFrame(given, ROWS + ", outer_fold int").repartition(3)
    said = holdout.holdout_predictions(rows, "utterance_id", 4)
    got = {(r.utterance_id, r.protocol): r.prob for r in said.collect()}
    speaker, label, x, fold = (np.array([g[i] for g in given]) for i in (2, 3, 4, 5))
    for s in sorted(set(speaker)):
        for f in range(5):
            test, train = (speaker == s) & (fold == f), (speaker != s) & (fold != f)
            shared = plain_logistic(x[fold != f], label[fold != f])
            joint = plain_logistic(x[train], label[train])
            for i in np.flatnonzero(test):
                assert got[i, "joint"] == pytest.approx(1 / (1 + np.exp(-joint(x[i : i + 1])[0])), abs=1e-7)
                assert got[i, "shared"] == pytest.approx(1 / (1 + np.exp(-shared(x[i : i + 1])[0])), abs=1e-7)
    gate = {r.protocol: r.asDict() for r in holdout.assert_one_prediction(rows, said, "utterance_id").collect()}
    assert gate["joint"] == {"protocol": "joint", "recordings": 240, "predictions": 240, "least": 1, "most": 1}
    with pytest.raises(GateError):
        holdout.assert_one_prediction(rows, said.where("utterance_id <> 3 or protocol = 'shared'"), "utterance_id")


def test_a_model_without_rows_and_one_class(spark):
    rows = spark.createDataFrame([(1, 1, "a", 1, [1.0]), (2, 2, "a", 1, [2.0]), (3, 3, "b", 1, [0.5])], ROWS).selectExpr("*", "0 as outer_fold")
    said = holdout.holdout_predictions(rows, "utterance_id", 1)
    assert said.count() == 6 and all(0 <= r.prob <= 1 for r in said.collect())


def test_empty_tables(spark):
    rows = spark.createDataFrame([], ROWS)
    pooled, mean = permutation.null_scores(rows, rows.select("key", "label"), 2, 3)
    assert pooled.tolist() == mean.tolist() == [0.0] * 4
    one = spark.createDataFrame(sample(n=6, groups=3), ROWS).where("label = 0")
    pooled, _ = permutation.null_scores(one, one.select("key", "label").distinct(), 4, 2)
    assert len(pooled) == 3 and all(0 <= p <= 1 for p in pooled)
