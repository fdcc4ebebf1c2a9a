"""k nearest neighbours equal brute force, however leaves are cut."""

import numpy as np
import pytest

from candleframe.operators import knn


@pytest.mark.parametrize(("leaf_rows", "visits", "n"), [(2048, 4096, 300), (16, 10, 300), (16, 10, 3)])
def test_equal_to_brute_force(spark, monkeypatch, leaf_rows, visits, n):
    monkeypatch.setattr(knn, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(knn, "VISITS", visits)
    rng = np.random.default_rng(n)
    x = np.round(rng.standard_normal((n, 3)) * [1, 5, 0.2] + (rng.random((n, 1)) > 0.5) * 9, 1)
    x[n // 2 :] = x[n // 2]  # a third and more of equal rows
    q = np.vstack((np.round(rng.standard_normal((60, 3)) * 4, 1), x[:5]))
    label = (rng.random(n) > 0.4).astype(float)
    train = spark.createDataFrame([(k, x[k].tolist(), float(label[k])) for k in range(n)], "id long, x array<double>, label double")
    test = spark.createDataFrame([(1000 + k, q[k].tolist()) for k in range(len(q))], "id long, x array<double>")
    got: dict[int, list] = {}
    for r in knn.nearest(train, test, 5).collect():
        got.setdefault(r.test - 1000, []).append((r.d2, r.id, r.label))
    for k in range(len(q)):
        d2 = ((q[k] - x) ** 2).sum(axis=1)
        want = [(d2[j], j, label[j]) for j in np.lexsort((np.arange(n), d2))[:5]]
        assert sorted(got[k]) == want
    plan = knn.nearest(train, test, 5)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_without_train_rows(spark):
    train = spark.createDataFrame([], "id long, x array<double>, label double")
    assert knn.nearest(train, spark.createDataFrame([(1, [0.0])], "id long, x array<double>")).isEmpty()
