"""The windowed scan equals the sequential recurrence, across sub-blocks and blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candleframe.operators import scan
from candleframe.operators.scan import Recurrence, linear_scan
from candleframe.operators.series import Layout, with_blocks


def sequential(a, c):
    y, out = 0.0, []
    for ai, ci in zip(a, c, strict=True):
        y = ai * y + ci
        out.append(y)
    return np.array(out)


@pytest.mark.parametrize(("block_rows", "group_blocks"), [(128, 4096), (4096, 4096), (128, 3), (128, 1)])
def test_scan_equals_sequential(spark, monkeypatch, block_rows, group_blocks):
    monkeypatch.setattr(scan, "GROUP_BLOCKS", group_blocks)
    rng = np.random.default_rng(block_rows)
    rows, series = [], {}
    for symbol, n in (("one", 1), ("edge", 128), ("over", 129), ("long", 1500)):
        a, c = rng.uniform(0.55, 1.0, n), rng.normal(0, 100, n)
        series[symbol] = (a, c)
        rows += [(symbol, k, float(x), float(y)) for k, (x, y) in enumerate(zip(a, c, strict=True))]
    df = with_blocks(spark.createDataFrame(rows, "symbol string, _rn long, a double, c double").repartition(5), block_rows)
    recs = [Recurrence("y", F.col("a"), F.col("c")), Recurrence("total", None, F.col("c")), Recurrence("some", F.col("a"), F.col("c"), F.col("_rn") >= 3)]
    out = linear_scan(df, Layout(block_rows=block_rows), recs)
    assert "InPandas" not in out._jdf.queryExecution().toString()
    got = out.toPandas()
    for symbol, (a, c) in series.items():
        own = got[got.symbol == symbol].sort_values("_rn")
        np.testing.assert_allclose(own.y, sequential(a, c), rtol=1e-9, atol=1e-8)
        np.testing.assert_allclose(own.total, np.cumsum(c), rtol=1e-9, atol=1e-8)
        assert own.some.isna().sum() == min(3, len(a))
