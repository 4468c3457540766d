"""Exact percentiles at every group size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.operators.quantiles import WHOLE_ROWS, exact_percentiles

PROBS = (0.0, 0.025, 0.5, 0.9, 0.95, 0.99, 1.0)


@pytest.mark.parametrize("sizes", [tuple(range(1, 401)), (333, 999, WHOLE_ROWS - 1, WHOLE_ROWS, WHOLE_ROWS + 1, 12_345)])
def test_every_group_size(spark, sizes):
    sizes_df = spark.createDataFrame([(n,) for n in sizes], "n int")
    rows = sizes_df.select(F.col("n").cast("string").alias("cell_id"), F.explode(F.sequence(F.lit(1), "n")).alias("i")).select(
        "cell_id", (F.xxhash64("cell_id", "i") % 1000 / 7).alias("x"))
    values = {}
    for c, x in rows.toPandas().groupby("cell_id").x:
        values[c] = x.to_numpy()
    got = exact_percentiles(rows, ["x"], PROBS).collect()
    assert len(got) == len(sizes) * len(PROBS)
    for r in got:
        assert r.n == int(r.cell_id)
        assert r.value == pytest.approx(np.quantile(values[r.cell_id], r.prob), rel=1e-12, abs=1e-9)
