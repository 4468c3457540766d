"""Gates and rankings read thin rows that are fixed once; the scored view groups by the id first."""

import pytest

from evalweave.operators import calibration, risk
from evalweave.registry import catalog, metric_queries
from evalweave.registry import views as V

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("operator", [risk.selective_risk_summary, calibration.calibration_summary])
def test_the_gate_reads_no_input_again(spark, tmp_path, operator):
    path = str(tmp_path / "scored-read-once")
    V.scored(spark, SMALL).write.parquet(path)
    assert "scored-read-once" not in plan(operator(spark.read.parquet(path)))


def test_adaptive_ece_fixes_its_pairs_before_they_are_ranged(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(metric_queries.C, "ascending", lambda pairs, group, f=calibration.ascending: seen.append(plan(pairs)) or f(pairs, group))
    assert catalog.load()[0]["adaptive_ece"](spark, SMALL).count() == 6
    assert "lineitem" not in seen[0]


def test_scored_rows_are_sorted_by_the_id_first(spark):
    df = V.scored(spark, SMALL).select("sample_index")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Sort [id" in text and "Sort [cell_id" not in text
