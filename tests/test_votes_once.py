"""Votes are grouped by the id first and an item's kind of answer is named once."""

from pyspark.sql import functions as F

from evalweave.functions.scoring import same_answer
from evalweave.operators import voting
from evalweave.registry import views as V

SMALL = "/root/testdata/sf0.001"


def test_pairs_name_the_kind_once_and_sort_by_the_id(spark):
    execution = voting.item_calibration_pairs(V.scored(spark, SMALL))._jdf.queryExecution()
    assert execution.optimizedPlan().toString().count(".task, math500)") == 2  # one kind tests for two prefixes
    plan = execution.executedPlan().toString()
    assert "Sort [id" in plan and "Sort [cell_id" not in plan and "key=[cell_id" not in plan


def test_same_answer_wants_equal_forms_that_are_not_empty(spark):
    rows = [(None, None, "math", False), ("", "", "choice", False), ("  ", "  ", "math", False), ("$ 1 $", "$ 1 $", "math", True), (None, "", "math", False),
            ("1,000", "1000", "numeric", True), ("1,000", "1000", "math", False), ("a", " A", "choice", True), ("a", None, "choice", False),
            (",", ",", "numeric", False), ("X", "x", "math", True), ("1", "2", "math", False)]
    df = spark.createDataFrame(rows, "a string, b string, kind string, want boolean")
    assert all(r.got is r.want for r in df.select("want", same_answer(F.col("a"), F.col("b"), F.col("kind")).alias("got")).collect())
