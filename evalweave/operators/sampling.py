"""Audit samples with failures first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.scoring import audit_columns, ensure_columns, is_true
from evalweave.operators.calibration import join_groups


def audit_sample(
    df: DataFrame, *, n: int = 50, seed: int = 0, group_cols: Sequence[str] = ("cell_id",),
    oversample_failures: bool = True,
) -> DataFrame:
    """At most ``n`` rows per group for manual review, drawn by hash order, no row twice.

    Ranking stops at ``n`` rows per class, a literal bound that Spark also applies before the
    shuffle, so a large group never travels whole.
    """
    df = ensure_columns(df, sample_index="int", gold_letter="string", gold_answer="string", pred_answer="string", completion="string",
                        task="string", answer_parse_success="boolean")
    failed = ~is_true(F.col("correct")) | ~is_true(F.col("answer_parse_success"))
    order_key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id"), F.coalesce("sample_index", F.lit(0)).cast("string")))
    rows = df.withColumns({"is_failure": failed, "_key": order_key})
    sizes = rows.groupBy(*group_cols).agg(
        F.count_if("is_failure").alias("_f"), F.count_if(~F.col("is_failure")).alias("_s")
    )
    half = n // 2
    if oversample_failures:
        wanted = F.greatest(F.lit(half), F.lit(n) - F.least(F.col("_s"), F.lit(half)))
        quota = sizes.withColumn("_take_f", F.least(F.col("_f"), wanted))
        quota = quota.withColumn("_take_s", F.lit(n) - F.col("_take_f"))
        classes = [*group_cols, "is_failure"]
        allowed = F.when(F.col("is_failure"), F.col("_take_f")).otherwise(F.col("_take_s"))
    else:
        # Successes alone when there are enough of them, else any row.
        quota = sizes.withColumn("_only_s", F.col("_s") >= n)
        rows = join_groups([rows, quota.select(*group_cols, "_only_s")], group_cols)
        rows = rows.filter(~F.col("_only_s") | ~F.col("is_failure")).drop("_only_s")
        classes, allowed = list(group_cols), F.lit(n)
    place = Window.partitionBy(*classes).orderBy("_key", "id", "sample_index")
    ranked = rows.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= n)
    kept = join_groups([ranked, quota], group_cols).filter(F.col("_place") <= allowed)
    return kept.select(*group_cols, "sample_index", "is_failure", *audit_columns())
