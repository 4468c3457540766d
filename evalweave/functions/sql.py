"""Text functions under SQL names (U4)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from evalweave.functions.text import SPACE, _boxed_residue


def register(spark: SparkSession) -> None:
    """``answer_norm``, expanded by the optimizer, and ``boxed_answer``, in Arrow batches, for the session.

    Both read text as it is stored; ``answer_norm`` repairs leaked tokenizer markers, as scoring does.
    """
    spark.sql(rf"""create or replace temporary function answer_norm(answer string) returns string return
        lower(regexp_replace(replace(replace(replace(replace(coalesce(answer, ''), 'Ġ', ' '), 'Ċ', '\n'), '$', ''), '\\,', ''), '{SPACE}+', ''))""")
    spark.udf.register("boxed_answer", _boxed_residue)
