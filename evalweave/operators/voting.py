"""Multi-sample agreement: majority votes, consistency, maj@k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.scoring import INVALID_ANSWER, ensure_columns, is_true, present, same_answer, task_kind
from evalweave.operators.calibration import join_groups

METHODS = ("agree_percent", "entropy", "fsd")


def answer_counts(df: DataFrame, *, group_cols: Sequence[str] = ("cell_id",)) -> DataFrame:
    """One row per (group, id, answer): votes, first position, correct votes, first gold.

    Rows without an answer collapse to one row with a NULL answer, so that item totals need no
    second scan.
    """
    df = ensure_columns(df, sample_index="int", task="string", gold_answer="string")
    answer = F.when(present(F.col("pred_answer")), F.col("pred_answer"))
    index = F.coalesce(F.col("sample_index"), F.lit(0))
    # The id leads the keys: cells share long beginnings, which a sort by the cell compares for every row.
    counts = df.groupBy(F.col("id").cast("string").alias("id"), *group_cols, answer.alias("answer")).agg(
        F.count(F.lit(1)).alias("votes"),
        F.min(index).alias("first_index"),
        F.count_if(is_true(F.col("correct"))).alias("hits"),
        F.min(F.struct(index.alias("at"), F.col("gold_answer").alias("gold"), F.col("task").alias("task"))).alias("head"),
    )
    return counts.select(*group_cols, "id", "answer", "votes", "first_index", "hits", "head")


def _entropy_agreement(n: Column, distinct: Column, c_log_c: Column) -> Column:
    entropy = F.log2(n) - c_log_c / n
    return 1 - entropy / F.log2(distinct)


def _top_two(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Votes of the two leading valid answers; the rank filter also limits rows before the shuffle."""
    lead = Window.partitionBy(*by).orderBy(F.desc("votes"), "first_index", F.desc("answer"))
    return (
        counts.filter(F.col("answer").isNotNull() & (F.col("answer") != INVALID_ANSWER))
        .withColumn("place", F.row_number().over(lead))
        .filter(F.col("place") <= 2)
        .groupBy(*by)
        .agg(
            F.max(F.when(F.col("place") == 1, F.col("votes"))).alias("top1"),
            F.max(F.when(F.col("place") == 2, F.col("votes"))).alias("top2"),
        )
    )


def item_votes(
    df: DataFrame, *, group_cols: Sequence[str] = ("cell_id",), method: str = "agree_percent"
) -> DataFrame:
    """Per item: sample and answer counts, majority answers, consistency, maj@k flags.

    ``majority`` follows the highest count, ties by first appearance (A25); ``majority_valid``
    prefers any other answer to the invalid marker (A26).
    """
    if method not in METHODS:
        raise ValueError(f"Unknown consistency method: {method}")
    by = [*group_cols, "id"]
    counts = answer_counts(df, group_cols=group_cols)
    answered = F.col("answer").isNotNull()
    valid = answered & (F.col("answer") != INVALID_ANSWER)
    place = F.struct("votes", -F.col("first_index"), "answer")
    votes = F.col("votes").cast("double")
    items = counts.groupBy("id", *group_cols).agg(
        F.sum("votes").alias("n_samples"),
        F.sum("hits").alias("n_correct"),
        F.coalesce(F.sum(F.when(answered, F.col("votes"))), F.lit(0)).alias("n_answers"),
        F.max_by(F.col("answer"), F.when(answered, place)).alias("majority"),
        F.coalesce(
            F.max_by(F.col("answer"), F.when(valid, place)), F.max(F.when(answered, F.col("answer")))
        ).alias("majority_valid"),
        F.min("head").alias("head"),
        F.count_if(valid).alias("_distinct"),
        F.sum(F.when(valid, votes)).alias("_valid"),
        F.max(F.when(valid, votes)).alias("_top"),
        F.sum(F.when(valid, votes * F.log2(votes))).alias("_clogc"),
    )
    if method == "fsd":
        items = join_groups([items, _top_two(counts, by)], by, how="left")
        score = F.when(F.col("_distinct") <= 1, 1.0).otherwise(
            (F.col("top1") - F.col("top2")) / F.col("n_answers")
        )
    elif method == "entropy":
        score = F.when(F.col("_distinct") <= 1, 1.0).otherwise(
            _entropy_agreement(F.col("_valid"), F.col("_distinct"), F.col("_clogc"))
        )
    else:
        score = F.when(F.col("_distinct") == 0, 1.0).otherwise(F.col("_top") / F.col("n_answers"))
    score = F.when(F.col("n_answers") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))
    more_than_half = F.col("n_correct") * 2 > F.col("n_samples")  # A27
    # The majority is compared with the gold answer of the first sample, without a text round trip.
    voted = same_answer(F.col("majority"), F.col("head.gold"), F.col("_kind"))
    return items.withColumn("_kind", task_kind(F.col("head.task"))).select(
        *by, "n_samples", "n_answers", "n_correct", "majority", "majority_valid",
        score.alias("consistency"),
        more_than_half.alias("more_than_half_correct"),
        F.when(F.col("majority").isNull(), more_than_half).otherwise(voted).alias("maj_correct"),
        F.when(F.col("majority").isNull(), False).otherwise(voted).alias("majority_matches_gold"),
        F.col("head.task").alias("task"),
    )


def multisample_summary(
    df: DataFrame, *, group_cols: Sequence[str] = ("cell_id",), method: str = "agree_percent"
) -> DataFrame:
    """maj@k, any-correct rate, per-sample mean and mean consistency per group."""
    items = item_votes(df, group_cols=group_cols, method=method)
    return items.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("n_samples").alias("n_rows"),
        F.max("n_samples").alias("n_samples_per_item"),
        F.avg(F.col("maj_correct").cast("int")).alias("maj_at_k"),
        F.avg((F.col("n_correct") > 0).cast("int")).alias("pass_at_1_any_sample"),
        (F.sum("n_correct") / F.sum("n_samples")).alias("pass_at_1_per_sample_mean"),
        F.avg(F.when(F.col("n_answers") > 0, F.col("consistency"))).alias("consistency_mean"),
        F.lit(method).alias("consistency_method"),
    )


def item_calibration_pairs(
    df: DataFrame, *, group_cols: Sequence[str] = ("cell_id",), method: str = "agree_percent"
) -> DataFrame:
    """Pairs with consistency as confidence and majority correctness as label."""
    return item_votes(df, group_cols=group_cols, method=method).select(
        *group_cols,
        F.col("consistency").alias("conf"),
        F.col("majority_matches_gold").cast("int").alias("y"),
        "id",
        F.lit(0).alias("sample_index"),
    )
