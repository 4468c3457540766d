"""Calibration metrics over (confidence, correct) pairs of every group at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.scoring import PARSE_PROXY, ensure_columns, resolve_confidence
from evalweave.plans.ranked import with_running
from evalweave.plans.shared import cut

TIE_KEYS = ("id", "sample_index")
NLL_CLIP = 1e-12
OUTSIDE = -1  # bin of values no bin covers


def with_confidence(df: DataFrame, *, allow_parse_proxy: bool = False) -> DataFrame:
    return df if "confidence_value" in df.columns else resolve_confidence(df, allow_parse_proxy=allow_parse_proxy)


def confidence_rows(
    df: DataFrame, *, group_cols: Sequence[str] = ("cell_id",), allow_parse_proxy: bool = False
) -> DataFrame:
    """What the availability check and the pairs need of every row, fixed once for the steps that read it."""
    df = ensure_columns(with_confidence(df, allow_parse_proxy=allow_parse_proxy), id="string", sample_index="int")
    return cut(df.select(
        *group_cols, *TIE_KEYS, "correct", "confidence_value", "confidence_source", "confidence_valid_for_calibration"))


def confidence_pairs(
    df: DataFrame, *, group_cols: Sequence[str] = ("cell_id",), allow_parse_proxy: bool = False
) -> DataFrame:
    """Rows usable for calibration (F1): group, conf, y and the keys that order ties."""
    df = ensure_columns(with_confidence(df, allow_parse_proxy=allow_parse_proxy), id="string", sample_index="int")
    return df.filter(F.col("correct").isNotNull() & F.col("confidence_value").isNotNull()).select(
        *group_cols,
        F.col("confidence_value").alias("conf"),
        F.col("correct").cast("int").alias("y"),
        *TIE_KEYS,
    )


def join_groups(parts: Sequence[DataFrame], group_cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-group results; group keys compare NULL-safe."""
    def pair(a: DataFrame, b: DataFrame) -> DataFrame:
        left, right = a.alias("l"), b.alias("r")
        on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in group_cols]
        extra = [F.col(f"r.{c}") for c in b.columns if c not in group_cols]
        return left.join(right, on, how).select("l.*", *extra)
    return reduce(pair, parts)


def merge_groups(parts: Sequence[DataFrame], group_cols: Sequence[str], how: str = "left") -> DataFrame:
    """Put results with one row per group side by side: a union and one small aggregate.

    Unlike a chain of joins it needs a single shuffle, and the parts run side by side.  "left"
    keeps the groups of the first part, "inner" those of all parts.
    """
    marked = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    names = [c for c in dict.fromkeys(c for p in parts for c in p.columns) if c not in group_cols]
    kept = F.bool_or(F.col("_part") == 0) if how == "left" else F.count(F.lit(1)) == len(parts)
    merged = stacked.groupBy(*group_cols).agg(
        *[F.any_value(F.col(f"`{n}`"), F.lit(True)).alias(n) for n in names], kept.alias("_kept")
    )
    return merged.filter("_kept").drop("_kept")


def fixed_bin(conf: Column, edges: Sequence[float]) -> Column:
    """Index of the bin (lo, hi] that holds the value, the first bin closed; OUTSIDE if none.

    ``edges`` are the inner and outer edges.  Counting the edges below the value stays inside
    generated code and needs no join with a bin table.
    """
    inside = ~F.isnan(conf) & (conf >= F.lit(edges[0])) & (conf <= F.lit(edges[-1]))
    index = reduce(lambda a, b: a + b, [(conf > F.lit(e)).cast("int") for e in edges[1:-1]], F.lit(0))
    return F.when(inside, index).otherwise(F.lit(OUTSIDE))


def ece_edges(n_bins: int) -> list[float]:
    """Edges as multiples of one step, the last one exactly 1."""
    return [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]


def diagram_edges(n_bins: int) -> list[float]:
    return [i / n_bins for i in range(n_bins + 1)]


def _binned(pairs: DataFrame, group_cols: Sequence[str], edges: Sequence[float], *extra: Column) -> DataFrame:
    return pairs.groupBy(*group_cols, fixed_bin(F.col("conf"), edges).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.sum("y").alias("hits"), F.sum("conf").alias("conf_sum"), *extra
    )


def brier_term() -> Column:
    return (F.col("conf") - F.col("y")) * (F.col("conf") - F.col("y"))


def nll_term() -> Column:
    p = F.greatest(F.lit(NLL_CLIP), F.least(F.lit(1.0 - NLL_CLIP), F.col("conf")))
    return -(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))


def pointwise_metrics(
    pairs: DataFrame, *, group_cols: Sequence[str] = ("cell_id",), n_bins: int = 10
) -> DataFrame:
    """n, Brier (A14), ECE (A15) and NLL (A17) in one pass: rows collapse to (group, bin) first."""
    edges = ece_edges(n_bins)
    bins = _binned(
        pairs, group_cols, edges, F.sum(brier_term()).alias("brier_sum"), F.sum(nll_term()).alias("nll_sum")
    )
    gap = F.when(F.col("bin") != OUTSIDE, F.abs(F.col("hits") - F.col("conf_sum"))).otherwise(0.0)
    n = F.sum("count")
    return bins.groupBy(*group_cols).agg(
        n.alias("n"),
        (F.sum("brier_sum") / n).alias("brier"),
        # weight * |accuracy - confidence| = |hits - conf_sum| / n
        (F.sum(gap) / n).alias("ece"),
        (F.sum("nll_sum") / n).alias("nll"),
    )


def reliability_bins(
    pairs: DataFrame, *, group_cols: Sequence[str] = ("cell_id",), n_bins: int = 10
) -> DataFrame:
    """Reliability diagram, empty bins included."""
    edges = diagram_edges(n_bins)
    # At most n_bins + 1 entries per group.
    filled = _binned(pairs, group_cols, edges).groupBy(*group_cols).agg(
        F.map_from_entries(
            F.collect_list(F.struct("bin", F.struct("count", "hits", "conf_sum")))
        ).alias("bins")
    )
    at = F.try_element_at("bins", F.col("bin"))
    rows = filled.select(*group_cols, "bins", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    share = lambda field: F.coalesce(F.try_divide(at[field], at["count"]), F.lit(0.0))
    return rows.select(
        *group_cols, "bin",
        (F.col("bin") / n_bins).alias("bin_lo"),
        ((F.col("bin") + 1) / n_bins).alias("bin_hi"),
        F.coalesce(at["count"], F.lit(0)).alias("count"),
        share("hits").alias("accuracy"),
        share("conf_sum").alias("confidence"),
    )


def ascending(pairs: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    return with_running(pairs, group_cols, [F.asc("conf"), *[F.asc(k) for k in TIE_KEYS], F.asc("y")])


def adaptive_ece(ranked: DataFrame, *, group_cols: Sequence[str] = ("cell_id",), n_bins: int = 15) -> DataFrame:
    """Equal-mass ECE over rows ranked by ``ascending`` (W4); a last partial chunk stays its own."""
    size = F.greatest(F.lit(1), F.floor(F.col("group_rows") / n_bins))
    chunks = (
        ranked.groupBy(*group_cols, F.floor((F.col("rank") - 1) / size).alias("chunk"))
        .agg(F.abs(F.sum("y") - F.sum("conf")).alias("gap"), F.count(F.lit(1)).alias("m"))
    )
    return chunks.groupBy(*group_cols).agg((F.sum("gap") / F.sum("m")).alias("adaptive_ece"))


def auroc(pairs: DataFrame, *, group_cols: Sequence[str] = ("cell_id",)) -> DataFrame:
    """AUROC by mid-ranks; NULL for a single class.

    Rows collapse to tie levels before the shuffle; only the levels are ordered.
    """
    levels = pairs.groupBy(*group_cols, "conf").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("m"))
    mid_rank = F.col("upto") - (F.col("m") - 1) / 2.0
    p = F.sum("pos").cast("double")
    q = (F.sum("m") - F.sum("pos")).cast("double")
    return with_running(levels, group_cols, [F.asc("conf")], {"upto": "m"}).groupBy(*group_cols).agg(
        F.try_divide(F.sum(F.col("pos") * mid_rank) - p * (p + 1) / 2, p * q).alias("auroc")
    )


def calibration_metrics(
    pairs: DataFrame, *, group_cols: Sequence[str] = ("cell_id",), n_bins: int = 10, full: bool = True
) -> DataFrame:
    """The metric bundle per group: Brier, ECE, AUROC, AURC and, if full, adaptive ECE and NLL."""
    # Thin rows, read by three steps.
    return _bundle(cut(pairs), group_cols, n_bins, full)


def _bundle(
    pairs: DataFrame, group_cols: Sequence[str], n_bins: int, full: bool, falling: DataFrame | None = None
) -> DataFrame:
    from evalweave.operators.risk import aurc, descending

    falling = descending(pairs, group_cols) if falling is None else falling
    parts = [
        pointwise_metrics(pairs, group_cols=group_cols, n_bins=n_bins),
        auroc(pairs, group_cols=group_cols),
        aurc(falling, group_cols=group_cols),
    ]
    if full:
        parts.append(adaptive_ece(ascending(pairs, group_cols), group_cols=group_cols, n_bins=max(n_bins, 10)))
    out = merge_groups(parts, group_cols, "inner")
    return out if full else out.drop("nll")


# Reasons and messages of the availability check.
MESSAGES = {
    "no_confidence_values": "Calibration cannot be calculated: no confidence values are available.",
    "parse_success_proxy": "Calibration computed from the parse-success proxy only; not valid for publication.",
    "no_valid_confidence_source": "Calibration cannot be calculated: no valid confidence source is available.",
}


def availability(
    df: DataFrame, *, group_cols: Sequence[str] = ("cell_id",), allow_parse_proxy: bool = False
) -> DataFrame:
    """Whether calibration may be computed and published, per group, closed by default."""
    df = with_confidence(df, allow_parse_proxy=allow_parse_proxy)
    usable = F.col("correct").isNotNull() & F.col("confidence_value").isNotNull()
    valid = F.coalesce(F.col("confidence_valid_for_calibration"), F.lit(False))
    counts = df.groupBy(*group_cols).agg(
        F.count_if(usable).alias("n_pairs"),
        F.count_if(usable & valid).alias("n_valid_for_calibration"),
        F.sort_array(F.collect_set(F.when(usable, F.col("confidence_source")))).alias("confidence_sources_seen"),
    )
    all_valid = (F.col("n_pairs") > 0) & (F.col("n_pairs") == F.col("n_valid_for_calibration"))
    reason = (
        F.when(F.col("n_pairs") == 0, "no_confidence_values")
        .when(F.col("all_valid_for_calibration"), F.lit(None))
        .otherwise("parse_success_proxy" if allow_parse_proxy else "no_valid_confidence_source")
    )
    message = F.coalesce(*[F.when(F.col("reason") == r, F.lit(m)) for r, m in MESSAGES.items()])
    return (
        counts.withColumn("all_valid_for_calibration", all_valid)
        .withColumn("reason", reason)
        .withColumns({
            "available": F.col("reason").isNull() | (F.col("reason") == "parse_success_proxy"),
            "valid_for_publication": F.col("reason").isNull(),
            "message": message,
        })
    )


def calibration_summary(
    df: DataFrame, *, group_cols: Sequence[str] = ("cell_id",), allow_parse_proxy: bool = False,
    pairs: DataFrame | None = None, falling: DataFrame | None = None,
) -> DataFrame:
    """Metrics and bins where they are available; other groups are marked skipped.

    A caller that already holds the pairs, or their ranking by falling confidence, may pass them.
    """
    if pairs is None:
        df = confidence_rows(df, group_cols=group_cols, allow_parse_proxy=allow_parse_proxy)
        pairs = confidence_pairs(df, group_cols=group_cols)
    gate = availability(df, group_cols=group_cols, allow_parse_proxy=allow_parse_proxy)
    bins = reliability_bins(pairs, group_cols=group_cols).groupBy(*group_cols).agg(
        F.array_sort(
            F.collect_list(F.struct("bin", "bin_lo", "bin_hi", "count", "accuracy", "confidence"))
        ).alias("reliability_bins")
    )
    metrics = _bundle(pairs, group_cols, 10, True, falling).drop("n")
    out = merge_groups([gate, metrics, bins], group_cols)
    kept = [c for c in (*metrics.columns, "reliability_bins") if c not in group_cols]
    return out.withColumn("skipped", ~F.col("available")).withColumns(
        {c: F.when(F.col("available"), F.col(c)) for c in kept}
    )
