"""Summaries take sketches of the fields that the rows have, and explode only rows inside a bracket."""

from evalweave.operators import quantiles, summary


def rows(spark):
    return spark.createDataFrame(
        [("a", i % 3 == 0, float(i), 2.0 * i) for i in range(9)], "cell_id string, correct boolean, latency_sec double, tokens_per_second double")


def test_absent_fields_take_no_sketch(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(summary, "percentile_columns", lambda df, named, **k: seen.update(named) or quantiles.percentile_columns(df, named, **k))
    out = summary.cell_summary(rows(spark)).first()
    assert set(seen) == {"latency_sec_p50", "tokens_per_second_p50"}
    assert (out.latency_sec_p50, out.tokens_per_second_p50, out.completion_tokens_p50, out.vram_max_gb_p50) == (4.0, 8.0, None, None)


def test_only_rows_inside_a_bracket_are_exploded(spark):
    found = quantiles.exact_percentiles(rows(spark), ["latency_sec"], (0.5,))
    text = found._jdf.queryExecution().analyzed().toString()
    assert text.index("Generate") < text.index("Filter ((latency_sec") and found.first().value == 4.0
