"""The streams of the registered queries: files of bounded size, a few micro-batches."""

import os

from evalweave.registry import stream_queries


def test_files_of_a_stream_are_bounded(spark, tmp_path, monkeypatch):
    spark.range(10_000).write.parquet(str(tmp_path / "given.parquet"))
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 500)
    target = str(tmp_path / "stream")
    monkeypatch.setattr(stream_queries, "scratch_path", lambda spark, name: target)
    rows = stream_queries.stream_table(spark, str(tmp_path), "given")
    parts = [spark.read.parquet(f"{target}/{f}").count() for f in os.listdir(target) if f.endswith(".parquet")]
    assert sum(parts) == 10_000 and max(parts) <= 750  # round robin, about FILE_ROWS
    seen = []
    rows.writeStream.foreachBatch(lambda df, k: seen.append(df.count())).option("checkpointLocation", str(tmp_path / "state")).trigger(
        availableNow=True).start().awaitTermination()
    assert len(seen) == stream_queries.BATCHES and sum(seen) == 10_000
