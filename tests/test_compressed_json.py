"""Raw files that a query writes and reads back are compressed; their rows come back whole."""

import glob

from evalweave.registry import source_queries
from evalweave.registry import views as V
from evalweave.sources import readers, writers

SMALL = "/root/testdata/sf0.001"


def test_compressed_lines_come_back_whole(spark, tmp_path):
    rows = V.raw_responses(spark, SMALL).drop("sd")
    for kind in ("none", "gzip"):
        writers.write_jsonl(rows, str(tmp_path / kind), partition_cols=["cell_id"], compression=kind)
    assert glob.glob(str(tmp_path / "gzip" / "*" / "*.json.gz")) and glob.glob(str(tmp_path / "none" / "*" / "*.json"))
    plain, packed = (readers.read_responses(spark, str(tmp_path / kind)) for kind in ("none", "gzip"))
    assert plain.count() == packed.count() == rows.count()
    lines = lambda df: df.selectExpr("to_json(struct(*)) as line")
    assert lines(plain).exceptAll(lines(packed)).isEmpty()


def test_scratch_copies_of_raw_files_are_compressed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(source_queries, "scratch_path", lambda s, name: str(tmp_path / name))
    source_queries.jsonl_roundtrip(spark, SMALL)
    source_queries.archive_rescore(spark, SMALL)
    for name in ("responses", "raw"):
        assert glob.glob(str(tmp_path / name / "*" / "*.gz"))
