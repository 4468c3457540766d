"""The document source, the newest results file and hashes of large files."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from evalweave.sources import documents, readers


@pytest.fixture
def folder(tmp_path):
    for k in range(6):
        sub = tmp_path / f"d{k % 2}"
        sub.mkdir(exist_ok=True)
        (sub / f"c{k}_summary.json").write_text(json.dumps({"n": k, "s": "é"}))
        (sub / f"c{k}_notes.json").write_text("{}")
    (tmp_path / "_hidden_summary.json").write_text("broken")
    return str(tmp_path)


def load(spark, path, **options):
    documents.register(spark)
    return spark.read.format("json_documents").options(path=path, **options).load()


def test_summaries(spark, folder, monkeypatch):
    df = load(spark, folder, pattern="*_summary.json")
    assert {(r.cell, r.n) for r in df.select("cell", F.from_json("value", "n long")["n"].alias("n")).collect()} == {(f"c{k}", k) for k in range(6)}
    assert [r.file_name for r in df.where("cell = 'c3'").collect()] == ["c3_summary.json"]
    assert df.where("cell in ('c1', 'c2') and value like '%1%'").count() == 1
    assert load(spark, folder + "/none").count() == 0


def test_names_choose_the_files(folder):
    reader = documents.DocumentReader({"path": folder, "pattern": "*_summary.json"})
    rest = list(reader.pushFilters([documents.EqualTo(("cell",), "c4"), documents.EqualTo(("value",), "x")]))
    assert [f.attribute for f in rest] == [("value",)]
    assert [p.paths for p in reader.partitions()] == [(f"{folder}/d0/c4_summary.json",)]
    whole = documents.DocumentReader({"path": folder, "pattern": "*.json"})
    documents_, documents.PARTITION_BYTES = documents.PARTITION_BYTES, 20
    try:
        parts = whole.partitions()
    finally:
        documents.PARTITION_BYTES = documents_
    assert len(parts) > 3 and sum(len(p.paths) for p in parts) == 12


def test_newest(spark, tmp_path):
    path = str(tmp_path)
    for name, text in (("results_1.json", '{"results": {"a": {"acc,none": 0.5}}}'), ("results_2.json", '{"results": {"b": {"acc,none": 0.25}}}'),
                       ("results_3.json", '{"config": 1}'), ("results_4.json", '{"results": '), ("results_5.json", '{"results": 3}'), ("zother.json", "{}")):
        (tmp_path / name).write_text(text)
    options = {"pattern": "results*.json", "newest": "true", "key": "results"}
    df = load(spark, path, **options)
    assert [r.file_name for r in df.collect()] == ["results_2.json"] and df.where("file_name = 'results_1.json'").count() == 0
    assert [(r.key, r.metrics) for r in readers.read_harness_results(spark, path).collect()] == [("b", {"acc,none": 0.25})]
    assert readers.newest_document(spark, path, "results*.json", "results").first().path.endswith("results_2.json")
    assert readers.newest_document(spark, path, "results*.json", "absent").count() == 0
    assert readers.newest_document(spark, path + "/none", "*", "x").count() == 0 == load(spark, path, pattern="results*", newest="true", key="no").count()


def test_many_results_files(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"results_{k:03d}.json").write_text('{"results": {"k%d": {"acc,none": 1.0}}}' % k if k < 20 else "{}")
    assert readers.read_harness_results(spark, str(tmp_path)).first().key == "k19"


def test_hash_of_a_file_over_two_gigabytes(spark, tmp_path):
    """A sparse file: no disk is filled, and no task holds it."""
    size, big = (2 << 30) + 12345, tmp_path / "big file.bin"
    with open(big, "wb") as file:
        file.truncate(size)
        file.seek(size - 3)
        file.write(b"end")
    (tmp_path / "small.bin").write_bytes(b"x" * 10)
    (tmp_path / "empty.bin").write_bytes(b"")
    want = {}
    for name in os.listdir(tmp_path):
        digest = hashlib.sha256()
        with open(tmp_path / name, "rb") as file:
            while piece := file.read(1 << 24):
                digest.update(piece)
        want[name.replace(" ", "%20")] = (digest.hexdigest(), os.path.getsize(tmp_path / name))
    got = {r.file_name: (r.sha256, r.n_bytes) for r in readers.file_hashes(spark, str(tmp_path), "*.bin").collect()}
    assert {k.replace(" ", "%20"): v for k, v in got.items()} == want


def test_hash_through_the_reader(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    row = readers.file_hashes(spark, str(tmp_path), local_schemes=()).first()
    assert row.sha256 == hashlib.sha256(b"abc").hexdigest() and row.n_bytes == 3
