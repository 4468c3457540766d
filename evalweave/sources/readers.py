"""Readers of responses, summaries and configuration."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.plans.shared import cut
from evalweave.sources import versioned
from evalweave.sources.schemas import RESPONSES

PIECE = 8 << 20  # bytes of a file in memory at a time


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = files.globStatus(target)
    return found is not None and len(found) > 0


def read_responses(spark: SparkSession, path: str, schema: T.StructType = RESPONSES) -> DataFrame:
    """Line-delimited JSON responses of all cells; a missing path is empty.

    Strict: a malformed line fails the read.  Use ``split_corrupt`` to set such lines aside.  Of a
    versioned table, the last version is read.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    if versioned.is_versioned(spark, path):
        rows = versioned.load(spark, path)
        return rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(
            f.name) for f in schema.fields])
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with their file (path, value)."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "path string, value string")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines.filter(F.col("value").rlike(r"\S"))


def is_row(value: Column) -> Column:
    """Whether a line is exactly one JSON object; repeated keys and NaN are allowed, as in the reader.

    The line is parsed as the only element of an array, so nothing may follow the object.
    """
    parsed = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<map<string,string>>")
    return F.coalesce((F.size(parsed) == 1) & F.get(parsed, F.lit(0)).isNotNull() & value.rlike(r"\}\s*$"), F.lit(False))


def line_validity(lines: DataFrame, group_cols: Sequence[str] = ("path",)) -> DataFrame:
    """Good and bad line counts per file, and whether all lines parse."""
    good = is_row(F.col("value"))
    return lines.groupBy(*group_cols).agg(
        F.count_if(good).alias("good_rows"),
        F.count_if(~good).alias("bad_rows"),
        F.bool_and(good).alias("valid"),
    )


def split_corrupt(lines: DataFrame, schema: T.StructType = RESPONSES) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, lines that are no JSON object) from text lines (S3)."""
    good = is_row(F.col("value"))
    parsed = lines.filter(good).select("path", F.from_json("value", schema).alias("row")).select("path", "row.*")
    return parsed, lines.filter(~good)


def prefer_valid_copy(primary: DataFrame, mirror: DataFrame) -> DataFrame:
    """File to use per name: the primary if valid, else a valid mirror copy (S3).

    Both inputs come from ``line_validity`` with a ``name`` column.
    """
    p = primary.select("name", F.col("path").alias("primary_path"), F.col("valid").alias("primary_valid"))
    m = mirror.select("name", F.col("path").alias("mirror_path"), F.col("valid").alias("mirror_valid"))
    return p.join(m, "name", "full_outer").select(
        "name",
        F.when(F.col("primary_valid"), F.col("primary_path"))
        .when(F.col("mirror_valid"), F.col("mirror_path")).alias("use_path"),
        F.when(F.col("primary_valid"), "primary").when(F.col("mirror_valid"), "mirror").otherwise("none").alias("source"),
    )


def read_summaries(spark: SparkSession, *paths: str) -> DataFrame:
    """Summary documents of a folder; the cell falls back to the file name."""
    df = (
        spark.read.option("multiLine", True).option("pathGlobFilter", "*_summary.json")
        .option("recursiveFileLookup", True).json(list(paths))
    )
    by_name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_summary\.json$", 1)
    cell = F.coalesce(F.col("cell_id"), by_name) if "cell_id" in df.columns else by_name
    return df.withColumn("cell_id", cell)


def read_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """One row per JSON document with its file name."""
    df = spark.read.option("multiLine", True).option("pathGlobFilter", pattern).json(path)
    return df.withColumn("file_name", F.col("_metadata.file_name"))


def _listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length) of the files below a folder; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")


def file_hashes(spark: SparkSession, path: str, pattern: str = "*", local_schemes: Sequence[str] = ("file",)) -> DataFrame:
    """Path, name, SHA-256 and size of every file.

    Files under ``local_schemes`` are opened by the tasks and hashed in pieces of constant memory, so
    they may be of any size.  Files in a store that only the file reader reaches are hashed in one piece,
    at most 2 GB; empty ones are not listed there.
    """
    def hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name in part["path"]:
                digest, size = hashlib.sha256(), 0
                with open(unquote(urlsplit(name).path), "rb") as file:
                    while piece := file.read(PIECE):
                        digest.update(piece)
                        size += len(piece)
                out.append((name, size, digest.hexdigest()))
            yield pd.DataFrame(out, columns=["path", "length", "sha256"])

    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    scheme = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getUri().getScheme()
    if scheme in local_schemes:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # The listing itself, as a scan leaves out empty files.
        names = [(re.sub("^file:/+", "file:/", n),) for n in _listed(spark, path, pattern).inputFiles()]
        found = spark.createDataFrame(names, "path string").repartition(tasks, "path").mapInPandas(hashed, "path string, length long, sha256 string")
    else:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select(
            "path", "length", F.sha2("content", 256).alias("sha256"))
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("file_name"), "sha256", F.col("length").alias("n_bytes"))


def file_row_counts(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """(cell_id, rows_saved) of line files named after their cell."""
    name = F.element_at(F.split("path", "/"), -1)
    return (
        read_lines(spark, path)
        .groupBy(F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("cell_id"))
        .agg(F.count(F.lit(1)).alias("rows_saved"))
    )


def newest_document(spark: SparkSession, path: str, pattern: str, key: str) -> DataFrame:
    """(path, value): the text of the file greatest by path that is a JSON object with ``key``; empty if none is.

    The files are listed without their content and tried from the greatest on, in growing pieces, so older
    results are not read.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], "path string, value string")
    files = _listed(spark, path, pattern)
    below, size = None, 1
    while True:
        left = files if below is None else files.where(F.col("path") < below)
        names = [r.path for r in left.orderBy(F.desc("path")).limit(size).collect()]
        if not names:
            return spark.createDataFrame([], "path string, value string")
        texts = spark.read.option("wholetext", True).text([unquote(n) for n in names]).select(F.col("_metadata.file_path").alias("path"), "value")
        fits = texts.where(F.get_json_object("value", f"$.{key}").startswith("{")).agg(F.max(F.struct("path", "value")).alias("x"))
        found = cut(fits.where("x is not null").select("x.*"))
        if not found.isEmpty():
            return found
        below, size = names[-1], min(size * 8, 4096)


def read_harness_results(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the newest results file that has a ``results`` object (S12): pos, key, metrics.

    Files are compared by path; ``pos`` is the order in the document, as maps of text keep it.
    """
    newest = newest_document(spark, path, "results*.json", "results").select(
        F.from_json("value", "results map<string,string>")["results"].alias("results"))
    return newest.select(F.posexplode("results").alias("pos", "key", "entry")).select(
        "pos", "key",
        F.map_filter(
            F.transform_values(
                F.try_variant_get(F.try_parse_json("entry"), "$", "map<string,variant>"),
                lambda k, v: F.try_variant_get(v, "$", "double"),
            ),
            lambda k, v: v.isNotNull(),
        ).alias("metrics"),
    )


def read_items(spark: SparkSession, path: str, *, split: str | None = None) -> DataFrame:
    """Item table in Parquet or JSON lines, optionally one split."""
    items = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return items if split is None else items.filter(F.col("split") == split)


# Tasks receive these functions by value; workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
