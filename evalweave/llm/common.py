"""Helpers of the corpus operators: bounded samples, split labels, batch sizes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.plans.shared import cut

# Rows and bytes per Arrow batch: documents and blocks of vectors may hold megabytes.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, so that Python tasks hold little at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def grid(rows: int, columns: int, cores: int, cell: int) -> tuple[int, int]:
    """Lines and columns of the cells in which two sides of so many blocks meet.

    A cell has about ``cell`` blocks of either side, fewer where all cores would not else have one.
    """
    lines = max(1, min(rows, max(-(-rows // cell), cores)))
    return lines, max(1, min(columns, max(-(-columns // cell), -(-cores // lines))))


def identified(df: DataFrame, name: str) -> DataFrame:
    """Add a stable identity to every row: repeated rows stay apart.

    A scan of files already has one (file and row); other inputs are fixed in a scratch table with
    a number of their own.
    """
    if "_metadata" not in df.columns:
        try:
            return df.withColumn(name, F.struct(
                F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
        except AnalysisException:
            pass  # not a scan of files
    return cut(df.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))))


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids that no model may learn labels from (NULL ids included)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def bounded_sample(rows: DataFrame, per_label: int) -> DataFrame:
    """At most ``per_label`` different texts of each label: (label, text, draw).

    ``rows`` has label and text.  Texts fall into ``per_label`` buckets by their hash and each
    bucket gives the text of its smallest hash, so the choice combines before the shuffle, depends
    on no row order, and counts copies once.  ``draw`` is the hash of the chosen text.
    """
    hashed = rows.where(F.col("label").isNotNull() & F.col("text").isNotNull()).select(
        "label", "text", F.xxhash64("text").alias("draw"))
    chosen = hashed.groupBy("label", F.pmod("draw", F.lit(per_label)).alias("bucket")).agg(F.min("draw").alias("draw"))
    # labels x per_label rows; the callers bound the number of labels
    return hashed.join(F.broadcast(cut(chosen.select("label", "draw"))), ["label", "draw"]).groupBy("label", "draw").agg(
        F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, known: DataFrame, per_label: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``per_label`` different texts of each label of ``known`` (doc_id, label): (label, draw, text).

    As ``bounded_sample``, for labels in a table of their own: they meet a narrow list of ids and text
    hashes, and only the chosen texts are read again.  The callers bound the number of labels.
    """
    hashed = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("draw"))
    marked = hashed.select("id", "draw").join(known.where("label is not null").select(F.col("doc_id").alias("id"), "label"), "id")
    chosen = marked.groupBy("label", F.pmod("draw", F.lit(per_label)).alias("bucket")).agg(F.min("draw").alias("draw"))
    fixed = cut(chosen.select("label", "draw"))
    return hashed.join(F.broadcast(fixed), "draw").groupBy("label", "draw").agg(F.min("text").alias("text"))
