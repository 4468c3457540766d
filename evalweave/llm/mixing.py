"""Mixing sources to target weights by Pfair scheduling.

Block i (from 1) of a source of weight w (all weights sum to 1) is released at floor((i - 1) / w) and
due at ceil(i / w), in exact whole numbers.  Earliest deadline first over released blocks meets every
deadline, so at any slot each source is less than one block away from its share w, however long the
corpus and however many the sources.  Rows get their rank in the source in a seeded random order; a
source that ends leaves its slots empty, save that blocks which wait may take them.

Earliest deadline first is sequential, so the order of blocks is settled on the driver, one step of a heap
per block.  A block has BLOCK_ROWS rows, and more in a corpus of over BLOCKS such blocks, so that the
driver takes about BLOCKS steps (and one more per source) whatever the number of rows; rows never pass
through it.  Deviations are below one block, at most 1 / BLOCKS of such a corpus.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.common import identified
from evalweave.plans.ranked import with_running
from evalweave.plans.shared import cut, small_side

BLOCK_ROWS = 32
BLOCKS = 1 << 17
SEED = 17
TEMPERATURE = 0.5


def block_rows(total: int) -> int:
    """Rows of a block in a corpus of so many rows."""
    return max(BLOCK_ROWS, -(-total // BLOCKS))


def blocks(counts: Mapping[str | None, int], weights: Mapping[str | None, float], size: int = BLOCK_ROWS) -> Iterator[tuple]:
    """(source, block, release, deadline, slot, first position), in slot order, for sources of so many rows.

    Weights are taken as the exact values of their floats.  Ties of deadlines go by name.
    """
    if lost := [s for s in counts if s not in weights]:
        raise ValueError(f"no weight for sources {lost[:5]}")
    if any(not 0 < w < math.inf for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    total = sum(whole.values())
    names = sorted((s for s in counts if counts[s]), key=lambda s: (s is None, s or ""))
    share, rows = [whole[s] for s in names], [counts[s] for s in names]
    ends = [-(-n // size) for n in rows]
    waiting = [(0, k, 0) for k in range(len(names))]  # by release
    ready: list[tuple] = []  # by deadline
    slot = first = 0
    while waiting or ready:
        if not ready and waiting[0][0] > slot:
            slot = waiting[0][0]
        while waiting and waiting[0][0] <= slot:
            release, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // share[k]), k, i, release))
        deadline, k, i, release = heapq.heappop(ready)
        if deadline >= 1 << 63:
            raise ValueError(f"the weight of source {names[k]} is too small for 64-bit slots")
        yield names[k], i, release, deadline, slot, first
        first += min(size, rows[k] - i * size)
        if i + 1 < ends[k]:
            heapq.heappush(waiting, ((i + 1) * total // share[k], k, i + 1))
        slot += 1


def _table(spark: SparkSession, rows: Iterator[tuple]) -> DataFrame:
    """The blocks as a scratch table; there are about BLOCKS of them."""
    kinds = "named string, at long, release long, deadline long, slot long, first long"
    return cut(spark.createDataFrame(list(rows), kinds))


def positions(rows: DataFrame, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """(key, source, block, release, deadline, slot, position) for rows (key, source, draw).

    ``weights`` maps every source to a positive weight; by default they are the row counts to the
    power TEMPERATURE.  ``draw`` orders the rows of a source; NULL is a source of its own.
    """
    counts = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}  # one row per source
    if weights is None:
        weights = {s: n ** TEMPERATURE for s, n in counts.items()}
    size = block_rows(sum(counts.values()))
    look = _table(rows.sparkSession, blocks(counts, weights, size))
    ranked = with_running(rows, ["source"], [F.col("draw"), F.col("key")])
    placed = ranked.withColumn("block", F.floor((F.col("rank") - 1) / size))
    timed = placed.join(look, F.col("source").eqNullSafe(F.col("named")) & (F.col("block") == F.col("at")))
    return timed.select("key", "source", "block", "release", "deadline", "slot",
                        (F.col("first") + (F.col("rank") - 1) % size).alias("position"))


def order(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """(doc_id, source, block, release, deadline, slot, position): every row once, position from 0.

    Repeated rows get positions of their own, NULL sources form a source, an empty table gives no
    rows.  With sources of any size no row is dropped or repeated.
    """
    rows = identified(docs.select(F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source")), "row").select(
        F.struct("id", "row").alias("key"), "source", F.xxhash64("id", F.lit(SEED)).alias("draw"))
    return positions(rows, weights).select(
        F.col("key.id").alias(doc_id), F.col("source"), "block", "release", "deadline", "slot", "position")


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """The documents in the order of the schedule (range-partitioned and sorted); all columns stay."""
    row = "_row_identity_of_mixing"
    marked = identified(docs, row)
    rows = marked.select(F.col(row).alias("key"), F.col(source).cast("string").alias("source"), F.xxhash64(
        F.col(doc_id), F.lit(SEED)).alias("draw"))
    place = positions(rows, weights).select(F.col("key").alias(row), F.col("position").alias("_position_of_mixing"))
    return marked.join(place, row).repartitionByRange("_position_of_mixing").sortWithinPartitions("_position_of_mixing").select(docs.columns)


def stored_position(docs: DataFrame, out: str = "position") -> DataFrame:
    """Add the place, from 0, that each row has in a table written by ``mixed`` and read again.

    A reader packs files by size, so the order comes from the files: the rows of all files before
    (by the number in the name) and the row's index in its own file.  Only one row per file is
    ranked.  Other inputs than a scan of files are numbered in the order they come in.
    """
    file, index = "_file_of_mixing", "_index_of_mixing"
    try:
        marked = docs.withColumns({file: F.col("_metadata.file_path"), index: F.col("_metadata.row_index")})
    except AnalysisException:  # not a scan of files; a table written from it keeps its order
        return stored_position(cut(docs), out)
    name = F.element_at(F.split(file, "/"), -1)
    number = F.coalesce(F.regexp_extract(name, "^part-([0-9]+)", 1).try_cast("long"), F.lit(-1).cast("long"))
    files = marked.groupBy(file).agg(F.count("*").alias("rows")).withColumns({"number": number, "name": name})
    ends = with_running(files, [], [F.col("number"), F.col("name"), F.col(file)], {"upto": "rows"})
    begins = small_side(ends.select(file, (F.col("upto") - F.col("rows")).alias("_rows_before_of_mixing")))
    return marked.join(begins, file).withColumn(out, F.col("_rows_before_of_mixing") + F.col(index)).drop(file, index, "_rows_before_of_mixing")
