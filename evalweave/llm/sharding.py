"""Consistent hashing with bounded loads: a ring of virtual nodes, full shards pass keys clockwise.

The ring has CELLS cells; every shard's virtual nodes take the cells their names hash to, and a key
belongs to the first virtual node at or after its own cell.  A shard takes keys up to its capacity;
keys that find their shard full go on to the next virtual nodes, in rounds, until a shard has room.
With no slack the capacities are the row count divided evenly, so counts differ by one at most, and
whatever the ring would move little stays where it was.

The rows of each arc (the cells of one virtual node) are counted in Spark, the overflow is settled on
those counts (shards * REPLICAS numbers, whatever the data), and each row finds its shard from its
rank in the arc.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.plans.ranked import with_running

CELLS = 1 << 16
REPLICAS = 128


def ring(shards: int, replicas: int = REPLICAS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in ring order; a taken cell is left to its first owner."""
    taken: dict[int, int] = {}
    for v in range(replicas):
        for s in range(shards):
            cell = int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % CELLS
            taken.setdefault(cell, s)
    return sorted(taken.items())


def arcs_of_cells(nodes: Sequence[tuple[int, int]]) -> list[int]:
    """The arc (index of the virtual node) of every cell."""
    cells = [c for c, _ in nodes]
    return [bisect_left(cells, c) % len(cells) for c in range(CELLS)]


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows each shard may take: even shares, the remainder to the first shards, plus the slack."""
    return [int((rows // shards + (s < rows % shards)) * (1 + slack)) + (slack > 0) for s in range(shards)]


def settle(counts: dict[int, int], nodes: Sequence[tuple[int, int]], room: Sequence[int]) -> list[dict]:
    """Intervals (arc, first, last rank, shard, slot of the first) that place every rank of every arc.

    In a round, each virtual node in ring order takes what waits at it, as long as its shard has
    room; the rest moves to the next virtual node of a shard that is not full.
    """
    free, used = list(room), [0] * len(room)
    waiting = {a: [(a, 1, n)] for a, n in counts.items() if n}
    placed = []
    while waiting:
        moved: dict[int, list[tuple[int, int, int]]] = {}
        for arc in sorted(waiting):
            shard = nodes[arc][1]
            for home, first, last in waiting[arc]:
                take = min(free[shard], last - first + 1)
                if take:
                    placed.append({"home": home, "first": first, "last": first + take - 1, "shard": shard, "base": used[shard]})
                    used[shard] += take
                    free[shard] -= take
                if first + take <= last:
                    moved.setdefault(arc, []).append((home, first + take, last))
        waiting = {}
        for arc, parts in moved.items():
            on = arc
            while not free[nodes[on][1]]:
                on = (on + 1) % len(nodes)
            waiting.setdefault(on, []).extend(parts)
    return placed


def _lookup(spark, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def assign(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row placed, slots gapless from 0 in each shard.

    Size is the UTF-8 length of the text plus 16 (NULL text: 16, NULL checksum).  Repeated rows are
    separate rows and may be split over shards; a NULL id is a key like any other; an empty table gives no
    rows.  With ``slack`` s no shard takes more than 1 + s of its even share, and fewer keys move
    when the number of shards changes.
    """
    spark = docs.sparkSession
    nodes = ring(shards)
    rows = docs.select(
        F.col(doc_id).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(doc_id).alias("point"), F.monotonically_increasing_id().alias("number"),
    ).withColumn("cell", F.pmod("point", F.lit(CELLS)).cast("int"))
    homes = _lookup(spark, [{"cell": c, "home": a} for c, a in enumerate(arcs_of_cells(nodes))], "cell:int,home:int")
    homed = rows.join(F.broadcast(homes), "cell").drop("cell")  # CELLS rows
    ranked = with_running(homed, ["home"], [F.col("point"), F.col("id"), F.col("number")])
    counts = {r.home: r["count"] for r in homed.groupBy("home").count().collect()}  # one per virtual node
    room = capacities(sum(counts.values()), shards, slack)
    plan = _lookup(spark, settle(counts, nodes, room), "home:int,first:bigint,last:bigint,shard:int,base:bigint")
    # at most two intervals per virtual node and round, a bound without the data
    return ranked.join(F.broadcast(plan), "home").where("rank between first and last").select(
        F.col("id").alias(doc_id), "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))
