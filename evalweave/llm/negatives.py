"""Hard-negative mining with a secondary-sort shuffle.

Vectors are quantised to floor(256 * x); a row's score for an anchor is the integer inner product.  An
anchor's positives are its best rows of the same label; each opens a window of scores, from LOW to HIGH
percent of its own, and the best rows of other labels in the window are its hard negatives.

Blocks of anchors meet blocks of rows on a grid of tiles, twice.  The first pass keeps the best rows of
the anchor's label in every tile, and so the windows of every anchor.  The second keeps, for every
window, the best rows of other labels in the tile; no other row of the tile can be in the result.  What
is kept is packed into keys (anchor, descending score, positives first, id) whose byte order is the
order wanted, and goes through repartitionAndSortWithinPartitions.  Each task then reads its anchors as
one sorted stream: a positive opens its window, a negative is given to the open windows that it lies
in, full and passed windows close.  At most as many windows are open as an anchor has positives; no
anchor's rows are held.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import grid, identified, small_batches
from evalweave.plans.shared import cut

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100
BLOCK_ROWS, ANCHOR_ROWS = 4096, 256
CELL = 16  # blocks of either side that one task takes at most
LIMIT = 1 << 62
MISSING = np.iinfo(np.int64).min
BLOCK = "ids binary, rows binary, labels array<string>, vectors binary"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
# A packed key: anchor id and row, score (complemented, so that greater ones come first), kind, id and row.
_KEY = np.dtype([("anchor", ">u8", 3), ("score", ">u8"), ("kind", "u1"), ("row", ">u8", 3)])
_FORM = ">3QQB3Q"
_SIGN = 1 << 63


def _prepared(vectors: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(id, row, label, q): the rows that take part, with an identity of their own, quantised."""
    fine = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # noqa: E731  NaN is greater
    scaled = lambda x: x.cast("double") * SCALE
    whole = lambda x: F.when(F.abs(scaled(x)) < float(LIMIT), F.floor(scaled(x))).otherwise(
        F.raise_error(F.lit("a vector component is too large for 64-bit scores")).cast("long"))
    named = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"), "row")
    return named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine)).select(
        "id", "row", "label", F.transform("v", whole).alias("q"))


def _blocks(size: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Blocks of at most ``size`` rows, by id and row."""
    def block(held: pd.DataFrame) -> pd.DataFrame:
        rows = np.array([(r["file"], r["row"]) for r in held["row"]], dtype=np.int64).reshape(-1, 2)
        ids = held["id"].to_numpy(np.int64)
        by = np.lexsort((rows[:, 1], rows[:, 0], ids))
        vectors = np.zeros((len(held), max(map(len, held["q"]), default=0)), dtype=np.int64)
        for i, v in enumerate(held["q"]):
            vectors[i, : len(v)] = v
        return pd.DataFrame([[ids[by].tobytes(), rows[by].tobytes(), list(held["label"].to_numpy()[by]), vectors[by].tobytes()]],
                            columns=["ids", "rows", "labels", "vectors"])

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for part in parts:
            held.append(part)
            n += len(part)
            while n >= size:
                joined = pd.concat(held, ignore_index=True)
                yield block(joined[:size])
                held, n = [joined[size:]], n - size
        if n:
            yield block(pd.concat(held, ignore_index=True))
    return blocks


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two int64 matrices; shorter rows count as padded with zeros."""
    dims = min(a.shape[1], b.shape[1])
    a, b = a[:, :dims], b[:, :dims]
    reach = dims * max(map(int, (a.max(initial=0), -a.min(initial=0)))) * max(map(int, (b.max(initial=0), -b.min(initial=0))))
    if reach < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if reach < 1 << 63:
        return a @ b.T
    raise ValueError("scores do not fit in 64 bits; scale the vectors down")


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the k best allowed entries of every line; ties go to the smaller column."""
    masked = np.where(allowed, scores, MISSING)
    if masked.shape[1] > k:
        bound = np.maximum(np.partition(masked, -k, axis=1)[:, -k], MISSING + 1)
        line, column = np.nonzero(masked >= bound[:, None])
    else:
        line, column = np.nonzero(allowed)
    by = np.lexsort((column, -masked[line, column], line))
    line, column = line[by], column[by]
    place = np.arange(len(line)) - np.searchsorted(line, line)
    return line[place < k], column[place < k]


class _Tile:
    """Scores of one block of anchors with one block of rows."""

    def __init__(self, r) -> None:
        of = lambda raw, *shape: np.frombuffer(raw, dtype="<i8").reshape(shape)
        self.a_ids, self.ids = of(r.a_ids, -1), of(r.ids, -1)
        self.a_rows, self.rows = of(r.a_rows, -1, 2), of(r.rows, -1, 2)
        codes = {v: k for k, v in enumerate(dict.fromkeys([*r.a_labels, *r.labels]))}
        number = lambda labels: np.array([codes[v] for v in labels])
        self.same = number(r.a_labels)[:, None] == number(r.labels)[None, :]
        self.scores = products(of(r.a_vectors, len(self.a_ids), -1), of(r.vectors, len(self.ids), -1))
        line, column = np.nonzero(self.a_ids[:, None] == self.ids[None, :])
        own = (self.a_rows[line] == self.rows[column]).all(axis=1)
        self.other = np.ones_like(self.same)
        self.other[line[own], column[own]] = False


def _packed(anchor: np.ndarray, anchor_row: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray, rows: np.ndarray) -> list[bytes]:
    keys = np.zeros(len(ids), dtype=_KEY)
    up = lambda x: x.view(np.uint64) ^ np.uint64(_SIGN)
    keys["anchor"] = up(np.ascontiguousarray(np.column_stack([anchor, anchor_row])))
    keys["score"] = ~up(np.ascontiguousarray(score))
    keys["kind"] = kind
    keys["row"] = up(np.ascontiguousarray(np.column_stack([ids, rows])))
    raw = keys.tobytes()
    return [raw[k : k + _KEY.itemsize] for k in range(0, len(raw), _KEY.itemsize)]


def stream(keys: Iterator[bytes], negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Rows of RESULT from sorted keys; open windows are all that is held."""
    anchor, windows = None, []
    for key in keys:
        a, a_file, a_row, score, kind, row, _, _ = struct.unpack(_FORM, key)
        if (a, a_file, a_row) != anchor:
            anchor, windows = (a, a_file, a_row), []
        score, row = (score ^ (2 * _SIGN - 1)) - _SIGN, row - _SIGN
        if not kind:
            windows.append([row, score, 0])
            continue
        windows = [w for w in windows if w[2] < negatives and 100 * score >= low * w[1]]
        for w in windows:
            if 100 * score <= high * w[1]:
                w[2] += 1
                yield a - _SIGN, w[0], w[2], row, w[1], score


def mine(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives.

    ``is_anchor`` chooses the anchors by the columns of ``vectors``.  Rows with a NULL key, label or vector
    or a NULL or non-finite component take no part; shorter vectors count as padded with zeros; other
    columns are not carried.  Positives are the ``positives`` best other rows of the anchor's label;
    negatives the ``negatives`` best rows of other labels whose score is ``low`` to ``high`` percent of the
    positive's (for a negative score of the positive that is no row).  Ties go to the smaller id.  A
    repeated key is a row of its own and, as an anchor, an anchor of its own.  Scores beyond 64 bits raise
    an error.  No anchors, or no rows, give an empty result.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("0 <= low <= high <= 100")
    spark = vectors.sparkSession
    small_batches(spark)
    marked = identified(vectors, "row").withColumn("_is_anchor", F.coalesce(is_anchor, F.lit(False)))
    if label == "row" or key == "row" or vector == "row":
        raise ValueError("the column name row is taken")
    rows = cut(_prepared(marked, key, label, vector).mapInPandas(_blocks(BLOCK_ROWS), BLOCK))
    anchors = cut(_prepared(marked.where("_is_anchor"), key, label, vector).mapInPandas(_blocks(ANCHOR_ROWS), BLOCK))

    lines, columns = grid(rows.count(), anchors.count(), spark.sparkContext.defaultParallelism, CELL)
    spread = lambda size: F.sequence(F.lit(0), F.lit(size - 1))
    place = lambda size: F.pmod(F.xxhash64("ids", "rows"), F.lit(size)).cast("int")
    left = rows.withColumn("line", place(lines)).withColumn("column", F.explode(spread(columns)))
    right = anchors.withColumn("column", place(columns)).withColumn("line", F.explode(spread(lines)))
    right = right.select("line", "column", *[F.col(c).alias(f"a_{c}") for c in ("ids", "rows", "labels", "vectors")])

    def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                tile = _Tile(r)
                line, column = best(tile.scores, tile.same & tile.other, positives)
                yield pd.DataFrame({
                    "anchor": tile.a_ids[line], "a_file": tile.a_rows[line, 0], "a_row": tile.a_rows[line, 1], "score": tile.scores[line, column],
                    "id": tile.ids[column], "file": tile.rows[column, 0], "row": tile.rows[column, 1]})

    tiles = left.join(right, ["line", "column"])
    near = tiles.mapInPandas(nearest, "anchor long, a_file long, a_row long, score long, id long, file long, row long")
    chosen = cut(near.withColumn("place", F.expr(
        "row_number() over (partition by anchor, a_file, a_row order by score desc, id, file, row)")).where(F.col("place") <= positives))

    # The scores of an anchor's positives travel with its block, one list of numbers a block.
    block = anchors.select(F.xxhash64("ids", "rows").alias("block"), "ids", "rows").mapInPandas(_members, "block long, anchor long, a_file long, a_row long")
    scores = block.join(chosen, ["anchor", "a_file", "a_row"]).groupBy("block").agg(
        F.collect_list(F.struct("anchor", "a_file", "a_row", "score")).alias("opened"))
    armed = right.withColumn("block", F.xxhash64("a_ids", "a_rows")).join(scores, "block")

    def windowed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                tile = _Tile(r)
                opened: dict[tuple, set[int]] = {}
                for o in r.opened:
                    opened.setdefault((o["anchor"], o["a_file"], o["a_row"]), set()).add(int(o["score"]))
                own = [sorted(opened.get((i, *x), ())) for i, x in zip(tile.a_ids.tolist(), tile.a_rows.tolist())]
                kept: list[np.ndarray] = []
                for turn in range(max(map(len, own), default=0)):
                    tops = [s[turn] if turn < len(s) else None for s in own]
                    top = np.array([MISSING if s is None else high * s // 100 for s in tops])
                    floor = np.array([0 if s is None else -(-low * s // 100) for s in tops])
                    allowed = ~tile.same & (tile.scores <= top[:, None]) & (tile.scores >= floor[:, None])
                    kept.append(np.column_stack(best(tile.scores, allowed, negatives)))
                if kept:
                    line, column = np.unique(np.concatenate(kept), axis=0).T
                    yield pd.DataFrame({"key": _packed(tile.a_ids[line], tile.a_rows[line], tile.scores[line, column], 1, tile.ids[column], tile.rows[column])})

    def openers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            whole = lambda *c: np.ascontiguousarray(p[list(c)].to_numpy(np.int64))
            yield pd.DataFrame({"key": _packed(p["anchor"].to_numpy(np.int64), whole("a_file", "a_row"), p["score"].to_numpy(np.int64), 0,
                                               p["id"].to_numpy(np.int64), whole("file", "row"))})

    keys = left.join(armed, ["line", "column"]).mapInPandas(windowed, "key binary").union(chosen.drop("place").mapInPandas(openers, "key binary"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = keys.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(parts, lambda key: crc32(key[:24]))
    return spark.createDataFrame(sorted_.mapPartitions(lambda pairs: stream((k for k, _ in pairs), negatives, low, high)), RESULT)


def _members(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The anchors of every block."""
    for part in parts:
        for r in part.itertuples():
            ids, rows = np.frombuffer(r.ids, dtype="<i8"), np.frombuffer(r.rows, dtype="<i8").reshape(-1, 2)
            yield pd.DataFrame({"block": np.full(len(ids), r.block), "anchor": ids, "a_file": rows[:, 0], "a_row": rows[:, 1]})


cloudpickle.register_pickle_by_value(sys.modules[__name__])
