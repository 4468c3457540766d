"""Exact top-k inner products over a bit-sliced index.

Components are quantised to floor(256 * x) and every block of vectors is stored as bit slices: for
each component and bit, one bitmap over the rows of the block (two's complement).  A query adds the
slices of its components, shifted by the bits of its own values, with bitmap arithmetic only: a
carry-save adder turns three bitmaps of one weight into a sum and a carry, until one bitmap per
weight is left.  Those result slices select the best rows from the most significant slice downward;
rows that tie at the boundary are resolved by their ids.

Blocks are built where the rows lie, and queries meet blocks on a grid of cells (parts of the query
set by parts of the index) whose size follows the counted blocks, so no side is held whole anywhere.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import grid, small_batches
from evalweave.plans.shared import cut

SCALE = 256
BLOCK_ROWS = 8192
QUERY_ROWS = 128
CELL = 16  # blocks of either side that one task takes at most, on average
LIMIT = 1 << 62  # quantised components of this size or more do not fit in a long
BLOCK = "part long, rows int, dims int, bits int, ids binary, slices binary"
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def slices_of(values: np.ndarray) -> tuple[int, np.ndarray]:
    """(bits, slices) of an int64 matrix (rows, dims): uint64 bitmaps shaped (dims, bits, words)."""
    rows, dims = values.shape
    top = int(max(values.max(initial=0), -values.min(initial=0) - 1, 0))
    bits = top.bit_length() + 1  # with the sign
    padded = np.zeros((-(-max(rows, 1) // 64) * 64, dims), dtype=np.int64)
    padded[:rows] = values
    planes = ((padded.T[:, None, :] >> np.arange(bits)[None, :, None]) & 1).astype(np.uint8)
    return bits, np.packbits(planes, axis=2, bitorder="little").view("<u8")


def _digits(query: np.ndarray) -> np.ndarray:
    """Signed binary digits of every component, no two of them adjacent: rows (component, shift, sign)."""
    out, left, shift = [], query.copy(), 0
    while left.any():
        digit = np.where(left & 1, 2 - (left & 3), 0)
        own = np.flatnonzero(digit)
        out.append(np.stack([own, np.full(len(own), shift), digit[own]], axis=1))
        left = (left - digit) >> 1
        shift += 1
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


def add_slices(query: np.ndarray, both: np.ndarray, width: int) -> np.ndarray:
    """Result slices (width, words) of the inner products of one query with every row, modulo 2**width.

    ``both`` holds the slices and their inverses, shaped (2, dims, bits, words).  A digit -1 subtracts:
    the inverted slices and 1 are added.  The sign slice weighs -2**top: its inverse is added and
    2**top taken off.  Such constants are summed up and enter as full bitmaps.
    """
    _, dims, bits, words = both.shape
    flat = both.reshape(2 * dims * bits, words)
    d, shift, sign = _digits(query[:dims]).T
    constant = sum((1 << int(s)) for s in shift[sign < 0]) - sum(1 << (int(s) + bits - 1) for s in shift)
    columns = []
    for w in range(width):
        b = w - shift
        use = (b >= 0) & (b < bits)
        inverse = (sign[use] < 0) ^ (b[use] == bits - 1)
        columns.append((inverse * dims + d[use]) * bits + b[use])
    result = np.zeros((width, words), dtype=np.uint64)
    carried: list[np.ndarray] = []
    for w in range(width):
        stack = np.concatenate([flat[columns[w]], *carried])
        if constant >> w & 1:
            stack = np.concatenate([stack, np.full((1, words), _ONES)])
        carried = []
        while len(stack) > 1:
            third = len(stack) // 3
            if not third:
                a, b = stack
                carried.append((a & b)[None])
                stack = (a ^ b)[None]
                break
            a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
            x = a ^ b
            carried.append((a & b) | (x & c))
            stack = np.concatenate([x ^ c, stack[3 * third :]])
        if len(stack):
            result[w] = stack[0]
    return result


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(result: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k best allowed rows by (score descending, id ascending), unordered."""
    width = len(result)
    sure, maybe = np.zeros_like(allowed), allowed.copy()
    missing = k
    for w in range(width - 1, -1, -1):
        ones = ~result[w] if w == width - 1 else result[w]  # the sign slice counts reversed
        better = maybe & ones
        n = int(np.bitwise_count(better).sum())
        if n > missing:
            maybe = better
        else:
            sure |= better
            missing -= n
            maybe = maybe & ~ones
        if not missing:
            break
    rows = _rows(sure)
    if missing:
        boundary = _rows(maybe)  # rows of one and the same score
        rows = np.concatenate([rows, boundary[np.argsort(ids[boundary], kind="stable")[:missing]]])
    bit = (result[:, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
    weights = [1 << w for w in range(width)]
    weights[-1] = -weights[-1]
    scores = sum((bit[w].astype(np.int64) * weights[w] for w in range(width)), np.zeros(len(rows), np.int64))
    return rows, scores


def _matrix(vectors: list, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, q): quantised vectors that take part."""
    scaled = lambda x: x.cast("double") * SCALE
    fine = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # noqa: E731  NaN is greater
    whole = lambda x: F.when(F.abs(scaled(x)) < float(LIMIT), F.floor(scaled(x))).otherwise(
        F.raise_error(F.lit("a vector component is too large for a 64-bit index")).cast("long"))
    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine)).select("id", F.transform("v", whole).alias("q"))


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The bit-sliced blocks of all vectors (columns of BLOCK), fixed in a table.

    Left out: NULL keys, NULL vectors, vectors with a NULL or non-finite component.
    Components and scores that do not fit in 64 bits raise an error.
    Shorter vectors count as padded with zeros; repeated keys are rows of their own.
    """
    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = number = 0

        def block(frame: pd.DataFrame) -> pd.DataFrame:
            dims = max(map(len, frame["q"]), default=0)
            bits, slices = slices_of(_matrix(list(frame["q"]), dims))
            return pd.DataFrame([[number, len(frame), dims, bits, frame["id"].to_numpy("<i8").tobytes(), slices.tobytes()]],
                                columns=["part", "rows", "dims", "bits", "ids", "slices"])

        for frame in parts:
            held.append(frame)
            n += len(frame)
            while n >= BLOCK_ROWS:
                joined = pd.concat(held, ignore_index=True)
                yield block(joined[:BLOCK_ROWS])
                held, n, number = [joined[BLOCK_ROWS:]], n - BLOCK_ROWS, number + 1
        if n:
            yield block(pd.concat(held, ignore_index=True))

    return cut(_clean(vectors, key, vector).mapInPandas(blocks, BLOCK))


def search(index: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of the index for every query, never its own id.

    Ties go to the smaller vec_id; with fewer than k other rows all are returned.  A query id that
    occurs several times is one query, by its greatest vector.
    """
    def chunks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for s in range(0, len(frame), QUERY_ROWS):
                own = frame[s : s + QUERY_ROWS]
                dims = max(map(len, own["q"]), default=0)
                yield pd.DataFrame([[len(own), dims, own["id"].to_numpy("<i8").tobytes(), _matrix(list(own["q"]), dims).tobytes()]],
                                   columns=["n", "q_dims", "query_ids", "values"])

    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for r in frame.itertuples():
                ids = np.frombuffer(r.ids, dtype="<i8")
                words = -(-r.rows // 64)
                slices = np.frombuffer(r.slices, dtype="<u8").reshape(r.dims, r.bits, words)
                both = np.stack([slices, ~slices])
                all_rows = np.packbits(np.arange(words * 64) < r.rows, bitorder="little").view("<u8")
                queries_here = np.frombuffer(r.values, dtype="<i8").reshape(r.n, r.q_dims)
                out = []
                for q_id, q in zip(np.frombuffer(r.query_ids, dtype="<i8"), queries_here):
                    reach = sum(map(int, np.abs(q))).bit_length()
                    if r.bits + reach > 64:
                        raise ValueError(f"scores of query {q_id} do not fit in 64 bits; scale the vectors down")
                    width = min(64, r.bits + 1 + reach)
                    result, valid = add_slices(q, both, width), all_rows
                    own = np.flatnonzero(ids == q_id)
                    if len(own):
                        valid = valid.copy()
                        for i in own:
                            valid[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
                    rows, scores = top_rows(result, valid, ids, k)
                    out.append((np.full(len(rows), q_id), ids[rows], scores))
                if out:
                    yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    small_batches(index.sparkSession)
    asked = _clean(queries, key, vector).groupBy("id").agg(F.max("q").alias("q"))
    parts = cut(asked.mapInPandas(chunks, "n int, q_dims int, query_ids binary, values binary"))
    # Either side is copied once for each line or column of the other, which follow the counted blocks.
    lines, columns = grid(index.count(), parts.count(), index.sparkSession.sparkContext.defaultParallelism, CELL)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = parts.withColumn("column", of("query_ids", columns)).withColumn("line", every(lines))
    right = index.drop("part").withColumn("line", of("ids", lines)).withColumn("column", every(columns))
    best = right.join(left, ["line", "column"]).mapInPandas(scored, "query_id long, vec_id long, score long")
    found = best.withColumn("rank", F.expr(
        "row_number() over (partition by query_id order by score desc, vec_id)")).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
