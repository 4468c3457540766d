"""Periodic runs of words, found with an enhanced suffix array, and their collapse.

A run is a stretch of words of smallest period q and length >= max(LEAST, 2q) that no neighbouring word
extends.  The texts of a batch are laid end to end and their words ranked as (text, word), so that one
suffix array serves the batch and no common prefix crosses a text.  Prefix doubling gives the suffix
array, its inverse and, from the kept ranks of all widths, the common prefixes.  A branching square (two
copies of l words whose next word differs from the first) joins two children of an LCP interval of depth
l: for the suffixes i of all children but the largest, the inverse array tells whether i + l or i - l
lies in the interval and in another child.  Intervals are index ranges from one pass with a stack; no
tree is built.  Every run ends in exactly one square of its period; the square is rotated to the left as
far as its words repeat (by the same ranks), and squares with equal ends merge into the one run of the
smallest period.

A run holds two equal stretches of at least LEAST / 2 words, so texts whose common prefixes are all
shorter have none and leave after the first three widths.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import small_batches

LEAST = 12
# Words that share one suffix array; a longer text has one of its own.
TOGETHER = 200_000


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 0 of equal keys, and their number."""
    values, ranks = np.unique(keys, return_inverse=True)
    return ranks.astype(np.int32), len(values)


def _doubled(ranks: np.ndarray, width: int) -> np.ndarray:
    """Keys of twice the width; past the end comes before any word."""
    after = np.zeros(len(ranks), dtype=np.int64)
    after[:-width] = ranks[width:].astype(np.int64) + 1
    return ranks.astype(np.int64) * (len(ranks) + 1) + after


def _same(ranks: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether both positions lie inside and have one rank."""
    n = len(ranks)
    inside = (a >= 0) & (b >= 0) & (a < n) & (b < n)
    return inside & (ranks[np.where(inside, a, 0)] == ranks[np.where(inside, b, 0)])


def _suffixes(ranks: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array and the ranks of the widths 1, 2, 4, ..."""
    levels, distinct, width = [], 0, 1
    while distinct < len(ranks):
        levels.append(ranks)
        ranks, distinct = _dense(_doubled(ranks, width)) if width < len(ranks) else (ranks, len(ranks))
        width *= 2
    order = np.empty(len(ranks), dtype=np.int64)
    order[ranks] = np.arange(len(ranks))
    return order, levels


def _prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common prefix of every suffix with the one before it in the suffix array (0 for the first)."""
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        more = _same(levels[k], a, b).astype(np.int64) << k
        a += more
        b += more
    return np.concatenate([[0], b - order[1:]])


def _intervals(prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every boundary of the suffix array, the first and last index of the LCP interval it splits."""
    values = prefixes.tolist()
    first, last = [0] * len(values), [0] * len(values)
    stack: list[int] = []
    floor = 0  # the last boundary of depth 0
    for k, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            last[stack.pop()] = k - 1
        if not v:
            floor = k
            continue
        if not stack:
            first[k] = floor
        else:
            top = stack[-1]
            first[k] = first[top] if values[top] == v else top
        stack.append(k)
    for k in stack:
        last[k] = len(values) - 1
    return np.array(first), np.array(last)


def _squares(order: np.ndarray, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all branching squares; some twice."""
    inverse = np.empty(len(order), dtype=np.int64)
    inverse[order] = np.arange(len(order))
    first, last = _intervals(prefixes)
    cut = np.flatnonzero(prefixes)
    cut = cut[np.lexsort((cut, prefixes[cut], first[cut]))]
    if not len(cut):
        return cut, cut
    lo, hi, depth = first[cut], last[cut], prefixes[cut]
    opens = np.concatenate([[True], (lo[1:] != lo[:-1]) | (depth[1:] != depth[:-1])])
    group = np.cumsum(opens) - 1
    heads = np.flatnonzero(opens)
    # Children: from the interval's start to its first boundary, then from each boundary to the next.
    ends = np.where(np.append(opens[1:], True), hi, np.append(cut[1:], 0) - 1)
    begin, end = np.concatenate([lo[heads], cut]), np.concatenate([cut[heads] - 1, ends])
    owner, at = np.concatenate([group[heads], group]), np.concatenate([heads, np.arange(len(cut))])
    size = end - begin + 1
    by = np.lexsort((-size, owner))  # the largest child comes first
    small = by[np.concatenate([[False], owner[by][1:] == owner[by][:-1]])]
    begin, end, at, size = begin[small], end[small], at[small], size[small]
    each = np.repeat(np.arange(len(small)), size)
    row = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size) + begin[each]
    i, length = order[row], depth[at[each]]
    starts, periods = [], []
    for other, start in ((i + length, i), (i - length, i - length)):
        inside = (other >= 0) & (other < len(order))
        place = inverse[np.where(inside, other, 0)]
        found = inside & (lo[at[each]] <= place) & (place <= hi[at[each]]) & ((place < begin[each]) | (place > end[each]))
        starts.append(start[found])
        periods.append(length[found])
    return np.concatenate(starts), np.concatenate(periods)


def _merged(starts: np.ndarray, periods: np.ndarray, levels: list[np.ndarray], least: int) -> tuple[np.ndarray, ...]:
    """(start, length, period) of the runs that the squares belong to, by start and period."""
    left, right = starts.copy(), starts + periods
    for k in range(len(levels) - 1, -1, -1):
        more = _same(levels[k], left - (1 << k), right - (1 << k)).astype(np.int64) << k
        left -= more
        right -= more
    end = starts + 2 * periods
    long = end - left >= least
    left, end, period = left[long], end[long], periods[long]
    by = np.lexsort((period, end, left))
    left, end, period = left[by], end[by], period[by]
    new = np.append(True, (left[1:] != left[:-1]) | (end[1:] != end[:-1]))[: len(left)]
    left, end, period = left[new], end[new], period[new]
    by = np.lexsort((period, left))
    return left[by], (end - left)[by], period[by]


def find(words: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(start, length, period) of all runs in texts laid end to end, by start and period.

    ``words`` has the word numbers, ``bounds`` the ends of the texts; starts count from the first text.
    """
    text = np.repeat(np.arange(len(bounds)), np.diff(bounds, prepend=0))
    none = np.zeros(0, dtype=np.int64)
    if not len(words):
        return none, none, none
    one, _ = _dense(text * (int(words.max()) + 1) + words)
    two, _ = _dense(_doubled(one, 1)) if len(one) > 1 else (one, 1)
    four, _ = _dense(_doubled(two, 2)) if len(one) > 2 else (two, 1)
    # A stretch of least / 2 words occurs twice in a text with a run; four words do for the usual length.
    need = (least + 1) // 2
    probe = four if need >= 4 else two if need >= 2 else one
    twice = np.bincount(text, weights=np.bincount(probe)[probe] > 1, minlength=len(bounds)) > 0
    kept = np.flatnonzero(twice[text])
    if not len(kept):
        return none, none, none
    own, _ = _dense(text[kept] * (int(words.max()) + 1) + words[kept])
    order, levels = _suffixes(own)
    start, length, period = _merged(*_squares(order, _prefixes(order, levels)), levels, least)
    return kept[start], length, period


def _parts(texts: pd.Series) -> Iterator[list[list[bytes]]]:
    """The words of the texts, in parts of about TOGETHER words."""
    held: list[list[bytes]] = []
    n = 0
    for t in texts:
        own = t.encode("utf-8", "surrogatepass").split() if t else []
        if held and n + len(own) > TOGETHER:
            yield held
            held, n = [], 0
        held.append(own)
        n += len(own)
    if held:
        yield held


def judged(texts: pd.Series, least: int = LEAST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
    """(starts, lengths, periods, collapsed text) of every text."""
    for part in _parts(texts):
        number: dict[bytes, int] = {}
        bounds = np.cumsum([len(own) for own in part])
        total = int(bounds[-1])
        words = np.fromiter((number.setdefault(w, len(number)) for own in part for w in own), np.int64, total)
        start, length, period = find(words, bounds, least)
        change = np.zeros(total + 1, dtype=np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        stays = np.cumsum(change[:-1]) == 0
        edges = np.searchsorted(start, np.concatenate([[0], bounds]))
        for k, own in enumerate(part):
            a, b = edges[k], edges[k + 1]
            base = int(bounds[k]) - len(own)
            if a < b:
                own = [own[i] for i in np.flatnonzero(stays[base : base + len(own)])]
            yield start[a:b] - base, length[a:b], period[a:b], b" ".join(own).decode("utf-8", "surrogatepass")


def with_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", least: int = LEAST) -> DataFrame:
    """Add the runs of a text column (array<struct<start, length, period>>, word numbers from 0, by start
    and period) and the text without the repetitions: a word goes if a run holds it after the run's first
    period; the others are joined by one blank.

    Words are separated by blanks, tabs and line ends.  NULL, empty and blank texts have no runs and an
    empty collapsed text.  Repeated rows give repeated rows; an empty table gives none; columns named as
    the new ones are replaced.  ``least`` (2 at least) is the smallest length of a run.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    small_batches(docs.sparkSession)

    @F.pandas_udf("starts array<long>, lengths array<long>, periods array<long>, collapsed string")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame(list(judged(texts, least)), columns=["starts", "lengths", "periods", "collapsed"], dtype=object)

    inner = "_found_by_runs"
    each = F.zip_with(F.col(f"{inner}.starts"), F.arrays_zip(F.col(f"{inner}.lengths"), F.col(f"{inner}.periods")), lambda s, x: F.struct(
        s.alias("start"), x["lengths"].alias("length"), x["periods"].alias("period")))
    return docs.withColumn(inner, found(F.col(text))).withColumns({runs: each, collapsed: F.col(f"{inner}.collapsed")}).drop(inner)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
