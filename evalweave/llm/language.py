"""Language identification by compression with per-language zstandard raw-content dictionaries.

Each language's dictionary is sampled text of that language.  A text is reduced to its
lower-case words and cut into windows; the language whose dictionary compresses the windows to the fewest bytes is predicted, and
the prediction is rejected (``accepted`` false) when the margin to the second is narrow.

The fit uses at most SAMPLE texts of each of at most LANGUAGES languages; of a longer text CHARS
characters from a place that its hash gives.  Predictions read whole texts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import bounded_sample, small_batches

SAMPLE = 128
CHARS = 1024
LANGUAGES = 200
LEVEL = 3
WINDOW = 2048
MARGIN = 0.01
BYTES_PER_NAT = 4.0
UNKNOWN = "und"
# The ASCII characters that are no letters, as a table to blanks.
_BLANKS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def plain(text: str) -> bytes:
    """Lower-case words with single blanks, as UTF-8."""
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_BLANKS).split()) + b" "


def fit(rows: DataFrame) -> dict[str, bytes]:
    """The dictionary of each language, from rows (text, label); NULL labels and texts are ignored."""
    known = rows.where(F.col("text").rlike("[\\p{L}]"))
    names = known.where(F.col("label").isNotNull()).select("label").distinct().limit(LANGUAGES + 1).count()
    if names > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    start = F.pmod(F.xxhash64("draw"), F.greatest(F.length("text") - CHARS, F.lit(0)) + 1).cast("int") + 1
    sample = bounded_sample(known, SAMPLE).select("label", "draw", F.substring("text", start, F.lit(CHARS)).alias("text"))
    texts: dict[str, list[bytes]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r.label, r.draw)):  # LANGUAGES * SAMPLE texts of CHARS characters
        texts.setdefault(r.label, []).append(plain(r.text))
    return {lang: b"".join(parts) for lang, parts in texts.items()}


class Judge:
    """Compressed lengths of texts under every dictionary."""

    def __init__(self, dictionaries: Mapping[str, bytes]):
        self.names = sorted(dictionaries)
        self.sides = []
        for name in self.names:
            words = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            self.sides.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=words, write_content_size=False, write_dict_id=False).compress)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted); ties go to the first name."""
        if not self.names or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        raw = plain(text)
        windows = [raw[k : k + WINDOW] for k in range(0, len(raw), WINDOW)]
        sizes = np.array([sum(len(side(w)) for w in windows) for side in self.sides], dtype=float)
        best = int(sizes.argmin())
        second = np.partition(sizes, 1)[1] if len(sizes) > 1 else np.inf
        score = 1 / np.exp(-np.minimum(sizes - sizes[best], 700.0) / BYTES_PER_NAT).sum()
        return self.names[best], float(score), bool(second - sizes[best] >= max(MARGIN * sizes[best], 1.0))


def predict(docs: DataFrame, dictionaries: Mapping[str, bytes], text: str = "text") -> DataFrame:
    """Add lang_pred, score (0 to 1) and accepted; columns of these names are replaced.

    NULL texts, texts without a letter, and all texts when nothing was learned, give ``und``, score 0
    and accepted false.  All rows stay; equal texts get equal predictions.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dict(dictionaries))  # LANGUAGES * SAMPLE * CHARS characters

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Judge(shared.value)
        for texts in parts:
            yield pd.DataFrame([judge(t) for t in texts], columns=["lang_pred", "score", "accepted"]).astype(
                {"lang_pred": object, "score": float, "accepted": bool})

    inner = "_verdict_of_language"
    return docs.withColumn(inner, judged(F.col(text))).withColumns(
        {c: F.col(f"{inner}.{c}") for c in ("lang_pred", "score", "accepted")}).drop(inner)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
