"""Byte-level BPE through a sentencepiece model built from a rank file.

The vocabulary becomes a sentencepiece BPE model without any training: each token's bytes are mapped
to one printable character per byte, its score is the negative rank, normalisation is the identity.
sentencepiece then merges the pair of highest score, which is the pair of lowest rank.  Texts are cut
by the pre-token pattern first; ids are the ranks; decoding maps the ids back to bytes.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.common import small_batches

CACHE = 200_000
LONGEST_CACHED = 64


def read_ranks(spark: SparkSession, path: str) -> list[bytes]:
    """Token bytes in rank order from a rank file (base64 token and rank per line).

    The ranks must run from 0 without gaps and contain every single byte.
    """
    if "://" not in path:
        with open(path, "rb") as f:  # the driver's own copy of a vocabulary of bounded size
            lines = f.read().splitlines()
    else:
        lines = [r.value.encode() for r in spark.read.text(path).collect()]
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in lines if line.strip()))
    tokens = [t for _, t in pairs]
    if [r for r, _ in pairs] != list(range(len(pairs))) or not {bytes([b]) for b in range(256)} <= set(tokens):
        raise ValueError("ranks must be gapless from 0 and cover all bytes")
    return tokens


def byte_letters() -> str:
    """One letter per byte, none of them blank, combining or special to sentencepiece."""
    return "".join(chr(0x4E00 + b) for b in range(256))


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """The serialised model: piece i is token i with score -i; the unknown piece comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    letters = byte_letters()
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(letters[b] for b in token), score=-float(rank))
    model.pieces.add(piece="<unk>", score=-float(len(tokens)), type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(tokens) + 1
    model.trainer_spec.unk_id = len(tokens)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one task, over a serialised model and its tokens."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.encode_pieces = sentencepiece.SentencePieceProcessor(model_proto=model).encode
        self.cut = regex.compile(pattern).findall
        self.letters = byte_letters()
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.known: dict[str, bytes] = {}

    def piece(self, part: str) -> bytes:
        """The ids of one pre-token as little-endian 32-bit integers."""
        raw = part.encode("utf-8", "surrogatepass")
        rank = self.whole.get(raw)
        ids = [rank] if rank is not None else self.encode_pieces("".join(map(self.letters.__getitem__, raw)))
        packed = np.array(ids, dtype="<u4").tobytes()
        if len(part) <= LONGEST_CACHED:
            self.known[part] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        if len(self.known) > CACHE:
            self.known.clear()
        known, piece = self.known.get, self.piece
        return b"".join([known(p) or piece(p) for p in self.cut(text or "")])


def _codec(spark: SparkSession, tokens: list[bytes], pattern: str):
    shared = spark.sparkContext.broadcast((sentencepiece_model(tokens), tokens, pattern))  # bounded by the vocabulary
    return lambda: Codec(*shared.value)


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of a text column, packed as little-endian unsigned 32-bit integers.

    Whole texts are encoded without special tokens; NULL and empty texts give no ids (empty binary).
    ``unpack`` turns the column into an array.  A column named ``out`` is replaced.
    """
    small_batches(docs.sparkSession)
    codec = _codec(docs.sparkSession, tokens, pattern)

    @F.pandas_udf("binary")
    def encoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec()
        for texts in parts:
            yield texts.map(own.encode)

    return docs.withColumn(out, encoded(F.coalesce(F.col(text), F.lit(""))))


def decode(docs: DataFrame, tokens: list[bytes], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that packed ids stand for (binary; NULL ids give none)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    @F.pandas_udf("binary")
    def decoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.array(shared.value, dtype=object)
        for packed in parts:
            yield packed.map(lambda b: b"".join(table[np.frombuffer(b, dtype="<u4")].tolist()))

    return docs.withColumn(out, decoded(F.coalesce(F.col(ids), F.lit(b""))))


def round_trip(docs: DataFrame, tokens: list[bytes], pattern: str, text: str = "text") -> DataFrame:
    """Add ids (array<int>), n_tokens and round_trip: whether the ids decode to the bytes of the text.

    Encoding and decoding run in one Python step, with one worker a task.  NULL texts count as empty;
    columns of these names are replaced.
    """
    small_batches(docs.sparkSession)
    codec = _codec(docs.sparkSession, tokens, pattern)

    @F.pandas_udf("ids array<int>, same boolean")
    def coded(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec()
        table = np.array(list(own.whole), dtype=object)
        for texts in parts:
            ids = [np.frombuffer(own.encode(t), dtype="<i4") for t in texts]
            same = [b"".join(table[i].tolist()) == t.encode("utf-8", "surrogatepass") for i, t in zip(ids, texts)]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "same": pd.Series(same, dtype=bool)})

    inner = "_coded_by_bpe"
    return docs.withColumn(inner, coded(F.coalesce(F.col(text), F.lit("")))).withColumns({
        "ids": F.col(f"{inner}.ids"), "n_tokens": F.size(f"{inner}.ids").cast("long"), "round_trip": F.col(f"{inner}.same")}).drop(inner)


def unpack(docs: DataFrame, ids: str = "ids", out: str = "ids") -> DataFrame:
    """Turn packed ids into array<int>."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def unpacked(packed: pd.Series) -> pd.Series:
        return packed.map(lambda b: np.frombuffer(b, dtype="<i4"))

    return docs.withColumn(out, unpacked(F.coalesce(F.col(ids), F.lit(b""))))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
