"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from terrafold.llm import common

#: Texts longer than this are encoded piece by piece.
LONG = 1 << 20
#: A blank after a letter or digit always starts a new match of the pre-splitting pattern: no alternative holds
#: white space behind other characters, and none looks further than the blank that ends it.
SAFE = re.compile(r"(?<=[^\W_])[ \n]")


@lru_cache(maxsize=4)
def encoding(vocab: str, pattern: str) -> tiktoken.Encoding:
    with open(vocab, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = LONG) -> Iterator[str]:
    """text cut at safe boundaries at least size apart; joined, they are text again."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str, size: int = LONG) -> np.ndarray:
    if len(text) <= size:
        return np.array(enc.encode_ordinary(text), "<u4")
    return np.concatenate([np.array(enc.encode_ordinary(p), "<u4") for p in pieces(text, size)])


def decode_ids(enc: tiktoken.Encoding, ids: bytes) -> bytes:
    return enc.decode_bytes(np.frombuffer(ids, "<u4").tolist())


def _texts(column: pa.Array) -> Iterator[str]:
    for b in column:
        raw = b.as_py()
        yield "" if raw is None else raw.decode("utf-8", "replace")


def encode_documents(docs: DataFrame, vocab: str, pattern: str, text: str = "text", out: str = "ids", size: int = LONG) -> DataFrame:
    """docs with the token ids of the text as little-endian unsigned 32-bit integers in the binary column `out`.

    All columns of docs stay; a column already named `out` is replaced. Null and empty texts give no ids.
    """
    kept = common.without(docs, out)
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(f"`{out}` binary").fields])

    def run(batches):
        enc = encoding(vocab, pattern)
        for b in batches:
            ids = [encode_text(enc, t, size).tobytes() for t in _texts(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.binary())], names=[f.name for f in schema])

    return docs.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(f"`{text}`").cast("binary").alias(common.free_name(docs))).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocab: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the raw bytes of its ids in the binary column `out`; null ids give no bytes."""
    kept = common.without(encoded, out)
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(f"`{out}` binary").fields])

    def run(batches):
        enc = encoding(vocab, pattern)
        for b in batches:
            raw = [decode_ids(enc, x.as_py() or b"") for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(raw, pa.binary())], names=[f.name for f in schema])

    return encoded.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(f"`{ids}`").alias(common.free_name(encoded))).mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocab: str, pattern: str, text: str = "text", key: str = "doc_id", size: int = LONG) -> DataFrame:
    """Digests of the ids and of the bytes that they decode to, in one pass through Python.

    One row per row of docs: key, n_tokens, ids_sha256, decoded_sha256. Null text counts as empty (0 tokens, digests of
    nothing); null and repeated keys are returned as they are; other columns are not read.
    """
    schema = common.row_schema(docs, key, "n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batches):
        enc = encoding(vocab, pattern)
        for b in batches:
            n, ids, raw = [], [], []
            for t in _texts(b.column(1)):
                x = encode_text(enc, t, size)
                n.append(len(x))
                ids.append(hashlib.sha256(x.tobytes()).hexdigest())
                raw.append(hashlib.sha256(enc.decode_bytes(x.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], names=[f.name for f in schema])

    return docs.select(F.col(key), F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)


def encoded_and_decoded(docs: DataFrame, vocab: str, pattern: str, text: str = "text", size: int = LONG) -> DataFrame:
    """docs with n_tokens, ids (as in encode_documents) and decoded (the text from the ids), in one pass through Python.

    Columns of docs named like one of these three are replaced, all others stay; null and empty texts give no ids and an empty
    decoded text. Repeated rows and null ids are rows like others.
    """
    kept = common.without(docs, "n_tokens", "ids", "decoded")
    schema = StructType([*kept.schema.fields, *StructType.fromDDL("n_tokens long, ids binary, decoded string").fields])

    def run(batches):
        enc = encoding(vocab, pattern)
        for b in batches:
            ids = [encode_text(enc, t, size) for t in _texts(b.column(b.num_columns - 1))]
            back = [enc.decode_bytes(x.tolist()).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(map(len, ids), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(back, pa.string())], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(f"`{text}`").cast("binary").alias(common.free_name(docs))).mapInArrow(run, schema)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
