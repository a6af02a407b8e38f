"""Documents dealt into parts: bounded sets of whole texts that NumPy kernels work on, and keys that parts share."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm import arrays


SCHEMA = "part int, ids binary, texts binary"


def dealt(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    """Rows of docs with a doc_id, dealt into n parts by its hash: part, ids, and sizes and bytes of the texts (null: empty),
    compressed, a row for each part of a batch."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=6)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            column = b.column(1)
            part = (arrays.mix(ids.view(np.uint64)) % np.uint64(n)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.diff(np.concatenate(([-1], part[order], [-1]))))
            rows = []
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                chosen = order[x:y]
                texts = column.take(pa.array(chosen)).to_pylist()
                sizes = np.fromiter(map(len, texts), "<i8", len(texts)).tobytes()
                rows.append((int(part[chosen[0]]), ids[chosen].tobytes(), press.compress(sizes + b"".join(texts))))
            number, keys, packed = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], names=["part", "ids", "texts"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).mapInArrow(run, SCHEMA)


@dataclass
class Part:
    """The texts of one part in order of doc_id, then text, one behind the other. Equal on every computation."""

    doc_id: np.ndarray
    start: np.ndarray  # of each text in data; one more for the end
    data: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Part:
        ids, texts, open_ = [], [], zstandard.ZstdDecompressor()
        for keys, packed in zip(table.column("ids").to_pylist(), table.column("texts").to_pylist(), strict=True):
            found = np.frombuffer(keys, np.int64).tolist()
            raw = open_.decompress(packed)
            edges = 8 * len(found) + np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<i8", len(found)))))
            ids += found
            texts += [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        texts = [texts[k] for k in order]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        return Part(np.array([ids[k] for k in order], np.int64), np.concatenate(([0], np.cumsum(sizes))), np.frombuffer(b"".join(texts), np.uint8))

    def doc_at(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, position, "right") - 1

    def clear(self, size: int) -> np.ndarray:
        """Whether the size bytes from each position on lie in one text."""
        ok = np.ones(len(self.data), bool)
        back = self.start[1:, None] - np.arange(1, size)
        back = back[back >= self.start[:-1, None]] if len(back) else back
        ok[back.ravel()] = False
        return ok


def shared(keys: DataFrame, key: str = "key", first: str | None = None) -> DataFrame:
    """The rows of keys (part, key, multi) whose key more than one text has.

    keys has a row for each key of a part, however many texts of the part have it, so a key has no more rows than there
    are parts. first: a column whose smallest value over all parts replaces it.
    """
    by = Window.partitionBy(key)
    found = keys.withColumn("_n", F.count("*").over(by)).withColumn("_m", F.max("multi").over(by))
    if first:
        found = found.withColumn(first, F.min(first).over(by))
    return found.where("_n > 1 or _m").drop("_n", "_m", "multi")
