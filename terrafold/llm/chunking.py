"""Substring dedup with content-defined chunks cut by a gear rolling hash."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import arrays, common
from terrafold.llm.parts import Part, dealt, shared

#: A cut falls behind a byte where the top CUT_BITS bits of the gear hash are 0, on average every 2**CUT_BITS bytes. It depends
#: on the REACH bytes before it only, so it moves with the text around an insertion. A chunk without a cut ends at MOST.
CUT_BITS = 5
REACH = 32
MOST = 256
#: Repeated chunks are removed in runs of this many bytes or more: single short chunks repeat by chance.
MIN_RUN = 64
GEAR = (arrays.TABLE >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash behind each byte: h = (h << 1) + GEAR[byte] in 32 bits, for all bytes by doubling."""
    h, n = GEAR[data], 1
    while n < REACH:
        more = h.copy()
        more[n:] += h[:-n] << np.uint32(n)
        h, n = more, 2 * n
    return h


def chunks(part: Part, segment: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of all chunks of the part in order; every text starts a chunk, and chunks cover the texts."""
    cuts = []
    for a in range(0, len(part.data), segment):
        lead = min(a, REACH - 1)
        h = gear(part.data[a - lead : a + segment])[lead:]
        cuts.append(np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + a + 1)
    cuts = np.concatenate([*cuts, np.zeros(0, np.int64)])
    # a hash that reaches into the text before is no cut of this one
    text = np.searchsorted(part.start, cuts - 1, "right") - 1
    cuts = cuts[cuts - part.start[text] >= REACH]
    edges = np.unique(np.concatenate((cuts, part.start)))
    gap = np.diff(edges)
    long = np.flatnonzero(gap > MOST)
    extra = [np.arange(edges[k] + MOST, edges[k + 1], MOST) for k in long]
    edges = np.unique(np.concatenate([edges, *extra])) if extra else edges
    return edges[:-1], edges[1:]


def _digests(part: Part, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    raw = part.data.tobytes()
    return np.array([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), stop.tolist(), strict=True)], "S16" if not len(start) else object)


def _codes(digests: np.ndarray) -> np.ndarray:
    """digests as pairs of 64-bit integers, which sort and compare fast."""
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2) if len(digests) else np.zeros((0, 2), np.uint64)


FIRST = "struct<doc_id:long,place:long>"


def _keys(table: pa.Table) -> pa.Table:
    """A row for each chunk digest of the part: its first doc_id and place, and whether the part has it again."""
    part = Part.of(table)
    start, stop = chunks(part)
    doc = part.doc_at(start)
    code = _codes(_digests(part, start, stop))
    order = np.lexsort((start, code[:, 1], code[:, 0]))
    c = code[order]
    head = np.concatenate(([True], (c[1:] != c[:-1]).any(axis=1))) if len(c) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    lead = order[at]
    multi = np.diff(np.append(at, len(order))) > 1
    first = pa.StructArray.from_arrays([pa.array(part.doc_id[doc[lead]]), pa.array(start[lead] - part.start[doc[lead]])], ["doc_id", "place"])
    number = table.column("part")[0].as_py()
    keys = pa.array([x.tobytes() for x in code[lead]], pa.binary())
    return pa.table({"part": pa.array(np.full(len(lead), number, np.int32)), "key": keys, "first": first, "multi": pa.array(multi)})


RESULT = "doc_id long, n_bytes long, n_chunks long, n_repeated long, n_removed long, n_spans long, first_docs array<long>, kept_sha256 string, kept binary"
RESULT_SCHEMA = pa.schema([(k, pa.int64()) for k in ("doc_id", "n_bytes", "n_chunks", "n_repeated", "n_removed", "n_spans")] + [("first_docs", pa.list_(pa.int64())), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _removed(with_text: bool, min_run: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return RESULT_SCHEMA.empty_table()
        part = Part.of(left)
        start, stop = chunks(part)
        doc = part.doc_at(start)
        source = np.full(len(start), -1, np.int64)
        repeated = np.zeros(len(start), bool)
        if right.num_rows:
            code = _codes(_digests(part, start, stop))
            known = _codes(np.array(right.column("key").to_pylist(), object))
            first = right.column("first").combine_chunks()
            first_doc, first_place = (first.field(k).to_numpy() for k in ("doc_id", "place"))
            # both halves of a digest decide: rows are matched by sorted position of the pair
            both = np.concatenate((known, code))
            _, group = np.unique(both.view([("a", np.uint64), ("b", np.uint64)]).ravel(), return_inverse=True)
            row = np.full(group.max() + 1, -1, np.int64)
            row[group[: len(known)]] = np.arange(len(known))
            row = row[group[len(known) :]]
            hit = row >= 0
            place = start - part.start[doc]
            repeated = hit & ((first_doc[row] != part.doc_id[doc]) | (first_place[row] != place))
            source[repeated] = first_doc[row[repeated]]
        out = []
        lo = np.searchsorted(doc, np.arange(len(part.doc_id)), "left")
        hi = np.searchsorted(doc, np.arange(len(part.doc_id)), "right")
        for k, doc_id in enumerate(part.doc_id):
            a, b = part.start[k], part.start[k + 1]
            s, e, r = start[lo[k] : hi[k]], stop[lo[k] : hi[k]], repeated[lo[k] : hi[k]]
            edge = np.flatnonzero(np.diff(np.concatenate(([False], r, [False])).astype(np.int8)))
            runs = [(s[i], e[j - 1], i, j) for i, j in zip(edge[::2], edge[1::2], strict=True) if e[j - 1] - s[i] >= min_run]
            kept, at, from_ = [], a, set()
            for x, y, i, j in runs:
                kept.append(part.data[at:x].tobytes())
                at = y
                from_.update(source[lo[k] + i : lo[k] + j].tolist())
            text = b"".join([*kept, part.data[at:b].tobytes()])
            out.append((int(doc_id), int(b - a), len(s), int(r.sum()), int(b - a) - len(text), len(runs), sorted(from_), hashlib.sha256(text).hexdigest(), text if with_text else None))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RESULT_SCHEMA, strict=True)], schema=RESULT_SCHEMA)

    return run


def dedup_substrings(docs: DataFrame, text: str = "text", min_run: int = MIN_RUN, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_repeated, n_removed, n_spans, first_docs, kept_sha256, kept for each row of docs.

    A chunk is repeated if its digest occurs before: in a smaller doc_id, or earlier in the same one. Runs of repeated
    chunks of min_run bytes or more are removed; first_docs lists where their chunks occur first. Null and empty texts
    have no chunks. Rows of a null doc_id are compared with nothing and keep all, with null counts of chunks. Other columns
    are not read. No rows give no rows.
    """
    n = common.parts_for(docs, common.bytes_of(docs, text))
    texts = dealt(docs, n, text)
    keys = texts.groupBy("part").applyInArrow(_keys, f"part int, key binary, first {FIRST}, multi boolean")
    found = shared(keys, first="first")
    out = texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_removed(with_text, min_run), RESULT)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    null, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    lone = docs.where("doc_id is null").select(
        F.col("doc_id").cast("long"), F.octet_length(raw).cast("long").alias("n_bytes"), null.alias("n_chunks"), null.alias("n_repeated"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.array().cast("array<long>").alias("first_docs"), F.sha2(raw, 256).alias("kept_sha256"), (raw if with_text else F.lit(None).cast("binary")).alias("kept"),
    )
    return out.unionByName(lone)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(common.documents(spark, sf_dir), with_text=False).drop("kept")
