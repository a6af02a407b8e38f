"""Removal of repeated strings over a sparse suffix array whose ranks are extended in three rounds, as prefix doubling extends them.

This is not the dense form, in which Spark ranks the suffix at every byte: that takes a row a byte and round, many times the
disk of the input (README has figures). Only some suffixes take part: in every LENGTH-byte window, the one whose first GRAM
bytes hash lowest. Equal windows choose the same suffix, so every repeated string of LENGTH bytes keeps a suffix. Round one ranks
the suffixes by HALF bytes on either side, which all windows there hold: Spark deals the ranks of all parts to ranges, in a close code,
a task sorts a range, and sides whose rank one text has drop out. GRAM bytes would not do: in many texts nearly all of them occur twice.
Round two extends what a rank stands for: the rank of a core of HALF bytes or more is paired with that of all bytes that the windows
around it hold, Spark sorts these pairs, and of texts with equal pairs only the smallest doc_id goes on, if the core has other surroundings too. Round three
ranks the LENGTH bytes, the threshold, of the windows that are left, and keeps the smallest doc_id of each. Windows of one core
meet in one bucket; those of sides whose rank of round one occurs more than HOT times meet by their own hash instead, a row
for each window of a part, so a string that many texts hold is dealt by its different windows. Ranks are 64-bit fingerprints, not
dense numbers: they sort equal strings together without a count of all smaller ones, and equal fingerprints count as equal
strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.llm import arrays, common
from terrafold.llm.parts import Part, dealt

LENGTH = 50
GRAM = 16
#: Bytes of the ranks of round one; all windows around a suffix on a side hold as many, its gram and what lies on that side of it.
HALF = 32
#: Windows that contain a suffix's first GRAM bytes, and how many of them start in the half next to it.
REACH = LENGTH - GRAM + 1
NEAR = REACH // 2 + 1
SPAN = NEAR - 1 + LENGTH
U64 = np.uint64
B = U64(arrays.BASE)
#: Bits of the ranks of round one, and of cores, above those that number the bytes of all texts. That two strings share one
#: costs a comparison more, never a byte.
SPARE = 4
#: Occurrences of a rank of round one up to which the windows of a core are compared in one bucket: all of the core's are among them.
HOT = 1000


def _power(n: int) -> np.uint64:
    return U64(pow(arrays.BASE, n, 1 << 64))


def _doubled(h: np.ndarray, size: int, sizes: list[int]) -> dict[int, np.ndarray]:
    """Polynomial hashes of 1, 2, 4 ... size elements along the last axis; those of `sizes`."""
    out, n = {}, 1
    while True:
        if n in sizes:
            out[n] = h
        if n == size:
            return out
        h = h[..., :-n] * _power(n) + h[..., n:]
        n *= 2


def shortened(n_bytes: int) -> np.uint64:
    """How far a 64-bit fingerprint is shifted to keep whole bytes of it, enough for n_bytes different strings and SPARE bits more."""
    return U64(64 - 8 * min(7, max(4, -(-(max(n_bytes, 1).bit_length() + SPARE) // 8))))


def anchors(part: Part, short: np.uint64, segment: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Positions in part.data of the suffixes that windows choose, in order, and the rank of their first GRAM bytes."""
    data, positions, ranks = part.data, [], []
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    clear = part.clear(LENGTH)[: len(data) - LENGTH + 1]
    low = U64((1 << 20) - 1)
    for a in range(0, len(clear), segment):
        b = min(a + segment, len(clear))
        rank = arrays.mix(_doubled(arrays.TABLE[data[a : b + LENGTH - 1]], GRAM, [GRAM])[GRAM])
        v = (rank & ~low) | np.arange(len(rank), dtype=np.uint64)
        n = 1
        while 2 * n <= REACH:
            v = np.minimum(v[:-n], v[n:])
            n *= 2
        v = np.minimum(v[: b - a], v[REACH - n : REACH - n + b - a])
        at = (v[clear[a:b]] & low).astype(np.int64)
        at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
        positions.append(at + a)
        ranks.append(rank[at])
    positions, ranks = np.concatenate(positions), np.concatenate(ranks)
    order = np.argsort(positions, kind="stable")
    positions, ranks = positions[order], ranks[order]
    new = np.concatenate(([True], positions[1:] != positions[:-1])) if len(positions) else np.zeros(0, bool)
    return positions[new], ranks[new] >> short


def _valid(part: Part, at: np.ndarray, doc: np.ndarray, right: bool) -> tuple[np.ndarray, ...]:
    """Of suffixes at `at`, the common origin of the windows around them on one side, and the offsets of the first and last that
    lie in the text; the last is smaller where there is none."""
    offset = at - (NEAR - 1) if right else at - (REACH - 1)
    n = NEAR if right else REACH - NEAR
    return offset, np.maximum(0, part.start[doc] - offset), np.minimum(n - 1, part.start[doc + 1] - LENGTH - offset)


def _halves(part: Part, at: np.ndarray, bits: int, segment: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in `at`, side and rank of `bits` bits of the HALF bytes that all windows around a suffix on a side hold: those from it on, or
    those up to the end of its gram. Suffixes without windows on a side have none there."""
    doc = part.doc_at(at)
    which, sides, ranks = [], [], []
    for right in (True, False):
        _, lo, hi = _valid(part, at, doc, right)
        use = np.flatnonzero(lo <= hi)
        first = at[use] - (0 if right else HALF - GRAM)
        rank = np.zeros(len(use), np.uint64)
        edges = np.searchsorted(first, np.arange(0, len(part.data) + segment, segment))
        for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if x < y:
                h = _doubled(arrays.TABLE[part.data[k * segment : (k + 1) * segment + HALF - 1]], HALF, [HALF])[HALF]
                rank[x:y] = h[first[x:y] - k * segment]
        which.append(use)
        sides.append(np.full(len(use), right))
        ranks.append(arrays.mix(rank + U64(right)) >> U64(64 - bits))
    return np.concatenate(which), np.concatenate(sides), np.concatenate(ranks)


def _bits(values: np.ndarray, n: int) -> bytes:
    """The lowest n bits of each value, one value behind the other."""
    return np.packbits(((values[:, None] >> np.arange(n, dtype=np.uint64)) & U64(1)).astype(np.uint8).ravel()).tobytes()


def _unbits(packed: bytes, count: int, n: int) -> np.ndarray:
    wide = np.unpackbits(np.frombuffer(packed, np.uint8), count=count * n).reshape(count, n).astype(np.uint64)
    return (wide << np.arange(n, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


RANKS = "part int, bucket int, n int, low int, lows binary, highs binary, times binary"
RANKS_SCHEMA = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("low", pa.int32()), ("lows", pa.binary()), ("highs", pa.binary()), ("times", pa.binary())])


def _ranks(table: pa.Table, bits: int, n_buckets: int) -> pa.Table:
    """Round one: the different ranks of the part, how often each occurs, and whether more than one text has it, a row for each range of
    ranks. The ranks of a row are in order: their low bits, and the differences of the others as runs of zeros (Elias and Fano's code)."""
    part, number = Part.of(table), table.column("part")[0].as_py()
    at, _ = anchors(part, U64(0))
    which, _, rank = _halves(part, at, bits)
    ids = part.doc_id[part.doc_at(at[which])]
    order = np.lexsort((ids, rank))
    rank, ids = rank[order], ids[order]
    first = np.flatnonzero(_heads(rank))
    stop = np.append(first[1:], len(ids))[: len(first)]
    times = (2 * np.minimum(stop - first, 1 << 29) + (ids[stop - 1] != ids[first])).astype("<u4")
    rank = rank[first]
    bucket = ((rank * U64(n_buckets)) >> U64(bits)).astype(np.int64)
    edges = np.append(np.flatnonzero(_heads(bucket)), len(bucket))
    press, rows = zstandard.ZstdCompressor(level=3), []
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        r = rank[x:y]
        low = max(0, ((1 << bits) // n_buckets // len(r)).bit_length() - 1)
        high = (r >> U64(low)) - (r[0] >> U64(low))
        ones = np.zeros(int(high[-1]) + len(r), np.uint8)
        ones[high.astype(np.int64) + np.arange(len(r))] = 1
        lows = _bits(r, low) if low else b""
        head = int(r[0] >> U64(low)).to_bytes(8, "little")
        rows.append((number, int(bucket[x]), len(r), low, lows, head + np.packbits(ones).tobytes(), press.compress(times[x:y].view(np.uint8).reshape(-1, 4).T.tobytes())))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RANKS_SCHEMA, strict=True)], schema=RANKS_SCHEMA) if rows else RANKS_SCHEMA.empty_table()


SIEVED = "part int, bucket int, shared binary, hot binary"
SIEVED_SCHEMA = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("shared", pa.binary()), ("hot", pa.binary())])


def _sieved(table: pa.Table, most: int) -> pa.Table:
    """For each part, which of its ranks in a range more than one text has, and which occur more than `most` times, a bit a rank."""
    open_, keys, times = zstandard.ZstdDecompressor(), [], []
    for r in table.to_pylist():
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(r["highs"], np.uint8, offset=8)))
        high = (ones[: r["n"]] - np.arange(r["n"])).astype(np.uint64) + U64(int.from_bytes(r["highs"][:8], "little"))
        keys.append((high << U64(r["low"])) + (_unbits(r["lows"], r["n"], r["low"]) if r["low"] else U64(0)))
        times.append(np.ascontiguousarray(np.frombuffer(open_.decompress(r["times"]), np.uint8).reshape(4, -1).T).view("<u4").ravel())
    stops = np.cumsum([len(k) for k in keys])
    key, times = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(_heads(key[order]))
    sizes = np.diff(np.append(first, len(key)))
    shared, hot = np.zeros(len(key), bool), np.zeros(len(key), bool)
    shared[order] = np.repeat((sizes > 1) | (np.bitwise_or.reduceat(times[order] & 1, first) > 0), sizes)
    hot[order] = np.repeat(np.add.reduceat((times[order] >> 1).astype(np.int64), first) > most, sizes)
    packed = lambda v: pa.array([np.packbits(x).tobytes() for x in np.split(v, stops[:-1])], pa.binary())
    return pa.table([table.column("part"), table.column("bucket"), packed(shared), packed(hot)], schema=SIEVED_SCHEMA)


PAIRS = "part int, seq int, doc_id long, start array<long>, lo int, hi int, span binary, bits int, run long, window long, bucket long"
PAIRS_SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("start", pa.list_(pa.int64())), ("lo", pa.int32()), ("hi", pa.int32()), ("span", pa.binary()), ("bits", pa.int32()), ("run", pa.int64()), ("window", pa.int64()), ("bucket", pa.int64())])


def _folded(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    acc = np.zeros(len(rows), np.uint64)
    for column in wide.view(np.uint64).T:
        acc = arrays.mix(acc * B + column)
    return acc


def _spans(part: Part, at: np.ndarray, doc: np.ndarray, right: bool, short: np.uint64, block: int = 1 << 14):
    """The windows around suffixes at `at` on one side: offsets of their first and last from a common origin, the bytes
    they hold (zero outside), and the fingerprints of these and of the core that all share."""
    offset, lo, hi = _valid(part, at, doc, right)
    core = np.arange(NEAR - 1, LENGTH) if right else np.arange(REACH - NEAR - 1, LENGTH)
    padded = np.concatenate((np.zeros(REACH, np.uint8), part.data, np.zeros(SPAN, np.uint8)))
    column = np.arange(SPAN)
    for a in range(0, len(at), block):
        s = slice(a, a + block)
        bytes_ = padded[offset[s, None] + REACH + column]
        bytes_[(column < lo[s, None]) | (column >= hi[s, None] + LENGTH)] = 0
        mark = arrays.mix((lo[s] * 64 + hi[s] * 2 + right).astype(np.uint64))
        yield s, offset[s], lo[s], hi[s], bytes_, _folded(bytes_) ^ mark, arrays.mix(_folded(bytes_[:, core]) + U64(right)) >> short


#: The low bits of a rank of round two are those of the suffix's rank of round one, by which a part finds it again.
LOW = U64((1 << 20) - 1)


def _surroundings(part: Part, at: np.ndarray, rank: np.ndarray, short: np.uint64, sides: tuple[bool, ...] = (True, False)):
    """For each of the sides: side, text, offset, first and last window, rank of round two and core of each suffix with windows.

    Suffixes are ordered by rank, then place: of equal ranks, the first is of the smallest doc_id.
    """
    doc = part.doc_at(at)
    for side in sides:
        got = [x[1:4] + x[5:] for x in _spans(part, at, doc, side, short)]
        if not got:
            continue
        offset, lo, hi, rank2, core = map(np.concatenate, zip(*got, strict=True))
        rank2 = (rank2 & ~LOW) | (rank & LOW)
        use = np.flatnonzero(lo <= hi)
        order = use[np.lexsort((at[use], rank2[use]))]
        yield side, at[order], doc[order], offset[order], lo[order], hi[order], rank2[order], core[order]


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted keys differs from the one before."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


#: Fields in an order that brings their bytes together which differ from row to row, doc_id shifted up to them, so that Spark's
#: shuffle presses the others away; a shift keeps the order of ids.
CLASSES = "part int, multi boolean, doc_id long, rank long, core long"
CLASSES_SCHEMA = pa.schema([("part", pa.int32()), ("multi", pa.bool_()), ("doc_id", pa.int64()), ("rank", pa.int64()), ("core", pa.int64())])


def room(least: int, most: int) -> int:
    """Whole bytes, in bits, by which ids from least to most can be shifted up without loss."""
    return 8 * max(0, (63 - max(abs(least), abs(most)).bit_length()) // 8)


def _classes(left: pa.Table, right: pa.Table, short: np.uint64, up: int, bits: int, n_buckets: int) -> pa.Table:
    """Round two: a row for each rank of the part, with the smallest doc_id that has it; multi if another has it too.

    The core of a hot suffix is its rank, so that its other surroundings are dealt elsewhere.
    """
    if not left.num_rows or not right.num_rows:
        return CLASSES_SCHEMA.empty_table()
    part, number = Part.of(left), left.column("part")[0].as_py()
    at, rank = anchors(part, short)
    which, sides, half = _halves(part, at, bits)
    known, place = np.unique(half, return_inverse=True)
    right = right.sort_by("bucket")
    edges = np.append(np.flatnonzero(_heads((known * U64(n_buckets)) >> U64(bits))), len(known))
    flags = [np.concatenate([np.unpackbits(np.frombuffer(v, np.uint8), count=n) for v, n in zip(right.column(k).to_pylist(), np.diff(edges), strict=True)]).astype(bool)[place] for k in ("shared", "hot")]
    out = []
    for side in (True, False):
        use = flags[0] & (sides == side)
        chosen, hot = which[use], flags[1][use]
        for _, a, doc, _, _, _, rank2, core in _surroundings(part, at[chosen], rank[chosen], short, (side,)):
            core = np.where(hot[np.searchsorted(at[chosen], a)], rank2, core)
            first = np.flatnonzero(_heads(rank2))
            ids = part.doc_id[doc]
            multi = ids[np.append(first[1:], len(ids)) - 1] != ids[first] if len(first) else np.zeros(0, bool)
            out.append(pa.table([pa.array(np.full(len(first), number, np.int32)), pa.array(multi), pa.array(ids[first] << up), pa.array(rank2[first].view(np.int64)), pa.array(core[first].view(np.int64))], schema=CLASSES_SCHEMA))
    return pa.concat_tables(out) if out else CLASSES_SCHEMA.empty_table()


def _verdicts(classes: DataFrame) -> DataFrame:
    """part, rank and flags (2 * open + later) of the ranks that matter: open, if the core occurs in other surroundings too and no smaller
    doc_id has the rank, so that round three must compare windows (1: in a bucket of the core, 2: by the windows, as of a hot
    suffix, whatever its surroundings); else a smaller doc_id has it, in this part or another."""
    least = F.min("doc_id").over(Window.partitionBy("core", "rank"))
    around = Window.partitionBy("core")
    found = classes.withColumn("_first", F.col("doc_id") == least).withColumn("_several", F.min("rank").over(around) < F.max("rank").over(around))
    opened = F.when(F.col("_first") & (F.col("core") == F.col("rank")), 2).when(F.col("_first") & F.col("_several"), 1).otherwise(0)
    found = found.withColumn("open", opened).withColumn("later", ~F.col("_first"))
    return found.where("later or open > 0 or multi").select("rank", "part", (2 * F.col("open") + F.col("later").cast("int")).alias("flags"))


def _values(spans: np.ndarray) -> np.ndarray:
    """Hashes of the windows of LENGTH bytes (spans x NEAR) of spans of SPAN bytes."""
    h = _doubled(arrays.TABLE[spans], 32, [2, 16, 32])
    w = SPAN - LENGTH + 1
    return arrays.mix((h[32][:, :w] * _power(16) + h[16][:, 32 : 32 + w]) * _power(2) + h[2][:, 48 : 48 + w])


def _single(part: Part, number: int, side: bool, at: np.ndarray, doc: np.ndarray, core: np.ndarray, block: int = 1 << 16):
    """Windows around hot suffixes, a block of suffixes at a time: runs (text, start, length) of those that a smaller doc_id of
    the block has, and a row of PAIRS for each other window and text, with all the places it has there."""
    order = np.argsort(core, kind="stable")
    for x in range(0, len(order), block):
        chosen = order[x : x + block]
        values, texts, starts = [], [], []
        for s, offset, lo, hi, spans, _, _ in _spans(part, at[chosen], doc[chosen], side, U64(0)):
            column = np.arange(SPAN - LENGTH + 1)
            i, j = np.nonzero((column >= lo[:, None]) & (column <= hi[:, None]))
            d = doc[chosen][s][i]
            values.append(_values(spans)[i, j])
            texts.append(d)
            starts.append(offset[i] + j - part.start[d])
        value, text, start = (np.concatenate(v) for v in (values, texts, starts))
        by = np.lexsort((start, text, value))  # texts are in order of doc_id
        value, text, start = value[by], text[by], start[by]
        head = _heads(value)
        ids = part.doc_id[text]
        later = ids > ids[np.flatnonzero(head)][np.cumsum(head) - 1]
        value, rest, where = value[~later], text[~later], start[~later]
        first = np.flatnonzero(_heads(value, rest))
        n = len(first)
        stops = np.append(first, len(value)).astype(np.int32)
        keys = pa.array(value[first].view(np.int64))
        rows = pa.table([
            pa.array(np.full(n, number, np.int32)), pa.array(rest[first].astype(np.int32)), pa.array(part.doc_id[rest[first]]), pa.ListArray.from_arrays(pa.array(stops), pa.array(where)),
            pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), keys, keys,
        ], schema=PAIRS_SCHEMA)
        yield np.stack((text[later], start[later], np.ones(int(later.sum()), np.int64))), rows


def _pairs(left: pa.Table, right: pa.Table, short: np.uint64) -> pa.Table:
    """Suffixes whose rank of round two a smaller doc_id has give runs of windows; open ones go on with their bytes, or with
    the hashes of their windows if hot."""
    if not left.num_rows:
        return PAIRS_SCHEMA.empty_table()
    part, number = Part.of(left), left.column("part")[0].as_py()
    at, rank = anchors(part, short)
    known = right.column("rank").to_numpy().view(np.uint64) if right.num_rows else np.zeros(0, np.uint64)
    by = np.argsort(known)
    both = right.column("flags").to_numpy().astype(np.int8)[by] if right.num_rows else np.zeros(0, np.int8)
    flags = [both >> 1, both & 1]
    known = known[by]
    seen = np.zeros(1 << 20, bool)
    seen[(known & LOW).astype(np.int64)] = True
    use = seen[(rank & LOW).astype(np.int64)]
    runs, rows = [], []
    for side, a, doc, offset, lo, hi, rank2, core in _surroundings(part, at[use], rank[use], short):
        place = np.minimum(np.searchsorted(known, rank2), max(len(known) - 1, 0))
        hit = known[place] == rank2 if len(known) else np.zeros(len(rank2), bool)
        head = _heads(rank2)
        least = part.doc_id[doc][np.flatnonzero(head)][np.cumsum(head) - 1] if len(rank2) else np.zeros(0, np.int64)
        later = part.doc_id[doc] > least
        opened, elsewhere = (np.where(hit, f[place], 0) if len(known) else hit.astype(np.int8) for f in flags)
        settled = np.flatnonzero(hit & (later | (elsewhere > 0)))
        runs.append(np.stack((doc[settled], offset[settled] + lo[settled] - part.start[doc[settled]], hi[settled] - lo[settled] + 1)))
        # the open ones of the smallest doc_id: one row for each text and rank, with all the places it has in the text
        hot = np.flatnonzero((opened == 2) & ~later)
        for run, single in _single(part, number, side, a[hot], doc[hot], core[hot]):
            runs.append(run)
            rows.append(single)
        order = np.flatnonzero((opened == 1) & ~later)
        first = np.flatnonzero(_heads(rank2[order], doc[order]))
        where = offset[order] - part.start[doc[order]]
        stops = np.append(first, len(order)).astype(np.int32)
        lead = order[first]
        n = len(first)
        spans = np.concatenate([np.zeros((0, SPAN), np.uint8), *(x[4] for x in _spans(part, a[lead], doc[lead], side, short))])
        spans = pa.array(spans.ravel()).buffers()[1] if n else pa.py_buffer(b"")
        spans = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * SPAN).astype(np.int32).tobytes()), spans])
        rows.append(pa.table([
            pa.array(np.full(n, number, np.int32)), pa.array(doc[lead].astype(np.int32)), pa.array(part.doc_id[doc[lead]]), pa.ListArray.from_arrays(pa.array(stops), pa.array(where)),
            pa.array(lo[lead].astype(np.int32)), pa.array(hi[lead].astype(np.int32)), spans, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(core[lead].view(np.int64)),
        ], schema=PAIRS_SCHEMA))
    if runs and any(r.shape[1] for r in runs):
        doc_, start, run = np.concatenate(runs, axis=1)
        order = np.lexsort((start, doc_))
        doc_, start, stop = doc_[order], start[order], (start + run)[order]
        # texts do not overlap on one axis, so one pass joins neighbouring runs of all of them
        shift = doc_ * (int(part.start[-1]) + 1)
        reach = np.maximum.accumulate(stop + shift) if len(stop) else stop
        head = np.concatenate(([True], (start + shift)[1:] > reach[:-1])) if len(stop) else np.zeros(0, bool)
        first = np.flatnonzero(head)
        last = reach[np.append(first[1:], len(reach)) - 1] - shift[first] if len(first) else reach
        n = len(first)
        spread = arrays.mix(np.arange(n, dtype=np.uint64) + U64(number << 32)).view(np.int64)
        one = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(start[first]))
        rows.append(pa.table([
            pa.array(np.full(n, number, np.int32)), pa.array(doc_[first].astype(np.int32)), pa.array(part.doc_id[doc_[first]]), one, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()),
            pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.array(last - start[first]), pa.nulls(n, pa.int64()), pa.array(spread),
        ], schema=PAIRS_SCHEMA))
    return pa.concat_tables(rows) if rows else PAIRS_SCHEMA.empty_table()


FLAGS = "part int, seq int, start array<long>, bits int, run long"
FLAGS_SCHEMA = pa.schema([PAIRS_SCHEMA.field(k) for k in ("part", "seq", "start", "bits", "run")])


def _windows(table: pa.Table) -> pa.Table:
    """Round three: windows of LENGTH bytes that a smaller doc_id has, as bits behind the common origin, or as runs of one where
    they came by their hash; runs pass."""
    done = table.filter(pc.is_valid(table.column("run"))).select(FLAGS_SCHEMA.names)
    single = table.filter(pc.is_valid(table.column("window")))
    if single.num_rows:
        value, ids = single.column("window").to_numpy(), single.column("doc_id").to_numpy()
        order = np.lexsort((ids, value))
        head = _heads(value[order])
        later = order[ids[order] > ids[order][np.flatnonzero(head)][np.cumsum(head) - 1]]
        found = single.take(pa.array(later)).select(FLAGS_SCHEMA.names)
        found = found.set_column(found.schema.get_field_index("run"), "run", pa.array(np.ones(len(later), np.int64)))
        done = pa.concat_tables([done, found.cast(done.schema)])
    open_ = table.filter(pc.and_(pc.is_null(table.column("run")), pc.is_null(table.column("window"))))
    n = open_.num_rows
    if not n:
        return done
    bytes_ = np.frombuffer(b"".join(open_.column("span").to_pylist()), np.uint8).reshape(n, SPAN)
    value = _values(bytes_)
    w = value.shape[1]
    lo, hi = (open_.column(k).to_numpy()[:, None] for k in ("lo", "hi"))
    ids = np.broadcast_to(open_.column("doc_id").to_numpy()[:, None], value.shape)
    at = np.flatnonzero(((np.arange(w) >= lo) & (np.arange(w) <= hi)).ravel())
    value, ids = value.ravel()[at], ids.ravel()[at]
    order = np.lexsort((ids, value))
    v, i = value[order], ids[order]
    head = np.concatenate(([True], v[1:] != v[:-1]))
    later = at[order[i > i[np.flatnonzero(head)][np.cumsum(head) - 1]]]
    bits = np.bincount(later // w, weights=(1 << (later % w)).astype(np.float64), minlength=n).astype(np.int64)
    hit = np.flatnonzero(bits)
    found = open_.take(pa.array(hit)).select(FLAGS_SCHEMA.names)
    found = found.set_column(found.schema.get_field_index("bits"), "bits", pa.array(bits[hit].astype(np.int32)))
    return pa.concat_tables([done, found.cast(FLAGS_SCHEMA)])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _removed(with_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return RESULT_SCHEMA.empty_table()
        part = Part.of(left)
        cover = np.zeros(len(part.data) + 1, np.int32)
        if right.num_rows:
            right = right.combine_chunks()
            column = right.column("start").combine_chunks()
            counts = np.diff(column.offsets.to_numpy())
            row = np.repeat(np.arange(right.num_rows), counts)
            start = column.flatten().to_numpy() + part.start[right.column("seq").to_numpy()[row]]
            bits, run_ = (right.column(k).fill_null(0).to_numpy()[row] for k in ("bits", "run"))
            np.add.at(cover, start[run_ > 0], 1)
            np.add.at(cover, (start + run_ + LENGTH - 1)[run_ > 0], -1)
            for w in range(NEAR):
                on = start[(bits >> w) & 1 == 1] + w
                np.add.at(cover, on, 1)
                np.add.at(cover, on + LENGTH, -1)
        gone = np.cumsum(cover, dtype=np.int32, out=cover)[:-1] > 0
        del cover
        out = []
        for k, doc_id in enumerate(part.doc_id):
            a, b = part.start[k], part.start[k + 1]
            g = gone[a:b]
            kept = part.data[a:b][~g].tobytes()
            spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(len(g) > 0 and g[0])
            out.append((int(doc_id), int(b - a), int(b - a) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RESULT_SCHEMA, strict=True)], schema=RESULT_SCHEMA)

    return run


def remove_repeats(docs: DataFrame, text: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) for each row of docs.

    A byte goes if a LENGTH-byte string that covers it also starts in a row of a smaller doc_id; the input is what counts.
    Null and empty texts, and texts shorter than LENGTH, keep what they have. Rows of one doc_id do not touch each other.
    Rows of a null doc_id are compared with nothing. Other columns are not read. No rows give no rows.
    """
    ids = F.col("doc_id").cast("long")
    total, least, most = (x or 0 for x in docs.agg(F.sum(F.octet_length(F.col(text))), F.min(ids), F.max(ids)).first())
    n, short, up = common.parts_for(docs, total), shortened(total), room(least, most)
    texts = dealt(docs, n, text)
    bits, hot = min(48, max(total, 1).bit_length() + SPARE), HOT
    ranks = texts.groupBy("part").applyInArrow(lambda t: _ranks(t, bits, n), RANKS)
    sieved = ranks.groupBy("bucket").applyInArrow(lambda t: _sieved(t, hot), SIEVED)
    classes = texts.groupBy("part").cogroup(sieved.groupBy("part")).applyInArrow(lambda t, u: _classes(t, u, short, up, bits, n), CLASSES)
    pairs = texts.groupBy("part").cogroup(_verdicts(classes).groupBy("part")).applyInArrow(lambda t, u: _pairs(t, u, short), PAIRS)
    buckets = pairs.withColumn("bucket", F.pmod("bucket", F.lit(16 * n)))
    flags = buckets.groupBy("bucket").applyInArrow(_windows, FLAGS)
    found = texts.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(_removed(with_text), RESULT)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    lone = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), (raw if with_text else F.lit(None).cast("binary")).alias("kept"))
    return found.unionByName(lone)


def op4_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.documents(spark, sf_dir), with_text=False).drop("kept")
