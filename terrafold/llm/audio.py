"""Media columns: chroma audio fingerprints, and alignment of recordings by offset histograms and bit errors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples a second, samples of a frame, samples from frame to frame.
RATE, FRAME, HOP = 8000, 256, 16
PITCHES = 12
#: Frames under a filter at most; a fingerprint begins at each frame that so many follow.
WIDTH = 16
FILTERS = 16
#: Quartiles are counted to 1 / STEPS for the quantiser thresholds.
STEPS = 1 << 10
#: A pair is reported whose best offset has this many equal fingerprints, and at most this share of unequal bits there.
LEAST_HITS, MOST_ERRORS = 2, 0.25


def _pitch_map() -> np.ndarray:
    """The pitch class of each bin of the spectrum; -1 outside 60 to 3600 Hz."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    note = np.round(12 * np.log2(np.maximum(hz, 1e-9) / 440.0)).astype(int) % PITCHES
    return np.where((hz >= 60) & (hz <= 3600), note, -1)


PITCH = _pitch_map()
ONE_HOT = (PITCH[:, None] == np.arange(PITCHES)).astype(np.float64)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Pitch-class energies of each frame (frames x 12), each frame scaled to length 1; silent frames stay 0."""
    if len(samples) < FRAME:
        return np.zeros((0, PITCHES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME)
    energy = np.abs(np.fft.rfft(frames, axis=1)) ** 2 @ ONE_HOT
    size = np.sqrt((energy**2).sum(axis=1, keepdims=True))
    return np.divide(energy, size, out=np.zeros_like(energy), where=size > 1e-9)


def filters() -> list[tuple[int, int, int, int]]:
    """Kind, first pitch, pitches and frames of the FILTERS rectangles, spread over all by a rule."""
    return [(i % 6, (5 * i) % 7, (3, 4, 6)[i % 3] if (5 * i) % 7 < 6 else 3, (4, 8, WIDTH)[i // 6]) for i in range(FILTERS)]


def responses(c: np.ndarray) -> np.ndarray:
    """Filter responses (fingerprints x FILTERS) from sums of rectangles, each four reads of an integral image."""
    n = len(c) - WIDTH + 1
    if n < 1:
        return np.zeros((0, FILTERS))
    image = np.zeros((len(c) + 1, PITCHES + 1))
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[t + t1, y1] - image[t + t0, y1] - image[t + t1, y0] + image[t + t0, y0]

    out = np.empty((n, FILTERS))
    for k, (kind, y, h, w) in enumerate(filters()):
        whole, mid_t, mid_y = area(0, w, y, y + h), w // 2, y + h // 2
        if kind == 0:
            part = area(0, w, 0, PITCHES) - whole
        elif kind == 1:
            part = area(0, w, mid_y, y + h)
        elif kind == 2:
            part = area(mid_t, w, y, y + h)
        elif kind == 3:
            part = area(0, mid_t, mid_y, y + h) + area(mid_t, w, y, mid_y)
        elif kind == 4:
            part = area(0, w, y + h // 3, y + h - h // 3)
        else:
            part = area(w // 3, w - w // 3, y, y + h)
        rest = whole if kind == 0 else whole - part
        out[:, k] = np.log((1 + rest) / (1 + part))
    return out


def fingerprints(samples: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Packed unsigned 32-bit integers, one a frame: two Gray-coded bits of each response against its three cuts."""
    r = responses(chroma(samples))
    level = (r[:, :, None] > cuts[None]).sum(axis=2)
    gray = np.array([0, 1, 3, 2], np.uint64)[level]
    return (gray << (2 * np.arange(FILTERS, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).astype(np.uint32)


def _samples(column: pa.Array) -> list[np.ndarray]:
    return [np.nan_to_num(np.array([v or 0.0 for v in x.as_py() or ()], np.float64)) for x in column]


def fit_cuts(recordings: DataFrame) -> np.ndarray:
    """Quartiles of each filter's responses (FILTERS x 3): the median over all recordings (rec_id, samples) that have an id of theirs,
    to 1 / STEPS. Tasks count rounded quartiles, so what comes to the driver is bounded by their range, not by the recordings."""

    def run(batches):
        for b in batches:
            found = [responses(chroma(s)) for s in _samples(b.column(0))]
            q = [np.rint(np.quantile(r, (0.25, 0.5, 0.75), axis=0).T.ravel() * STEPS).astype(np.int64) for r in found if len(r)]
            cuts, n = np.unique([(k, v) for r in q for k, v in enumerate(r)] or np.zeros((0, 2), np.int64), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cuts[:, 0]), pa.array(cuts[:, 1]), pa.array(n)], names=["cut", "value", "n"])

    counts = recordings.where("rec_id is not null").select("samples").mapInArrow(run, "cut long, value long, n long").groupBy("cut", "value").agg(F.sum("n").alias("n"))
    out = np.zeros(FILTERS * 3)
    rows = np.array(sorted(tuple(r) for r in counts.collect()), np.int64).reshape(-1, 3)
    for k in np.unique(rows[:, 0]):
        value, upto = rows[rows[:, 0] == k, 1], np.cumsum(rows[rows[:, 0] == k, 2])
        middle = [value[np.searchsorted(upto, m, "right")] for m in ((upto[-1] - 1) // 2, upto[-1] // 2)]
        out[k] = sum(middle) / 2 / STEPS
    return out.reshape(FILTERS, 3)


def fingerprint(recordings: DataFrame, cuts: np.ndarray) -> DataFrame:
    """rec_id and prints (array of int, the packed bits) of each recording (rec_id, samples); too short and null ones have none.

    Null samples count as silence. Rows of one id, and of null ids, stay as they are; other columns are not read.
    """

    def run(batches):
        for b in batches:
            prints = [fingerprints(s, cuts).view(np.int32).tolist() for s in _samples(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.list_(pa.int32()))], names=["rec_id", "prints"])

    return recordings.select(F.col("rec_id").cast("long"), "samples").mapInArrow(run, "rec_id long, prints array<int>")


ALIGNED = "query_id long, rec_id long, offset int, n_hits int, overlap int, bit_errors double"


#: Pairs of equal fingerprints that are listed one by one; values that have more are counted by a product of spectra.
LISTED = 1 << 20


def offsets(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many i have x[i] = y[i + o], for each offset o from -len(x) on: len(x) + len(y) counts.

    Values that both have are met in sorted order. The pairs of one value are listed where they are few; of a sustained one,
    as silence gives, they are counted together as the correlation of where it stands in either.
    """
    shared, a, b = np.unique(x), np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    xs, ys = x[a], y[b]
    xa, xz = np.searchsorted(xs, shared), np.searchsorted(xs, shared, "right")
    ya, yz = np.searchsorted(ys, shared), np.searchsorted(ys, shared, "right")
    out = np.zeros(len(x) + len(y), np.int64)
    pairs = (xz - xa) * (yz - ya)
    size = 1 << int(len(x) + len(y)).bit_length()
    many = pairs > max(LISTED, 32 * size)
    for k in np.flatnonzero(many):
        u, v = np.zeros(size), np.zeros(size)
        u[len(x) - a[xa[k] : xz[k]]] = 1  # so that i and j meet at len(x) + j - i
        v[b[ya[k] : yz[k]]] = 1
        out += np.rint(np.fft.irfft(np.fft.rfft(u) * np.fft.rfft(v), size)[: len(out)]).astype(np.int64)
    for k in np.flatnonzero((pairs > 0) & ~many):
        i, j = a[xa[k] : xz[k]], b[ya[k] : yz[k]]
        for part in range(0, len(i), max(1, LISTED // len(j))):
            out += np.bincount((len(x) + j[None] - i[part : part + max(1, LISTED // len(j)), None]).ravel(), minlength=len(out))
    return out


def _align(batches):
    for b in batches:
        rows = []
        for q, r, x, y in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            x, y = (np.array(v, np.int32).view(np.uint32) for v in (x, y))
            counts = offsets(x, y)
            best = int(counts.argmax())
            if not counts[best]:
                continue
            offset = best - len(x)
            a, z = max(0, -offset), min(len(x), len(y) - offset)
            wrong = int(np.bitwise_count(x[a:z] ^ y[a + offset : z + offset]).sum())
            rows.append((q, r, offset, int(counts[best]), z - a, wrong / (32.0 * (z - a))))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query_id", "rec_id", "offset", "n_hits", "overlap", "bit_errors"])


def align(prints: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rec_id, offset, n_hits, overlap, bit_errors of the recordings that match a query other than themselves.

    An index of every fingerprint of every recording gives the pairs that share LEAST_HITS values or more, where a value counts
    as often as both have it: so many hits an offset can have at most. For these, the
    histogram of offsets between equal values gives the alignment (frames that rec_id lags), the smallest of equals, and the
    overlap its bit errors. Null ids and recordings without fingerprints match nothing. Of rows of one id the least fingerprints
    count. A value of many recordings, as silence gives, meets each query that has it once for each recording: as many rows as
    such matches have, in partitions that Spark splits.
    """
    once = lambda df: df.where("rec_id is not null and prints is not null").groupBy("rec_id").agg(F.min("prints").alias("prints"))
    values = lambda df, name, n: once(df).select(F.col("rec_id").alias(name), F.explode("prints").alias("value")).groupBy(name, "value").agg(F.count("*").alias(n))
    met = values(queries, "query_id", "_x").join(values(prints, "rec_id", "_y"), "value").where("query_id <> rec_id")
    pairs = met.groupBy("query_id", "rec_id").agg(F.sum(F.least("_x", "_y")).alias("_n")).where(F.col("_n") >= LEAST_HITS).drop("_n")
    full = pairs.join(once(queries).select(F.col("rec_id").alias("query_id"), F.col("prints").alias("x")), "query_id").join(once(prints).select("rec_id", F.col("prints").alias("y")), "rec_id")
    return full.select("query_id", "rec_id", "x", "y").mapInArrow(_align, ALIGNED).where((F.col("n_hits") >= LEAST_HITS) & (F.col("bit_errors") <= MOST_ERRORS))


def recordings_of(embeddings: DataFrame, vectors: int = 16) -> DataFrame:
    """Signals made of the embeddings: the values of `vectors` vectors of following ids, one behind the other.

    Null ids and vectors are left out; a vector id given twice gives its values twice.
    """
    rows = embeddings.where("vec_id is not null and embedding is not null").select(F.floor(F.col("vec_id") / vectors).cast("long").alias("rec_id"), F.struct("vec_id", "embedding").alias("v"))
    return rows.groupBy("rec_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["embedding"])).alias("samples"))


def op9_audio_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording whose id 50 divides, against all recordings; a recording's fingerprint count stands beside it."""
    recordings = recordings_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    prints = fingerprint(recordings, fit_cuts(recordings))
    queries = prints.where("rec_id % 50 = 0")
    own = prints.select("rec_id", F.size("prints").cast("long").alias("n_prints"), F.sha2(F.array_join(F.transform("prints", lambda p: F.hex(p)), ","), 256).alias("prints_sha256"))
    found = align(prints, queries)
    return own.join(found, "rec_id", "left").select("rec_id", "n_prints", "prints_sha256", "query_id", "offset", "n_hits", "overlap", "bit_errors")
