"""Tiles as npz archives, one a tile, named like it: a data source that reads parts of them, an atomic sink, a stream.

    npz.read_npz_tiles(spark, folder, members=["ndsm", "instance_labels"], tiles=["a", "b"], y=(0, 100))
    npz.write_npz_tiles(pixels, folder)
    npz.stream_npz_tiles(spark, folder, "tile string, y int, x int, ndsm float")

Rows are pixels (tile, y, x, a column for each member); members of three dimensions are arrays. Archives of tiles not asked for
are not opened, members not asked for not unpacked, rows and columns outside the window not given. Folders are those of pyarrow's
file systems; on a cluster, all machines must see them. Pickled members are refused.

What to read is said in options, not by pushFilters: Spark 4.1.2 keeps the reader that one query's filters went to for later
queries on the same DataFrame, so df.count() after df.where(...).count() loses rows. Filters in a query work, behind the scan.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType, _parse_datatype_string

from terrafold.model import RasterError

KEYS = ("tile", "y", "x")
#: Bytes of archives that a task reads.
GROUP = 32 << 20
#: Pixels of a batch.
BATCH = 1 << 16
TYPES = {"b1": "boolean", "i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "i8": "bigint", "f2": "float", "f4": "float", "f8": "double"}


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _archives(path: str) -> list[tuple[str, int]]:
    """Path and bytes of the archives in a folder (or of one archive), by name; names that begin with _ or . are no archives."""
    at, where = _files(path)
    info = at.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise RasterError(f"no folder {path}")
    found = [info] if info.is_file else at.get_file_info(fs.FileSelector(where))
    return sorted((f.path, f.size) for f in found if f.is_file and f.extension == "npz" and f.base_name[0] not in "_.")


def _tile(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".npz")


def _shape(raw, member: str) -> tuple[tuple[int, ...], np.dtype]:
    """Shape and element type of a member, from its header alone."""
    with zipfile.ZipFile(raw) as z, z.open(f"{member}.npy") as f:
        read = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(f)[0] == 1 else np.lib.format.read_array_header_2_0
        shape, _, dtype = read(f)
    return shape, dtype


def element_types(raw: bytes) -> dict[str, str]:
    """Spark types of the members of an archive that hold pixels, from their headers: wide enough for unsigned numbers."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = [n.removesuffix(".npy") for n in z.namelist() if n.endswith(".npy")]
    out = {}
    for n in names:
        shape, dtype = _shape(io.BytesIO(raw), n)
        kind = TYPES.get(dtype.str[1:])
        if kind and len(shape) in (2, 3):
            out[n] = kind if len(shape) == 2 else f"array<{kind}>"
    return out


@dataclass
class Window:
    """Tiles by name (None: all that begin with prefix), and first and last row and column to read."""

    tiles: set[str] | None = None
    prefix: str = ""
    y: tuple[int, int | None] = (0, None)
    x: tuple[int, int | None] = (0, None)

    @classmethod
    def of(cls, options: dict[str, str]) -> Window:
        """From the options tiles (a JSON array), prefix, and y and x (`first,end`, end exclusive or empty)."""

        def ends(name: str) -> tuple[int, int | None]:
            first, _, end = options.get(name, "0,").partition(",")
            return max(0, int(first or 0)), int(end) if end.strip() else None

        return cls(set(json.loads(options["tiles"])) if "tiles" in options else None, options.get("prefix", ""), ends("y"), ends("x"))

    def wants(self, tile: str) -> bool:
        return tile.startswith(self.prefix) and (self.tiles is None or tile in self.tiles)

    @staticmethod
    def cut(ends: tuple[int, int | None], size: int) -> tuple[int, int]:
        return ends[0], size if ends[1] is None else min(size, ends[1])


def _pixels(tile: str, raw, schema: pa.Schema, window: Window) -> Iterator[pa.RecordBatch]:
    """Batches of the pixels of one archive within window, some rows of the tile at a time; members of unlike sizes are refused."""
    with np.load(raw, allow_pickle=False) as archive:
        arrays = {n: archive[n] for n in schema.names if n not in KEYS}
    shapes = {a.shape[:2] for a in arrays.values()}
    if len(shapes) != 1 or any(a.ndim not in (2, 3) for a in arrays.values()):
        raise RasterError(f"{tile}: members must be rasters of one size, not {sorted(a.shape for a in arrays.values())}")
    h, w = shapes.pop()
    (y0, y1), (x0, x1) = window.cut(window.y, h), window.cut(window.x, w)
    if x0 >= x1:
        return
    step = max(1, BATCH // (x1 - x0))
    for top in range(y0, y1, step):
        rows = slice(top, min(y1, top + step))
        y, x = np.mgrid[rows, x0:x1]
        columns = {"tile": pa.array([tile], pa.string()).take(pa.array(np.zeros(y.size, np.int32))), "y": pa.array(y.ravel(), pa.int32()), "x": pa.array(x.ravel(), pa.int32())}
        for n, a in arrays.items():
            part, kind = a[rows, x0:x1], schema.field(n).type
            if pa.types.is_list(kind) != (a.ndim == 3):
                raise RasterError(f"{tile}: {n} has {a.ndim} dimensions, which is not {kind}")
            flat = pa.array(np.ascontiguousarray(part).ravel()).cast(kind.value_type if a.ndim == 3 else kind)
            columns[n] = pa.ListArray.from_arrays(pa.array(np.arange(y.size + 1, dtype=np.int32) * a.shape[2]), flat).cast(kind) if a.ndim == 3 else flat
        yield pa.RecordBatch.from_arrays([columns[n] for n in schema.names], schema=schema)


@dataclass
class Group(InputPartition):
    """Archives of one task."""

    paths: list[str]


class NpzReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.path, self.group = to_arrow_schema(schema), options["path"], int(options.get("groupbytes", GROUP))
        self.window = Window.of(options)

    def partitions(self) -> list[Group]:
        """Archives of the tiles asked for, by name, as many a task as the group's bytes hold (at least one)."""
        groups, held = [], 0
        for path, size in _archives(self.path):
            if not self.window.wants(_tile(path)):
                continue
            if not groups or held + size > self.group:
                groups.append(Group([]))
                held = 0
            groups[-1].paths.append(path)
            held += size
        return groups or [Group([])]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        at, _ = _files(self.path)
        for path in partition.paths:
            with at.open_input_file(path) as raw:
                yield from _pixels(_tile(path), raw, self.schema, self.window)


@dataclass
class Written(WriterCommitMessage):
    """Folder of a task's attempt, and the tiles in it."""

    folder: str
    tiles: list[str]


class NpzWriter(DataSourceArrowWriter):
    """Archives go to a folder of the attempt; the commit moves those of the attempts that count, an abort leaves nothing."""

    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool) -> None:
        missing = [k for k in KEYS if k not in schema.names]
        if missing:
            raise RasterError(f"npz tiles need the columns {missing}")
        self.path, self.overwrite = options["path"], overwrite
        self.stage = f"_writing-{uuid.uuid4().hex}"

    def _where(self, *parts: str) -> tuple[fs.FileSystem, str]:
        at, where = _files(self.path)
        return at, "/".join([where.rstrip("/"), *parts])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        at, folder = self._where(self.stage, uuid.uuid4().hex)
        at.create_dir(folder, recursive=True)
        tiles, current, held = [], None, []

        def close() -> None:
            if held:
                if current in tiles:
                    raise RasterError(f"rows of tile {current} do not come together")
                packed = _archive(current, pa.Table.from_batches(held))
                with at.open_output_stream(f"{folder}/{current}.npz") as out:
                    out.write(packed)
                tiles.append(current)

        for batch in iterator:
            names = batch.column("tile")
            if names.null_count or pa.compute.any(pa.compute.or_(batch.column("y").is_null(), batch.column("x").is_null())).as_py():
                raise RasterError("a pixel needs tile, y and x")
            start = 0
            while start < len(names):
                name = names[start].as_py()
                same = pa.compute.equal(names.slice(start), name).to_numpy(zero_copy_only=False)
                n = len(same) if same.all() else int(same.argmin())
                if name != current:
                    close()
                    current, held = name, []
                held.append(batch.slice(start, n))
                start += n
        close()
        return Written(folder, tiles)

    def commit(self, messages: list[Written | None]) -> None:
        at, where = self._where()
        done = [m for m in messages if m is not None]
        names = [t for m in done for t in m.tiles]
        try:
            if len(set(names)) < len(names):
                raise RasterError(f"tiles in two tasks: {sorted({t for t in names if names.count(t) > 1})[:5]}")
            at.create_dir(where, recursive=True)
            old = [p for p, _ in _archives(self.path)] if self.overwrite else []
            for m in done:
                for t in m.tiles:
                    at.move(f"{m.folder}/{t}.npz", f"{where}/{t}.npz")
            for p in old:
                if _tile(p) not in names:
                    at.delete_file(p)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        at, folder = self._where(self.stage)
        if at.get_file_info(folder).type != fs.FileType.NotFound:
            at.delete_dir(folder)


def _archive(tile: str, table: pa.Table) -> bytes:
    """The archive of one tile's pixels, 0 where it has none."""
    if not tile or tile[0] in "_." or "/" in tile:
        raise RasterError(f"{tile!r} names no file")
    y, x = (table.column(c).to_numpy() for c in ("y", "x"))
    if y.min() < 0 or x.min() < 0:
        raise RasterError(f"tile {tile} has pixels before 0")
    arrays = {}
    for n in table.column_names:
        if n in KEYS:
            continue
        c = table.column(n).combine_chunks()
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        if pa.types.is_list(c.type):
            sizes = set(pa.compute.list_value_length(c).to_pylist())
            if len(sizes) != 1 or None in sizes:
                raise RasterError(f"tile {tile}: arrays of {n} are not of one size")
            values = c.flatten().fill_null(0).to_numpy(zero_copy_only=False).reshape(len(c), -1)
        else:
            values = c.fill_null(0).to_numpy(zero_copy_only=False)
        a = np.zeros((int(y.max()) + 1, int(x.max()) + 1, *values.shape[1:]), values.dtype)
        a[y, x] = values
        arrays[n] = a
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


class NpzTiles(DataSource):
    """Options: path; members (all rasters of the first archive where not given); tiles, prefix, y, x (see Window); groupBytes,
    archives' bytes a task."""

    @classmethod
    def name(cls) -> str:
        return "npz_tiles"

    def schema(self) -> str:
        found = _archives(self.options["path"])
        if not found:
            raise RasterError(f"no archive in {self.options['path']} to tell the columns: give a schema")
        at, _ = _files(self.options["path"])
        with at.open_input_file(found[0][0]) as raw:
            types = element_types(raw.read())
        asked = self.options.get("members")
        names = [m.strip() for m in asked.split(",")] if asked else list(types)
        lost = [n for n in names if n not in types]
        if lost:
            raise RasterError(f"{found[0][0]} has no rasters {lost}")
        return ", ".join(["tile string", "y int", "x int", *[f"`{n}` {types[n]}" for n in names]])

    def reader(self, schema: StructType) -> NpzReader:
        return NpzReader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """The source npz_tiles in a session."""
    spark.dataSource.register(NpzTiles)


def read_npz_tiles(spark: SparkSession, path: str, members: list[str] | None = None, tiles: list[str] | None = None, prefix: str = "", y: tuple[int, int | None] = (0, None), x: tuple[int, int | None] = (0, None), group: int = GROUP) -> DataFrame:
    """Pixels of the archives in path: of tiles (None: all that begin with prefix), of rows y and columns x (first, end; None: to the
    last). A table of tile names too long to be listed is joined behind the scan instead."""
    register(spark)
    ends = lambda e: f"{e[0]},{'' if e[1] is None else e[1]}"
    options = {"prefix": prefix, "y": ends(y), "x": ends(x), "groupBytes": str(group)}
    if members is not None:
        options["members"] = ",".join(members)
    if tiles is not None:
        options["tiles"] = json.dumps(tiles)
    return spark.read.format("npz_tiles").options(**options).load(path)


def write_npz_tiles(pixels: DataFrame, path: str, mode: str = "append") -> None:
    """pixels (tile, y, x, members) as one archive a tile; a tile's rows meet in one task, which holds one tile at a time. Archives
    of the same names are replaced, with mode overwrite all others go. Nothing is seen before all tasks are done."""
    register(pixels.sparkSession)
    pixels.repartition("tile").sortWithinPartitions("tile").write.format("npz_tiles").mode(mode).save(path)


def _decoder(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0), b.column(1), strict=True):
                yield from _pixels(_tile(unquote(path.as_py())), io.BytesIO(raw.as_buffer()), schema, Window())

    return run


def stream_npz_tiles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the pixels (tile, y, x and members, as schema says) of archives as they arrive. Spark's file stream keeps which
    archives it has read in the query's checkpoint, so a query that starts again reads none twice."""
    kind = _parse_datatype_string(schema)
    if not isinstance(kind, StructType) or any(isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, ArrayType) for f in kind):
        raise RasterError(f"{schema} are no pixels")
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "[!_.]*.npz").load(path)
    return raw.select(F.col("path"), F.col("content")).mapInArrow(_decoder(to_arrow_schema(kind)), kind)
