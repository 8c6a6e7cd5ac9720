"""Rasters in files as tables of pixels: a data source "raster" that reads and writes them.

A raster is a folder: GeoTIFF files of ``block_rows`` rows each (bands apart, strips deflated),
``raster.json``, which lists the files that belong to it with the raster's geometry, and
``mosaic.vrt``, by which other programs see the files as one raster. As a table it has row, col,
band (from 1) and value; pixels without data have no row.

Reading: a partition is a block of one file and one band. Ranges of rows and lists of bands
come from options or from filters on ``row`` and ``band`` (where Spark hands filters to Python
sources); blocks and bands outside them are never opened, of the others only the strips wanted
are read, and filters are evaluated again by Spark.

Writing: each task writes whole blocks under names of its own and reports them; the driver then
publishes ``raster.json`` in one step, so a lost task or job leaves no raster that is half
there, and deletes what a failed job has written. Blocks stream through a task in order, one
in memory at a time.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "row int, col int, band int, value double"
MANIFEST, MOSAIC = "raster.json", "mosaic.vrt"
STRIP_ROWS = 16

#: Fixed values of the file format: numbers of tags, and of sample formats by kind of number.
_WIDTH, _LENGTH, _BITS, _COMPRESSION, _PHOTOMETRIC, _OFFSETS, _SAMPLES, _ROWS_PER_STRIP, _COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
_PLANAR, _SAMPLE_FORMAT, _PIXEL_SCALE, _TIEPOINT, _METADATA, _NODATA = 284, 339, 33550, 33922, 42112, 42113
_FORMATS = {"u": 1, "i": 2, "f": 3}
_FIELD_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 12: "d", 16: "Q"}
_VRT_TYPES = {"uint8": "Byte", "int16": "Int16", "uint16": "UInt16", "int32": "Int32", "uint32": "UInt32", "float32": "Float32", "float64": "Float64"}


@dataclass
class Raster:
    """What ``raster.json`` holds. ``files`` has (first row, rows, name) of each block."""

    rows: int
    cols: int
    bands: int
    x_min: float
    y_max: float
    cell_size: float
    dtype: str = "float64"
    nodata: float = -32768.0
    block_rows: int = 256
    scalar: float = 1.0
    files: list[tuple[int, int, str]] = field(default_factory=list)


# --- one file -----------------------------------------------------------------------------


def encode_tiff(values: np.ndarray, raster: Raster, first_row: int) -> bytes:
    """A file of ``values`` (bands, rows, cols), which begin at ``first_row`` of the raster."""
    bands, rows, cols = values.shape
    strips = [zlib.compress(np.ascontiguousarray(b[r : r + STRIP_ROWS]).astype(f"<{values.dtype.str[1:]}").tobytes(), 6) for b in values for r in range(0, rows, STRIP_ROWS)]
    offsets = 8 + np.cumsum([0, *map(len, strips)])
    meta = f'<GDALMetadata><Item name="SCALAR">{raster.scalar!r}</Item></GDALMetadata>'
    tags: list[tuple[int, int, Sequence | bytes]] = [
        (_WIDTH, 4, [cols]), (_LENGTH, 4, [rows]), (_BITS, 3, [8 * values.itemsize] * bands), (_COMPRESSION, 3, [8]), (_PHOTOMETRIC, 3, [1]), (_OFFSETS, 4, offsets[:-1].tolist()),
        (_SAMPLES, 3, [bands]), (_ROWS_PER_STRIP, 4, [STRIP_ROWS]), (_COUNTS, 4, [len(s) for s in strips]), (_PLANAR, 3, [2]), (_SAMPLE_FORMAT, 3, [_FORMATS[values.dtype.kind]] * bands),
        (_PIXEL_SCALE, 12, [raster.cell_size, raster.cell_size, 0.0]), (_TIEPOINT, 12, [0.0, 0.0, 0.0, raster.x_min, raster.y_max - first_row * raster.cell_size, 0.0]),
        (_METADATA, 2, meta.encode() + b"\0"), (_NODATA, 2, f"{raster.nodata:.17g}".encode() + b"\0"),
    ]
    at = int(offsets[-1]) + int(offsets[-1]) % 2
    extra_at, entries, extra = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind, content in tags:
        raw = content if isinstance(content, bytes) else struct.pack(f"<{len(content)}{_FIELD_TYPES[kind]}", *content)
        if len(raw) <= 4:
            place = raw.ljust(4, b"\0")
        else:
            place = struct.pack("<I", extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        entries += struct.pack("<HHI", tag, kind, len(content)) + place
    body = b"".join(strips)
    return b"II*\0" + struct.pack("<I", at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra


def _tags(file) -> dict[int, list]:
    file.seek(0)
    head = file.read(8)
    if head[:4] != b"II*\0":
        raise ValueError("not a little-endian TIFF file")
    file.seek(struct.unpack("<I", head[4:])[0])
    (n,) = struct.unpack("<H", file.read(2))
    entries, out = file.read(12 * n), {}
    for k in range(n):
        tag, kind, count = struct.unpack("<HHI", entries[12 * k : 12 * k + 8])
        if kind not in _FIELD_TYPES:
            continue
        form = f"<{count}{_FIELD_TYPES[kind]}"
        raw = entries[12 * k + 8 : 12 * k + 12]
        if struct.calcsize(form) > 4:
            file.seek(struct.unpack("<I", raw)[0])
            raw = file.read(struct.calcsize(form))
        out[tag] = list(struct.unpack(form, raw[: struct.calcsize(form)]))
    return out


def decode_tiff(file, band: int, begin: int, end: int) -> np.ndarray:
    """Rows ``begin`` to ``end`` (of the file) of one band; reads the strips that hold them.
    Files have bands apart and are stored plain or deflated."""
    tags = _tags(file)
    if tags[_COMPRESSION][0] not in (1, 8, 32946) or (tags.get(_SAMPLES, [1])[0] > 1 and tags.get(_PLANAR, [1])[0] != 2):
        raise ValueError("only plain or deflated files with bands apart can be read")
    kind = {v: k for k, v in _FORMATS.items()}[tags.get(_SAMPLE_FORMAT, [1])[0]]
    dtype = np.dtype(f"<{kind}{tags[_BITS][0] // 8}")
    cols, rows = tags[_WIDTH][0], tags[_LENGTH][0]
    per = min(tags.get(_ROWS_PER_STRIP, [rows])[0], rows)
    strips = -(-rows // per)
    out = []
    for s in range(begin // per, -(-end // per)):
        k = (band - 1) * strips + s
        file.seek(tags[_OFFSETS][k])
        raw = file.read(tags[_COUNTS][k])
        part = np.frombuffer(raw if tags[_COMPRESSION][0] == 1 else zlib.decompress(raw), dtype).reshape(-1, cols)
        out.append(part[max(0, begin - s * per) : end - s * per])
    return np.concatenate(out)


def mosaic(raster: Raster) -> str:
    """The description by which other programs see the files as one raster."""
    kind = _VRT_TYPES[raster.dtype]
    bands = []
    for b in range(1, raster.bands + 1):
        sources = "".join(
            f'<SimpleSource><SourceFilename relativeToVRT="1">{name}</SourceFilename><SourceBand>{b}</SourceBand><SrcRect xOff="0" yOff="0" xSize="{raster.cols}" ySize="{rows}"/>'
            f'<DstRect xOff="0" yOff="{first}" xSize="{raster.cols}" ySize="{rows}"/></SimpleSource>'
            for first, rows, name in raster.files
        )
        bands.append(f'<VRTRasterBand dataType="{kind}" band="{b}"><NoDataValue>{raster.nodata:.17g}</NoDataValue>{sources}</VRTRasterBand>')
    place = f"{raster.x_min!r}, {raster.cell_size!r}, 0.0, {raster.y_max!r}, 0.0, {-raster.cell_size!r}"
    return f'<VRTDataset rasterXSize="{raster.cols}" rasterYSize="{raster.rows}"><GeoTransform>{place}</GeoTransform>{"".join(bands)}</VRTDataset>\n'


# --- folders ------------------------------------------------------------------------------


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pyarrow.fs.LocalFileSystem(), path


def describe(path: str) -> Raster:
    """Geometry, scale factor and files of a raster."""
    store, own = _store(path)
    with store.open_input_stream(f"{own}/{MANIFEST}") as f:
        found = json.loads(f.read())
    return Raster(**(found | {"files": [tuple(x) for x in found["files"]]}))


@dataclass
class Block(InputPartition):
    name: str
    first_row: int
    begin: int
    end: int
    band: int


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.raster = options["path"], describe(options["path"])
        span = options.get("rows", "").split(":")
        self.begin = int(span[0]) if span[0] else 0
        self.end = int(span[1]) if len(span) > 1 and span[1] else self.raster.rows
        self.bands = {int(x) for x in options["bands"].split(",")} if options.get("bands") else set(range(1, self.raster.bands + 1))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("row",):
                if isinstance(f, EqualTo):
                    self.begin, self.end = max(self.begin, f.value), min(self.end, f.value + 1)
                elif isinstance(f, In):
                    self.begin, self.end = max(self.begin, min(f.value)), min(self.end, max(f.value) + 1)
                elif isinstance(f, GreaterThan):
                    self.begin = max(self.begin, f.value + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    self.begin = max(self.begin, f.value)
                elif isinstance(f, LessThan):
                    self.end = min(self.end, f.value)
                elif isinstance(f, LessThanOrEqual):
                    self.end = min(self.end, f.value + 1)
            elif name == ("band",) and isinstance(f, (EqualTo, In)):
                self.bands &= {f.value} if isinstance(f, EqualTo) else set(f.value)
            yield f  # Spark evaluates them as well

    def partitions(self) -> list[Block]:
        out = []
        for first, rows, name in self.raster.files:
            begin, end = max(first, self.begin), min(first + rows, self.end)
            if begin < end:
                out += [Block(name, first, begin - first, end - first, b) for b in sorted(self.bands)]
        return out or [Block("", 0, 0, 0, 0)]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        if not block.name:
            return
        store, own = _store(self.path)
        with store.open_input_file(f"{own}/{block.name}") as f:
            values = decode_tiff(f, block.band, block.begin, block.end)
        for at in range(0, len(values), STRIP_ROWS):
            part = values[at : at + STRIP_ROWS].astype(np.float64)
            r, c = np.nonzero((part != self.raster.nodata) & ~np.isnan(part))
            row = (r + at + block.first_row + block.begin).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(c.astype(np.int32)), pa.array(np.full(len(r), block.band, np.int32)), pa.array(part[r, c])], names=["row", "col", "band", "value"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, int, str]]


class RasterWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        kinds = {"rows": int, "cols": int, "bands": int, "x_min": float, "y_max": float, "cell_size": float, "dtype": str, "nodata": float, "block_rows": int, "scalar": float}
        self.raster = Raster(**{k: kind(options[k]) for k, kind in kinds.items() if k in options})
        if self.raster.dtype not in _VRT_TYPES:
            raise ValueError(f"unknown kind of numbers {self.raster.dtype}")
        if not overwrite:
            store, own = _store(self.path)
            if store.get_file_info(f"{own}/{MANIFEST}").type != pyarrow.fs.FileType.NotFound:
                raise ValueError(f"there is a raster in {self.path}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        raster, now, values, done = self.raster, None, None, []

        def flush() -> None:
            if now is not None:
                done.append(self._write_block(now, values))

        for batch in batches:
            row, col, band, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "col", "band", "value"))
            inside = (row >= 0) & (row < raster.rows) & (col >= 0) & (col < raster.cols) & (band >= 1) & (band <= raster.bands)
            if not inside.all():
                raise ValueError("a pixel lies outside the raster")
            number = row // raster.block_rows
            for b in np.unique(number):
                if b != now:
                    flush()
                    now = b
                    values = np.full((raster.bands, min(raster.block_rows, raster.rows - b * raster.block_rows), raster.cols), raster.nodata, dtype=raster.dtype)
                own = number == b
                known = own & ~np.isnan(value.astype(np.float64))
                values[band[known] - 1, row[known] - b * raster.block_rows, col[known]] = value[known]
        flush()
        return Written(done)

    def _write_block(self, number: int, values: np.ndarray) -> tuple[int, int, str]:
        store, own = _store(self.path)
        store.create_dir(own, recursive=True)
        first, name = int(number) * self.raster.block_rows, f"block-{int(number):06d}-{uuid.uuid4().hex}.tif"
        with store.open_output_stream(f"{own}/{name}") as f:
            f.write(encode_tiff(values, self.raster, first))
        return first, values.shape[1], name

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted(x for m in messages if m is not None for x in m.files)
        if any(a[0] == b[0] for a, b in zip(files, files[1:])):
            self.abort(messages)
            raise ValueError("rows of one block came from two tasks; use write_raster")
        store, own = _store(self.path)
        store.create_dir(own, recursive=True)
        before = []
        if self.overwrite and store.get_file_info(f"{own}/{MANIFEST}").type != pyarrow.fs.FileType.NotFound:
            before = [name for _, _, name in describe(self.path).files]
        self.raster.files = files
        for name, content in ((MOSAIC, mosaic(self.raster)), (f"{MANIFEST}.new", json.dumps(asdict(self.raster)))):
            with store.open_output_stream(f"{own}/{name}") as f:
                f.write(content.encode())
        store.move(f"{own}/{MANIFEST}.new", f"{own}/{MANIFEST}")  # from here on it is the raster
        for name in before:
            store.delete_file(f"{own}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, own = _store(self.path)
        for m in messages:
            for _, _, name in m.files if m is not None else ():
                store.delete_file(f"{own}/{name}")


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make format "raster" known, and have Spark hand filters to it."""
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_raster(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, bands: Sequence[int] | None = None) -> DataFrame:
    """row, col, band, value of a raster; of rows from the first up to the second, if given."""
    register(spark)
    own = spark.read.format("raster").option("path", path)
    if rows is not None:
        own = own.option("rows", f"{rows[0]}:{rows[1]}")
    if bands is not None:
        own = own.option("bands", ",".join(map(str, bands)))
    return own.load()


def write_raster(pixels: DataFrame, path: str, raster: Raster, overwrite: bool = False) -> None:
    """Write row, col, value (and band, else 1) as a raster of the given geometry. Each block
    of rows is one task's. Pixels that are missing, null or NaN have no data; of several rows
    for one pixel the greatest value is kept; pixels outside the raster raise."""
    register(pixels.sparkSession)
    band = F.col("band").cast("int") if "band" in pixels.columns else F.lit(1)
    own = pixels.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), band.alias("band"), F.col("value").cast("double").alias("value"))
    block = F.floor(F.col("row") / raster.block_rows)
    placed = own.where(F.col("value").isNotNull()).withColumn("_block", block).repartition("_block").sortWithinPartitions("_block", "value").drop("_block")
    options = {k: str(v) for k, v in asdict(raster).items() if k != "files"}
    placed.write.format("raster").mode("overwrite" if overwrite else "append").options(path=path, **options).save()
