"""Binary formats as Spark data sources whose tasks read byte ranges: OSM PBF by blobs,
Shapefiles by records, GeoTIFF by strips or tiles.

The driver reads headers only: where blobs, records and strips lie.  Tasks open the file
again, by any path that Arrow's file systems know, read their ranges and yield Arrow
batches.  A range that is read twice, after an executor is lost, gives the same rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.functions import crs

#: Bytes that a task reads, about.
TASK_BYTES = 16 << 20
#: Rows of a batch.
BATCH = 4096


def files_of(path: str, *suffixes: str) -> list[str]:
    """The files at a path with one of these endings, in order; of a folder those in it."""
    system, at = fs.FileSystem.from_uri(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.Directory:
        found = sorted(f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file)
        found = [f for f in found if f.lower().endswith(suffixes)]
    else:
        found = [at] if info.is_file else []
    if not found:
        raise FileNotFoundError(f"no {' or '.join(suffixes)} at {path}")
    return found


@dataclass
class Range(InputPartition):
    """Part of a file: what it covers is for its reader to know."""

    file: str
    parts: list

    def __post_init__(self) -> None:
        super().__init__(self.file)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.options = options
        self.system = None

    def open(self, file: str):
        return fs.FileSystem.from_uri(self.path)[0].open_input_file(file)


# ------------------------------------------------------------------------------- OSM PBF
def _varint(b: bytes, i: int) -> tuple[int, int]:
    shift = out = 0
    while True:
        x = b[i]
        out |= (x & 0x7F) << shift
        i += 1
        if x < 0x80:
            return out, i
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: integers, or bytes of what has a length."""
    i, n = 0, len(b)
    while i < n:
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            size, i = _varint(b, i)
            if i + size > n:
                raise ValueError("a field is longer than its message")
            value, i = b[i : i + size], i + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, i = b[i : i + size], i + size
        else:
            raise ValueError(f"fields of kind {kind} are unknown")
        yield key >> 3, value


def packed(b: bytes) -> np.ndarray:
    """The integers of a packed field, as unsigned 64 bits."""
    x = np.frombuffer(b, np.uint8)
    if not len(x):
        return np.empty(0, np.uint64)
    last = x < 0x80
    if not last[-1]:
        raise ValueError("a packed field breaks off")
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    with np.errstate(over="ignore"):
        return np.add.reduceat((x & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def zigzag(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(1)) ^ (np.uint64(0) - (x & np.uint64(1)))).view(np.int64)


def _signed(x: int) -> int:
    return (x >> 1) ^ -(x & 1)


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blob(b: bytes) -> bytes:
    raw, size, data = None, None, None
    for k, v in fields(b):
        if k == 1:
            raw = v
        elif k == 2:
            size = v
        elif k == 3:
            data = v
    if raw is None and data is None:
        raise ValueError("only blobs that are raw or zlib are known")
    raw = zlib.decompress(data) if raw is None else raw
    if size is not None and size != len(raw):
        raise ValueError("a blob has another size than it says")
    return raw


#: What a reader of this format has to know.
KNOWN_FEATURES = {"OsmSchema-V0.6", "DenseNodes"}
OSM_SCHEMA = "kind string, id bigint, lon double, lat double, refs array<bigint>, members array<struct<_type:string,_ref:bigint,_role:string>>, tags map<string,string>"
_OSM_ARROW = pa.schema(
    [("kind", pa.string()), ("id", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), ("refs", pa.list_(pa.int64())), ("members", pa.list_(pa.struct([("_type", pa.string()), ("_ref", pa.int64()), ("_role", pa.string())]))), ("tags", pa.map_(pa.string(), pa.string()))]
)
MEMBER_KINDS = ("node", "way", "relation")


def elements(block: bytes, kinds: set[str]) -> Iterator[tuple]:
    """(kind, id, lon, lat, refs, members, tags) of the elements of a primitive block."""
    strings, groups, step, lat0, lon0 = [], [], 100, 0, 0
    for k, v in fields(block):
        if k == 1:
            strings = [s.decode() for n, s in fields(v) if n == 1]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            step = v
        elif k == 19:
            lat0 = _long(v)
        elif k == 20:
            lon0 = _long(v)
    degrees = lambda x, zero: 1e-9 * (zero + step * x)

    def tagged(keys: bytes, values: bytes) -> list[tuple[str, str]]:
        return [(strings[a], strings[b]) for a, b in zip(packed(keys).tolist(), packed(values).tolist(), strict=True)]

    for group in groups:
        for k, v in fields(group):
            if k == 1 and "node" in kinds:
                f = dict(fields(v))
                yield "node", _signed(f[1]), degrees(_signed(f[9]), lon0), degrees(_signed(f[8]), lat0), None, None, tagged(f.get(2, b""), f.get(3, b""))
            elif k == 2 and "node" in kinds:
                f = dict(fields(v))
                ids, lats, lons = (np.cumsum(zigzag(packed(f.get(n, b"")))) for n in (1, 8, 9))
                said = packed(f.get(10, b"")).tolist()
                at = 0
                for i, lon, lat in zip(ids.tolist(), degrees(lons, lon0).tolist(), degrees(lats, lat0).tolist(), strict=True):
                    tags = []
                    while at < len(said) and said[at]:
                        tags.append((strings[said[at]], strings[said[at + 1]]))
                        at += 2
                    at += 1
                    yield "node", i, lon, lat, None, None, tags
            elif k == 3 and "way" in kinds:
                f = dict(fields(v))
                yield "way", _long(f[1]), None, None, np.cumsum(zigzag(packed(f.get(8, b"")))).tolist(), None, tagged(f.get(2, b""), f.get(3, b""))
            elif k == 4 and "relation" in kinds:
                f = dict(fields(v))
                ids = np.cumsum(zigzag(packed(f.get(9, b"")))).tolist()
                members = [{"_type": MEMBER_KINDS[t], "_ref": i, "_role": strings[r]} for i, r, t in zip(ids, packed(f.get(8, b"")).tolist(), packed(f.get(10, b"")).tolist(), strict=True)]
                yield "relation", _long(f[1]), None, None, None, members, tagged(f.get(2, b""), f.get(3, b""))


class _PbfReader(_Reader):
    def partitions(self) -> list[Range]:
        out = []
        for file in files_of(self.path, ".pbf"):
            held, size = [], 0
            with self.open(file) as f:
                end = f.size()
                while f.tell() < end:
                    head = f.read(4)
                    if len(head) < 4:
                        raise ValueError(f"{file} breaks off in a blob's head")
                    header = dict(fields(f.read(struct.unpack(">I", head)[0])))
                    kind, length, at = header[1].decode(), header[3], f.tell()
                    if at + length > end:
                        raise ValueError(f"{file} breaks off in a blob")
                    if kind == "OSMHeader":
                        unknown = {v.decode() for k, v in fields(_blob(f.read(length))) if k == 4} - KNOWN_FEATURES
                        if unknown:
                            raise ValueError(f"{file} asks for {', '.join(sorted(unknown))}")
                    elif kind == "OSMData":
                        held.append((at, length))
                        size += length
                        if size >= int(self.options.get("taskbytes", TASK_BYTES)):
                            out.append(Range(file, held))
                            held, size = [], 0
                    f.seek(at + length)
            if held:
                out.append(Range(file, held))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kinds = set(self.options.get("kinds", "node,way,relation").split(","))
        with self.open(partition.file) as f:
            for at, length in partition.parts:
                f.seek(at)
                rows = list(elements(_blob(f.read(length)), kinds))
                for k in range(0, len(rows), BATCH):
                    columns = list(zip(*rows[k : k + BATCH]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _OSM_ARROW)], schema=_OSM_ARROW)


class OsmPbf(DataSource):
    """Options: path; kinds, of node,way,relation; taskbytes."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return OSM_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _PbfReader(self.options)


def read_osm_pbf(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relations) of OSM PBF files, as networks.read_osm() gives them of XML."""
    spark.dataSource.register(OsmPbf)
    scan = lambda kind: spark.read.format("osm_pbf").option("kinds", kind).option("taskbytes", task_bytes).load(path)
    return scan("node").select("id", "lon", "lat", "tags"), scan("way").select("id", "refs", "tags"), scan("relation").select("id", "members", "tags")


# ------------------------------------------------------------------------------- Shapefile
SHAPE_SCHEMA = "path string, pos bigint, kind string, parts array<array<struct<x:double,y:double,z:double>>>, p map<string,string>, n map<string,double>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])
_SHAPE_ARROW = pa.schema([("path", pa.string()), ("pos", pa.int64()), ("kind", pa.string()), ("parts", pa.list_(pa.list_(_POINT))), ("p", pa.map_(pa.string(), pa.string())), ("n", pa.map_(pa.string(), pa.float64()))])
#: Kinds of shapes by their number, the number's tens being dimensions.
SHAPES = {0: None, 1: "point", 3: "line", 5: "polygon", 8: "points"}


def shape(content: bytes) -> tuple[str | None, list[list[tuple[float, float, float | None]]]]:
    """(kind, parts) of a record's content; a polygon's parts are its outer rings, which run
    clockwise."""
    number = struct.unpack_from("<i", content)[0]
    kind, deep = SHAPES.get(number % 10, "unknown"), 10 < number < 20
    if kind == "unknown" or number > 28:
        raise ValueError(f"shapes of kind {number} are unknown")
    if kind is None:
        return None, []
    if kind == "point":
        x, y, *z = struct.unpack_from("<3d" if deep else "<2d", content, 4)
        return kind, [[(x, y, z[0] if z else None)]]
    if kind == "points":
        n, at, starts = struct.unpack_from("<i", content, 36)[0], 40, [0]
    else:
        k, n = struct.unpack_from("<2i", content, 36)
        starts, at = list(struct.unpack_from(f"<{k}i", content, 44)), 44 + 4 * k
    xy = np.frombuffer(content, "<f8", 2 * n, at).reshape(n, 2).tolist()
    zs = np.frombuffer(content, "<f8", n, at + 16 * n + 16).tolist() if deep else [None] * n
    points = [(x, y, z) for (x, y), z in zip(xy, zs)]
    parts = [points[a:b] for a, b in zip(starts, [*starts[1:], n])]
    if kind == "polygon":
        area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1]))
        parts = [r for r in parts if area(r) <= 0]
    return kind, parts


@dataclass
class Table:
    """What the head of a DBF says: rows, bytes before the first, bytes of a row, and
    (name, type, place, length) of the fields."""

    rows: int
    head: int
    width: int
    columns: list[tuple[str, str, int, int]]


def dbf_head(b: bytes) -> Table:
    rows, head, width = struct.unpack_from("<IHH", b, 4)
    columns, at, place = [], 32, 1
    while at < head - 1 and b[at] != 0x0D:
        name = b[at : at + 11].split(b"\0")[0].decode("utf-8", "replace").strip()
        columns.append((name.lower(), chr(b[at + 11]), place, b[at + 16]))
        place += b[at + 16]
        at += 32
    return Table(rows, head, width, columns)


def dbf_row(row: bytes, table: Table) -> tuple[list[tuple[str, str]], list[tuple[str, float]]]:
    """(texts, numbers) of a row, without blank ones; truths are numbers 1 and 0.  Memos, which
    lie in another file, are left out."""
    texts, numbers = {}, {}
    for name, kind, at, n in table.columns:
        raw = row[at : at + n]
        if kind in "CDV":
            if s := raw.decode("utf-8", "replace").strip(" \0"):
                texts.setdefault(name, s)
        elif kind in "NF":
            try:
                numbers.setdefault(name, float(raw.strip(b" \0*") or b"x"))
            except ValueError:
                pass
        elif kind == "L":
            if raw[:1] in b"TtYyFfNn":
                numbers.setdefault(name, float(raw[:1] in b"TtYy"))
        elif kind in "IBOY" and n >= 4:
            value = struct.unpack("<i", raw[:4])[0] if kind == "I" else struct.unpack("<q", raw[:8])[0] / 1e4 if kind == "Y" else struct.unpack("<d", raw[:8])[0]
            numbers.setdefault(name, float(value))
    return list(texts.items()), list(numbers.items())


class _ShapeReader(_Reader):
    def partitions(self) -> list[Range]:
        out, most = [], int(self.options.get("taskbytes", TASK_BYTES))
        for file in files_of(self.path, ".shp"):
            stem = file[:-4]
            with self.open(stem + ".shx") as x, self.open(file) as f:
                n, size = (x.size() - 100) // 8, f.size()
            step = max(1, n * most // max(size, 1))
            out += [Range(file, [k, min(n, k + step)]) for k in range(0, n, step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        first, stop = partition.parts
        stem = partition.file[:-4]
        with self.open(stem + ".shx") as x, self.open(partition.file) as f, self.open(stem + ".dbf") as d:
            x.seek(100 + 8 * first)
            places = np.frombuffer(x.read(8 * (stop - first)), ">i4").reshape(-1, 2).astype(np.int64) * 2
            table = dbf_head(d.read(32) + d.read(32 * 256))
            for k in range(first, stop, BATCH):
                d.seek(table.head + table.width * k)
                block = d.read(table.width * min(BATCH, stop - k))
                rows = []
                for j, (at, length) in enumerate(places[k - first : k - first + BATCH].tolist()):
                    f.seek(at + 8)
                    row = block[j * table.width : (j + 1) * table.width]
                    if len(row) < table.width:
                        raise ValueError(f"{stem}.dbf has fewer rows than {partition.file} has shapes")
                    if row[:1] == b"*":
                        continue
                    kind, parts = shape(f.read(length))
                    rows.append((partition.file, k + j, kind, [[dict(zip("xyz", p)) for p in part] for part in parts], *dbf_row(row, table)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SHAPE_ARROW)], schema=_SHAPE_ARROW)


class Shapefile(DataSource):
    """Options: path; taskbytes."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SHAPE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _ShapeReader(self.options)


def shape_rows(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(path, pos, kind, parts, p, n): the shapes at a path, with the texts (p) and numbers (n)
    of their rows by lower-case name.  Rows that are marked as deleted are left out."""
    spark.dataSource.register(Shapefile)
    return spark.read.format("shapefile").option("taskbytes", task_bytes).load(path)


def prj_text(path: str) -> dict[str, str | None]:
    """What stands in the .prj beside each shapefile at a path; None where there is none."""
    system = fs.FileSystem.from_uri(path)[0]
    out = {}
    for file in files_of(path, ".shp"):
        prj = file[:-4] + ".prj"
        if system.get_file_info(prj).is_file:
            with system.open_input_file(prj) as f:
                out[file] = f.read().decode("utf-8", "replace")
        else:
            out[file] = None
    return out


# ------------------------------------------------------------------------------- GeoTIFF
#: Sizes of a TIFF's types, and how they unpack.
TIFF_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


@dataclass
class Raster:
    """The head of a GeoTIFF.  transform: x = x0 + dx_col * col + dx_row * row, and y alike."""

    file: str
    width: int
    height: int
    epsg: int
    transform: tuple[float, float, float, float, float, float]
    nodata: float | None
    order: str
    kind: str
    compression: int
    predictor: int
    block: tuple[int, int]
    places: list[tuple[int, int]]


def geotiff_head(path: str) -> Raster:
    """The head of a single-band GeoTIFF; what isn't supported is an error."""
    system, file = fs.FileSystem.from_uri(path)
    with system.open_input_file(file) as f:
        order = {b"II": "<", b"MM": ">"}.get(f.read(2))
        if order is None or struct.unpack(order + "H", f.read(2))[0] != 42:
            raise ValueError(f"{file} is no TIFF")
        f.seek(struct.unpack(order + "I", f.read(4))[0])
        entries = f.read(12 * struct.unpack(order + "H", f.read(2))[0])
        tags: dict[int, tuple] = {}
        for at in range(0, len(entries), 12):
            tag, kind, n = struct.unpack_from(order + "HHI", entries, at)
            letters = TIFF_TYPES.get(kind)
            if letters is None:
                continue
            size = n * struct.calcsize("<" + letters)
            raw = entries[at + 8 : at + 12]
            if size > 4:
                f.seek(struct.unpack(order + "I", raw)[0])
                raw = f.read(size)
            tags[tag] = (raw[:size],) if kind == 2 else struct.unpack(order + letters * n, raw[:size])
    one = lambda t, default=None: tags[t][0] if t in tags else default
    if one(277, 1) != 1:
        raise ValueError(f"{file} has {one(277)} bands; a grid of heights has one")
    compression, predictor = one(259, 1), one(317, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(one(339, 1))
    bits = one(258, 1)
    if compression not in (1, 8, 32946) or predictor not in (1, 2) or kind is None or bits not in (8, 16, 32, 64) or (predictor == 2 and kind == "f"):
        raise ValueError(f"{file}: compression {compression}, predictor {predictor} and {bits} bits of format {one(339, 1)} are not supported")
    width, height = one(256), one(257)
    if 322 in tags:
        block, places = (one(322), one(323)), list(zip(tags[324], tags[325]))
    else:
        block, places = (width, min(one(278, height), height)), list(zip(tags[273], tags[279]))
    keys = tags.get(34735, (1, 1, 0, 0))
    said = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4) if keys[k + 1] == 0}
    epsg = said.get(3072) or said.get(2048)
    if epsg is None:
        raise ValueError(f"{file} names no coordinate system")
    if 34264 in tags:
        m = tags[34264]
        transform = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif 33550 in tags and 33922 in tags:
        (w, h), t = (abs(x) for x in tags[33550][:2]), tags[33922]
        transform = (t[3] - t[0] * w, w, 0.0, t[4] + t[1] * h, 0.0, -h)
    else:
        raise ValueError(f"{file} has neither a scale with a tie point nor a transformation")
    if transform[1] * transform[5] - transform[2] * transform[4] == 0 or not all(np.isfinite(transform)):
        raise ValueError(f"{file} has a transformation that can't be inverted")
    nodata = None
    if 42113 in tags:
        try:
            nodata = float(one(42113).strip(b"\0 "))
        except ValueError:
            pass
    return Raster(file, width, height, epsg, transform, nodata, order, f"{kind}{bits // 8}", compression, predictor, block, places)


def strip(raw: bytes, head: Raster, k: int) -> tuple[int, int, np.ndarray]:
    """(row, column, values) of the k-th strip or tile, without what lies beyond the grid."""
    w, h = head.block
    across = -(-head.width // w)
    row, col = k // across * h, k % across * w
    data = raw if head.compression == 1 else zlib.decompress(raw)
    rows = h if len(data) >= w * h * int(head.kind[1:]) else head.height - row  # the last strip may be short
    x = np.frombuffer(data, head.order + head.kind, w * rows).reshape(rows, w)
    if head.predictor == 2:
        x = np.cumsum(x, axis=1, dtype=x.dtype.newbyteorder("="))
    return row, col, x[: head.height - row, : head.width - col].astype(float)


class _TiffReader(_Reader):
    def partitions(self) -> list[Range]:
        head, held, out = geotiff_head(self.path), [], []
        for k, (_, size) in enumerate(head.places):
            held.append(k)
            if sum(head.places[j][1] for j in held) >= int(self.options.get("taskbytes", TASK_BYTES)) or k + 1 == len(head.places):
                out.append(Range(head.file, held))
                held = []
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        head = geotiff_head(self.path)
        if "nodata" in self.options:
            head.nodata = float(self.options["nodata"])
        with self.open(partition.file) as f:
            for k in partition.parts:
                f.seek(head.places[k][0])
                row, col, x = strip(f.read(head.places[k][1]), head, k)
                bad = ~np.isfinite(x)
                if head.nodata is not None:
                    bad |= np.abs(x - head.nodata) <= 2.220446049250313e-16
                rows, cols = np.divmod(np.arange(x.size), x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(rows + row, pa.int32()), pa.array(cols + col, pa.int32()), pa.array(x.ravel(), mask=bad.ravel())], ["row", "col", "z"])


class GeoTiff(DataSource):
    """Options: path of one file; nodata, instead of the file's; taskbytes."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "row int, col int, z double"

    def reader(self, schema) -> DataSourceReader:
        return _TiffReader(self.options)


def read_geotiff(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, Raster]:
    """(cells (row, col, z), head) of a single-band GeoTIFF; z is null where there is no value."""
    spark.dataSource.register(GeoTiff)
    return spark.read.format("geotiff").option("taskbytes", task_bytes).load(path), geotiff_head(path)


def read_vrt(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, Raster]:
    """read_geotiff() through a VRT that shows one whole GeoTIFF, with the VRT's transformation
    and, where it has one, its value for no data; what else a VRT may do is an error."""
    system, file = fs.FileSystem.from_uri(path)
    with system.open_input_file(file) as f:
        root = ElementTree.fromstring(f.read())
    text = lambda node, name: (node.findtext(name) or "").strip() or None
    band = root.find("VRTRasterBand")
    simple = band.find("SimpleSource") if band is not None else None
    if root.tag != "VRTDataset" or simple is None or text(simple, "SourceFilename") is None or text(simple, "SourceBand") not in (None, "1"):
        raise ValueError(f"{file} is no VRT of one band of one source")
    width, height = int(root.get("rasterXSize", 0)), int(root.get("rasterYSize", 0))
    numbers = [float(x) for x in (text(root, "GeoTransform") or "").split(",") if x.strip()]
    if width < 1 or height < 1 or len(numbers) != 6:
        raise ValueError(f"{file} has no size or no GeoTransform of six numbers")
    for name in ("SrcRect", "DstRect"):
        rect = simple.find(name)
        if rect is not None and [float(rect.get(k, "nan")) for k in ("xOff", "yOff", "xSize", "ySize")] != [0, 0, width, height]:
            raise ValueError(f"{file} shows a part of its source")
    source = text(simple, "SourceFilename")
    if "://" not in source and not source.startswith("/"):
        source = path.rsplit("/", 1)[0] + "/" + source
    head = geotiff_head(source)
    if (head.width, head.height) != (width, height):
        raise ValueError(f"{file} is {width} by {height}, its source {head.width} by {head.height}")
    srs = text(root, "SRS")
    if srs is not None and crs.crs_of_text(srs) != crs.crs_of_text(str(head.epsg)):
        raise ValueError(f"{file} has another coordinate system than its source")
    x0, dx_col, dx_row, y0, dy_col, dy_row = numbers
    if dx_col * dy_row - dx_row * dy_col == 0:
        raise ValueError(f"{file} has a GeoTransform that can't be inverted")
    head.transform = (x0, dx_col, dx_row, y0, dy_col, dy_row)
    nodata = text(band, "NoDataValue") or text(root, "NoDataValue")
    spark.dataSource.register(GeoTiff)
    scan = spark.read.format("geotiff").option("taskbytes", task_bytes)
    if nodata is not None:
        head.nodata = float(nodata)
        scan = scan.option("nodata", nodata)
    return scan.load(source), head
