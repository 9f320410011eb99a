"""Classic netCDF cubes (netCDF-3: CDF-1, CDF-2 and CDF-5) as tables.

Files come as rows of path and content.  ``variables`` lists what a file holds; ``cells`` gives a variable as a long table with a column a
dimension, labelled by the coordinate variable of that name (the index, where there is none).  Values that equal _FillValue or missing_value are
null; scale_factor and add_offset are applied.  A record's cells go out at a time, and records outside the wanted labels aren't read.
Files that can't be parsed, or lack the variable, have no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of the format by number.
KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


@dataclass(frozen=True)
class Variable:
    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    kind: str
    begin: int
    record: bool
    attributes: dict = field(default_factory=dict)

    @property
    def slab(self) -> int:
        """Bytes of one record, or of the whole variable."""
        return int(np.prod(self.shape[self.record :], dtype=np.int64)) * np.dtype(self.kind).itemsize


@dataclass(frozen=True)
class Cube:
    content: bytes
    dims: dict[str, int]
    variables: dict[str, Variable]
    attributes: dict
    stride: int  # bytes from a record to the next

    def read(self, name: str, record: int | None = None) -> np.ndarray:
        """A variable's raw values, whole or of one record."""
        v = self.variables[name]
        if not v.record:
            return np.frombuffer(self.content, v.kind, int(np.prod(v.shape, dtype=np.int64)), v.begin).reshape(v.shape)
        if record is not None:
            return np.frombuffer(self.content, v.kind, v.slab // np.dtype(v.kind).itemsize, v.begin + record * self.stride).reshape(v.shape[1:])
        return np.stack([self.read(name, k) for k in range(v.shape[0])]) if v.shape[0] else np.zeros(v.shape, v.kind)

    def labels(self, dim: str) -> np.ndarray:
        """A dimension's labels: texts of a character variable, numbers of another, or indices."""
        v = self.variables.get(dim)
        if v is None or not v.dims or v.dims[0] != dim:
            return np.arange(self.dims[dim])
        raw = self.read(dim)
        if v.kind == "S1":
            width = v.shape[1] if len(v.shape) > 1 else 1
            return np.array([row.tobytes().decode("utf-8", "replace").rstrip("\0 ") for row in raw.reshape(-1, width)], object)
        return raw.astype(raw.dtype.newbyteorder("="))

    def values(self, name: str, record: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """A variable's values as floats, unpacked, and which are missing."""
        v, raw = self.variables[name], self.read(name, record)
        gone = np.zeros(raw.shape, bool)
        for a in ("_FillValue", "missing_value"):
            if a in v.attributes:
                gone |= raw == np.asarray(v.attributes[a]).reshape(-1)[0]
        out = raw.astype(float)
        for a, f in (("scale_factor", np.multiply), ("add_offset", np.add)):
            if a in v.attributes:
                out = f(out, float(np.asarray(v.attributes[a]).reshape(-1)[0]))
        return out, gone | np.isnan(out)


def parse(content: bytes) -> Cube:
    """The header of a file; a ValueError when it isn't a classic netCDF file."""
    if content[:3] != b"CDF" or len(content) < 8 or content[3] not in (1, 2, 5):
        raise ValueError("not a classic netCDF file")
    version, at = content[3], 4
    count, place = ("q" if version == 5 else "i"), ("i" if version == 1 else "q")

    def number(code: str) -> int:
        nonlocal at
        size = 8 if code == "q" else 4
        out = struct.unpack(f">{code}", content[at : at + size])[0]
        at += size
        return out

    def text() -> str:
        nonlocal at
        n = number(count)
        out = content[at : at + n].decode()
        at += n + -n % 4
        return out

    def attributes() -> dict:
        nonlocal at
        number("i")
        out = {}
        for _ in range(number(count)):
            name, kind, n = text(), KINDS[number("i")], number(count)
            size = n * np.dtype(kind).itemsize
            raw = content[at : at + size]
            out[name] = raw.decode("utf-8", "replace").rstrip("\0") if kind == "S1" else np.frombuffer(raw, kind)
            at += size + -size % 4
        return out

    try:
        records = number(count)
        number("i")
        dims = [(text(), number(count)) for _ in range(number(count))]
        own = attributes()
        number("i")
        found = []
        for _ in range(number(count)):
            name = text()
            ids = [number(count) for _ in range(number(count))]
            more, kind = attributes(), KINDS[number("i")]
            number(count)
            record = bool(ids) and dims[ids[0]][1] == 0
            shape = tuple(records if dims[k][1] == 0 else dims[k][1] for k in ids)
            found.append(Variable(name, tuple(dims[k][0] for k in ids), shape, kind, number(place), record, more))
    except (struct.error, KeyError, IndexError, UnicodeDecodeError) as e:
        raise ValueError(f"broken netCDF header: {e}") from e
    moving = [v for v in found if v.record]
    stride = sum(v.slab + -v.slab % 4 for v in moving) if len(moving) != 1 else moving[0].slab
    return Cube(content, {n: size or records for n, size in dims}, {v.name: v for v in found}, own, stride)


def variables(files: DataFrame) -> DataFrame:
    """(path, variable, dims, shape, kind) of all variables of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    rows += [(path, v.name, list(v.dims), list(v.shape), np.dtype(v.kind).newbyteorder("=").name) for v in parse(content.as_py() or b"").variables.values()]
                except ValueError:
                    continue
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["path", "variable", "dims", "shape", "kind"])

    return files.select("path", "content").mapInArrow(run, "path string, variable string, dims array<string>, shape array<long>, kind string")


def cells(files: DataFrame, variable: str, dims: dict[str, str], **labels: object) -> DataFrame:
    """(path, a column a dimension, value) of a variable; ``dims`` names the dimensions in the file's order with the kinds of their labels.

    ``labels`` picks a value, a list of values, or a (low, high) tuple of a dimension, before any value is read.
    """
    names = list(dims)

    def wanted(have: np.ndarray, what: object) -> np.ndarray:
        if isinstance(what, tuple):
            return np.array([what[0] <= x <= what[1] for x in have], bool)
        return np.isin(have, what if isinstance(what, list) else [what])

    kinds = {"string": pa.string(), "double": pa.float64(), "float": pa.float32(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    cube = parse(content.as_py() or b"")
                    v = cube.variables[variable]
                except (ValueError, KeyError):
                    continue
                if list(v.dims) != names:
                    raise ValueError(f"{variable} of {path} has the dimensions {', '.join(v.dims)}")
                have = [cube.labels(d) for d in names]
                keep = [np.flatnonzero(wanted(h, labels[d])) if d in labels else np.arange(len(h)) for d, h in zip(names, have, strict=True)]
                for k in keep[0] if names else [None]:
                    values, gone = cube.values(variable, int(k)) if v.record else (x[k] for x in cube.values(variable)) if names else cube.values(variable)
                    part = np.ix_(*keep[1:]) if names[1:] else ...
                    values, gone = np.asarray(values)[part].reshape(-1), np.asarray(gone)[part].reshape(-1)
                    grid = np.meshgrid(*(np.asarray(h)[p] for h, p in zip(have[1:], keep[1:], strict=True)), indexing="ij") if names[1:] else []
                    first = [np.repeat(np.asarray(have[0])[k : k + 1], len(values))] if names else []
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(values)), *(pa.array(x.reshape(-1).tolist() if x.dtype == object else x.reshape(-1)).cast(kinds[dims[d]]) for x, d in zip([*first, *grid], names, strict=True)), pa.array(values, mask=gone)], names=["path", *names, "value"])

    return files.select("path", "content").mapInArrow(run, ", ".join(["path string", *(f"`{d}` {k}" for d, k in dims.items()), "value double"]))


def files(spark: SparkSession, root: str, pattern: str = "*.nc") -> DataFrame:
    """(path, content) of the files under a folder; several files of one layout are one cube."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")


def pixels(rows: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """Cells by their coordinates with row and col, counted along the distinct labels (rows from the top)."""
    ys, xs = (rows.select(c).distinct().withColumn(n, F.row_number().over(w) - 1) for c, n, w in ((y, "row", _order(F.desc(y))), (x, "col", _order(F.col(x)))))
    return rows.join(F.broadcast(ys), y).join(F.broadcast(xs), x)


def _order(by):
    from pyspark.sql import Window

    return Window.orderBy(by)  # labels of one axis
