"""Binary files read in byte ranges: framed records, flat points and PLY clouds, and their writers.

Spark lists the files. A first pass reads of each file only what tells where its records lie (lengths, or a header) and
gives byte ranges of bounded size; the ranges are dealt to tasks, each of which opens the file at its range. So a file of any
size is read by many tasks, and none holds more than a batch of it. Paths are opened with Arrow's file systems (local,
hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import itertools
import struct
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.tables import materialise

#: Bytes of a range, of what leaves a worker at once, and of what is read at once while looking for lengths.
RANGE_BYTES, BATCH_BYTES, LOOK_BYTES = 1 << 27, 1 << 25, 1 << 20
#: Bytes of small ranges, and their number, that leave a worker together.
JOINED_BYTES, JOINED = 1 << 22, 1 << 10
RANGE = "path string, start long, stop long, first long, layout string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it. Paths are as Hadoop writes them: not encoded, a local one with one slash or three."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@?=&%"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of files, folders or patterns, from Spark's own listing; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")


def _ranges(files: DataFrame, of: Callable[[pa.NativeFile, int, int], Iterator[tuple[int, int, int, str]]], size: int) -> DataFrame:
    """Byte ranges of the files; one small row each. ``of`` gives (start, stop, number of the first record, layout) of an open file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                where, at = opened(name)
                with where.open_input_file(at) as f:
                    rows = [(name, *r) for r in of(f, length, size)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["path", "start", "stop", "first", "layout"])

    spread = max(1, min(files.sparkSession.sparkContext.defaultParallelism * 4, files.count()))
    return files.repartition(spread, "path").mapInArrow(run, RANGE)


def _read(ranges: DataFrame, of: Callable[[pa.NativeFile, dict], Iterator[pa.RecordBatch]], schema: str, range_bytes: int) -> DataFrame:
    """What ``of`` makes of each range, the ranges dealt to tasks of ``RANGE_BYTES`` about; small ranges and small files share a task.

    A task goes through a file's ranges in order with one opening, and what small ranges give leaves it together.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (r for b in batches for r in b.to_pylist())
        for name, own in itertools.groupby(every, key=lambda r: r["path"]):
            where, at = opened(name)
            with where.open_input_file(at) as f:
                for r in own:
                    f.seek(r["start"])
                    yield from of(f, r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts(batches):
            held.append(part)
            size += part.nbytes
            if size >= JOINED_BYTES or len(held) >= JOINED:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    held = materialise(ranges, "ranges")
    n, size = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    tasks = max(1, min(n, 4 * held.sparkSession.sparkContext.defaultParallelism), -(-size // max(range_bytes, RANGE_BYTES)))
    return held.repartition(tasks, "path", "start").sortWithinPartitions("path", "start").mapInArrow(run, schema)


# --- framed records -------------------------------------------------------------------------------------------------


def _frames(f: pa.NativeFile, length: int, size: int) -> Iterator[tuple[int, int, int, str]]:
    """Ranges of whole records, by their lengths; a record cut short, and what follows it, is left out."""
    at, start, first, n = 0, 0, 0, 0
    held, base = b"", 0
    while at + 12 <= length:
        if not base <= at or at + 8 > base + len(held):
            f.seek(at)
            held, base = f.read(LOOK_BYTES), at
        (record,) = struct.unpack_from("<Q", held, at - base)
        if at + 16 + record > length:
            break
        at, n = at + 16 + record, n + 1
        if at - start >= size:
            yield start, at, first, ""
            start, first = at, n
    if at > start:
        yield start, at, first, ""


def _records(f: pa.NativeFile, r: dict) -> Iterator[pa.RecordBatch]:
    """The records of a range, which is read by blocks and not by record."""
    n, left, data, at, held, out = r["first"], r["stop"] - r["start"], b"", 0, 0, []

    def batch() -> pa.RecordBatch:
        numbers = pa.array(np.arange(n - len(out), n))
        return pa.RecordBatch.from_arrays([pa.repeat(r["path"], len(out)), numbers, pa.array(out, pa.binary())], names=["path", "n", "record"])

    def ahead(size: int) -> None:
        nonlocal data, at, left
        if at + size > len(data):
            more = f.read(min(max(size - len(data) + at, LOOK_BYTES), left))
            data, at, left = data[at:] + more, 0, left - len(more)

    while left or at < len(data):
        ahead(12)
        (size,) = struct.unpack_from("<Q", data, at)
        ahead(16 + size)
        out.append(data[at + 12 : at + 12 + size])
        at, n, held = at + 16 + size, n + 1, held + size + 16
        if held >= BATCH_BYTES:
            yield batch()
            held, out = 0, []
    if out:
        yield batch()


def framed_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, n, record binary): length-prefixed records (u64 length, u32 check, bytes, u32 check), numbered within their file.

    Checks are not looked at; a record cut short at a file's end is dropped. A file is read by ranges of ``range_bytes``, or of
    one record where that is longer.
    """
    return _read(_ranges(listed(spark, path), _frames, range_bytes), _records, "path string, n long, record binary", range_bytes)


# --- points ---------------------------------------------------------------------------------------------------------


def points(spark: SparkSession, path: str, columns: tuple[str, ...] = ("x", "y", "z"), range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, n, columns float): flat little-endian 32-bit records, numbered within their file; a record cut short is dropped."""
    k = 4 * len(columns)
    each = max(1, range_bytes // k)
    whole = F.floor(F.col("length") / k)
    cuts = listed(spark, path).where(F.col("length") >= k).select("path", whole.alias("whole"), F.explode(F.sequence(F.lit(0), whole - 1, F.lit(each))).alias("first"))
    ranges = cuts.select("path", (F.col("first") * k).alias("start"), (F.least(F.col("first") + each, F.col("whole")) * k).alias("stop"), "first", F.lit("").alias("layout"))

    def of(f: pa.NativeFile, r: dict) -> Iterator[pa.RecordBatch]:
        n, left = r["first"], r["stop"] - r["start"]
        while left:
            m = np.frombuffer(f.read(min(left, BATCH_BYTES // k * k)), "<f4").reshape(-1, len(columns))
            yield _rows(r["path"], n, {c: np.ascontiguousarray(m[:, i]) for i, c in enumerate(columns)})
            n, left = n + len(m), left - m.nbytes

    return _read(ranges, of, "path string, n long, " + ", ".join(f"{c} float" for c in columns), range_bytes)


def _rows(path: str, first: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.array(np.arange(first, first + n)), *(pa.array(v) for v in columns.values())], names=["path", "n", *columns])


# --- PLY clouds -----------------------------------------------------------------------------------------------------

# fixed values: the format's names of number types, as numpy writes them
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
COLOURS = {"r": ("red", "r", "diffuse_red"), "g": ("green", "g", "diffuse_green"), "b": ("blue", "b", "diffuse_blue")}
PLAIN = ["x", "y", "z", "r", "g", "b"]


def ply_header(head: bytes) -> tuple[int, str, list[tuple[str, int, list[tuple[str, ...]]]]]:
    """(bytes of the header, format, elements (name, count, properties as words)); a file may have no format line."""
    end = head.find(b"end_header")
    if end < 0:
        raise ValueError("a PLY file without an end of its header")
    line = head.find(b"\n", end)
    size = len(head) if line < 0 else line + 1
    kind, elements = "ascii", []
    for words in (s.split() for s in head[:end].decode("ascii", "replace").splitlines()):
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"] and elements:
            elements[-1][2].append(tuple(words[1:]))
    return size, kind, elements


def _skipped(f: pa.NativeFile, at: int, order: str, count: int, properties: list[tuple[str, ...]]) -> int:
    """The place behind a binary element that stands before the vertices; one with lists is walked through."""
    if not any(p[0] == "list" for p in properties):
        return at + count * sum(np.dtype(PLY_TYPES[p[0]]).itemsize for p in properties)
    f.seek(at)
    for _ in range(count):
        for p in properties:
            if p[0] == "list":
                size = np.dtype(order + PLY_TYPES[p[1]])
                n = int(np.frombuffer(f.read(size.itemsize), size)[0])
                f.seek(f.tell() + n * np.dtype(PLY_TYPES[p[2]]).itemsize)
            else:
                f.seek(f.tell() + np.dtype(PLY_TYPES[p[0]]).itemsize)
    return f.tell()


def _clouds(f: pa.NativeFile, length: int, size: int) -> Iterator[tuple[int, int, int, str]]:
    """Ranges of vertices. layout: a binary record's order, types and names, or ``ascii``, the lines before and of the vertices, and their names."""
    at, kind, elements = ply_header(f.read(1 << 16))
    before, vertex = [], None
    for e in elements:
        if e[0] == "vertex":
            vertex = e
            break
        before.append(e)
    if kind == "ascii":
        lines = sum(n for _, n, _ in before)
        names = " ".join(p[-1] for p in vertex[2]) if vertex else ""
        yield at, length, 0, f"ascii {lines} {vertex[1] if vertex else -1} {names}".rstrip()
        return
    if vertex is None:
        return
    order = {"binary_little_endian": "<", "binary_big_endian": ">"}[kind]
    for _, n, properties in before:
        at = _skipped(f, at, order, n, properties)
    if any(p[0] == "list" for p in vertex[2]):
        raise ValueError("vertices with lists have no fixed size")
    layout = order + " " + " ".join(f"{PLY_TYPES[p[0]]}:{p[1]}" for p in vertex[2])
    k = sum(np.dtype(PLY_TYPES[p[0]]).itemsize for p in vertex[2])
    n, each = min(vertex[1], (length - at) // k if k else 0), max(1, size // max(k, 1))
    for first in range(0, n, each):
        yield at + first * k, at + min(first + each, n) * k, first, layout


def _cloud(path: str, first: int, found: dict[str, np.ndarray], n: int, grey: int) -> pa.RecordBatch:
    out = {c: found[c].astype("f8") if c in found else np.zeros(n) for c in "xyz"}
    for c, names in COLOURS.items():
        own = next((found[x] for x in names if x in found), None)
        out[c] = np.full(n, grey, "i4") if own is None else np.where(np.isnan(own.astype("f8")), grey, np.nan_to_num(own.astype("f8"))).astype("i4")
    return _rows(path, first, out)


def ply_points(spark: SparkSession, path: str, grey: int = 128, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, n, x, y, z double, r, g, b int) of the vertices of ASCII, little- and big-endian files; colour is grey where a file has none.

    Binary records are decoded by the types and places that the header gives; vertices cut short at the end are dropped. In ASCII
    files without properties the fields are x y z r g b; a line of fewer than three fields is no vertex. An ASCII file is one range.
    """

    def of(f: pa.NativeFile, r: dict) -> Iterator[pa.RecordBatch]:
        words = r["layout"].split()
        if words[0] != "ascii":
            record = np.dtype([(name, words[0] + kind) for kind, name in (w.split(":") for w in words[1:])])
            n, left = r["first"], r["stop"] - r["start"]
            while left:
                m = np.frombuffer(f.read(min(left, max(1, BATCH_BYTES // record.itemsize) * record.itemsize)), record)
                yield _cloud(r["path"], n, {c: m[c] for c in record.names}, len(m), grey)
                n, left = n + len(m), left - m.nbytes
            return
        skip, most, names = int(words[1]), int(words[2]), words[3:] or PLAIN
        n, rest, end, rows = 0, b"", False, []

        def batch() -> pa.RecordBatch:
            wide = np.full((len(rows), len(names)), np.nan)
            for i, line in enumerate(rows):
                wide[i, : min(len(line), len(names))] = [float(v) for v in line[: len(names)]]
            return _cloud(r["path"], n, {c: wide[:, i] for i, c in enumerate(names)}, len(rows), grey)

        while not end and (most < 0 or n + len(rows) < most):
            data = f.read(LOOK_BYTES)
            end = not data
            *lines, rest = [*(rest + data).split(b"\n"), *([b""] if end else [])]
            for line in lines:
                if skip:
                    skip -= 1
                elif len(fields := line.split()) >= 3 and (most < 0 or n + len(rows) < most):
                    rows.append(fields)
            if rows:
                yield batch()
                n, rows = n + len(rows), []

    ranges = _ranges(listed(spark, path), _clouds, range_bytes)
    return _read(ranges, of, "path string, n long, x double, y double, z double, r int, g int, b int", range_bytes)


# --- writers --------------------------------------------------------------------------------------------------------


def _written(df: DataFrame, folder: str, ending: str, put: Callable[[pa.NativeFile, pa.RecordBatch], int]) -> DataFrame:
    """A file for each task that has rows, moved to its name when whole, so that a lost attempt leaves no such file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = opened(folder)
        where.create_dir(at, recursive=True)
        name, n, out = f"part-{TaskContext.get().partitionId():06d}.{ending}", 0, None
        hidden = f"{at}/.{name}-{uuid.uuid4().hex}"
        for b in batches:
            out = out or where.open_output_stream(hidden)
            n += put(out, b)
        if out:
            out.close()
            where.move(hidden, f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["name", "n"])

    return df.mapInArrow(run, "name string, n long")


def write_framed(df: DataFrame, folder: str, column: str) -> int:
    """Write the records of a binary column as framed files, one a task, without checks; their number."""

    def put(out: pa.NativeFile, b: pa.RecordBatch) -> int:
        for record in b.column(0).to_pylist():
            out.write(struct.pack("<QI", len(record or b""), 0) + (record or b"") + struct.pack("<I", 0))
        return b.num_rows

    return _written(df.select(F.col(column).cast("binary")), folder, "rec", put).agg(F.sum("n")).first()[0] or 0


def write_points(df: DataFrame, folder: str, columns: tuple[str, ...] = ("x", "y", "z")) -> int:
    """Write rows of numbers as flat little-endian 32-bit records, one file a task; nulls become NaN; their number."""

    def put(out: pa.NativeFile, b: pa.RecordBatch) -> int:
        out.write(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype("<f4").tobytes())
        return b.num_rows

    return _written(df.select(*(F.col(c).cast("float") for c in columns)), folder, "bin", put).agg(F.sum("n")).first()[0] or 0


def write_ply(df: DataFrame, folder: str, kind: str = "binary_little_endian") -> int:
    """Write (x, y, z, r, g, b) as PLY files, one an Arrow batch of a task, in any of the three formats; the number of points.

    A header holds the number of its vertices, so a batch, whose size Spark bounds, is a file.
    """
    mark = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": "<"}[kind]
    record = np.dtype([(c, mark + "f8") for c in "xyz"] + [(c, "u1") for c in ("red", "green", "blue")])
    properties = "".join(f"property {'double' if n in 'xyz' else 'uchar'} {n}\n" for n in record.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = opened(folder)
        where.create_dir(at, recursive=True)
        for i, b in enumerate(batches):
            m = np.empty(b.num_rows, record)
            for name, c in zip(record.names, b.columns, strict=True):
                m[name] = c.to_numpy(zero_copy_only=False)
            body = m.tobytes() if kind != "ascii" else "".join(" ".join(map(repr, r)) + "\n" for r in m.tolist()).encode()
            name = f"part-{TaskContext.get().partitionId():06d}-{i:04d}.ply"
            hidden = f"{at}/.{name}-{uuid.uuid4().hex}"
            with where.open_output_stream(hidden) as out:
                out.write(f"ply\nformat {kind} 1.0\nelement vertex {len(m)}\n{properties}end_header\n".encode() + body)
            where.move(hidden, f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(m)])], names=["name", "n"])

    slim = df.select(*(F.col(c).cast("double") for c in "xyz"), *(F.col(c).cast("int") for c in "rgb"))
    return slim.mapInArrow(run, "name string, n long").agg(F.sum("n")).first()[0] or 0
