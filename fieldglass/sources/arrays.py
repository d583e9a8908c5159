"""Array files (NPY, and NPZ archives of them) as a Spark data source.

Reading: the driver reads headers only; each task reads one range of rows of one file, straight from its offset. Members of an
archive that are stored plain are split alike; a compressed member can only be read from its start, so it is one task. Writing: each task
writes files of at most ``rows_per_file`` rows, under names that no other task uses; those of failed tries are deleted.

    arrays.register(spark)
    spark.read.format("arrays").option("path", folder_or_file).load()      # row, c0, c1, ...
    df.write.format("arrays").mode("append").option("path", folder).save() # numeric columns, in order

Rows of a folder's files count on in the order of the file names. Nulls and edges: nulls are written as NaN; an array without rows
has no partition; arrays of more than two axes are flattened per row, those of one axis have one column; all values become doubles; a
folder without an array file is an error.
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage


def open_path(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pyarrow.fs.FileSystem.from_uri(path)


@dataclass
class Member:
    """Where the rows of one array lie: file, member of an archive if compressed, shape, type, offset of the first row and place of its first row among all."""

    path: str
    member: str | None
    rows: int
    width: int
    dtype: str
    fortran: bool
    offset: int
    first: int = 0


def _header(f) -> tuple[tuple, bool, np.dtype]:
    version = np.lib.format.read_magic(f)
    return np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)


def _member(path: str, f, member: str | None, base: int) -> Member:
    shape, fortran, dtype = _header(f)
    rows, width = (shape[0] if shape else 1), int(np.prod(shape[1:], dtype=np.int64)) if len(shape) > 1 else 1
    return Member(path, member, int(rows), width, dtype.str, bool(fortran) and len(shape) > 1, base + f.tell())


def members(path: str, array: str | None = None) -> list[Member]:
    """All arrays of a file or folder, in order; of an archive the named one, else the first. Reads headers only."""
    fs, top = open_path(path)
    info = fs.get_file_info(top)
    if info.type == pyarrow.fs.FileType.Directory:
        files = sorted(x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(top)) if x.path.endswith((".npy", ".npz")))
    else:
        files = [top]
    if not files:
        raise ValueError(f"no array files in {path}")
    out, first = [], 0
    for file in files:
        with fs.open_input_file(file) as f:
            if file.endswith(".npz"):
                with zipfile.ZipFile(f) as z:
                    name = f"{array}.npy" if array else z.namelist()[0]
                    entry = z.getinfo(name)
                    with z.open(name) as inner:
                        found = _member(file, inner, name, 0)
                if entry.compress_type == zipfile.ZIP_STORED:
                    # the local header holds the lengths of its own name and extra field
                    f.seek(entry.header_offset + 26)
                    name_size, extra_size = struct.unpack("<HH", f.read(4))
                    found.offset += entry.header_offset + 30 + name_size + extra_size
                    found.member = None
            else:
                found = _member(file, f, None, 0)
        found.first = first
        first += found.rows
        out.append(found)
    return out


@dataclass
class Rows(InputPartition):
    member: Member
    begin: int
    end: int


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.array, self.rows = options["path"], options.get("array"), int(options.get("rows_per_task", 65_536))
        self.names = [f.name for f in schema]

    def partitions(self) -> list[Rows]:
        out = []
        for m in members(self.path, self.array):
            step = self.rows if m.member is None and not m.fortran else max(1, m.rows)
            out += [Rows(m, a, min(a + step, m.rows)) for a in range(0, m.rows, step)]
        return out

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read
            return
        m, dtype = partition.member, np.dtype(partition.member.dtype)
        fs, top = open_path(self.path)
        with fs.open_input_file(m.path) as f:
            if m.member is not None:
                with zipfile.ZipFile(f) as z:
                    table = np.load(io.BytesIO(z.read(m.member)), allow_pickle=False).reshape(m.rows, -1)
            elif m.fortran:
                f.seek(m.offset)
                table = np.frombuffer(f.read(m.rows * m.width * dtype.itemsize), dtype).reshape(m.width, m.rows).T
            else:
                row = m.width * dtype.itemsize
                f.seek(m.offset + partition.begin * row)
                table = np.frombuffer(f.read((partition.end - partition.begin) * row), dtype).reshape(-1, m.width)
        for a in range(0, len(table), 4096):
            part = table[a : a + 4096].astype(np.float64)
            columns = [pa.array(np.arange(len(part), dtype=np.int64) + m.first + partition.begin + a)] + [pa.array(np.ascontiguousarray(part[:, k])) for k in range(m.width)]
            yield pa.RecordBatch.from_arrays(columns, names=self.names)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rows_per_file", 65_536))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, top = open_path(self.path)
        fs.create_dir(top, recursive=True)
        files, held, size = [], [], 0

        def flush(table: np.ndarray) -> None:
            name = f"{top}/part-{task.partitionId():06d}-{len(files):06d}-{uuid.uuid4().hex}.npy"
            body = io.BytesIO()
            np.save(body, table, allow_pickle=False)
            with fs.open_output_stream(name) as f:
                f.write(body.getvalue())
            files.append(name)

        for batch in batches:
            table = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            while len(table):
                take = table[: self.rows - size]
                held.append(take)
                size += len(take)
                table = table[len(take) :]
                if size == self.rows:
                    flush(np.concatenate(held))
                    held, size = [], 0
        if size:
            flush(np.concatenate(held))
        return Written(files)

    def abort(self, messages) -> None:
        fs, _ = open_path(self.path)
        for message in messages:
            for file in message.files if message else []:
                fs.delete_file(file)


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> T.StructType:
        widths = {m.width for m in members(self.options["path"], self.options.get("array"))}
        if len(widths) > 1:
            raise ValueError(f"arrays of different widths: {sorted(widths)}")
        return T.StructType([T.StructField("row", T.LongType())] + [T.StructField(f"c{i}", T.DoubleType()) for i in range(widths.pop())])

    def reader(self, schema: T.StructType) -> ArrayReader:
        return ArrayReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrayWriter:
        if overwrite:
            raise ValueError("array folders are only appended to; write to a new one")
        return ArrayWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrayFiles)
