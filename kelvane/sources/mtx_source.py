"""Matrix Market coordinate files as a Spark data source: ``spark.read.format("mtx")`` and ``df.write.format("mtx")``.

A file is read by ranges of its bytes, a task each; a line belongs to the range in which it begins. What is written is a
folder: a task writes its rows to a part of its own, and the commit step, which only sees how many rows each part has, renames
the parts and writes the header, the last thing that makes the folder readable. Reading takes a file or such a folder.

Options. Reading: ``path``, ``rangebytes`` (of a task). Writing: ``path``, ``nrows``, ``ncols``. Rows and columns are counted from 0
in tables and from 1 in files. Symmetric files hold one triangle: the other is read as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..matrix import SparseMatrix

SCHEMA = "row long, col long, val double"
#: Bytes of a task's range, and of what a task parses at once.
RANGE, CHUNK = 32 << 20, 4 << 20
HEADER = "_header.mtx"


@dataclass(frozen=True)
class Head:
    """What a header says, and where the entries begin."""

    field: str
    symmetry: str
    nrows: int
    ncols: int
    nnz: int
    start: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def parse_head(raw: bytes, name: str) -> Head:
    """From the first bytes of a file, which must hold all comments and the line of sizes."""
    at, first = 0, raw.split(b"\n", 1)[0].decode("latin-1").lower().split()
    if len(first) < 5 or first[0] != "%%matrixmarket":
        raise ValueError(f"{name} is no Matrix Market file")
    layout, field, symmetry = first[2:5]
    if layout != "coordinate" or field not in ("real", "integer", "pattern") or symmetry not in ("general", "symmetric", "skew-symmetric"):
        raise ValueError(f"{name}: {layout} {field} {symmetry} matrices are not read by ranges")
    while True:
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError(f"{name} has no line of sizes in its first {len(raw)} bytes")
        line, at = raw[at:end].strip(), end + 1
        if line and not line.startswith(b"%"):
            sizes = [int(x) for x in line.split()]
            return Head(field, symmetry, *sizes[:3], at)


def head_of(path: str, most: int = 1 << 20) -> tuple[Head, list[tuple[str, int, int]]]:
    """The header of a file or folder, and its files with entries: path, first byte, size."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.Directory:
        found = sorted((x for x in system.get_file_info(fs.FileSelector(at)) if x.base_name.startswith("part-")), key=lambda x: x.base_name)
        with system.open_input_file(f"{at}/{HEADER}") as f:
            return parse_head(f.read(most), path), [(x.path, 0, x.size) for x in found]
    with system.open_input_file(at) as f:
        head = parse_head(f.read(most), path)
    return head, [(at, head.start, info.size)]


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def lines_of(f, start: int, end: int, first: int, chunk: int = CHUNK) -> Iterator[bytes]:
    """Whole lines that begin in [start, end), some at a time; the file's entries begin at ``first``."""
    at = start
    if start > first:  # the line that begins before this range is the one before's
        f.seek(start - 1)
        at, tail = start - 1, b""
        while True:
            tail = f.read(4096)
            cut = tail.find(b"\n")
            if cut >= 0 or not tail:
                at += cut + 1 if cut >= 0 else 0
                break
            at += len(tail)
        if not tail or at >= end:
            return
    f.seek(at)
    rest = b""
    while at < end:
        raw = f.read(min(chunk, end - at))
        if not raw:
            break
        at += len(raw)
        rest += raw
        cut = rest.rfind(b"\n") + 1
        if cut:
            yield rest[:cut]
            rest = rest[cut:]
    if rest:  # the last line may end behind the range
        while not rest.endswith(b"\n") and (raw := f.read(4096)):
            cut = raw.find(b"\n")
            rest += raw if cut < 0 else raw[: cut + 1]
        yield rest


class MtxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[Range]:
        _, files = head_of(self.path)
        # A range ends no earlier than the entries begin, so that none is without a first byte.
        return [Range(p, s, min(s + self.range, size)) for p, first, size in files for s in range(first, size, self.range)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a matrix without entries has no range
            return
        head, files = head_of(self.path)
        first = next(f for p, f, _ in files if p == partition.path)
        width = 2 if head.field == "pattern" else 3
        with opened(self.path)[0].open_input_file(partition.path) as f:
            for raw in lines_of(f, partition.start, partition.end, first):
                if b"%" in raw:
                    raw = b"\n".join(x for x in raw.split(b"\n") if not x.lstrip().startswith(b"%"))
                numbers = np.array(raw.split(), np.float64).reshape(-1, width)
                row, col = numbers[:, 0].astype(np.int64) - 1, numbers[:, 1].astype(np.int64) - 1
                val = numbers[:, 2] if width == 3 else np.ones(len(row))
                if head.symmetry != "general":
                    off = row != col
                    sign = -1.0 if head.symmetry == "skew-symmetric" else 1.0
                    row, col, val = np.r_[row, col[off]], np.r_[col, row[off]], np.r_[val, sign * val[off]]
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(val)], names=["row", "col", "val"])


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class MtxWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.nrows, self.ncols = int(options["nrows"]), int(options["ncols"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, at = opened(self.path)
        context = TaskContext.get()
        part = f"{at}/_temporary-{self.job}/part-{context.partitionId():06}-{context.taskAttemptId()}"
        system.create_dir(part.rsplit("/", 1)[0], recursive=True)
        n = 0
        with system.open_output_stream(part) as out:
            for batch in iterator:
                row, col, val = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("row", "col", "val"))
                out.write("".join(f"{r + 1} {c + 1} {v!r}\n" for r, c, v in zip(row, col, val, strict=True)).encode())
                n += batch.num_rows
        return Written(part, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = opened(self.path)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(at)):
                if x.base_name == HEADER or x.base_name.startswith("part-"):
                    system.delete_file(x.path)
        done = [m for m in messages if m is not None]
        for m in done:
            system.move(m.path, f"{at}/{m.path.rsplit('/', 1)[1]}")
        if done:
            system.delete_dir(done[0].path.rsplit("/", 1)[0])
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{HEADER}") as out:
            out.write(f"%%MatrixMarket matrix coordinate real general\n{self.nrows} {self.ncols} {sum(m.rows for m in done)}\n".encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, at = opened(self.path)
        if system.get_file_info(f"{at}/_temporary-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/_temporary-{self.job}")


class MtxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MtxReader:
        return MtxReader(self.options)

    def writer(self, schema, overwrite: bool) -> MtxWriter:
        return MtxWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("mtx")`` known to a session."""
    spark.dataSource.register(MtxSource)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE) -> SparseMatrix:
    """A coordinate file, or a folder that :func:`write` made, by several tasks. Repeated cells add up."""
    register(spark)
    head, _ = head_of(path)
    cells = spark.read.format("mtx").option("rangebytes", range_bytes).load(path)
    return SparseMatrix.of(cells, head.nrows, head.ncols, path.rstrip("/").rsplit("/", 1)[-1])


def write(m: SparseMatrix, path: str, mode: str = "append") -> None:
    """A folder of parts, by row and column; no entry passes through the driver. ``mode``: append (to a new folder) or overwrite."""
    register(m.spark)
    rows: DataFrame = m.entries.select("row", "col", F.col("val").cast("double").alias("val")).orderBy("row", "col")
    rows.write.format("mtx").option("nrows", m.nrows).option("ncols", m.ncols).mode(mode).save(path)
