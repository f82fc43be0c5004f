"""Matrices in ``.npy`` files: a data source whose partitions are ranges of rows, and a writer.

Rows have no key but their place, so ``row_id`` is a row's place in all files, in the order of their names. The
driver reads the files' headers only. Paths are local to a shared folder or URIs that ``pyarrow.fs`` knows.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from spectroloom.operators.matrix import vectors

#: Rows of a partition and of a file, unless given, and rows of an Arrow batch.
ROWS, BATCH_ROWS = 1 << 20, 4096


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


@dataclass
class Header:
    rows: int
    width: int
    dtype: str
    begin: int


def read_header(f: io.IOBase) -> Header:
    """Shape and type of a matrix in row order; an error for anything else."""
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if len(shape) != 2 or (fortran and min(shape) > 1) or dtype.kind not in "fiu":
        raise ValueError(f"a matrix of numbers in row order is wanted, not {dtype} of shape {shape}" + ", by column" * fortran)
    return Header(*shape, dtype.str, f.tell())


@dataclass
class Rows(InputPartition):
    """A range of one file's rows."""

    path: str
    header: Header
    first: int  # in the file
    n: int
    row_id: int  # of the first

    def __post_init__(self) -> None:
        super().__init__(self.row_id)


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows

    def partitions(self) -> list[InputPartition]:
        fs, root = _file_system(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root))
        out, total, widths = [], 0, set()
        for f in sorted((f for f in found if f.is_file and f.base_name.endswith(".npy")), key=lambda f: f.path):
            with fs.open_input_file(f.path) as opened:
                h = read_header(opened)
            widths |= {h.width} if h.rows else set()
            out += [Rows(f.path, h, i, min(self.rows, h.rows - i), total + i) for i in range(0, h.rows, self.rows)]
            total += h.rows
        if len(widths) > 1:
            raise ValueError(f"files have rows of {sorted(widths)} values")
        return out or [Rows("", Header(0, 0, "<f8", 0), 0, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if not part.n:
            return
        fs, kind = _file_system(self.path)[0], np.dtype(part.header.dtype)
        with fs.open_input_file(part.path) as f:
            for i in range(0, part.n, BATCH_ROWS):
                n = min(BATCH_ROWS, part.n - i)
                size = part.header.width * kind.itemsize
                f.seek(part.header.begin + (part.first + i) * size)
                x = np.frombuffer(f.read(n * size), kind).astype(np.float64)
                ends = np.arange(n + 1, dtype=np.int32) * part.header.width
                yield pa.RecordBatch.from_arrays([pa.array(part.row_id + i + np.arange(n)), pa.ListArray.from_arrays(ends, x)], names=["row_id", "x"])


@dataclass
class _Part(WriterCommitMessage):
    written: str
    name: str


class _Writer(DataSourceWriter):
    """A file for each task, under a name of its own until all tasks have ended."""

    def __init__(self, path: str, dtype: str) -> None:
        self.path, self.dtype, self.run = path, dtype, uuid.uuid4().hex

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        x = np.array([r["x"] for r in rows], np.dtype(self.dtype))
        x = x if x.ndim == 2 else x.reshape(len(x), 0)
        fs, root = _file_system(self.path)
        fs.create_dir(root, recursive=True)
        written = f"{root}/.{self.run}-{part:05d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(written) as f:
            held = io.BytesIO()
            np.save(held, x)
            f.write(held.getbuffer())
        return _Part(written, f"{root}/part-{part:05d}.npy")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = _file_system(self.path)
        for m in messages:
            if m is not None:
                fs.move(m.written, m.name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = _file_system(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.written)


class NpySource(DataSource):
    """``spark.read.format("npy").option("rows", n).load(path)``: ``(row_id, x)``; ``dtype`` is the writer's."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row_id bigint, x array<double>"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rows", ROWS)))

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("dtype", "<f4"))


def read_npy(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """``(row_id, x)`` of a ``.npy`` file or of all in a folder, ``rows`` of them to a partition at most."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("rows", str(rows)).load(path)


def write_npy(df: DataFrame, path: str, row_id: str = "row_id", x: str = "x", rows: int = ROWS, dtype: str = "<f4") -> int:
    """Write rows in the order of their ids, about ``rows`` to a file, and return the number of files.

    Rows must be of one length, without nulls. The folder must be new: files with these names are replaced.
    """
    spark, held = df.sparkSession, vectors(df, row_id, x)
    spark.dataSource.register(NpySource)
    files = max(1, -(-held.count() // rows))
    ordered = held.repartitionByRange(files, "row_id").sortWithinPartitions("row_id") if files > 1 else held.coalesce(1).sortWithinPartitions("row_id")
    ordered.write.format("npy").option("dtype", dtype).mode("append").save(path)
    return files


def from_batches(spark: SparkSession, batches: Iterable, path: str, rows: int = ROWS) -> DataFrame:
    """``(row_id, x)`` of an iterable of matrices, or of tuples that begin with one, in their order.

    Each batch becomes a file below ``path``, so the driver holds one at a time.
    """
    fs, root = _file_system(path)
    fs.create_dir(root, recursive=True)
    for i, batch in enumerate(batches):
        x = np.asarray(batch[0] if isinstance(batch, (tuple, list)) else batch)
        if x.ndim != 2 or x.dtype.kind not in "f":
            raise ValueError("batches must be floating-point matrices")
        held = io.BytesIO()
        np.save(held, np.ascontiguousarray(x))
        with fs.open_output_stream(f"{root}/batch-{i:09d}.npy") as f:
            f.write(held.getbuffer())
    return read_npy(spark, path, rows)


def with_positions(spark: SparkSession, path: str, name: str = "row_id", format: str = "parquet") -> DataFrame:
    """The rows of files with their place in all of them: gapless, by file name and then as in the file.

    Two passes and no sort of rows: a count for each file, whose running sum is joined back by file. The place
    depends on the files alone, not on how they are split into tasks. Parquet only, as it knows a row's index.
    """
    rows = spark.read.format(format).load(path)
    if name in rows.columns:
        raise ValueError(f"there is a column {name} already")
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    files = sorted((r["_file"], r["n"]) for r in rows.groupBy("_file").agg(F.count("*").alias("n")).collect())
    starts = np.cumsum([0, *(n for _, n in files)])[:-1].tolist() if files else []
    table = pa.table({"_file": pa.array([f for f, _ in files], pa.string()), "_start": pa.array(starts, pa.int64())})
    out = rows.join(spark.createDataFrame(table), "_file")
    return out.withColumn(name, F.col("_start") + F.col("_index")).drop("_file", "_index", "_start")
