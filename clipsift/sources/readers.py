"""Data sources for Spark: `npy` matrices in ranges of rows, and pages of ids from a service, with cursors as partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a matrix that a task reads, and rows of a batch.
SPLIT_BYTES, BATCH_ROWS = 64 << 20, 10_000
#: Ids asked for at a time.
PAGE = 100_000
#: fetch(set id, cursor, page size) -> (ids, next cursor or None).
Fetch = Callable[[str, str | None, int], tuple[list[str], str | None]]


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path within it."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Rows(InputPartition):
    """Rows [lo, hi) of a matrix, the first of which is row `row` of all matrices, `at` bytes from the start of its file."""

    path: str
    at: int
    lo: int
    hi: int
    row: int
    width: int
    kind: str


def header(path: str) -> tuple[tuple[int, int], np.dtype, int]:
    """Shape, type and first byte of a matrix, from its file's header alone."""
    system, inner = filesystem(path)
    with system.open_input_file(inner) as f:
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
        shape, fortran, kind = read[np.lib.format.read_magic(f)](f)
        if len(shape) != 2 or (fortran and min(shape) > 1) or kind.kind not in "fiu":
            raise ValueError(f"{path} is no matrix of numbers in order of rows")
        return shape, kind, f.tell()


def matrices(path: str) -> list[str]:
    """The .npy files of a folder, in order of name; a file is itself."""
    system, inner = filesystem(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(inner)) if f.base_name.endswith(".npy"))
    return [f"{path.rstrip('/')}/{n}" for n in names]


def splits(path: str, most: int = SPLIT_BYTES) -> list[Rows]:
    """Ranges of rows of at most `most` bytes (one row at least), through the files in order of name."""
    out: list[Rows] = []
    row = 0
    for p in matrices(path):
        (n, width), kind, at = header(p)
        step = max(1, most // max(1, width * kind.itemsize))
        out += [Rows(p, at, lo, min(lo + step, n), row + lo, width, kind.str) for lo in range(0, n, step)]
        row += n
    return out


def vectors(part: Rows, batch: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """(row, vec) of a range of rows, which is read once, a batch at a time."""
    system, inner = filesystem(part.path)
    size = part.width * np.dtype(part.kind).itemsize
    with system.open_input_file(inner) as f:
        f.seek(part.at + part.lo * size)
        for lo in range(part.lo, part.hi, batch):
            n = min(batch, part.hi - lo)
            raw = f.read(n * size)
            if len(raw) < n * size:
                raise ValueError(f"{part.path} ends before its row {part.hi}")
            values = pa.array(np.frombuffer(raw, part.kind).astype(np.float32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.width), values)
            rows = pa.array(np.arange(n, dtype=np.int64) + part.row + lo - part.lo)
            yield pa.RecordBatch.from_arrays([rows, lists], names=["row", "vec"])


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[InputPartition]:
        return splits(self.path, self.most) or [Rows("", 0, 0, 0, 0, 0, "<f4")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return vectors(partition) if partition.path else iter(())


class MatrixSource(DataSource):
    """`spark.read.format("npy")`: .npy files of a folder as (row, vec), in tasks of at most `splitBytes` bytes."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row long, vec array<float>"

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


@dataclass
class Cursor(InputPartition):
    """Pages from a cursor on, as far as the cursor where the next partition begins (None: to the end)."""

    start: str | None
    stop: str | None


def pages(fetch: Fetch, uuid: str, size: int = PAGE, start: str | None = None, stop: str | None = None) -> Iterator[list[str]]:
    """Pages of ids without empty ones from a cursor on, until no cursor follows or `stop` does."""
    cursor = start
    while True:
        ids, cursor = fetch(uuid, cursor, size)
        yield [i for i in ids if i]
        if not cursor or cursor == stop:
            return


class PageReader(DataSourceReader):
    def __init__(self, fetch: Fetch, cursors: Callable[[str, int], list[str]] | None, uuid: str, size: int):
        self.fetch, self.cursors, self.uuid, self.size = fetch, cursors, uuid, size

    def partitions(self) -> list[InputPartition]:
        inner = self.cursors(self.uuid, self.size) if self.cursors else []
        return [Cursor(a, b) for a, b in zip([None, *inner], [*inner, None], strict=True)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for ids in pages(self.fetch, self.uuid, self.size, partition.start, partition.stop):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string())], names=["segment_id"])


def register_pages(spark: SparkSession, fetch: Fetch, cursors: Callable[[str, int], list[str]] | None = None, name: str = "segment_pages") -> None:
    """`spark.read.format(name).option("set", id)`: the ids of a set, fetched by executors page by page. `cursors(set id, page
    size)`, if the service has such a call, names cursors inside the set, in order: a task reads from one to the next. Without
    it one task follows the cursors from the first page on, as each is known only from the page before."""

    class PageSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "segment_id string"

        def reader(self, schema: StructType) -> PageReader:
            return PageReader(fetch, cursors, self.options["set"], int(self.options.get("pageSize", PAGE)))

    spark.dataSource.register(PageSource)
