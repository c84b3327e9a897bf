"""Files of exported rows."""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from clipsift.sources.readers import filesystem

#: Rows of one file of a corpus at most.
CORPUS_FILE_ROWS = 1_048_576


def stem(label: str, now: datetime | None = None) -> str:
    """A unique name for an artifact: safe characters, a UTC stamp and eight hexadecimal digits."""
    at = (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%SZ")
    return f"{re.sub(r'[^A-Za-z0-9._-]+', '_', label)}_{at}_{uuid.uuid4().hex[:8]}"


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A header, and quotes only where a value needs them; nulls and empty texts are empty."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=False, emptyValue="", nullValue="", escape='"')


def write_corpus(df: DataFrame, path: str, rows: int = CORPUS_FILE_ROWS) -> None:
    df.write.option("maxRecordsPerFile", rows).option("compression", "zstd").mode("overwrite").parquet(path)


def write_matrices(df: DataFrame, path: str, *, row: str = "row", vec: str = "vec", parts: int | None = None, batch: int = 65_536) -> DataFrame:
    """Vectors in order of row as .npy matrices of at most `batch` rows, whose names are in that order; (path, rows) of each.

    Null vectors, which a matrix cannot hold, and vectors of unequal length are errors. A matrix gets its name when it is whole, so
    a task that is lost and run again leaves the same files. No rows leave an empty folder.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = filesystem(path)
        k, held, task = 0, [], TaskContext.get()

        def put() -> pa.RecordBatch:
            nonlocal k
            m = np.array(held, np.float32)
            name = f"{folder}/part-{task.partitionId():05d}-{k:05d}.npy"
            whole = io.BytesIO()
            np.save(whole, m)
            with system.open_output_stream(f"{name}.{task.taskAttemptId()}") as f:
                f.write(whole.getbuffer())
            system.move(f"{name}.{task.taskAttemptId()}", name)
            k += 1
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], names=["path", "rows"])

        for b in batches:
            if b.column(0).null_count:
                raise ValueError("a matrix cannot hold null vectors")
            values = b.column(0).to_pylist()
            while values:
                free = batch - len(held)
                held, values = held + values[:free], values[free:]
                if len(held) == batch:
                    yield put()
                    held = []
        if held:
            yield put()

    system, folder = filesystem(path)
    system.create_dir(folder, recursive=True)
    n = parts or df.sparkSession.sparkContext.defaultParallelism
    done = df.repartitionByRange(n, row).sortWithinPartitions(row).select(vec).mapInArrow(write, "path string, rows long")
    return df.sparkSession.createDataFrame(done.collect(), "path string, rows long")  # one row a file


def write_visit(df: DataFrame, path: str) -> None:
    """Append usage records as JSON lines."""
    df.write.mode("append").json(path)
