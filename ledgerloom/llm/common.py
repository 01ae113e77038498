"""Helpers the operators share: input tables, hashes of ids, files on shared storage, Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did."""
    home, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (known, home) if x)
    env["TOKENIZERS_PARALLELISM"] = "false"


def id_remainder(doc_id: str = "doc_id", mod: int = 5) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % mod


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text, empty for null."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def bytes_list(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def write_bytes(folder: str, name: str, parts: list) -> str:
    """A file on shared storage under a name that no other task attempt uses; returns its path.

    Only files named in a result that Spark has committed count, so a task that ran twice
    or died half-way leaves nothing but an unread file.
    """
    from pyspark import TaskContext

    attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
    path = f"{folder}/{name}-{attempt}"
    system, inner = open_store(folder)
    with system.open_output_stream(inner + path[len(folder) :]) as out:
        for part in parts:
            out.write(memoryview(np.ascontiguousarray(part)).cast("B") if isinstance(part, np.ndarray) else part)
    return path


def open_store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("file:///", "/").replace("file:/", "/"))


def read_bytes(path: str, start: int = 0, length: int | None = None) -> memoryview:
    """Bytes of a file on shared storage."""
    system, inner = open_store(path)
    with system.open_input_file(inner) as file:
        return memoryview(file.read_at(file.size() - start if length is None else length, start))


def each_row_a_task(df: DataFrame) -> DataFrame:
    """Deal rows that stand for files or blocks evenly over the cluster's tasks."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 4)


def stream_runs(batches: Iterator[pa.RecordBatch], keys: list[str], emit: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by ``keys``; ``emit`` gets tables of whole runs with the number of each row's run."""
    held: list[pa.Table] = []

    def out() -> pa.RecordBatch:
        table = pa.concat_tables(held).combine_chunks()
        changed = np.zeros(len(table), dtype=bool)
        for k in keys:
            values = table[k].to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        return emit(table, np.cumsum(changed))

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        last = [table[k][-1].as_py() for k in keys]
        same = np.ones(len(table), dtype=bool)
        for k, value in zip(keys, last):
            same &= table[k].to_numpy() == value
        cut = len(table) - int(same.sum())
        if cut:
            held.append(table.slice(0, cut))
            yield out()
            held = []
        elif held and [held[-1][k][-1].as_py() for k in keys] != last:
            yield out()
            held = []
        held.append(table.slice(cut))
    if held:
        yield out()
