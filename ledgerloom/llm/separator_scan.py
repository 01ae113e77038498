"""Token counts: a separator scan over flat token files without an index.

A flat file is ids of a fixed width, little-endian, document after document, each closed by the end-of-document
id.  Nothing in it tells where documents lie.  Files are cut into blocks of equal size that tasks read by
themselves; numpy compares a whole block with the end id.  A document may reach over any number of blocks: a
prefix scan over the blocks of a file carries the place of the last end seen before each block and the number
of documents closed before it.  Ids behind the last end of a file are a document too, marked as not closed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint, shared_folder
from .common import each_row_a_task, open_store, read_bytes, ready
from .token_files import by_bytes
from .tokenize import Encoder

#: Bytes of a block; a multiple of any id's width.
BLOCK_BYTES = 4 << 20


def write_flat(docs: DataFrame, folder: str, encoder: Callable[[], Encoder], end_id: int, dtype: str = "<u2") -> DataFrame:
    """Every text as ids closed by ``end_id``, in files as the table's partitions lie; one row per document.

    Rows ``path, ordinal, doc_id`` tell which document a file holds at which place; the files themselves know
    nothing of it.  Null and empty texts give an end id alone.  Only files named here count: a task
    that ran twice leaves another file that nobody reads.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        path, ordinal, out = f"{folder}/tokens-{context.partitionId():08d}-{context.taskAttemptId()}", 0, None
        system, inner = open_store(folder)
        for batch in batches:
            for part in by_bytes(batch):
                out = out or system.open_output_stream(inner + path[len(folder) :])
                ids, counts = encoder().batch(part.column(1))
                if len(ids) and max(int(ids.max()), end_id) > np.iinfo(dtype).max:
                    raise ValueError(f"an id does not fit {dtype}")
                out.write(np.insert(ids, np.cumsum(counts), end_id).astype(dtype).tobytes())
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), part.column(0)], names=["path", "ordinal", "doc_id"]
                )
                ordinal += n
        if out:
            out.close()

    return reliable_checkpoint(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "path string, ordinal long, doc_id long"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length`` of the files of a folder; their contents are not read."""
    return spark.read.format("binaryFile").load(folder).select("path", "length")


def scan(files: DataFrame, end_id: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``path, ordinal, start, n_tokens, closed`` of every document of the files ``(path, length)``.

    ``start`` counts ids from the file's beginning, ``n_tokens`` leaves out the end id.  Two ends in a row
    close a document without ids.  An empty file has none; a file that breaks off within an id is an error.
    """
    ready(files.sparkSession)
    width = np.dtype(dtype).itemsize
    block_bytes -= block_bytes % width
    last = F.greatest(F.ceil(F.col("length") / block_bytes) - 1, F.lit(0))
    cut = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, block in zip(*(c.to_pylist() for c in batch.columns)):
                if length % width:
                    raise ValueError(f"{path} breaks off within an id")
                begin = block * block_bytes
                ids = np.frombuffer(read_bytes(path, begin, min(block_bytes, length - begin)), dtype)
                at = np.flatnonzero(ids == end_id) + begin // width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([length // width]), pa.array([block]), pa.array([at.tolist()], pa.list_(pa.int64()))],
                    names=["path", "ids", "block", "ends"],
                )

    found = reliable_checkpoint(each_row_a_task(cut).mapInArrow(ends, "path string, ids long, block long, ends array<long>"))
    # the prefix scan: one small row per block
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own_last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    placed = found.select("path", "block", F.size("ends").cast("long").alias("n"), own_last.alias("end_")).select(
        "path", "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("closed_before"),
        F.coalesce(F.max("end_").over(before), F.lit(-1).cast("long")).alias("end_before"),
    )
    documents = found.join(placed, ["path", "block"])
    begins = F.concat(F.array("end_before"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    closed = documents.where("size(ends) > 0").select("path", "closed_before", F.posexplode(F.arrays_zip(begins.alias("b"), F.col("ends").alias("e"))))
    closed = closed.select(
        "path", (F.col("closed_before") + F.col("pos")).alias("ordinal"), (F.col("col.b") + 1).alias("start"),
        (F.col("col.e") - F.col("col.b") - 1).alias("n_tokens"), F.lit(True).alias("closed"),
    )
    tails = found.groupBy("path").agg(F.max("ids").alias("ids"), F.sum(F.size("ends")).alias("n"), F.max(own_last).alias("end_"))
    after = F.coalesce(F.col("end_"), F.lit(-1)) + 1
    tails = tails.where(F.col("ids") > after).select("path", F.col("n").alias("ordinal"), after.alias("start"), (F.col("ids") - after).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(tails)


def count_tokens(docs: DataFrame, encoder: Callable[[], Encoder], end_id: int) -> DataFrame:
    """``doc_id, file, ordinal, start, n_tokens, closed`` of every document, counted from flat files written for it."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    order = write_flat(docs, folder, encoder, end_id)
    # the file system tells lengths; the order table tells which files count
    sizes = list_files(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    named = order.select("path").distinct().withColumn("file", F.element_at(F.split("path", "/"), -1))
    files = reliable_checkpoint(named.join(sizes, "file").select("path", "length"))
    counted = scan(files, end_id)
    return order.join(counted, ["path", "ordinal"]).select(
        "doc_id", F.regexp_extract("path", r"tokens-\d+", 0).alias("file"), "ordinal", "start", "n_tokens", "closed"
    )
