"""Token-ID / binary output: ids ranked by frequency, in bytes of variable length with separate control bytes.

A file holds documents in ascending ``doc_id`` order; the files of a folder, in order of their number, hold
the whole table in that order.  One file, all numbers little-endian::

    8 x int64   magic, documents, ids, distinct ids, control bytes, data bytes, 0, 0
    int64       doc_id of each document        uint8   1 where the doc_id is null
    int64       number of ids of each document
    uint32      the distinct ids, most frequent first: the rank is what the data hold
    control     two bits for each rank: its length in bytes less one, four ranks to a byte
    data        the ranks, lowest byte first, without leading zero bytes

Ranks are counted over the whole file that uses them, so every file can be decoded alone and
one pass over the texts is enough.  A file is bounded by the ids a task may hold (``FILE_IDS``),
longer partitions make several.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint, shared_folder
from .common import each_row_a_task, read_bytes, ready, write_bytes
from .tokenize import Encoder

MAGIC = 0x31304C5242454C54
#: Ids in a file, at least; a file ends with the batch that reaches them.
FILE_IDS = 4_000_000
#: Texts encoded at once, by bytes.
BATCH_BYTES = 12 << 20
#: Ids packed at once; the temporary arrays of a whole file would take some hundred bytes for each id.
PACKED = 1 << 18

# lengths of the four ranks that a control byte describes, and their sum
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, most frequent first (ties: smaller id first), control bytes and data bytes."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, dtype=np.int64)
    present = np.flatnonzero(counts)
    ranked = present[np.argsort(-counts[present], kind="stable")].astype("<u4")
    rank_of = np.zeros(len(counts), dtype="<u4")
    rank_of[ranked] = np.arange(len(ranked))
    ranks = rank_of[ids]
    less_one = np.zeros(-(-len(ids) // 4) * 4, dtype=np.uint8)
    for limit in (0xFF, 0xFFFF, 0xFFFFFF):
        if len(ranked) > limit + 1:
            less_one[: len(ids)] += ranks > limit
    quads = less_one.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = np.empty(len(ids) + int(less_one.sum()), dtype=np.uint8)
    end = 0
    for a in range(0, len(ids), PACKED):
        some = ranks[a : a + PACKED]
        lengths = less_one[a : a + len(some)].astype(np.int64) + 1
        begin = end + np.cumsum(lengths) - lengths
        for k in range(int(lengths.max(initial=0))):
            has = lengths > k
            data[begin[has] + k] = (some[has] >> (8 * k)).astype(np.uint8)
        end += int(lengths.sum())
    return ranked, control, data


def unpack(ranked: np.ndarray, control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ids again; lengths come from a table with an entry for each control byte."""
    lengths = LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    ranks = data[begin].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        has = np.flatnonzero(lengths > k)
        ranks[has] |= data[begin[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranked[ranks]


def file_parts(doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    ranked, control, data = pack(ids)
    head = np.array([MAGIC, len(counts), len(ids), len(ranked), len(control), len(data), 0, 0], dtype="<i8")
    null = np.asarray(doc_ids.is_null()).astype(np.uint8)
    numbers = doc_ids.fill_null(0).to_numpy().astype("<i8")
    return [head, numbers, null, counts.astype("<i8"), ranked, control, data]


def parse_file(raw: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, null flags, numbers of ids and all ids of a file."""
    head = np.frombuffer(raw, "<i8", 8)
    if head[0] != MAGIC:
        raise ValueError("not a token file")
    at, found = 64, []
    for kind, n in (("<i8", head[1]), ("u1", head[1]), ("<i8", head[1]), ("<u4", head[3]), ("u1", head[4]), ("u1", head[5])):
        found.append(np.frombuffer(raw, kind, int(n), at))
        at += found[-1].nbytes
    doc_ids, null, counts, ranked, control, data = found
    return doc_ids, null, counts, unpack(ranked, control, data, int(head[2]))


def write_token_files(
    docs: DataFrame, folder: str, encoder: Callable[[], Encoder], end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode every text, append ``end_id`` to each and write the files; returns one row per file.

    Null and empty texts give a document of the end id alone; a null id comes first and stays null;
    rows with equal ids stay separate documents, ordered by text.  Other columns are not read.
    An empty table gives no file.  Rows: ``part, seq`` (the files' order), ``path, n_docs, n_ids``.
    """
    ready(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            counts = np.concatenate([c for _, c, _ in held])
            ids = np.concatenate([i for _, _, i in held])
            numbers = pa.concat_arrays([d for d, _, _ in held])
            path = write_bytes(folder, f"{part:08d}-{seq:06d}", file_parts(numbers, counts, ids))
            row = {"part": [part], "seq": [seq], "path": [path], "n_docs": [len(counts)], "n_ids": [len(ids)]}
            return pa.RecordBatch.from_pydict(row, schema=MANIFEST)

        for batch in batches:
            for slice_ in by_bytes(batch):
                ids, counts = encoder().batch(slice_.column(1))
                # the end id goes behind every document
                ids = np.insert(ids, np.cumsum(counts), end_id) if len(counts) else ids
                held.append((slice_.column(0), counts + 1, ids))
                size += len(ids)
                if size >= FILE_IDS:
                    yield flush()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield flush()

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = chosen.repartitionByRange(F.col("doc_id"), F.length("text")).sortWithinPartitions("doc_id", "text")
    return reliable_checkpoint(ordered.mapInArrow(write, "part long, seq long, path string, n_docs long, n_ids long"))


MANIFEST = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def by_bytes(batch: pa.RecordBatch, column: int = 1, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes (``BATCH_BYTES``) of text each, a longer text alone."""
    sizes = np.array([0 if x is None else x for x in pa.compute.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // (most or BATCH_BYTES), prepend=0))
    for a, b in zip([0, *cuts], [*cuts, len(sizes)]):
        if b > a:
            yield batch.slice(a, b - a)


def read_token_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Decode the files of a manifest: one row per document.

    ``doc_id, start`` (ids of all documents before it in all files), ``n_tokens`` (with the end id),
    ``ids_crc32`` (of its ids as little-endian unsigned 32-bit numbers), and ``ids`` if asked for.
    """
    ready(files.sparkSession)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [int(np.frombuffer(read_bytes(p, 0, 64), "<i8")[2]) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64())], names=["part", "seq", "path", "held"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids, null, counts, ids = parse_file(read_bytes(path))
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                columns = [pa.array(doc_ids, mask=null.astype(bool)), pa.array(before + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.LargeListArray.from_arrays(np.append(0, ends), ids.astype(np.int32)).cast(pa.list_(pa.int32())))
                    names.append("ids")
                yield from pa.Table.from_arrays(columns, names).to_batches(max_chunksize=5000 if with_ids else 100_000)

    listed = each_row_a_task(files.select("part", "seq", "path")).mapInArrow(heads, "part long, seq long, path string, held long")
    # one row per file: the only ordering of the whole table is of its files
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = listed.select("path", F.coalesce(F.sum("held").over(order), F.lit(0)).alias("before"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return each_row_a_task(placed).mapInArrow(decode, schema)


def token_output(docs: DataFrame, encoder: Callable[[], Encoder], end_id: int) -> DataFrame:
    """Write all documents as token files in a folder on shared storage and read them back."""
    return read_token_files(write_token_files(docs, shared_folder(docs.sparkSession), encoder, end_id))
