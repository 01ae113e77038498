"""SimHash near-duplicates by a generalised pigeonhole search.

The 64 bits are grouped into partitions of correlated bits.  Two fingerprints that differ in at most
``distance`` bits differ in at most ``t_i`` bits of some partition ``i`` whenever the thresholds add up to
``distance - partitions + 1``; a partition may be left out with threshold -1.  Thresholds are allotted by
dynamic programming on the number of pairs that every partition would bring up, counted over all
fingerprints.  Candidates meet in the buckets of partition values and are verified there on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .common import bytes_list, ready, stream_runs, text_bytes
from .components import components

SEED = 42
#: Cost of shuffling a row of the probe table, in verified pairs.
ROW_COST = 200
#: Numbers of partitions that are weighed up, and the bits whose values are counted at a time.
PARTITIONS, CHUNK = (2, 3, 4, 5), 16
#: A bucket with more rows is split into blocks that meet pairwise.
BLOCK = 4096
#: Runs up to this length are compared by shifted copies, longer ones by a search through the run.
SHORT = 48


def fingerprint(text: bytes, words: int, seed: int = SEED) -> bytes:
    """64 bits, big-endian: bit set if more than half of the shingles' XXH64 have it; zero without words."""
    found = text.lower().split()
    if not found:
        return bytes(8)
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_digest
    spans = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())
    raw = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in spans]), np.uint8)
    bits = np.unpackbits(raw).reshape(-1, 64)
    ones = sum(bits[k : k + 60_000].sum(axis=0, dtype=np.uint16).astype(np.int64) for k in range(0, len(bits), 60_000))
    return np.packbits(2 * ones > len(bits)).tobytes()


def fingerprints(docs: DataFrame, words: int, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed 64-bit number."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join([fingerprint(x, words) for x in bytes_list(batch.column(len(keep)))])
            fp = pa.array(np.frombuffer(raw, ">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], fp], names=[*batch.schema.names[: len(keep)], "fp"])

    chosen = docs.select(*keep, text_bytes(text).alias("text__bytes"))
    schema = chosen.drop("text__bytes").schema.add("fp", "long")
    return chosen.mapInArrow(run, schema)


# --- partitions and thresholds ---------------------------------------------------------------------


def _bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def correlations(prints: DataFrame) -> np.ndarray:
    """Absolute correlation of every two of the 64 bits over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), dtype=np.int64)
        for batch in batches:
            bits = _bit_matrix(batch.column(0).to_numpy()).astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
        i, j = np.divmod(np.arange(4096), 64)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "n"])

    rows = prints.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    n, both = prints.count(), np.zeros((64, 64))
    for r in rows:
        both[r.i, r.j] = r.n
    mean = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return np.abs((both / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread))


def group_bits(similar: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of nearly equal width: each starts with the most entangled bit left and takes the bits closest to it."""
    left, groups = list(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        group = [max(left, key=lambda b: similar[b, left].sum())]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(left, key=lambda b: similar[b, group].mean()))
            left.remove(group[-1])
        groups.append(group)
    return groups


def _values(bits: np.ndarray, group: list[int]) -> np.ndarray:
    return bits[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64))


def _transform(counts: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform."""
    h = 1
    while h < len(counts):
        pairs = counts.reshape(-1, 2, h)
        counts = np.stack([pairs[:, 0] + pairs[:, 1], pairs[:, 0] - pairs[:, 1]], axis=1).ravel()
        h *= 2
    return counts


def distances(prints: DataFrame, chunks: list[list[int]]) -> dict[int, np.ndarray]:
    """For each chunk of bits: the share of all pairs of fingerprints at every distance within the chunk."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << len(c), dtype=np.int64) for c in chunks]
        for batch in batches:
            bits = _bit_matrix(batch.column(0).to_numpy())
            for c, t in zip(chunks, total):
                t += np.bincount(_values(bits, c), minlength=len(t))
        for k, t in enumerate(total):
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(t[at])], names=["chunk", "value", "n"])

    def spread(key, table):
        k = key[0].as_py()
        counts = np.zeros(1 << len(chunks[k]))
        np.add.at(counts, table["value"].to_numpy(), table["n"].to_numpy())
        pairs = _transform(_transform(counts) ** 2) / len(counts)
        by = np.bincount(np.bitwise_count(np.arange(len(pairs))), weights=pairs, minlength=len(chunks[k]) + 1)
        share = np.maximum(by, 0) / max(counts.sum() ** 2, 1)
        return pa.table({"chunk": np.full(len(share), k), "d": np.arange(len(share)), "share": share})

    counted = prints.select("fp").mapInArrow(count, "chunk long, value long, n long")
    rows = counted.groupBy("chunk").applyInArrow(spread, "chunk long, d long, share double").collect()
    found = {k: np.zeros(len(c) + 1) for k, c in enumerate(chunks)}
    for r in rows:
        found[r.chunk][r.d] = r.share
    return found


def allot(n: int, widths: list[int], shares: list[np.ndarray], distance: int) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost that add up to ``distance - partitions + 1``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for width, share in zip(widths, shares):
        reached = np.cumsum(share)
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                if used + t + 1 > distance + 1 or t > width:
                    break
                rows = n * sum(comb(width, k) for k in range(t + 1))
                own = cost + ROW_COST * rows + (n * n * reached[t] if t >= 0 else 0)
                key = used + t + 1
                if key not in after or own < after[key][0]:
                    after[key] = (own, [*chosen, t])
        best = after
    return best[distance + 1]


def plan_search(prints: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """The cheapest partitions with their thresholds: ``[(bits, threshold)]``, those left out omitted."""
    n, similar = prints.count(), correlations(prints)
    options = [group_bits(similar, m) for m in PARTITIONS if m <= distance + 1] or [group_bits(similar, 2)]
    chunks = [g[k : k + CHUNK] for groups in options for g in groups for k in range(0, len(g), CHUNK)]
    share_of = distances(prints, chunks)
    found, k = [], 0
    for groups in options:
        shares = []
        for g in groups:
            share = np.ones(1)
            for _ in range(0, len(g), CHUNK):  # wider partitions: chunks taken as independent
                share, k = np.convolve(share, share_of[k]), k + 1
            shares.append(share)
        found.append((*allot(n, [len(g) for g in groups], shares, distance), groups))
    _, thresholds, groups = min(found, key=lambda x: x[0])
    return [(g, t) for g, t in zip(groups, thresholds) if t >= 0]


# --- probe and verify ------------------------------------------------------------------------------


def _probes(batches: Iterator[pa.RecordBatch], plan: list[tuple[list[int], int]]) -> Iterator[pa.RecordBatch]:
    """A row for each partition value a fingerprint stands in, and for each larger value within the threshold."""
    for batch in batches:
        fps = batch.column(0).to_numpy()
        bits = _bit_matrix(fps)
        for k, (group, t) in enumerate(plan):
            own = _values(bits, group)
            for size in range(t + 1):
                for flipped in combinations(range(len(group)), size):
                    value = own ^ sum(1 << b for b in flipped)
                    up = value >= own if not size else value > own
                    if up.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array((np.int64(k) << 40) + value[up]), pa.array(fps[up]), pa.array(np.full(up.sum(), size > 0))],
                            names=["bucket", "fp", "probe"],
                        )


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all fingerprints linked within a run, at most one for each of them."""
    unseen, a, b = np.arange(len(fps)), [], []
    while len(unseen) > 1:
        frontier, unseen = unseen[:1], unseen[1:]
        while len(frontier) and len(unseen):
            fresh = []
            for k in range(0, len(frontier), 128):
                near = np.bitwise_count(fps[frontier[k : k + 128], None] ^ fps[unseen][None, :]) <= distance
                hit = near.any(axis=0)
                if hit.any():
                    a.append(frontier[k + near[:, hit].argmax(axis=0)])
                    b.append(unseen[hit])
                    fresh.append(unseen[hit])
                    unseen = unseen[~hit]
            frontier = np.concatenate(fresh) if fresh else unseen[:0]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def link_runs(run: np.ndarray, fps: np.ndarray, probe: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal numbers; every two linked members of a run end up connected."""
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    lengths = np.diff(np.append(starts, len(run)))
    edges_a, edges_b = [], []
    short = np.repeat(lengths <= SHORT, lengths)
    x, f, p = run[short], fps[short], probe[short]
    for d in range(1, int(lengths[lengths <= SHORT].max(initial=1))):
        near = (x[d:] == x[:-d]) & ~(p[d:] & p[:-d])
        near &= np.bitwise_count(f[d:] ^ f[:-d]) <= distance
        at = np.flatnonzero(near)
        edges_a.append(f[at])
        edges_b.append(f[at + d])
    for s, n in zip(starts[lengths > SHORT], lengths[lengths > SHORT]):
        own = fps[s : s + n]
        i, j = forest(own, distance)
        edges_a.append(own[i])
        edges_b.append(own[j])
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *edges_a]), np.concatenate([none, *edges_b])


def _verify(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and blocks."""

    def emit(table: pa.Table, run: np.ndarray) -> pa.RecordBatch:
        a, b = link_runs(run, table["fp"].to_numpy().view(np.uint64), table["probe"].to_numpy(), distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return stream_runs(batches, ["bucket", "lo", "hi"], emit)


def links(prints: DataFrame, distance: int) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column ``fp``) at most ``distance`` bits apart.

    Not every pair is listed, but any two linked fingerprints are connected by listed links.
    """
    probes = prints.select("fp").mapInArrow(
        partial(_probes, plan=plan_search(prints, distance)), "bucket long, fp long, probe boolean"
    )
    sizes = probes.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    hot = sizes.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = probes.join(hot, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "probe"
    )
    runs = met.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return runs.mapInArrow(partial(_verify, distance=distance), "a long, b long")


def near_duplicates(docs: DataFrame, words: int, distance: int, *keep: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the columns ``keep``, ``fp`` and ``component_id`` of every row.

    Two rows link if their fingerprints over ``words``-word shingles differ in at most ``distance`` bits;
    the component is named by its smallest id (null ids count as largest, null if it has no other).
    Null, empty and blank texts have fingerprint zero.  Rows with equal ids stay separate rows.
    """
    prints = reliable_checkpoint(fingerprints(docs.withColumnRenamed(doc_id, "doc_id"), words, "doc_id", *keep, text=text))
    classes = reliable_checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(classes, distance))
    placed = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = reliable_checkpoint(placed)
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(placed.join(names, "root").select("fp", "component_id", "root"), "fp")


def one_of_each(docs: DataFrame, words: int, distance: int) -> DataFrame:
    """The documents with one of every group of near-duplicates, the columns unchanged.

    The one with the smallest id stays (null ids last; equal ids: the smallest hash of the whole row;
    equal rows: one of them).
    """
    row = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    marked = docs.withColumn("row__hash", row)
    found = near_duplicates(marked, words, distance, "row__hash")
    first = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id__"), F.col("row__hash").alias("h__"))).alias("first")
    )
    stay = first.select("first.id__", "first.h__")
    kept = marked.join(stay, marked["doc_id"].eqNullSafe(stay["id__"]) & (marked["row__hash"] == stay["h__"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "row__hash"]).select(*[f"`{c}`" for c in docs.columns])
