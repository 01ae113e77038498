"""Substring dedup: paragraphs repeated in other documents, exactly or nearly, found by MinHash banding.

A paragraph is a line with at least ``WORDS`` words (white space apart, A-Z lower-cased); shorter lines say
nothing about copying.  Paragraphs with the same words are one class.  Bands of MinHash values over five-word
shingles are tuned so that two classes of Jaccard similarity ``SIMILAR`` share a band with probability
``RECALL`` at least.  Classes that share a band meet, are compared by their exact shingle sets, and linked ones
form components.  The first paragraph of a component (smallest id, null ids last, then place) stays; the
others are the removals.

Null, empty and blank texts have no paragraphs; rows with equal ids are separate documents; paragraphs
repeated within a document count as well.  Buckets of any size are compared whole, in blocks.

Lines are compared as wholes.  ``repeated_substrings`` also cuts paragraphs by content: in the words of a whole text,
whatever its line breaks, every run of ``LEAST`` words whose hash is the least of ``RUN - LEAST + 1`` neighbours is a
paragraph.  The cuts depend on nothing but the words around them, so that two texts that share ``RUN`` words in a row
share such a paragraph for certain.  These paragraphs may overlap, have one length and are met by equal words only;
near copies are found among the lines, of ``WORDS`` words and more as everywhere.

``repeated_passages`` adds to the lines what they cannot show: in the words of the lines that stay,
whatever the line breaks, every run of ``RUN`` words that stands earlier (same order of places) as well.  Words are
hashed in runs of ``GRAM``, the least hash of every ``RUN - GRAM + 1`` neighbours is an anchor, so that equal runs of
``RUN`` words have an anchor in common: nothing is missed.  Only texts with an anchor met twice are read again, and
there all runs of ``RUN`` words around such anchors are looked up by 128-bit hashes.  No pairs are formed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .common import WORD, ready, stream_runs
from .components import components
from .kneser_ney import chain
from .token_files import by_bytes

WORDS, SIMILAR, RECALL = 5, 0.8, 0.999
#: Share of pairs of similarity ``FAR`` that bands may bring together at most.
FAR, WASTE = 0.3, 0.5
#: Classes compared with each other at once; larger buckets are cut into blocks that meet pairwise.
BLOCK = 2048
#: Bits of the map that picks the paragraphs whose words are read again.
MAP_BITS = 1 << 22
#: Words of a repeated passage at least, and of the runs whose least hashes are its anchors.
RUN, GRAM = 50, 26
#: Words of a paragraph at least, where those cut by content count as well.
LEAST = 40
#: Bytes of text cut at a time, and words whose hashes a task remembers.
CUT_BYTES, REMEMBERED = 2 << 20, 400_000


def tune(similar: float = SIMILAR, recall: float = RECALL, far: float = FAR, waste: float = WASTE) -> tuple[int, int]:
    """Bands and values per band: the fewest bands that reach the recall without too many far pairs."""
    for rows in range(1, 30):
        bands = ceil(log(1 - recall) / log(1 - similar**rows))
        if 1 - (1 - far**rows) ** bands <= waste:
            return bands, rows
    raise ValueError("no bands reach this recall")


def split(text: str | None) -> list[tuple[int, int, int, list[bytes]]]:
    """Number, start and end (code points) and words of every line with ``WORDS`` words."""
    found, at = [], 0
    for k, line in enumerate((text or "").split("\n")):
        words = line.encode("utf-8", "surrogatepass").lower().split()
        if len(words) >= WORDS:
            found.append((k, at, at + len(line), words))
        at += len(line) + 1
    return found


def key_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def band_values(word_lists: list[list[bytes]], bands: int, rows: int) -> np.ndarray:
    """A hash for each band of each paragraph."""
    flat = np.array([xxhash.xxh64_intdigest(w) for words in word_lists for w in words], dtype=np.uint64)
    sizes = np.array([len(w) for w in word_lists], dtype=np.int64)
    n = len(flat) - WORDS + 1
    shingles = chain(np.stack([flat[k : n + k] for k in range(WORDS)], axis=1))
    ends = np.cumsum(sizes)
    whole = np.arange(n) + WORDS <= np.repeat(ends, sizes)[:n]  # does not reach into the next paragraph
    shingles = shingles[whole]
    starts = np.cumsum(sizes - WORDS + 1) - (sizes - WORDS + 1)
    found = np.zeros((len(sizes), bands), dtype=np.uint64)
    for b in range(bands):
        mins = []
        for r in range(rows):
            seed = np.uint64(xxhash.xxh64_intdigest(f"{b},{r}"))
            h = (shingles ^ seed) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            mins.append(np.minimum.reduceat(h ^ (h >> np.uint64(32)), starts))
        found[:, b] = chain(np.stack([np.full(len(sizes), b, dtype=np.uint64), *mins], axis=1))
    return found


def list_paragraphs(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``pid`` (unique), ``doc_id, paragraph, start, stop, n_words, key``, the document's ``did`` and a column for each band."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_pid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                found = [(d, *x, i) for d, t, i in zip(*(c.to_pylist() for c in part.columns)) for x in split(t)]
                if not found:
                    continue
                values = band_values([x[4] for x in found], bands, rows).view(np.int64)
                columns = [
                    pa.array(np.arange(next_pid, next_pid + len(found))),
                    *(pa.array([x[k] for x in found], pa.int64()) for k in range(4)),
                    pa.array([len(x[4]) for x in found], pa.int64()),
                    pa.array([key_of(x[4]) for x in found], pa.binary()),
                    pa.array([x[5] for x in found], pa.int64()),
                    *(pa.array(values[:, b]) for b in range(bands)),
                ]
                next_pid += len(found)
                yield pa.RecordBatch.from_arrays(columns, names=NAMES + [f"band{b}" for b in range(bands)])

    kinds = "pid long, doc_id long, paragraph long, start long, stop long, n_words long, key binary, did long, "
    return docs.select(F.col("doc_id").cast("long"), "text", "did").mapInArrow(run, kinds + ", ".join(f"band{b} long" for b in range(bands)))


NAMES = ["pid", "doc_id", "paragraph", "start", "stop", "n_words", "key", "did"]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by band value: those whose value occurs at least twice; nothing but the last row is held."""
    last, last_used = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, member = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        twin = np.zeros(len(bucket), dtype=bool)
        twin[1:] = bucket[1:] == bucket[:-1]
        joins_last = last is not None and last[0] == bucket[0]
        used = twin.copy()
        used[:-1] |= twin[1:]
        used[0] |= joins_last
        first = [last] if joins_last and not last_used else []
        at = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append([x[0] for x in first], bucket[at]).astype(np.int64)), pa.array(np.append([x[1] for x in first], member[at]).astype(np.int64))],
            names=["bucket", "id"],
        )
        last, last_used = (bucket[-1], member[-1]), bool(used[-1])


def forest(sets: list[set[bytes]], similar: float = SIMILAR) -> list[tuple[int, int]]:
    """Pairs that connect all sets linked by a Jaccard similarity of ``similar``; at most one for each set."""
    numbers: dict[bytes, int] = {}
    flat = np.array([numbers.setdefault(x, len(numbers)) for s in sets for x in s], dtype=np.int64)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    edges, unseen = [], np.ones(len(sets), dtype=bool)
    for seed in range(len(sets)):
        if not unseen[seed]:
            continue
        unseen[seed], frontier = False, [seed]
        while frontier and unseen.any():
            f = frontier.pop()
            mark = np.zeros(len(numbers), dtype=bool)
            mark[flat[starts[f] : starts[f] + sizes[f]]] = True
            common = np.add.reduceat(mark[flat].astype(np.int64), starts)
            near = np.flatnonzero(unseen & (common >= similar * (sizes + sizes[f] - common) - 1e-9))
            unseen[near] = False
            edges += [(f, int(k)) for k in near]
            frontier += near.tolist()
    return edges


def shingles_of(text: bytes) -> set[bytes]:
    words = text.split(b" ")
    return {b" ".join(words[k : k + WORDS]) for k in range(len(words) - WORDS + 1)}


def _compare(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    def emit(table: pa.Table, run: np.ndarray) -> pa.RecordBatch:
        ids, texts, edges = table["id"].to_numpy(), table["words"].to_pylist(), []
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(run)]):
            if b - a > 1:
                edges += [(ids[a + i], ids[a + j]) for i, j in forest([shingles_of(t) for t in texts[a:b]], similar)]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64())], names=["a", "b"])

    return stream_runs(batches, ["bucket", "lo", "hi"], emit)


def _bits_of(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([k[:8] for k in keys]), "<u8") % np.uint64(MAP_BITS)


def bit_map(keys: DataFrame) -> Broadcast:
    """A broadcast map, of fixed size, with a bit for each key of the only column."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(MAP_BITS, dtype=bool)
        for batch in batches:
            mask[_bits_of(batch.column(0).to_pylist())] = True
        packed = np.packbits(mask, bitorder="little").view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], names=["at", "m"])

    rows = keys.mapInArrow(bits, "at long, m long").groupBy("at").agg(F.bit_or("m").alias("m")).collect()
    packed = np.zeros(MAP_BITS // 64, dtype=np.int64)
    for r in rows:
        packed[r["at"]] = r["m"]
    return keys.sparkSession.sparkContext.broadcast(packed)


def words_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """``id, words`` of the classes ``(id, key)``, read from the documents again.

    A bit map of the keys, of fixed size, goes to every task and leaves out most other paragraphs there.
    """

    shared = bit_map(needed.select("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(shared.value.view(np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            found = {}
            for text in batch.column(0).to_pylist():
                for *_, words in split(text):
                    found.setdefault(key_of(words), words)
            keys = list(found)
            chosen = [k for k, ok in zip(keys, mask[_bits_of(keys)] if keys else []) if ok]
            yield pa.RecordBatch.from_arrays(
                [pa.array(chosen, pa.binary()), pa.array([b" ".join(found[k]) for k in chosen], pa.binary())], names=["key", "words"]
            )

    read = docs.select("text").mapInArrow(run, "key binary, words binary")
    # equal keys have equal words
    return read.join(needed, "key").groupBy("id").agg(F.max("words").alias("words"))


def linked_classes(docs: DataFrame, classes: DataFrame, bands: int, similar: float) -> DataFrame:
    """Edges ``(a, b)`` that connect all classes linked by their shingles' similarity."""
    probes = classes.select("id", F.explode(F.array(*[f"band{b}" for b in range(bands)])).alias("bucket"))
    met = probes.select("bucket", "id").repartition("bucket").sortWithinPartitions("bucket")
    met = reliable_checkpoint(met.mapInArrow(_shared, "bucket long, id long"))
    # buckets with the same members are compared once
    named = met.groupBy("bucket").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64(F.lit(1), "id") % (1 << 30)).alias("s")
    )
    once = named.groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    members = reliable_checkpoint(met.join(once, "bucket"))
    needed = reliable_checkpoint(classes.select("id", "key").join(members.select("id").distinct(), "id"))
    words = words_of(docs, needed)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "id"
    )
    rows = dealt.join(words, "id").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return rows.mapInArrow(partial(_compare, similar=similar), "a long, b long")


def repeated_paragraphs(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The paragraphs to remove: ``doc_id, paragraph, start, stop, n_words`` and where the one that stays is found
    (``kept_doc_id, kept_paragraph``); ``exact`` tells that the words are the same."""
    return _removed_lines(docs.select("doc_id", "text", F.lit(0).cast("long").alias("did")), similar).drop("did")


def _removed_lines(docs: DataFrame, similar: float) -> DataFrame:
    """``repeated_paragraphs`` of ``doc_id, text, did``, with ``did``."""
    bands, rows = tune(similar)
    listed = reliable_checkpoint(list_paragraphs(docs, bands, rows))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pid", "paragraph")
    classes = reliable_checkpoint(
        listed.groupBy("key").agg(
            F.min("pid").alias("id"), F.count("*").alias("n"), F.min(place).alias("first"), *[F.max(f"band{b}").alias(f"band{b}") for b in range(bands)]
        )
    )
    found = components(linked_classes(docs, classes, bands, similar)).withColumnRenamed("node", "id")
    placed = classes.select("id", "key", "n", "first").join(found, "id", "left").where("n > 1 or root is not null")
    placed = reliable_checkpoint(placed.withColumn("root", F.coalesce("root", "id")))
    stay = placed.groupBy("root").agg(F.min("first").alias("stays"))
    doomed = placed.join(stay, "root").select("key", "first", "stays")
    return (
        listed.select(*NAMES)
        .join(doomed, "key")
        .where(F.col("pid") != F.col("stays.pid"))
        .select(
            "doc_id", "paragraph", "start", "stop", "n_words",
            F.col("stays.doc_id").alias("kept_doc_id"), F.col("stays.paragraph").alias("kept_paragraph"),
            (F.col("first") == F.col("stays")).alias("exact"), "did",
        )
    )


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` words in a row, put together from runs of 1, 2, 4 ... words."""
    found, offset, size, level = None, 0, 1, hashes
    while size <= n:
        if n & size:
            part = level[offset : offset + len(hashes) - n + 1]
            found = part if found is None else chain(np.stack([found, part], axis=1))
            offset += size
        size *= 2
        if size <= n:
            level = chain(np.stack([level[: -(size // 2)], level[size // 2 :]], axis=1))
    return found


class WordHashes(dict):
    """Hashes of words, remembered up to ``REMEMBERED`` of them."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def cut_texts(texts: pa.Array, word_hash: WordHashes) -> list[np.ndarray]:
    """The paragraphs cut by content of many texts: row, hash, number of the first word, line of it, start and stop.

    The texts lie one behind the other in one array of bytes, with a line break behind each.
    """
    if len(word_hash) > REMEMBERED:
        word_hash.clear()
    parts = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    joined = b"\n".join([*parts, b""])
    flat = np.frombuffer(joined, dtype=np.uint8)
    text_end = np.cumsum([len(x) + 1 for x in parts])
    hashes = np.fromiter(map(word_hash.__getitem__, joined.lower().split()), dtype=np.uint64)
    inside = ~((flat == 32) | ((flat >= 9) & (flat <= 13)))
    edges = np.flatnonzero(np.diff(inside, prepend=False))  # words start and end in turn; a line break ends the last
    first, last = edges[::2], edges[1::2]
    to = np.searchsorted(first, text_end)  # words up to the end of each text
    begin = np.append(0, to[:-1])
    n_runs = np.maximum(to - begin - LEAST + 1, 0)
    if not n_runs.any():
        return [np.zeros(0, dtype=np.int64)] * 6
    width = RUN - LEAST + 1
    # runs that reach into the next text count as greatest: the window of a short text sees no other text
    runs = np.full(len(hashes) + width, np.iinfo(np.uint64).max)
    own = np.arange(int(n_runs.sum())) + np.repeat(begin - (np.cumsum(n_runs) - n_runs), n_runs)
    runs[own] = run_hashes(hashes, LEAST)[own]
    n_windows = np.where(n_runs > 0, np.maximum(n_runs - width + 1, 1), 0)
    opens = np.arange(int(n_windows.sum())) + np.repeat(begin - (np.cumsum(n_windows) - n_windows), n_windows)
    at = np.unique(opens + sliding_window_view(runs, width)[opens].argmin(axis=1))
    row = np.searchsorted(to, at, side="right")
    text_start = np.append(0, text_end[:-1])[row]
    points = np.append(0, np.cumsum((flat & 0xC0) != 0x80))  # code points before each byte
    lines = np.append(0, np.cumsum(flat == 10))
    start, stop = first[at], last[at + LEAST - 1]
    place = [lines[start] - lines[text_start], points[start] - points[text_start], points[stop] - points[text_start]]
    return [row, runs[at].view(np.int64), at - begin[row], *place]


def list_cut_paragraphs(docs: DataFrame) -> DataFrame:
    """``hash, did`` (unique), ``doc_id``, number of the first word, line of it, start and stop of the paragraphs cut by content."""
    ready(docs.sparkSession)
    names = ["hash", "did", "doc_id", "at", "paragraph", "start", "stop"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        did, word_hash = TaskContext.get().partitionId() << 40, WordHashes()
        for batch in batches:
            for part in by_bytes(batch, most=CUT_BYTES):
                row, *found = cut_texts(part.column(1), word_hash)
                columns = [found[0], did + 1 + row, part.column(0).take(pa.array(row)), *found[1:]]
                did += part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def repeated_substrings(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``repeated_paragraphs`` (``whole_line`` true, all lines of ``WORDS`` words), and the passages of paragraphs cut by content that
    stand earlier as well, by document id (null ids last), row and place.

    Such a passage may reach over line ends (``paragraph`` is the line it starts in) and joins the repeated paragraphs of a document
    that overlap or touch and stand in the same earlier document; ``kept_paragraph`` is the line where the first of them stands there.
    Passages and lines may overlap: the union is removed.  Null, empty and shorter texts have none.
    """
    lines = _removed_lines(docs.select("doc_id", "text", F.lit(0).cast("long").alias("did")), similar).drop("did")
    listed = reliable_checkpoint(list_cut_paragraphs(docs))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "did", "at", "paragraph")
    first = reliable_checkpoint(listed.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    # a paragraph may share words with its own first place only in another document
    later = listed.join(first, "hash").where(f"did <> first.did or at >= first.at + {LEAST}")
    in_order = Window.partitionBy("did", "first.did").orderBy("at")
    passages = (
        later.withColumn("opens", (F.col("at") > F.coalesce(F.lag("at").over(in_order), F.lit(-LEAST - 1)) + LEAST).cast("long"))
        .withColumn("passage", F.sum("opens").over(in_order))
        .groupBy("did", F.col("first.did").alias("first_did"), "passage")
        .agg(
            F.first("doc_id").alias("doc_id"), F.min("paragraph").alias("paragraph"), F.min("start").alias("start"), F.max("stop").alias("stop"),
            (F.max("at") - F.min("at") + LEAST).alias("n_words"), F.first("first.doc_id").alias("kept_doc_id"),
            F.min_by("first.paragraph", "at").alias("kept_paragraph"),
            (F.max(F.col("first.at") - F.col("at")) == F.min(F.col("first.at") - F.col("at"))).alias("exact"),
        )
        .drop("did", "first_did", "passage")
    )
    return lines.withColumn("whole_line", F.lit(True)).unionByName(passages.withColumn("whole_line", F.lit(False)))


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` words in a row."""
    return chain(sliding_window_view(hashes, n))


def anchors(grams: np.ndarray) -> np.ndarray:
    """Places of the least of every ``RUN - GRAM + 1`` neighbours, the first of equal ones."""
    near = sliding_window_view(grams, RUN - GRAM + 1)
    return np.unique(near.argmin(axis=1) + np.arange(len(near)))


def list_anchors(texts: DataFrame) -> DataFrame:
    """``hash, did`` and the lines of the first and last word for every anchor of ``did, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for did, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = [x.split() for x in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]
                hashes = np.array([xxhash.xxh64_intdigest(w) for words in lines for w in words], dtype=np.uint64)
                if len(hashes) < RUN:
                    continue
                line = np.repeat(np.arange(len(lines)), [len(words) for words in lines])
                grams = rolled(hashes, GRAM)
                at = anchors(grams)
                columns = [grams[at].view(np.int64), np.full(len(at), did), line[at], line[at + GRAM - 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["hash", "did", "head", "tail"])

    return texts.select("did", "text").mapInArrow(run, "hash long, did long, head long, tail long")


def runs_of(text: str, gone: list[int], wanted: list[int]) -> list[np.ndarray]:
    """Two hashes, first word's number, line, start and end (code points) of every run of ``RUN`` words around a wanted anchor
    that has no word in the lines ``gone``."""
    spans = np.array([m.span() for m in re.finditer(WORD, text)], dtype=np.int64)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in text.encode("utf-8", "surrogatepass").lower().split()], dtype=np.uint64)
    line = np.searchsorted([m.start() for m in re.finditer("\n", text)], spans[:, 0])
    stays = ~np.isin(line, gone)
    grams, marks = rolled(hashes, GRAM), np.zeros(len(hashes) - GRAM + 1, dtype=bool)
    marks[anchors(grams)] = True
    marks &= np.isin(grams.view(np.int64), np.array(wanted, dtype=np.int64))
    at = np.flatnonzero(sliding_window_view(marks, RUN - GRAM + 1).any(axis=1) & sliding_window_view(stays, RUN).all(axis=1))
    words = sliding_window_view(hashes, RUN)[at]
    return [chain(words).view(np.int64), chain(words[:, ::-1]).view(np.int64), at, line[at], spans[at, 0], spans[at + RUN - 1, 1]]


def _merge_runs(table: pa.Table) -> pa.Table:
    """Runs of a document that follow each other and stand in the same document as one passage."""
    table = table.sort_by("at")
    at, to, to_at = (table[c].to_numpy() for c in ("at", "first_did", "first_at"))
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (to[1:] != to[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    head, tail = table.take(pa.array(heads)), table.take(pa.array(tails))
    bent = np.append(0, np.cumsum(np.append(False, np.diff(to_at) != 1) & ~new))
    columns = {
        "doc_id": head["doc_id"], "paragraph": head["paragraph"], "start": head["start"], "stop": tail["stop"],
        "n_words": pa.array(at[tails] - at[heads] + RUN), "kept_doc_id": head["first_doc_id"], "kept_paragraph": head["first_paragraph"],
        "exact": pa.array(bent[tails + 1] == bent[heads]),
    }
    return pa.table(columns)


def repeated_passages(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``repeated_paragraphs`` (``whole_line`` true) and the passages to remove from the lines that stay.

    A passage has ``RUN`` words at least, may reach over line ends (``paragraph`` is the line it starts in), and every
    ``RUN`` words of it stand in the document ``kept_doc_id``; ``exact`` tells that they do so in one piece.  Passages of a
    document that stand in different documents may overlap: the union is removed.
    """
    ready(docs.sparkSession)
    held = reliable_checkpoint(docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("did")))
    lines = reliable_checkpoint(_removed_lines(held, similar))
    gone = lines.select("did", F.col("paragraph").alias("line")).distinct()
    listed = list_anchors(held)
    for end in ("head", "tail"):
        listed = listed.join(gone.withColumnRenamed("line", end), ["did", end], "left_anti")
    listed = reliable_checkpoint(listed.select("hash", "did"))
    twice = listed.groupBy("hash").count().where("count > 1").select("hash")
    met = reliable_checkpoint(listed.join(twice, "hash").groupBy("did").agg(F.collect_set("hash").alias("wanted")))
    mark = F.unhex(F.lpad(F.hex(F.xxhash64("did")), 16, "0"))
    shared = bit_map(met.select(mark))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(shared.value.view(np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(mask[_bits_of(batch.column(3).to_pylist())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for did, doc_id, text, wanted, out in zip(*(c.to_pylist() for c in batch.columns)):
                first, second, *found = runs_of(text, out or [], wanted)
                columns = [first, second, np.full(len(first), did), pa.array([doc_id] * len(first), pa.int64()), *found]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h1", "h2", "did", "doc_id", "at", "paragraph", "start", "stop"])

    near = held.select("did", "doc_id", "text", mark.alias("mark"))
    near = near.mapInArrow(pick, "did long, doc_id long, text string, mark binary").drop("mark").join(met, "did")
    near = near.join(gone.groupBy("did").agg(F.collect_list("line").alias("out")), "did", "left")
    kinds = "h1 long, h2 long, did long, doc_id long, at long, paragraph long, start long, stop long"
    runs = reliable_checkpoint(near.select("did", "doc_id", "text", "wanted", "out").mapInArrow(run, kinds))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "did", "at", "paragraph")
    first = runs.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a run may share words with its own first place only in another document
    later = runs.join(first, ["h1", "h2"]).where(f"did <> first.did or at >= first.at + {RUN}")
    later = later.select(*["did", "doc_id", "at", "paragraph", "start", "stop"], *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "did", "at", "paragraph")])
    kinds = "doc_id long, paragraph long, start long, stop long, n_words long, kept_doc_id long, kept_paragraph long, exact boolean"
    passages = later.groupBy("did").applyInArrow(_merge_runs, kinds)
    return lines.drop("did").withColumn("whole_line", F.lit(True)).unionByName(passages.withColumn("whole_line", F.lit(False)))
