"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, mapped by workers.

Counting.  Every task hashes its tokens (XXH64) and counts the n-grams of its documents in numpy; they go
through the shuffle as sorted blocks, one for each part of the hash space of the context.  The most frequent
words (``BOOK`` at most, found by a first count of all words) take two bytes there, the others their hash.  The task of a part
merges its blocks, writes the part's arrays and passes on the distinct n-grams without their first token, whose
number is the continuation count of the next lower order - and so on down to single tokens.  Orders lie in
the same number of parts, which grows with the text, so no task holds more than a part.

Files.  A part of an order is one file: sorted n-gram hashes with their counts, and sorted context hashes
with their totals and the numbers of their n-grams counted once, twice and more often.  Of a hash 48 bits are kept: an
unknown n-gram passes for a known one about once in 2^48 / (n-grams of a part, a million) look-ups.  The figures take one
byte, the place in the file's book of its 255 most frequent figures; others stand in full behind it.  Files lie in
the shared folder; workers map them, from a local copy that Spark distributes if the folder is no mounted one.
The counts of an order are deleted as soon as the files of the next one are written.

Scoring.  A text is its words and one end token.  The probability of a token is the discounted count of its
n-gram plus the left-over mass of the context times the probability of one order less; single tokens go over
into a uniform share of all tokens known and one unknown.  A context never seen passes all mass on.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import passing_checkpoint, remove, shared_folder
from .common import bytes_list, ready, text_bytes, write_bytes

ORDER = 3
#: Bytes of training text to a part.
PART_BYTES = 12 << 20
#: Texts hashed at a time, and scored at a time.
TEXTS, SCORED = 500, 1000
#: Words with a short code in the shuffle; the last code of two bytes stands for all others.
BOOK = (1 << 16) - 1
END, START = xxhash.xxh64_intdigest(b"\n end"), xxhash.xxh64_intdigest(b"\n start")  # no word has white space
MIX, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text, A-Z lower-cased, an end token behind each; and the tokens of each text."""
    digest, end, found, sizes = xxhash.xxh64_digest, END.to_bytes(8, "big"), [], []
    for t in texts:
        words = t.lower().split()
        found += map(digest, words)
        found.append(end)
        sizes.append(len(words) + 1)
    return np.frombuffer(b"".join(found), ">u8").astype(np.uint64), np.array(sizes, dtype=np.int64)


def windows(flat: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` tokens that end at each token, earlier ones first, start tokens before a text."""
    found = np.full((len(flat), order), START, dtype=np.uint64)
    found[:, -1] = flat
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    for back in range(1, order):
        has = np.flatnonzero(place >= back)
        found[has, order - 1 - back] = flat[has - back]
    return found


def _step(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    h = (h ^ words) * MIX
    h ^= h >> np.uint64(29)
    h *= TURN
    h ^= h >> np.uint64(32)
    return h


def chain(columns: np.ndarray) -> np.ndarray:
    """A hash of each row of tokens; 0 columns hash to 0."""
    h = np.zeros(len(columns), dtype=np.uint64)
    for k in range(columns.shape[1]):
        h = _step(h, columns[:, k])
    return h


def hashes_of(grams: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the contexts and of the n-grams, and the parts: one for all n-grams of a context, single tokens by themselves."""
    context = chain(grams[:, :-1])
    whole = _step(context, grams[:, -1])
    h = context if grams.shape[1] > 1 else whole
    return context, whole, ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _above(part: np.ndarray, parts: int, rest: np.ndarray) -> np.ndarray:
    """Keys that order by part, then by the leading bits of ``rest``."""
    bits = np.uint64(int(parts).bit_length())
    return (part << (np.uint64(64) - bits)) | (rest >> bits)


def _merge(grams: np.ndarray, counts: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal neighbours in the order of ``key`` as one gram with the sum of their counts (columns), and a place of each."""
    order = np.argsort(key)
    grams = grams[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = grams[1:, 0] != grams[:-1, 0]
    for k in range(1, grams.shape[1]):
        new[1:] |= grams[1:, k] != grams[:-1, k]
    at = np.flatnonzero(new)
    return grams[at], np.add.reduceat(counts[order], at, axis=0) if len(at) else counts[:0], order[at]


def _drain(held: list[np.ndarray]) -> np.ndarray:
    """The arrays as one; the list lets go of them."""
    whole = np.concatenate(held)
    held.clear()
    return whole


BLOCK = "level long, part long, n long, grams binary, counts binary, path string, facts array<long>"


class Book(NamedTuple):
    """Hashes of frequent words, the most frequent first; the same in order, and the places of these among the first."""

    words: np.ndarray
    ordered: np.ndarray
    ranks: np.ndarray

    def codes(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.ordered, words), len(self.ordered) - 1)
        return np.where(self.ordered[at] == words, self.ranks[at], BOOK).astype("<u2")


def _blocks(grams: np.ndarray, counts: np.ndarray, level: int, parts: int, book: Book) -> Iterator[pa.RecordBatch]:
    """A row for each part: its grams, those with the same first word together, and their counts, narrow where they fit.

    Equal grams are added up, but for the rare ones that another gram of the same key parts; the part's task does the rest.
    """
    _, whole, part = hashes_of(grams, parts)
    word = np.uint64(0xFFFFFF << 40)
    key = _above(part, parts, (grams[:, 0] & word) | (whole >> np.uint64(24)))
    del whole
    grams, counts, place = _merge(grams, counts, key)
    part = part[place].astype(np.int64)
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(part)]):
        yield _row(level, int(part[a]), b - a, _narrow(grams[a:b], book), _counts(counts[a:b]))


def _narrow(grams: np.ndarray, book: Book) -> bytes:
    """The first column as words and repeats, then the others; words as places in the book, those outside it in full behind."""
    first = np.flatnonzero(np.concatenate([[True], grams[1:, 0] != grams[:-1, 0]]))
    repeats = np.diff(np.append(first, len(grams)))
    words = np.concatenate([grams[first, 0], *grams[:, 1:].T])
    codes = book.codes(words)
    more = repeats[repeats >= 255].astype("<u4")
    # low and high bytes apart: the high ones are mostly small
    found = [np.minimum(repeats, 255).astype("u1"), more, (codes & 255).astype("u1"), (codes >> 8).astype("u1"), words[codes == BOOK]]
    raw = b"".join(x.tobytes() for x in found)
    return np.array([len(first), len(more), len(raw)], "<i8").tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _wide(packed: bytes, n: int, order: int, book: Book) -> np.ndarray:
    m, more, length = map(int, np.frombuffer(packed, "<i8", 3))
    raw = pa.decompress(packed[24:], length, "zstd", asbytes=True)
    repeats = np.frombuffer(raw, "u1", m).astype(np.int64)
    repeats[repeats == 255] = np.frombuffer(raw, "<u4", more, m)
    at, size = m + 4 * more, m + n * (order - 1)
    codes = np.frombuffer(raw, "u1", size, at) | (np.frombuffer(raw, "u1", size, at + size).astype("<u2") << 8)
    words, short = np.empty(size, dtype=np.uint64), codes < BOOK
    words[short] = book.words[codes[short]]
    words[~short] = np.frombuffer(raw[at + 2 * size :], np.uint64)
    return np.column_stack([np.repeat(words[:m], repeats), *words[m:].reshape(order - 1, n)])


def _counts(counts: np.ndarray) -> bytes:
    """Two counts to a row; one byte each, 255 standing for those that follow in full."""
    flat = counts.ravel()
    raw = np.minimum(flat, 255).astype(np.uint8).tobytes() + flat[flat >= 255].astype("<i8").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _read_counts(packed: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
    found = np.frombuffer(raw, np.uint8, 2 * n).astype(np.int64)
    found[found == 255] = np.frombuffer(raw[2 * n :], "<i8")
    return found.reshape(n, 2)


class Hashes(NamedTuple):
    """Mixed hashes in order: the leading 32 bits and the next 16 of each."""

    high: np.ndarray
    low: np.ndarray

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which mixed hashes are there, and their places."""
        high, low = _cut(wanted)
        at, last = np.searchsorted(self.high, high), len(self.high) - 1
        place = np.minimum(at, last)
        hit = (at <= last) & (self.high[place] == high) & (self.low[place] == low)
        # few hashes share the leading bits with one before them
        more = np.flatnonzero(~hit & (at < last))
        more = more[self.high[at[more] + 1] == high[more]]
        for k in more:
            a, b = at[k], np.searchsorted(self.high, high[k], "right")
            same = np.flatnonzero(self.low[a:b] == low[k])
            if len(same):
                place[k], hit[k] = a + same[0], True
        hit = np.flatnonzero(hit)
        return hit, place[hit]


def mix(hashes: np.ndarray) -> np.ndarray:
    """Hashes of a part share their leading bits, mixed ones do not."""
    return hashes * MIX


def _cut(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (mixed >> np.uint64(32)).astype("<u4"), (mixed >> np.uint64(16)).astype("<u2")


class Packed(NamedTuple):
    """Rows of figures in one byte each: places in ``book``; 255 stands for the rows ``rest``, given in ``full``."""

    codes: np.ndarray
    book: np.ndarray
    rest: np.ndarray
    full: np.ndarray

    def at(self, rows: np.ndarray) -> np.ndarray:
        """The figures of rows, a line for each column."""
        codes = self.codes[rows]
        padded = np.zeros((len(self.book), 256), dtype=np.int64)
        padded[:, : self.book.shape[1]] = self.book
        found = padded[:, codes]
        long = np.flatnonzero(codes == 255)
        found[:, long] = self.full[:, np.searchsorted(self.rest, rows[long])]
        return found


def pack(columns: list[np.ndarray]) -> Packed:
    """At most four columns of figures; those of 65,536 and more are always given in full."""
    small = np.logical_and.reduce([c < 1 << 16 for c in columns])
    key = np.zeros(len(small), dtype=np.uint64)
    for k, c in enumerate(columns):
        key |= np.where(small, c, 0).astype(np.uint64) << np.uint64(16 * k)
    if len(columns) == 1:
        index = key[small].astype(np.int64)
        n = np.bincount(index)
        values = np.arange(len(n), dtype=np.uint64)
    else:
        values, index, n = np.unique(key[small], return_inverse=True, return_counts=True)
    top = np.argsort(-n, kind="stable")[:255]
    top = top[n[top] > 0]
    place = np.full(len(values), 255, dtype=np.uint8)
    place[top] = np.arange(len(top))
    codes = np.full(len(small), 255, dtype=np.uint8)
    codes[small] = place[index]
    rest = np.flatnonzero(codes == 255)
    book = np.stack([(values[top] >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(len(columns))])
    return Packed(codes, book.astype("<u8"), rest.astype("<u8"), np.stack([c[rest] for c in columns]).astype("<u8"))


def _row(level, part, n, grams=None, counts=None, path=None, facts=None) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.list_(pa.int64())]
    names = ["level", "part", "n", "grams", "counts", "path", "facts"]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((level, part, int(n), grams, counts, path, facts), kinds)], names)


def frequent_words(raw: DataFrame) -> Book:
    """The ``BOOK`` most frequent tokens of the texts in the only column, the start token among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_list(batch.column(0))
            for a in range(0, len(texts), TEXTS):
                words, n = np.unique(tokens(texts[a : a + TEXTS])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    counted = raw.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top, folder = passing_checkpoint(counted.orderBy(F.desc("n"), "word").limit(BOOK - 1).select("n", "word"))
    rows = top.orderBy(F.desc("n"), "word").collect()
    remove(raw.sparkSession, folder)
    words = np.array([START, *(r.word % (1 << 64) for r in rows)], dtype=np.uint64)
    ranks = np.argsort(words)
    return Book(words, words[ranks], ranks)


@dataclass(frozen=True)
class Model:
    """Paths of the files by level and part, discounts by level, and the numbers the formulas need."""

    order: int
    parts: int
    paths: dict[tuple[int, int], str]
    discounts: dict[int, tuple[float, float, float]]
    train_tokens: int
    vocabulary: int


def train(docs: DataFrame, order: int = ORDER, text: str = "text", part_bytes: int = PART_BYTES) -> Model:
    """Count the n-grams of all texts and write the model's files; null and empty texts have the end token alone."""
    spark = docs.sparkSession
    ready(spark)
    folder = shared_folder(spark)
    raw = docs.select(text_bytes(text).alias("text"))
    size = raw.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(4, -(-size // part_bytes))
    book = spark.sparkContext.broadcast(frequent_words(raw))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            yield from _blocks(_drain(held), np.ones((n, 2), dtype=np.int64), order, parts, book.value)

        for batch in batches:
            texts = bytes_list(batch.column(0))
            for a in range(0, len(texts), TEXTS):
                flat, sizes = tokens(texts[a : a + TEXTS])
                held.append(windows(flat, sizes, order))
                n += len(flat)
                if n > 2_000_000:
                    yield from flush()
                    n = 0
        if n:
            yield from flush()

    def settle(key, table):
        """Write a part's file; pass on its grams without their first token."""
        level, part = key[0].as_py(), key[1].as_py()
        rows = zip(table["n"].to_pylist(), table["grams"].to_pylist(), table["counts"].to_pylist())
        found = [[], []]
        for n, g, c in rows:
            found[0].append(_wide(g, n, level, book.value))
            found[1].append(_read_counts(c, n))
        grams, counts = map(_drain, found)
        keys = mix(chain(grams) if level > 1 else grams[:, 0])
        grams, counts, place = _merge(grams, counts, keys)
        keys = keys[place]
        # column 0: occurrences; column 1: what this level counts (occurrences, or distinct tokens before)
        own = counts[:, 1]
        hashes = Hashes(*_cut(keys))
        where, index = np.unique(mix(chain(grams[:, :-1])), return_inverse=True)
        totals = [np.bincount(index, weights=w, minlength=len(where)).astype("<u8") for w in (own, own == 1, own == 2, own >= 3)]
        contexts = Hashes(*_cut(where))
        figures = [pack([own, counts[:, 0]] if level == 1 else [own]), pack(totals)]
        head = np.array([len(grams), len(where), *(x for p in figures for x in (*p.book.shape, len(p.rest)))], "<i8")
        arrays = [*(x for p in figures for x in p[1:]), hashes.high, contexts.high, hashes.low, contexts.low, *(p.codes for p in figures)]
        path = write_bytes(folder, f"level{level}-{part:06d}", [head, *(x for x in arrays if x.size)])
        facts = [*((own == k).sum() for k in (1, 2, 3, 4)), own.sum(), counts[:, 0].sum(), len(own), own[own >= 3].size]
        out = [_row(level, part, len(grams), path=path, facts=[int(x) for x in facts])]
        if level > 1:
            both = np.stack([counts[:, 0], np.ones(len(grams), dtype=np.int64)], axis=1)
            out += _blocks(grams[:, 1:], both, level - 1, parts, book.value)
        return pa.Table.from_batches(out)

    blocks, written, used = raw.mapInArrow(count, BLOCK), [], None
    for level in range(order, 0, -1):
        # as many tasks as parts: a task may get none or a few of them
        dealt = blocks.select("level", "part", "n", "grams", "counts")
        done, place = passing_checkpoint(dealt.groupBy("level", "part").applyInArrow(settle, BLOCK))
        if used:
            remove(spark, used)
        written += done.where("path is not null").select("level", "part", "path", "facts").collect()
        blocks, used = done.where("path is null"), place
    remove(spark, used)
    paths = {(r.level, r.part): r.path for r in written}
    facts = {k: np.sum([r.facts for r in written if r.level == k], axis=0) for k in range(1, order + 1)}
    if not written:
        return Model(order, parts, {}, {}, 0, 0)
    discounts = {k: _discounts(*map(int, f[:4])) for k, f in facts.items()}
    return Model(order, parts, paths, discounts, int(facts[1][5]), int(facts[1][6]))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more; where counts of counts are missing the usual middle values."""
    if not (n1 and n2):
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    third = 3 - 4 * y * n4 / n3 if n3 else 1.0
    values = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, third)
    return tuple(min(max(v, 0.05), top) for v, top in zip(values, (1.0, 2.0, 3.0)))


@cache
def _file(path: str) -> dict[str, tuple[Hashes, Packed]]:
    """A part's arrays, mapped: n-grams with their counts (single tokens with their occurrences too), contexts with their figures."""
    name = path
    if path.startswith("file:"):
        name = path.replace("file://", "", 1) if path.startswith("file:///") else path[5:]
    elif "://" in path:
        from pyspark import SparkFiles

        name = SparkFiles.get(path.rsplit("/", 1)[1])
    with open(name, "rb") as file:
        raw = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    head = list(map(int, np.frombuffer(raw, "<i8", 8)))
    at = 64

    def take(kind: str, *shape: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(raw, kind, int(np.prod(shape)), at).reshape(shape)
        at += found.nbytes
        return found

    books = [(take("<u8", k, m), take("<u8", r), take("<u8", k, r)) for k, m, r in (head[2:5], head[5:8])]
    high, low, codes = ([take(kind, n) for n in head[:2]] for kind in ("<u4", "<u2", "u1"))
    both = [(Hashes(*h), Packed(c, *b)) for h, c, b in zip(zip(high, low), codes, books)]
    return dict(zip(("grams", "contexts"), both))


def _look_up(model: Model, level: int, part: np.ndarray, wanted: np.ndarray, kind: str, figures: int) -> tuple[np.ndarray, np.ndarray]:
    """Figures of every distinct hash, 0 where it is not known, and the place of each hash among them; looked up part by part in order."""
    mixed = mix(wanted)
    # by part, and in the order of the files within a part
    order = np.argsort(_above(part, model.parts, mixed))
    ordered = mixed[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    distinct, of = ordered[new], np.empty(len(order), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    parts = part[order[new]].astype(np.int64)
    values = np.zeros((figures, len(distinct)), dtype=np.int64)
    starts = np.flatnonzero(np.diff(parts, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(parts)]):
        path = model.paths.get((level, int(parts[a])))
        if path is None:
            continue
        hashes, packed = _file(path)[kind]
        hit, place = hashes.find(distinct[a:b])
        values[:, a + hit] = packed.at(place)
    return values, of


def score(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every text: tokens, known tokens, the base score and the model's log10 probability."""
    flat, sizes = tokens(texts)
    grams = windows(flat, sizes, model.order)
    probability = np.full(len(flat), 1 / (model.vocabulary + 1))
    known = np.zeros(len(flat), dtype=bool)
    seen = np.zeros(len(flat), dtype=np.int64)
    for level in range(1, model.order + 1):
        if not model.paths:
            break
        own = grams[:, model.order - level :]
        context, whole, part = hashes_of(own, model.parts)
        if level == 1:
            figures, of = _look_up(model, 1, part, own[:, 0], "grams", 2)
            count, seen = figures[:, of]
            known = seen > 0
            figures, of = np.array(_single_totals(model)).reshape(4, 1), np.zeros(len(flat), dtype=np.int64)
        else:
            (count,), of = _look_up(model, level, part, whole, "grams", 1)
            count = count[of]
            figures, of = _look_up(model, level, part, context, "contexts", 4)
        total, n1, n2, n3 = figures
        d1, d2, d3 = model.discounts[level]
        # a context never seen passes all mass on
        left = np.where(total > 0, (d1 * n1 + d2 * n2 + d3 * n3) / np.maximum(total, 1), 1.0)[of]
        off = np.array([0.0, d1, d2, d3])[np.minimum(count, 3)]
        probability = (count - off) / np.maximum(total, 1)[of] + left * probability
    starts = np.cumsum(sizes) - sizes
    base = np.log10((seen + 0.5) / (model.train_tokens + 0.5 * (model.vocabulary + 1)))
    add = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]
    return sizes, add(known.astype(np.int64)), add(base), add(np.log10(probability))


@cache
def _totals_of(paths: tuple[str, ...]) -> tuple[int, int, int, int]:
    files = [_file(p)["contexts"] for p in paths]
    return tuple(int(x) for x in sum(packed.at(np.arange(len(packed.codes))).sum(axis=1) for _, packed in files))


def _single_totals(model: Model) -> tuple[int, int, int, int]:
    return _totals_of(tuple(p for (level, _), p in sorted(model.paths.items()) if level == 1))


def score_texts(docs: DataFrame, model: Model, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep``, ``n_tokens, n_known, train_tokens, base_score, score`` of every text."""
    spark = docs.sparkSession
    ready(spark)
    for path in model.paths.values():
        if not path.startswith("file:"):
            spark.sparkContext.addFile(path)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_list(batch.column(len(keep)))
            for a in range(0, len(texts), SCORED):
                sizes, known, base, own = score(shared.value, texts[a : a + SCORED])
                columns = [pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), shared.value.train_tokens)), pa.array(base), pa.array(own)]
                kept = [c.slice(a, len(sizes)) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*batch.schema.names[: len(keep)], "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], text_bytes(text).alias("text__bytes"))
    schema = chosen.drop("text__bytes").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    return chosen.mapInArrow(run, schema)


def perplexity(score_: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score_ / n_tokens)
