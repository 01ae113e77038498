"""Phrase collocation mining: count streams in prefix and in suffix order, merge-joined in lockstep.

Counting.  A text is lower-cased (A-Z), cut into pieces at punctuation and line ends and into words at spaces and tabs.
A task numbers the words of a block of texts in their order and counts the n-grams by sorting arrays of numbers.
The sorted phrases go through the shuffle as blocks, one for each language, order and part of the phrases' hashes; the
number of parts grows with the text, so a part stays small, and a frequent phrase is one entry of a block.  The task of a
part adds its blocks up.  Phrases below ``least`` leave there: a part of a phrase stands wherever the phrase stands, so no
phrase that counts needs a part that does not.

Streams.  The counts of an order are joined with those of one word less twice: sorted by what lies before their last word
(prefix order: left counts) and by what lies behind their first word (suffix order: right counts).  Both are sort-merge
joins by order of the text, no hash tables; every row takes the counts of its shorter parts along, so
one join for each side and order is enough.  The streams sorted either way also give each phrase its most frequent extension.
A frequent word makes a long run of equal keys in one stream; adaptive execution splits it.

Null and empty texts have no words; a null language counts as ``und``, together with documents that say so; equal rows
count as often as they stand; other columns are not read.  Ties are settled by score, count and bytes of the phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .common import ready
from .kneser_ney import chain

LONGEST, LEAST, INSIDE, BEST = 3, 10, 50, 2000
#: Words counted at once in a task, and bytes of a text cut into words at once (then on to the end of the piece).
WORDS, BYTES = 1_000_000, 4 << 20
#: Bytes of text to a part of the phrases' hashes.
PART_BYTES = 12 << 20
#: Parts in which a language's phrases are ranked before the last ranking.
SALTS = 256
UNKNOWN = "und"
# punctuation and line ends become a full stop, which is no part of a word; a tab becomes a space
_CUT = bytes(ord(".") if chr(b) in ".,;:!?\n\v\f\r" else ord(" ") if b == 9 else b for b in range(256))


def words_and_stops(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text with a full stop between pieces and behind the last one, whole pieces at a time."""
    text, at = text.lower().translate(_CUT), 0
    while at < len(text):
        end = text.find(b".", at + BYTES)
        end = len(text) if end < 0 else end
        found = (text[at:end].replace(b".", b" . ") + b" .").split(b" ")
        yield [w for w in found if w]
        at = end + 1


def gram_counts(words: pa.Array, longest: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """Order, phrases in the order of their words, counts and hashes of the n-grams of words with full stops between pieces."""
    coded = words.dictionary_encode()
    by = pc.array_sort_indices(coded.dictionary).to_numpy()
    names, place = coded.dictionary.take(pa.array(by)), np.empty(len(by), dtype=np.int64)
    place[by] = np.arange(len(by))
    codes = place[coded.indices.to_numpy()]
    hash_of = np.array([xxhash.xxh64_intdigest(w) for w in names.to_pylist()], dtype=np.uint64)
    stop = pc.index_in(pa.array([b"."], words.type), names)[0].as_py()
    stops = codes == (-1 if stop is None else stop)
    wide = len(names)
    at = np.flatnonzero(~stops)
    numbers = codes[at]
    for order in range(1, longest + 1):
        if order > 1:
            # the grams of one word less that another word follows; a stop closes the array
            going = ~stops[at + order - 1]
            at, numbers = at[going], inverse[going] * wide + codes[at[going] + order - 1]
        distinct, inverse, counts = np.unique(numbers, return_inverse=True, return_counts=True)
        if not len(distinct):
            return
        last = pa.array(distinct % wide)
        if order == 1:
            phrases, hashes = names.take(last), hash_of[distinct]
        else:
            phrases = pc.binary_join_element_wise(phrases.take(pa.array(distinct // wide)), names.take(last), pa.scalar(b" ", words.type))
            hashes = chain(np.stack([hashes[distinct // wide], hash_of[distinct % wide]], axis=1))
        yield order, phrases, counts, hashes


BLOCK = "lang string, size int, part long, lengths binary, letters binary, counts binary"
GRAMS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _blocks(name: str, order: int, phrases: pa.Array, counts: np.ndarray, hashes: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row for each part of the hashes: lengths, bytes and counts of its phrases, which keep their order."""
    part = (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    phrases, counts, part = phrases.take(pa.array(by)), counts[by].astype("<i8"), part[by]
    offsets = np.frombuffer(phrases.buffers()[1], "<i8", len(phrases) + 1, phrases.offset * 8)
    lengths, letters = np.diff(offsets).astype("<u4"), memoryview(phrases.buffers()[2] or b"")
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(part)]))
    columns = [
        pa.array([name] * len(spans), pa.string()),
        pa.array([order] * len(spans), pa.int32()),
        pa.array(part[starts]),
        pa.array([lengths[a:b].tobytes() for a, b in spans], pa.binary()),
        pa.array([bytes(letters[offsets[a] : offsets[b]]) for a, b in spans], pa.binary()),
        pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "size", "part", "lengths", "letters", "counts"])


def _add_up(key: tuple, table: pa.Table, least: int) -> pa.Table:
    """The phrases of a part met ``least`` times in all blocks; the empty phrase stays."""
    joined = lambda c: b"".join(table[c].to_pylist())
    offsets = np.append(0, np.cumsum(np.frombuffer(joined("lengths"), "<u4").astype("<i8")))
    phrases = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(joined("letters"))])
    coded = phrases.dictionary_encode()
    # whole numbers below 2^53 are exact in floating point
    f = np.bincount(coded.indices.to_numpy(), weights=np.frombuffer(joined("counts"), "<i8"), minlength=len(coded.dictionary)).astype(np.int64)
    name, size = key[0].as_py(), key[1].as_py()
    at = np.flatnonzero(f >= (least if size else 0))
    columns = [pa.array([name] * len(at), pa.string()), pa.array([size] * len(at), pa.int32()), coded.dictionary.take(pa.array(at)).cast(pa.large_string()).cast(pa.string()), pa.array(f[at])]
    return pa.Table.from_arrays(columns, schema=GRAMS)


def count_grams(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, size`` (words), ``phrase, f`` of the n-grams up to ``longest`` words met ``least`` times; the empty phrase counts all words."""
    spark = docs.sparkSession
    ready(spark)
    chosen = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    parts = max(4, -(-(chosen.agg(F.sum(F.length("text"))).first()[0] or 0) // PART_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[list[bytes]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name in list(held):
                words, total = pa.array([w for ws in held.pop(name) for w in ws], pa.large_binary()), 0
                for order, phrases, counts, hashes in gram_counts(words, longest):
                    total = total or int(counts.sum())
                    yield _blocks(name, order, phrases, counts, hashes, parts)
                yield _blocks(name, 0, pa.array([b""], pa.large_binary()), np.array([total]), np.zeros(1, dtype=np.uint64), parts)

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for words in words_and_stops(raw):
                    held.setdefault(name, []).append(words)
                    size += len(words)
                    if size >= WORDS:
                        yield from flush()
                        size = 0
        yield from flush()

    blocks = chosen.mapInArrow(run, BLOCK)
    return blocks.groupBy("lang", "size", "part").applyInArrow(lambda key, table: _add_up(key, table, least), "lang string, size int, phrase string, f long")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact: counts below 10^15 leave 38 digits enough room."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1000000).cast("decimal(7,0)"), wide(left) * wide(right))


def enrich(grams: DataFrame, longest: int = LONGEST) -> dict[int, DataFrame]:
    """By order: ``lang, phrase, f`` and the counts of the parts before (``lefts``) and behind (``rights``) each cut."""
    none = F.array().cast("array<bigint>")
    streams = {1: grams.where("size = 1").select("lang", "phrase", "f", none.alias("lefts"), none.alias("rights"))}
    for order in range(2, longest + 1):
        shorter = streams[order - 1]
        heads = shorter.select("lang", F.col("phrase").alias("head"), F.concat("lefts", F.array("f")).alias("lefts"))
        tails = shorter.select("lang", F.col("phrase").alias("tail"), F.concat(F.array("f"), "rights").alias("rights"))
        own = grams.where(F.col("size") == order).select(
            "lang", "phrase", "f", F.substring_index("phrase", " ", order - 1).alias("head"), F.substring_index("phrase", " ", 1 - order).alias("tail")
        )
        merged = own.join(heads.hint("merge"), ["lang", "head"]).join(tails.hint("merge"), ["lang", "tail"])
        streams[order] = reliable_checkpoint(merged.select("lang", "phrase", "f", "head", "tail", "lefts", "rights"))
    return streams


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, best: int = BEST, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """The ``best`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Phrases of 2 to ``longest`` words met ``least`` times or more are scored at their weakest cut (ties: the first), and
    go if a phrase of one word more around them is met at ``inside`` percent of their number or more.
    (A longer phrase around that one is met no more often, so it need not be asked.)
    """
    counted = reliable_checkpoint(count_grams(docs, longest, least, lang, text))
    streams = enrich(counted.where("size > 0"), longest)
    found = None
    for order in range(2, longest + 1):
        own = streams[order]
        if order < longest:
            longer = streams[order + 1]
            around = longer.select("lang", F.col("head").alias("phrase"), "f").unionByName(longer.select("lang", F.col("tail").alias("phrase"), "f"))
            most = around.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
            own = own.join(most.hint("merge"), ["lang", "phrase"], "left").where(f"most IS NULL OR 100 * most < {inside} * f")
        cuts = F.transform(
            F.arrays_zip("lefts", "rights"),
            lambda c, k: F.struct(_score(F.col("f"), c["lefts"], c["rights"]).alias("score"), k.alias("k"), c["lefts"].alias("l"), c["rights"].alias("r")),
        )
        own = own.select("lang", "phrase", F.col("f").alias("a"), F.array_min(cuts).alias("cut"))
        found = own if found is None else found.unionByName(own)
    sizes = counted.where("size = 0").select("lang", F.col("f").alias("n"))
    ranked = found.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    # the first ones of a language are among the first ones of its salts
    for keys in (["lang", "salt"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
        ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(sizes.hint("merge"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
