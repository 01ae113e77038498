"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is found in a document that holds at least ``CONTAINED`` of the item's distinct five-word
shingles.  Items are partitioned by their number of shingles into classes of doubling size.  An item's
sketch is its bottom-k MinHash: the ``k`` smallest hashes of its shingles, ``k`` set by the class so that a
document that lacks all of them lacks more shingles than containment allows.  The search joins the shingles of documents
with those of the sketches alone, which gives candidates and misses none; then the shingles of a candidate document
are joined with all those of the item and counted, word by word.  A sketch of the document would not do: a short
item is a thousandth of a long document, and its share of the document's smallest hashes is about as small.

Words are runs of letters and digits, lower-cased; a text with fewer than five words is one shingle.
Everything is DataFrame functions.  Texts without words hold nothing and are found nowhere; items with the
same shingles are one class, named by its smallest id (null ids last).  Documents are told apart by a row
key, so equal or null ids do not mix.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

WORDS, CONTAINED = 5, 0.8
#: Bits of the map of the items' shingles that every task holds: 256 for each shingle within these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 22


def _word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _hash_at(h: Column, i: Column) -> Column:
    """The hash of the shingle at a place, made of the hashes of its words."""
    return F.when(F.size(h) >= WORDS, F.xxhash64(*[h[i + k] for k in range(WORDS)])).otherwise(F.xxhash64(h))


def _places(h: Column) -> Column:
    """Where shingles start: one in a short text, none without words."""
    none = F.expr("cast(array() as array<int>)")
    return F.when(F.size(h) > 0, F.sequence(F.lit(0), F.greatest(F.size(h) - WORDS, F.lit(0)))).otherwise(none)


def _shingle_at(words: Column, i: Column) -> Column:
    return F.array_join(F.slice(words, i + 1, WORDS), " ")


def item_shingles(items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """``cls, item_id, items, n, shingle, hash, in_sketch`` for every distinct shingle of every class of equal items."""
    listed = items.select("item_id", _word_list(F.col("text")).alias("w")).where("size(w) > 0")
    listed = listed.select("item_id", "w", _word_hashes(F.col("w")).alias("h"))
    one = F.transform(_places(F.col("h")), lambda i: F.struct(_hash_at(F.col("h"), i).alias("hash"), _shingle_at(F.col("w"), i).alias("shingle")))
    classes = (
        listed.select("item_id", F.array_sort(F.array_distinct(one)).alias("shingles"))
        .groupBy("shingles")
        .agg(F.min("item_id").alias("item_id"), F.count("*").alias("items"))
        .withColumn("n", F.size("shingles"))
    )
    # the largest item of the class may lack this many shingles; one more cannot all be missing
    top = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double"))))
    k = F.least(F.floor(top * (1 - contained) + 1e-9) + 1, F.col("n"))
    numbered = classes.select(F.monotonically_increasing_id().alias("cls"), "item_id", "items", "n", k.alias("k"), "shingles")
    placed = numbered.select("cls", "item_id", "items", "n", "k", F.posexplode("shingles").alias("place", "s"))
    return placed.select("cls", "item_id", "items", "n", "s.shingle", "s.hash", (F.col("place") < F.col("k")).alias("in_sketch"))


def _bit_map(wanted: DataFrame) -> tuple[Column, int]:
    """A constant array of 64-bit words with a bit for every shingle's hash; at most ``MOST_BITS`` bits come to the driver."""
    n, bits = wanted.count(), LEAST_BITS
    while bits < min(256 * n, MOST_BITS):
        bits *= 2
    low = wanted.select(F.pmod("hash", F.lit(bits)).alias("b"))
    mask = F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))"))
    rows = low.groupBy(F.expr("cast(b div 64 as int)").alias("at")).agg(mask.alias("m")).collect()
    words = ["0"] * (bits // 64)
    for r in rows:
        words[r["at"]] = str(r["m"])
    return F.split(F.lit(",".join(words)), ",").cast("array<bigint>"), bits


def contained_items(docs: DataFrame, items: DataFrame, *keep: str, contained: float = CONTAINED) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``item_id, items, n_shingles, n_found, containment``: a row for each class of
    equal items that a document holds."""
    wanted = reliable_checkpoint(item_shingles(items, contained))
    sketch = wanted.where("in_sketch")
    maps = {"any": _bit_map(wanted), "sketch": _bit_map(sketch)}

    def marked(kind: str, i: Column) -> Column:
        bit_map, bits = maps[kind]
        low = F.pmod(_hash_at(F.col("h"), i), F.lit(bits))
        return F.getbit(bit_map[F.floor(low / 64).cast("int")], (low % 64).cast("int")) == 1

    kept = [F.col(f"`{c}`") for c in keep]
    read = docs.select("doc_id", *kept, _word_list(F.col("text")).alias("w")).where("size(w) > 0")
    read = read.select("*", F.monotonically_increasing_id().alias("row"), _word_hashes(F.col("w")).alias("h"))
    # the few shingles that may be an item's are kept, so that no text is read again for the verification
    read = read.select("*", F.filter(_places(F.col("h")), lambda i: marked("any", i)).alias("at"))
    read = read.where(F.exists("at", lambda i: marked("sketch", i)))
    held = F.transform("at", lambda i: F.struct(_shingle_at(F.col("w"), i).alias("shingle"), marked("sketch", i).alias("probe")))
    hits = reliable_checkpoint(read.select("row", "doc_id", *kept, F.array_distinct(held).alias("held")))
    # the search: shingles meet the sketches, as text
    probes = hits.select("row", F.explode("held").alias("s")).where("s.probe").select("row", "s.shingle")
    candidates = probes.join(sketch.select("shingle", "cls"), "shingle").select("row", "cls").distinct()
    # the verification: all shingles of the candidates' items
    shown = hits.join(candidates, "row").select("row", "doc_id", *kept, "cls", F.explode("held.shingle").alias("shingle"))
    met = shown.join(wanted.select("cls", "shingle", "item_id", "items", "n"), ["cls", "shingle"])
    found = met.groupBy("row", "doc_id", *kept, "cls", "item_id", "items", "n").agg(F.count("*").alias("n_found"))
    return found.where(F.col("n_found") >= contained * F.col("n") - 1e-9).select(
        "doc_id", *kept, "item_id", "items", F.col("n").cast("long").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("n")).alias("containment")
    )


def clean(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """The documents that hold no item, the columns unchanged."""
    content = F.xxhash64("text")
    marked = docs.withColumn("text__hash", content)
    leaks = contained_items(marked, items, "text__hash", contained=contained)
    leaks = leaks.select(F.col("doc_id").alias("id__"), F.col("text__hash").alias("hash__")).distinct()
    same = marked["doc_id"].eqNullSafe(leaks["id__"]) & (marked["text__hash"] == leaks["hash__"])
    return marked.join(leaks, same, "left_anti").select(*[f"`{c}`" for c in docs.columns])
