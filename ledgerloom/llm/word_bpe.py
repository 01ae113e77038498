"""BPE encoding and decoding: merge rounds over the symbols of many words in one flat array.

A tokenizer file is read for its vocabulary, merges, added tokens, normalizer and pre-tokenizer; the last two
come from the tokenizers library and see every distinct piece between white space once per worker.  Merging is done here.
The symbols of all new words lie in one array.  A round finds the rank of every neighbouring pair by binary search
over the sorted keys of all merges, takes the lowest rank of each word and merges all its pairs of that rank, from
the left; words without a known pair leave the array.  As the parts of a merge are always made by earlier merges
(checked), no merge makes a pair of lower rank, so this equals merging one pair at a time.  A word of more than
``LONG`` symbols is merged alone, rank by rank, each round touching only the places of its rank: same rule,
but a text without any space does not cost its length in every round.

Null and empty texts have no ids and decode to the empty text; repeated rows stay; other columns are not read.
Strings of added tokens in a text give their ids, as the library does it.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready
from .token_files import by_bytes

#: Where texts may be cut: such characters are dropped, and nothing before or behind sees across them.
SPACE = r"[\x20\x09-\x0D]+"
#: Symbols of a word that is merged alone.
LONG = 2048
#: Distinct pieces a worker remembers before it starts afresh.
REMEMBERED = 400_000
#: Bytes of text encoded at once: the arrays for them take some fifty times as much.
ENCODED_BYTES = 2 << 20
#: Rank of pairs that no merge knows.
NONE = np.iinfo(np.int64).max


class WordBpe:
    """Ids of texts and texts of ids, for a BPE vocabulary whose words end in a suffix and whose white space is dropped."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library, spec = Tokenizer.from_file(path), json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        unused = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(k) for k in unused) or spec["decoder"] or spec["post_processor"]:
            raise ValueError("this tokenizer has parts that are not supported")
        if [w for w, _ in self.split(self.normalize("a b"))] != ["a", "b"]:
            raise ValueError("this tokenizer keeps white space")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that reach beyond their own string are not supported")
        vocabulary: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # the longest of those that start at a place comes first
        names = sorted(self.added, key=len, reverse=True)
        self.added_text = re.compile("|".join(map(re.escape, names))) if names else None
        end = model["end_of_word_suffix"] or ""
        letters = [x for x in vocabulary if len(x) == 1]
        top = max(map(ord, letters)) + 1
        self.inner, self.last = np.full(top, -1, dtype=np.int64), np.full(top, -1, dtype=np.int64)
        for x in letters:
            self.inner[ord(x)], self.last[ord(x)] = vocabulary[x], vocabulary.get(x + end, -1)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b: rank for rank, (a, b) in enumerate(merges)}
        if len(made) < len(merges) or any(made.get(x, -1) >= rank for rank, m in enumerate(merges) for x in m):
            raise ValueError("merges must build on earlier ones")
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in merges], dtype=np.int64)
        self.rank_of = np.argsort(keys)
        self.keys = keys[self.rank_of]
        self.made = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)
        names_by_id = {i: x for x, i in [*vocabulary.items(), *self.added.items()]}
        self.names = pa.array([names_by_id.get(i) for i in range(max(names_by_id) + 1)], pa.string())
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(0, dtype=np.int64)
        self.begin = self.count = np.zeros(0, dtype=np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.rank_of[at], NONE)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols and their words, in order; ``word`` numbers the word of each symbol."""
        done = []

        def rank_at(at: np.ndarray) -> np.ndarray:
            after = np.minimum(at + 1, len(symbols) - 1)
            inside = (after > at) & (word[after] == word[at])
            return np.where(inside, self.ranks(symbols[at], symbols[after]), NONE)

        rank = rank_at(np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            lengths = np.diff(starts, append=len(word))
            best = np.minimum.reduceat(rank, starts)
            open_ = np.repeat(best < NONE, lengths)
            hit = open_ & (rank == np.repeat(best, lengths))
            at = np.flatnonzero(hit)
            at = at[self._alternate(at[1:] == at[:-1] + 1)]
            symbols[at] = self.made[rank[at]]
            keep = open_.copy()
            keep[at + 1] = False
            done.append((word[~open_], symbols[~open_]))
            stale = np.zeros(len(symbols), dtype=bool)
            stale[at] = True
            stale[at[at > 0] - 1] = True  # where that symbol goes, the one before it is stale by itself
            symbols, word, rank, stale = symbols[keep], word[keep], rank[keep], stale[keep]
            again = np.flatnonzero(stale)
            rank[again] = rank_at(again)
        words, found = (np.concatenate(x) for x in zip(*done)) if done else (word, symbols)
        order = np.argsort(words, kind="stable")
        return found[order], words[order]

    @staticmethod
    def _alternate(follows: np.ndarray) -> np.ndarray:
        """Of pairs of equal symbols in a row, where each but the first may overlap the one before: every other one."""
        first = np.append(True, ~follows)
        place = np.arange(len(first))
        return (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0 if len(follows) else slice(None)

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The merged symbols of one word; pairs wait by rank, and only those of the lowest one are touched."""
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.append(self.ranks(symbols[:-1], symbols[1:]), NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] < NONE]
            places = places[np.argsort(rank[places], kind="stable")]
            own = rank[places]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for group in np.split(places, cuts) if len(places) else []:
                r = int(rank[group[0]])
                if r not in waiting:
                    heapq.heappush(heap, r)
                waiting.setdefault(r, []).append(group)

        wait(np.arange(n))
        gone = np.zeros(n, dtype=bool)
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[~gone[at] & (rank[at] == r)]
            if not len(at):
                continue
            at = at[self._alternate(at[1:] == after[at[:-1]])]
            symbols[at] = self.made[r]
            dead = after[at]
            gone[dead] = True
            after[at] = after[dead]
            inside = after[at] < n
            before[after[at][inside]] = at[inside]
            touched = np.concatenate([at, before[at][before[at] >= 0]])
            touched = np.unique(touched[~gone[touched]])
            nxt = np.minimum(after[touched], n - 1)
            rank[touched] = np.where(after[touched] < n, self.ranks(symbols[touched], symbols[nxt]), NONE)
            wait(touched)
        return symbols[~gone]

    def words_of(self, piece: str) -> list[str]:
        """The words of a piece without white space; an added token is a word behind a zero character."""
        if self.added_text is None or not self.added_text.search(piece):
            return [w for w, _ in self.split(self.normalize(piece))]
        found, at = [], 0
        for m in self.added_text.finditer(piece):
            found += self.words_of(piece[at : m.start()]) if m.start() > at else []
            found.append("\0" + m[0])
            at = m.end()
        return found + (self.words_of(piece[at:]) if at < len(piece) else [])

    def ids_of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order and their numbers."""
        plain = [k for k, w in enumerate(words) if w[0] != "\0" and len(w) <= LONG]
        flat = np.frombuffer("".join([words[k] for k in plain]).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.array([len(words[k]) for k in plain], dtype=np.int64)
        found, of = self.merge(self._symbols(flat, np.cumsum(sizes) - 1), np.repeat(np.array(plain, dtype=np.int64), sizes))
        ids, numbers = [found], [of]
        for k, w in enumerate(words):
            if w[0] == "\0":
                alone = np.array([self.added[w[1:]]])
            elif len(w) > LONG:
                flat = np.frombuffer(w.encode("utf-32-le"), "<u4").astype(np.int64)
                alone = self.merge_long(self._symbols(flat, np.array([len(w) - 1])))
            else:
                continue
            ids.append(alone)
            numbers.append(np.full(len(alone), k))
        ids, numbers = np.concatenate(ids), np.concatenate(numbers)
        order = np.argsort(numbers, kind="stable")
        return ids[order], np.bincount(numbers, minlength=len(words))

    def _symbols(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        symbols = self.inner[flat]
        symbols[ends] = self.last[flat[ends]]
        if (symbols < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        return symbols

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces not met before."""
        if len(self.known) > REMEMBERED:
            self.forget()
        missing = [p for p in pieces if p not in self.known]
        if not missing:
            return
        lists = [self.words_of(p) for p in missing]
        numbers: dict[str, int] = {}
        words = np.array([numbers.setdefault(w, len(numbers)) for ws in lists for w in ws], dtype=np.int64)
        ids, counts = self.ids_of_words(list(numbers)) if numbers else (self.pool[:0], self.count[:0])
        flat = gather(ids, np.cumsum(counts) - counts, counts, words)
        ends = np.append(0, np.cumsum(counts[words]))[np.cumsum([len(ws) for ws in lists])]
        fresh = np.diff(ends, prepend=0)
        self.known.update(zip(missing, range(len(self.known), len(self.known) + len(missing))))
        self.begin = np.append(self.begin, len(self.pool) + ends - fresh)
        self.count = np.append(self.count, fresh)
        self.pool = np.append(self.pool, flat)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the number of ids of each text."""
        parts = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE)
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        self.learn(pieces)
        place = np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        codes = place[coded.indices.to_numpy()]
        ids = gather(self.pool, self.begin, self.count, codes)
        ends = np.append(0, np.cumsum(self.count[codes]))[offsets]
        return ids, np.diff(ends)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The names of the ids of each row with a space between them; an id without a name is left out."""
        names = self.names.take(ids.flatten())
        offsets = ids.offsets.to_numpy() - ids.offsets[0].as_py()
        if names.null_count:
            offsets = np.append(0, np.cumsum(np.asarray(names.is_valid()).astype(np.int64)))[offsets]
            names = names.drop_null()
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names), " ")


def gather(pool: np.ndarray, begin: np.ndarray, count: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` that the codes stand for, one behind the other."""
    counts = count[codes]
    ends = np.cumsum(counts)
    return pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin[codes] - (ends - counts), counts)]


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_texts(docs: DataFrame, bpe: Callable[[], WordBpe], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int) of every text."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, most=ENCODED_BYTES):
                ids, counts = bpe().encode(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, bpe: Callable[[], WordBpe]) -> DataFrame:
    """``doc_id, ids`` with ``decoded``, the text of the ids; null ids have none."""
    ready(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                lists = part.column(1)
                decoded = bpe().decode(lists)
                if lists.null_count:
                    decoded = pc.if_else(lists.is_valid(), decoded, None)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, decoded], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
