"""Language ID by cross-parsing: the language whose sample a text can be copied from in the fewest phrases.

A suffix automaton of labelled text per language answers how long the text at a position goes on matching
somewhere in the sample.  Greedy parsing cuts a text into longest matches; each costs the logarithm of the
sample's length, so the phrases of different languages compare.  Only letters count: each run of other
characters is one gap.  Texts are parsed whole, in pieces of
``PIECE`` code points that numpy walks side by side through the automata of all languages.

The sample is bounded: at most ``SAMPLE_DOCS`` documents of a language (the smallest hash in each of as
many slots), at most ``DOC_CHARS`` of each and ``LANG_CHARS`` in all.  Nothing else is bounded.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, ready

SAMPLE_DOCS, DOC_CHARS, LANG_CHARS = 96, 2_000, 24_000
#: Code points parsed in one go; a phrase ends with its piece.
PIECE = 512
#: Letters of the samples with a class of their own, most frequent first; others share classes.
OWN, SHARED = 96, 15
#: Code points walked at a time.
WALK = 1 << 21
#: Texts turned into strings at a time.
TEXTS = 1000

UNKNOWN, GAP = "und", 1
LETTER = regex.compile(r"\p{L}")
GAPS = regex.compile(r"[^\p{L}\p{M}\0]+")


@dataclass(frozen=True)
class Model:
    langs: list[str]
    classes: np.ndarray  # of each code point; 0 ends a sample and matches nothing, GAP is no letter
    steps: np.ndarray  # next state by (language, state, class), 0: none; state 0 is the start
    cost: np.ndarray  # bits of a phrase in each language


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, state 0 the start; code 0 breaks it."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        if c == 0:
            last = 0
            continue
        if (q := steps[last].get(c)) is not None:  # goes on within what has been read
            if length[q] == length[last] + 1:
                last = q
                continue
            steps.append(dict(steps[q]))
            link.append(link[q])
            length.append(length[last] + 1)
            clone = len(steps) - 1
            link[q], p = clone, last
            while p >= 0 and steps[p].get(c) == q:
                steps[p][c], p = clone, link[p]
            last = clone
            continue
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        new, p = len(steps) - 1, last
        while p >= 0 and c not in steps[p]:
            steps[p][c], p = new, link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                steps.append(dict(steps[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                clone = len(steps) - 1
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c], p = clone, link[p]
                link[q] = link[new] = clone
        last = new
    return steps


def fit(samples: dict[str, list[str]]) -> Model:
    """Automata of the languages' sample texts."""
    langs = sorted(samples, key=lambda x: x.encode())
    joined = {}
    for lang in langs:
        text = "\0".join(dict.fromkeys(GAPS.sub(" ", x.replace("\0", " ").lower()[:DOC_CHARS]) for x in sorted(samples[lang])))
        joined[lang] = text[:LANG_CHARS]
    seen = Counter("".join(joined.values()))
    own = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if c not in "\0 "][:OWN]
    classes = (2 + len(own) + np.arange(0x110000) % SHARED).astype(np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for found in GAPS.finditer(every):
        a, b = ord(found[0][0]), ord(found[0][-1])
        classes[a : b + 1] = GAP
    classes[0] = GAP
    for k, c in enumerate(own):
        for form in (c, c.upper()):
            if len(form) == 1:
                classes[ord(form)] = k + 2
    size = 2 + len(own) + SHARED
    built = []
    for lang in langs:
        raw = np.frombuffer(joined[lang].encode("utf-32-le", "surrogatepass"), np.uint32)
        built.append(automaton(np.where(raw, classes[raw], 0).tolist()))
    steps = np.zeros((len(langs), max(map(len, built), default=1), size), dtype=np.uint32)
    for k, states in enumerate(built):
        for s, out in enumerate(states):
            steps[k, s, list(out)] = list(out.values())
    cost = np.array([np.log2(len(joined[x]) + 1) for x in langs])
    return Model(langs, classes, steps.astype(np.uint16) if steps.shape[1] < 1 << 16 else steps, cost)


def phrases(model: Model, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Phrases of every text (``sizes`` code points each, one after the other) in every language."""
    pieces = -(-sizes // PIECE)
    of = np.repeat(np.arange(len(sizes)), pieces)
    within = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
    begin = np.repeat(np.cumsum(sizes) - sizes, pieces) + within
    left = np.minimum(PIECE, sizes[of] - within)
    order = np.argsort(-left, kind="stable")
    of, begin, left = of[order], begin[order], left[order]
    langs, states, width = model.steps.shape
    flat = model.steps.reshape(-1)
    base = (np.arange(langs, dtype=np.int64) * states * width)[:, None]
    state = np.zeros((langs, len(of)), dtype=np.int64)
    count = np.zeros((langs, len(of)), dtype=np.int32)
    live = np.searchsorted(-left, -np.arange(PIECE), side="left")  # pieces longer than j
    for j in range(int(left.max(initial=0))):
        n = live[j]
        c = codes[begin[:n] + j].astype(np.int64) + base
        now = state[:, :n]
        to = flat[now * width + c]
        stuck = to == 0
        fresh = flat[c]
        count[:, :n] += stuck & (now > 0)  # the phrase before has ended
        count[:, :n] += stuck & (fresh == 0)  # a letter the sample lacks is a phrase
        state[:, :n] = np.where(stuck, fresh, to)
    count += state > 0
    total = np.zeros((langs, len(sizes)))
    for k in range(langs):
        total[k] = np.bincount(of, weights=count[k], minlength=len(sizes))
    return total


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language of each text and the share of its likelihood among all languages."""
    known = [k for k, x in enumerate(texts) if x and model.langs and LETTER.search(x)]
    langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    at = 0
    while at < len(known):
        end, size = at, 0
        while end < len(known) and (size == 0 or size + len(texts[known[end]]) <= WALK):
            size, end = size + len(texts[known[end]]), end + 1
        part = known[at:end]
        raw = "".join([texts[k] for k in part]).encode("utf-32-le", "surrogatepass")
        codes = model.classes[np.frombuffer(raw, np.uint32)]
        ends = np.cumsum(np.array([len(texts[k]) for k in part], dtype=np.int64))
        kept = np.ones(len(codes), dtype=bool)
        kept[1:] = (codes[1:] != GAP) | (codes[:-1] != GAP)
        kept[ends[:-1]] = True  # a text does not depend on its neighbour
        sizes = np.diff(np.cumsum(kept)[ends - 1], prepend=0)
        bits = phrases(model, codes[kept], sizes) * model.cost[:, None]
        best = bits.argmin(axis=0)
        share = 1 / np.exp2(-(bits - bits.min(axis=0))).sum(axis=0)
        for k, b, s in zip(part, best.tolist(), share.tolist()):
            langs[k], score[k] = model.langs[b], s
        at = end
    return langs, score


def learn(docs: DataFrame, allowed=None) -> Model:
    """Fit on the labelled documents for which ``allowed`` holds; null languages teach nothing."""
    labelled = docs.where("lang is not null")
    if allowed is not None:
        labelled = labelled.where(allowed)
    place = F.xxhash64(F.lit("sample"), "doc_id")
    labelled = labelled.select("lang", "text", place.alias("h"))
    slot = F.pmod("h", F.lit(SAMPLE_DOCS))
    picks = [r.h for r in labelled.groupBy("lang", slot).agg(F.min("h").alias("h")).collect()]
    if not picks:
        return fit({})
    rows = labelled.where(F.col("h").isin(picks)).where("text is not null")
    # rows with equal ids share a hash: one of them is enough
    found = rows.groupBy("lang", "h").agg(F.min(F.substring("text", 1, DOC_CHARS)).alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.h)):
        samples.setdefault(r.lang, []).append(r.text)
    return fit(samples)


def identify(docs: DataFrame, model: Model, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep``, ``lang_pred`` and ``score``; ``und`` and 0 for null and letterless texts."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                langs, score = predict(shared.value, part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(score)],
                    names=[*part.schema.names[: len(keep)], "lang_pred", "score"],
                )

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("text__whole"))
    return chosen.mapInArrow(run, chosen.drop("text__whole").schema.add("lang_pred", "string").add("score", "double"))


def held_out() -> Column:
    return id_remainder() == 0
