"""Token ids of many texts at once: every distinct piece of a batch is encoded once.

Byte-level BPE never merges across the step from a character that is not white space to a
space, so a text may be cut there.  Pieces are found and numbered by Arrow; the distinct
ones go through the tokenizer as one long text whose ids are cut apart again by the known
byte length of every id.  Texts with white space right before a space are encoded whole.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space (Unicode property) right before a space: no place to cut.
UNSAFE = r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: Distinct pieces that go through the tokenizer in one text.
JOINED = 500
#: Distinct pieces a worker remembers before it starts afresh.
REMEMBERED = 400_000


class Encoder:
    """Ids of byte-level BPE texts; ``encode`` maps texts to lists of ids, ``sizes`` an id to its bytes."""

    def __init__(self, encode, sizes: np.ndarray):
        self.encode, self.sizes = encode, sizes
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(0, dtype=np.uint32)
        self.begin = self.count = np.zeros(0, dtype=np.int64)

    def numbers(self, texts: list[str]) -> np.ndarray:
        """The number of each distinct piece; its ids are ``pool[begin[n] : begin[n] + count[n]]``."""
        if len(self.known) > REMEMBERED:
            self.forget()
        known = self.known
        missing = [x for x in texts if x not in known]
        joint = [x for x in missing if x[:1] == " "]
        alone = [x for x in missing if x[:1] != " "]
        groups = [joint[k : k + JOINED] for k in range(0, len(joint), JOINED)]
        ids, counts = [], []
        for group, found in zip(groups, self.encode(["".join(g) for g in groups])):
            found = np.array(found, dtype=np.uint32)
            want = np.cumsum(np.array([len(x.encode()) for x in group]))
            cuts = np.searchsorted(np.cumsum(self.sizes[found]), want) + 1
            ids.append(found)
            counts.append(np.diff(cuts, prepend=0))
        for found in self.encode(alone):
            ids.append(np.array(found, dtype=np.uint32))
            counts.append(np.array([len(found)]))
        if missing:
            first, fresh = len(known), np.concatenate(counts)
            known.update(zip(joint + alone, range(first, first + len(missing))))
            self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(fresh) - fresh])
            self.count = np.concatenate([self.count, fresh])
            self.pool = np.concatenate([self.pool, *ids])
        return np.fromiter(map(known.__getitem__, texts), dtype=np.int64, count=len(texts))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the number of ids of each text; null and empty texts have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, UNSAFE)
        spaced = pc.if_else(whole, "", texts)
        parts = pc.split_pattern(spaced, " ")
        flat, offsets = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy()
        # a space belongs to the piece behind it; only the first piece of a text has none
        later = coded.dictionary.to_pylist()
        opening = flat.take(pa.array(offsets[:-1])).dictionary_encode()
        codes = codes.astype(np.int64)
        codes[offsets[:-1]] = opening.indices.to_numpy() + len(later)
        used = np.zeros(len(later) + len(opening.dictionary), dtype=bool)
        used[codes] = True
        texts_of = [" " + x for x in later] + opening.dictionary.to_pylist()
        place = np.zeros(len(used), dtype=np.int64)
        place[used] = self.numbers([x for x, u in zip(texts_of, used) if u])
        codes = place[codes]
        counts = self.count[codes]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.arange(total) + np.repeat(self.begin[codes] - (ends - counts), counts)]
        per_text = np.diff(np.concatenate([[0], ends])[offsets]).astype(np.int64)
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(odd):
            split = np.split(ids, np.cumsum(per_text)[:-1])
            for i, x in zip(odd, self.encode(texts.take(pa.array(odd)).to_pylist())):
                split[i] = np.array(x, dtype=np.uint32)
            ids, per_text = np.concatenate(split), np.array([len(x) for x in split], dtype=np.int64)
        return ids, per_text


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows at 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def hub_encoder(path: str) -> Encoder:
    """An encoder from a byte-level tokenizer file in JSON; strings of added tokens in a text give their ids.

    No added token holds a space, so cutting at spaces cuts none.
    """
    from tokenizers import Tokenizer

    tokenizer, spec = Tokenizer.from_file(path), json.load(open(path, encoding="utf-8"))
    bytes_of = _byte_characters()
    vocabulary, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that reach over spaces are not supported")
    sizes = np.zeros(max([*vocabulary.values(), *added.values()]) + 1, dtype=np.int64)
    for token, i in vocabulary.items():
        sizes[i] = len(token) if all(c in bytes_of for c in token) else 0
    for token, i in added.items():
        sizes[i] = len(token.encode())
    return Encoder(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], sizes)


@cache
def rank_encoder(path: str, pattern: str) -> Encoder:
    """An encoder from a file of base64 tokens and their ranks."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return Encoder(lambda texts: [encoding.encode_ordinary(x) for x in texts], sizes)
