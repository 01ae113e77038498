"""Operators 11 to 13 against the library, brute force, and their SQL."""

import hashlib
import random
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from compare import connect
from llm_data import ODD, lower, no_docs, odd_docs
from pyspark.sql import functions as F

from ledgerloom.llm import collocations, fill_middle, queries, word_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"


def same_as_sql(spark, name):
    """The rows of a query and of its SQL, by column name."""
    got = queries.QUERIES[name](spark, FOLDER)
    want = connect(FOLDER).sql(queries.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    by_name = lambda rows, names: Counter(tuple(r[names.index(c)] for c in sorted(names)) for r in rows)
    assert by_name(map(tuple, got.collect()), got.columns) == by_name(want.fetchall(), want.columns)


# fill-in-middle


def brute_units(text):
    units = []
    for letter, run in groupby(text, lambda c: c.isascii() and c.isalpha()):
        units += ["".join(run)] if letter else list(run)
    return units


def brute_middle(doc_id, text):
    text = text or ""
    units = brute_units(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_middle_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choices("aBz é中\U0001f600\n\r<>PSM\0", k=rng.randrange(40))), None, None) for k in range(400)]
    rows += ODD + [(900 + k, x, None, None) for k, x in enumerate(("<P>", "a<M>", "<S", ">", "a" * 70_000, "1 " * 70_000))]
    found = fill_middle.fill_in_middle(odd_docs(spark, rows)).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = [tuple(r) for r in found.collect()]
    assert Counter(r[:6] for r in got) == Counter(brute_middle(*r[:2]) for r in rows)
    assert Counter((r[0], r[6]) for r in got) == Counter((r[0], r[1] or "") for r in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(no_docs(spark)).collect() == []


def test_middle_equals_sql(spark):
    same_as_sql(spark, "op11_fill_middle")


# collocations


def brute_phrases(rows, least, inside, best, longest):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        piece = lower(text)
        for c in ".,;:!?\n\v\f\r":
            piece = piece.replace(c, "\n")
        for p in piece.split("\n"):
            words = [w for w in p.replace("\t", " ").split(" ") if w]
            sizes[lang] += len(words)
            for m in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, found in counts.items():
        kept, often = [], {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, k = min((10**6 * a * a // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:best]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, sizes[lang], -score))
    return Counter(out)


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_phrases_equal_brute_force(spark, monkeypatch, longest):
    monkeypatch.setattr(collocations, "WORDS", 150)
    monkeypatch.setattr(collocations, "BYTES", 60)
    rng = random.Random(longest)
    words = ["a", "b", "A", "c", "é", "中", "x.y", "d\te", "f\x1cg", "z,", "!", "\r", "q"]
    rows = [(k, " ".join(rng.choices(words, weights=range(13, 0, -1), k=rng.randrange(60))), rng.choice(["en", "de", None, "und", ""]), None) for k in range(150)]
    rows += [*ODD, rows[3], rows[3]]
    for least, inside, best in ((3, 50, 2000), (10, 50, 7), (2, 20, 30)):
        got = collocations.collocations(odd_docs(spark, rows), longest, least, inside, best)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert Counter(map(tuple, got.collect())) == brute_phrases([(r[2], r[1]) for r in rows], least, inside, best, longest)
    assert collocations.collocations(no_docs(spark)).collect() == []


def test_score_is_exact_beyond_64_bits(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        a = rng.randrange(1, 10 ** rng.randrange(1, 15))
        rows.append((a, rng.randrange(a, 10**15), rng.randrange(a, 10**15)))
    rows += [(10**15 - 1,) * 3, (10**14, 10**15 - 1, 10**14)]
    got = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", collocations._score(F.col("a"), F.col("l"), F.col("r")))
    assert got.schema["s"].dataType.simpleString() == "bigint"
    assert all(r.s == 10**6 * r.a * r.a // (r.l * r.r) for r in got.collect())


def test_phrases_equal_sql(spark):
    same_as_sql(spark, "op12_collocations")


def test_phrases_are_merge_joined(spark):
    plan = queries.op12_collocations(spark, FOLDER)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" not in plan


# word BPE


def whole():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    return library


STRANGE = [
    "", None, " ", "Hello  World's 123", "don't WE'LL 'S I'M", "<|endoftext|>", "a<|endoftext|>b<|startoftext|> <|endoftext", "é é ́a ́",
    "İSTANBUL ΑΣ ΣΑΣ ß ﬁ Å", "a b c　d\x1ce\x85f", "😀👍🏽 中文字 한국어 العربية", "aaaaaaaaaaaaaaaaaaaaaaa", "banana" * 50, "\0\x01 \x7f", "½ ² ٣ ⅷ",
    "x" * 5000, "the" * 3000, "\U0001f600" * 900, "ab" * 2047 + "!!!!!!!" * 500, "가 Å  x",
]


def strings(n):
    rng = random.Random(3)
    letters = "aaabcdeeestinoрд中é́ \t\n'.,!-1²<|>😀 "
    return ["".join(rng.choices(letters, k=rng.randrange(80))) for _ in range(n)]


@pytest.mark.parametrize("long", [2048, 0, 5])
def test_bpe_equals_library(monkeypatch, long):
    monkeypatch.setattr(word_bpe, "LONG", long)
    library, bpe = whole(), word_bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    texts = STRANGE + strings(400 if long else 40)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time from memory
        ids, counts = bpe.encode(pa.array(texts))
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == want
    decoded = bpe.decode(pa.array(got, pa.list_(pa.int32()))).to_pylist()
    assert decoded == [library.decode(x, skip_special_tokens=False) for x in want]


def test_bpe_of_a_table(spark):
    library = whole()
    rows = [*ODD, *((100 + k, x, None, None) for k, x in enumerate(STRANGE))]
    bpe = queries.word_bpe_49k
    got = word_bpe.decode_ids(word_bpe.encode_texts(odd_docs(spark, rows), bpe), bpe).collect()
    want = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=key) == sorted(((d, i, library.decode(i, skip_special_tokens=False)) for d, i in want), key=key)
    assert word_bpe.encode_texts(no_docs(spark), bpe).collect() == []


def test_bpe_query_digests(spark):
    library = whole()
    docs = queries.table(spark, FOLDER, "documents").select("doc_id", "text").collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        want.append((d.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert Counter(map(tuple, queries.op13_word_bpe(spark, FOLDER).collect())) == Counter(want)


def test_bpe_refuses_other_tokenizers(tmp_path):
    import json

    with pytest.raises(Exception):
        word_bpe.WordBpe(public_tokenizers.path("byte_bpe_50k.json"))
    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    spec["model"]["merges"].reverse()
    (tmp_path / "x.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="build on earlier"):
        word_bpe.WordBpe(str(tmp_path / "x.json"))
