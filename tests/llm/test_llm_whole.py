"""The whole job where a shorter one would go unnoticed."""

import math
import re

import pytest
from llm_data import lower, no_docs, odd_docs
from test_llm_mix_score import direct_model, tokens
from test_llm_near import direct_repeats
from test_llm_quality import stratum

from ledgerloom.llm import kneser_ney, paragraphs, quality, queries

FOLDER = "/root/testdata/sf0.001"


def test_default_model_uses_two_words_of_context(spark):
    texts = ["a b c d"] * 4 + ["x b y d"] * 4 + ["a b c", "x b y", "b c", "b y"]
    docs = odd_docs(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])
    model = kneser_ney.train(docs)
    assert model.order == 3
    _, probability = direct_model(texts, 3)
    for r in kneser_ney.score_texts(docs, model, "doc_id").collect():
        padded = ["<", "<", *tokens(texts[r.doc_id])]
        assert r.score == pytest.approx(sum(math.log10(probability(tuple(padded[i : i + 3]))) for i in range(r.n_tokens)))
    # one word of context cannot tell these apart
    assert probability(("a", "b", "c")) > 2 * probability(("x", "b", "c"))


def direct_passages(rows):
    """{(doc_id, code point)} of the words in runs of 50 that stand earlier too, in lines that stay; ids ascend."""
    gone = {x[:2] for x in direct_repeats(rows)}
    first, found = {}, set()
    for doc_id, text in rows:
        words, at = [], 0
        for k, line in enumerate((text or "").split("\n")):
            for m in re.finditer(r"[^\x20\x09-\x0D]+", line):
                words.append((lower(m[0]), at + m.start(), (doc_id, k) in gone))
            at += len(line) + 1
        for a in range(len(words) - 49):
            run = words[a : a + 50]
            if not any(x[2] for x in run):
                seen = first.setdefault(tuple(x[0] for x in run), (doc_id, a))
                if seen[0] != doc_id or a >= seen[1] + 50:
                    found |= {(doc_id, x[1]) for x in run}
    return found


def covered(rows, found):
    texts = dict(rows)
    starts = lambda r: [r.start + m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[r.doc_id][r.start : r.stop])]
    assert all(len(starts(r)) == r.n_words >= 50 for r in found)
    return {(r.doc_id, at) for r in found for at in starts(r)}


def test_passages_in_lines_that_stay(spark):
    passage, other = [f"w{k}" for k in range(60)], [f"v{k}" for k in range(300)]
    rows = [
        (1, " ".join(other[:90] + passage + other[90:180])),
        (2, "\n".join(" ".join(passage[k : k + 4]).upper() for k in range(0, 60, 4))),  # broken into lines too short to count
        (3, " ".join(other[200:280] + passage[5:56] + other[280:])),
        (4, " ".join(passage[:49])),
        (5, " ".join(["same"] * 200)),
        (6, None),
    ]
    got = paragraphs.repeated_passages(odd_docs(spark, [(*r, "en", "a") for r in rows])).collect()
    assert not any(r.whole_line for r in got)
    assert sorted((r.doc_id, r.n_words, r.kept_doc_id, r.exact) for r in got) == [(2, 60, 1, True), (3, 51, 1, True), (5, 150, 5, False)]
    assert covered(rows, got) == direct_passages(rows)
    assert paragraphs.repeated_passages(no_docs(spark)).collect() == []


def test_passages_match_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in queries.table(spark, FOLDER, "documents").collect())
    got = queries.op7_passages(spark, FOLDER).collect()
    want = direct_passages(rows)
    assert want and covered(rows, [r for r in got if not r.whole_line]) == want


def test_five_hundred_good_labels_certify(spark):
    assert quality.choose_cutoffs(*stratum(spark, 500, 50, 60)) == {("x", "symbols"): 0.5}
    assert quality.choose_cutoffs(*stratum(spark, 500, 50, 60, value_good=60)) == {}
