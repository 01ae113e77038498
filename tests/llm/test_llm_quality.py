import re
from collections import Counter
from math import comb

import pytest
from llm_data import WORDS, no_docs, odd_docs

from ledgerloom.llm import quality, queries

MORE = [
    (20, "of of of of of of " * 20, "en", "a"),
    (21, "a b c\na b c\n \nx\nx\n", "en", "a"),
    (22, "w%%% x*** y### z&&& " * 30, "en", "a"),
]


def brute(text):
    text = text or ""
    words, lines = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(lines), len(hit)


def test_measures(spark):
    from llm_data import ODD

    for docs in (odd_docs(spark, ODD + MORE), queries.table(spark, "/root/testdata/sf0.001", "documents"), no_docs(spark)):
        got = quality.measures(docs, "doc_id", "text").collect()
        assert [tuple(r)[2:] for r in got] == [brute(r.text) for r in got]


@pytest.mark.parametrize("k,n,doubt", [(0, 100, 0.05), (3, 50, 0.01), (7, 300, 0.001), (49, 50, 0.05), (0, 1, 0.2), (30, 4000, 1e-5)])
def test_exact_bound(k, n, doubt):
    p = quality.upper_bound(k, n, doubt)
    assert sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(doubt, rel=1e-6)


def test_bound_ends():
    assert quality.upper_bound(5, 5, 0.1) == 1.0
    assert quality.upper_bound(0, 0, 0.1) == 1.0


def stratum(spark, good, bad, value_bad, value_good=0):
    rows = [(i, "x", 100, 500, value_good, 0, 10, 0) for i in range(good)] + [(10**6 + i, "x", 100, 500, value_bad, 0, 10, 0) for i in range(bad)]
    labels = [(i, 1, 0) for i in range(good)] + [(10**6 + i, 0, 0) for i in range(bad)] + [(None, 0, 0), (5, None, 0)]
    measured = spark.createDataFrame(rows, "doc_id long, stratum string, " + ", ".join(f"{m} long" for m in quality.MEASURES))
    return measured, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_cutoffs_need_enough_good_labels(spark):
    assert quality.choose_cutoffs(*stratum(spark, 3000, 50, 60)) == {("x", "symbols"): 0.5}
    assert quality.choose_cutoffs(*stratum(spark, 300, 50, 60)) == {}
    assert quality.choose_cutoffs(*stratum(spark, 3000, 50, 60, value_good=60)) == {}
    assert quality.choose_cutoffs(*stratum(spark, 3000, 0, 60)) == {}


def test_judge(spark):
    from llm_data import ODD

    docs = odd_docs(spark, ODD + MORE)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (20, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(ODD + MORE)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.judge(no_docs(spark), labels).collect() == []


def test_few_good_documents_are_rejected(spark):
    folder = "/root/testdata/sf0.1"
    got = quality.judge(queries.table(spark, folder, "documents"), queries.table(spark, folder, "labels"))
    known = got.join(queries.table(spark, folder, "labels"), "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in known.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= quality.RISK * n[1, True]
    assert n[0, False] > 0
