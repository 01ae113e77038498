"""SimHash, paragraphs, decontamination and components against direct versions."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from compare import check, connect
from llm_data import BON, LOREM, ODD, WORDS, Sets, lower, no_docs, odd_docs

from ledgerloom.llm import components, decontaminate, paragraphs, queries, simhash

FOLDER = "/root/testdata/sf0.001"


# --- components ---


def test_components(spark):
    rng = random.Random(5)
    for n, m in ((1, 0), (30, 12), (200, 180)):
        edges = [(rng.randrange(n) - 5, rng.randrange(n) - 5) for _ in range(m)]
        sets = Sets(n)
        for a, b in edges:
            sets.join(a + 5, b + 5)
        rows = [*edges, *edges[:3], (None, 1)]
        got = {r.node: r.root for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
        assert got == {x: sets.find(x + 5) - 5 for e in edges for x in e if e[0] != e[1] or x in got}


def test_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(2000, 2400)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[k] for k in range(2000, 2400)} == {1000}


# --- SimHash ---


def fingerprint(text, k):
    words = WORDS.findall(lower(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def direct_components(rows, distance):
    """[(doc_id, fingerprint, component_id)] by comparing every pair."""
    prints = np.array([f for _, f in rows], dtype=np.uint64)
    sets = Sets(len(rows))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= distance) + i + 1:
            sets.join(i, int(j))
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[sets.find(i)].append(doc_id)
    return sorted([(d, format(f, "016x"), min(least[sets.find(i)], default=None)) for i, (d, f) in enumerate(rows)], key=str)


def as_rows(found):
    return sorted([(r.doc_id, format(r.fp & (1 << 64) - 1, "016x"), r.component_id) for r in found.collect()], key=str)


@pytest.mark.parametrize("words,distance", [(4, 4), (2, 1), (4, 9)])
def test_simhash_odd(spark, words, distance):
    docs = odd_docs(spark)
    rows = [(r[0], fingerprint(r[1], words)) for r in ODD]
    assert as_rows(simhash.near_duplicates(docs, words, distance)) == direct_components(rows, distance)
    assert simhash.near_duplicates(no_docs(spark), words, distance).collect() == []


def test_simhash_table(spark):
    docs = queries.table(spark, FOLDER, "documents").select("doc_id", "text").collect()
    want = direct_components([(r.doc_id, fingerprint(r.text, 4)) for r in docs], 4)
    assert sorted(map(tuple, queries.op9_simhash(spark, FOLDER).collect()), key=str) == want


def test_links_connect_everything(spark, monkeypatch):
    """Correlated fingerprints with large buckets, split into small blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 50)
    rng = np.random.default_rng(2)
    prints = set()
    for centre in rng.integers(0, 1 << 62, 6):
        for _ in range(120):
            flips = rng.choice(20, rng.integers(0, 9), replace=False)
            prints.add(int(centre) ^ sum(1 << int(b) for b in flips))
    prints = sorted(prints)
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 4).collect()
    direct, listed = Sets(len(prints)), Sets(len(prints))
    at = {p: i for i, p in enumerate(prints)}
    for r in found:
        assert bin(r.a ^ r.b).count("1") <= 4
        listed.join(at[r.a], at[r.b])
    array = np.array(prints, dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(array[i] ^ array) <= 4):
            direct.join(i, int(j))
    assert [direct.find(i) for i in range(len(prints))] == [listed.find(i) for i in range(len(prints))]


def test_forest_and_runs_agree():
    rng = np.random.default_rng(4)
    prints = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    direct, spread = Sets(len(prints)), Sets(len(prints))
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints) <= 2):
            direct.join(i, int(j))
    for a, b in zip(*simhash.forest(prints, 2)):
        spread.join(int(a), int(b))
    assert [direct.find(i) for i in range(len(prints))] == [spread.find(i) for i in range(len(prints))]


def test_thresholds_add_up():
    for distance in (0, 1, 4, 7):
        shares = [np.array([0.5, 0.3, 0.2] + [0.0] * 14)] * 4  # a share for each distance within 16 bits
        cost, chosen = simhash.allot(1000, [16] * 4, shares, distance)
        assert sum(chosen) == distance - 4 + 1


def test_one_of_each(spark):
    got = simhash.one_of_each(odd_docs(spark), 4, 4)
    assert got.columns == odd_docs(spark).columns
    rows = [(r[0], fingerprint(r[1], 4)) for r in ODD]
    wanted = {c for *_, c in direct_components(rows, 4)}
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted(wanted, key=str)
    assert simhash.one_of_each(no_docs(spark), 4, 4).collect() == []


# --- paragraphs ---


def direct_repeats(rows):
    """{(doc_id, paragraph): (start, stop, kept doc, kept paragraph)} by comparing all classes."""
    places = defaultdict(list)
    for doc_id, text in rows:
        at = 0
        for k, line in enumerate((text or "").split("\n")):
            words = line.encode().lower().split()
            if len(words) >= 5:
                places[b" ".join(words)].append((doc_id is None, doc_id, k, at, at + len(line)))
            at += len(line) + 1
    keys = list(places)
    shingles = [{tuple(k.split(b" ")[i : i + 5]) for i in range(len(k.split(b" ")) - 4)} for k in keys]
    sets = Sets(len(keys))
    for i, a in enumerate(shingles):
        for j, b in enumerate(shingles[:i]):
            if len(a & b) >= 0.8 * len(a | b) - 1e-9:
                sets.join(i, j)
    groups = defaultdict(list)
    for i, k in enumerate(keys):
        groups[sets.find(i)] += places[k]
    out = []
    for members in groups.values():
        members.sort(key=lambda m: (m[0], m[1] or 0, m[2]))
        out += [(m[1], m[2], m[3], m[4], members[0][1], members[0][2]) for m in members[1:]]
    return sorted(out, key=str)


def listed(found):
    return sorted([(r.doc_id, r.paragraph, r.start, r.stop, r.kept_doc_id, r.kept_paragraph) for r in found.collect()], key=str)


def near_copies(n):
    """Copies of a long line with one word changed each: linked to the original, not to each other."""
    words = [f"w{i}" for i in range(60)]
    rows = [(100, " ".join(words))]
    for k in range(n):
        rows.append((101 + k, "intro line of a few words here %d\n" % k + " ".join(w if i != (k * 7) % 60 else f"x{k}" for i, w in enumerate(words))))
    return rows


def test_paragraphs_odd(spark):
    # equal ids: which of two equal documents comes first is not fixed, so they are left out here
    rows = [(r[0], r[1], r[2], r[3]) for r in ODD if r[0] not in (9, None)] + [(None, LOREM + "\n" + BON, "en", "a")]
    assert listed(paragraphs.repeated_paragraphs(odd_docs(spark, rows))) == direct_repeats([r[:2] for r in rows])
    assert paragraphs.repeated_paragraphs(no_docs(spark)).collect() == []


def test_paragraphs_table(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, FOLDER, "documents").collect()]
    got, want = set(listed(paragraphs.repeated_paragraphs(queries.table(spark, FOLDER, "documents")))), set(direct_repeats(docs))
    assert len(got ^ want) <= 0.01 * len(want) and not got - want


def word_runs(text, n):
    """Every ``n`` words in a row, with start and end (code points)."""
    words = [(m.group().encode().lower(), *m.span()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    return [(tuple(w for w, *_ in words[k : k + n]), words[k][1], words[k + n - 1][2]) for k in range(len(words) - n + 1)]


def check_substrings(rows, found):
    """Every run of 50 words that a document with a smaller id holds meets a removal; removals stand where they are said to."""
    texts, first = dict(rows), {}
    spans = defaultdict(list)
    for r in found:
        assert r.n_words >= (paragraphs.WORDS if r.whole_line else paragraphs.LEAST)
        spans[r.doc_id].append((r.start, r.stop))
        if not r.whole_line:
            words = [w for w, *_ in word_runs(texts[r.doc_id][r.start : r.stop], paragraphs.LEAST)]
            kept = {w for w, *_ in word_runs(texts[r.kept_doc_id], paragraphs.LEAST)}
            assert len(words) == r.n_words - paragraphs.LEAST + 1 and words[0] in kept and words[-1] in kept
            assert texts[r.doc_id][: r.start].count("\n") == r.paragraph
            assert not r.exact or set(words) <= kept
    met = 0
    for doc_id in sorted(texts):
        for run, start, stop in word_runs(texts[doc_id], 50):
            if first.setdefault(run, doc_id) != doc_id:
                met += 1
                assert any(a < stop and b > start for a, b in spans[doc_id]), (doc_id, start)
    return met


def test_substrings_table(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, FOLDER, "documents").collect()]
    found = queries.op7_paragraphs(spark, FOLDER).collect()
    assert check_substrings(rows, found) > 1000
    # lines are those of the direct comparison, short ones too
    lines = {(r.doc_id, r.paragraph) for r in found if r.whole_line}
    want = {(d, k) for d, k, *_ in direct_repeats(rows)}
    assert len(lines ^ want) <= 0.01 * len(want) and not lines - want


def test_substrings_odd(spark):
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"q{rng.randrange(10**7)}" for _ in range(n))
    passage = fresh(50)
    rows = [
        (1, f"{fresh(33)} {passage} {fresh(20)}"), (2, f"{fresh(7)}\n{passage.upper().replace(' ', chr(10))} {fresh(5)}"), (3, fresh(60)), (4, None), (5, ""),
        (6, " \n "), (7, "a b c"), (8, f"{fresh(3000)} {passage} {fresh(3000)}"), (9, "same " * 400), (10, f"{passage} {fresh(2)} {passage}"),
        (11, " ".join(passage.split()[:39])), (12, "é€ " * 45), (13, "É€ " * 45),
    ]
    found = paragraphs.repeated_substrings(odd_docs(spark, [(*r, "en", "a") for r in rows])).collect()
    assert check_substrings(rows, found) == 4
    assert {r.doc_id for r in found} == {2, 8, 9, 10} and {r.kept_doc_id for r in found} == {1, 9}
    assert all(r.exact for r in found if r.doc_id in (2, 8, 10)) and sum(r.doc_id == 10 for r in found) == 2
    # equal and null ids are separate documents; nulls come last
    twice = [(None, passage, "en", "a"), (1, passage, "en", "a"), (1, passage, None, None), (None, None, None, None)]
    found = paragraphs.repeated_substrings(odd_docs(spark, twice)).collect()
    assert sorted((str(r.doc_id), r.kept_doc_id, r.whole_line) for r in found) == [("1", 1, False), ("1", 1, True), ("None", 1, False), ("None", 1, True)]
    assert paragraphs.repeated_substrings(no_docs(spark)).collect() == []


def test_substrings_short_lines(spark):
    rng = random.Random(4)
    line = [f"s{rng.randrange(10**7)}" for _ in range(39)]
    near = " ".join(line[:-1] + ["other"])
    rows = [(1, " ".join(line)), (2, f"x y\n{near}"), (3, "one two three four five"), (4, "q\nOne two  three four five\n"), (5, "one two three four")]
    found = paragraphs.repeated_substrings(odd_docs(spark, [(*r, "en", "a") for r in rows])).collect()
    assert {(r.doc_id, r.paragraph, r.kept_doc_id, r.n_words, r.exact, r.whole_line) for r in found} == {(2, 1, 1, 39, False, True), (4, 1, 3, 5, True, True)}


def direct_cuts(text):
    """Hash, first word, line, start and stop of the paragraphs cut by content, from one text alone."""
    runs = word_runs(text, 40)
    if not runs:
        return []
    words = [xxhash.xxh64_intdigest(w) for w, *_ in [(m.group().encode().lower(),) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]]
    hashes = paragraphs.run_hashes(np.array(words, dtype=np.uint64), 40).tolist()
    width = min(11, len(runs))
    at = sorted({min(range(k, k + width), key=lambda i: (hashes[i], i)) for k in range(len(runs) - width + 1)})
    return [(hashes[i], i, text[: runs[i][1]].count("\n"), runs[i][1], runs[i][2]) for i in at]


def test_cut_many_texts():
    rng = random.Random(6)
    long = ["\n".join(" ".join(rng.choice("abé€X") for _ in range(rng.randrange(9))) for _ in range(90)) for _ in range(5)]
    texts = [None, "", " \n ", "a b", "é " * 39, "w " * 40, " \n" + "x é€\t" * 22, *long, "y " * 300, None]
    row, hashes, *rest = paragraphs.cut_texts(pa.array(texts, pa.string()), paragraphs.WordHashes())
    got = list(zip(row.tolist(), hashes.view(np.uint64).tolist(), *(x.tolist() for x in rest)))
    assert got == [(i, *r) for i, t in enumerate(texts) for r in direct_cuts(t or "")] and len(got) > 20
    assert len(paragraphs.cut_texts(pa.array([None, "a"], pa.string()), paragraphs.WordHashes())[0]) == 0


def test_run_hashes():
    words = np.array([random.Random(5).randrange(2**63) for _ in range(90)] * 2, dtype=np.uint64)
    for n in (1, 2, 3, 26, 40, 90, 180):
        found = paragraphs.run_hashes(words, n)
        want = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        assert len(found) == len(want) and len(set(found.tolist())) == len(set(want))


def test_paragraph_star_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "BLOCK", 16)
    rows = near_copies(80)
    got = listed(paragraphs.repeated_paragraphs(odd_docs(spark, [(*r, "en", "a") for r in rows])))
    assert got == direct_repeats(rows)
    assert sum(r[4] == 100 for r in got) == 80


def test_bands_reach_the_recall():
    bands, rows = paragraphs.tune()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999
    rng, hits = random.Random(1), 0
    for k in range(400):
        words = [b"%d" % rng.randrange(10**6) for _ in range(72)]
        other = words[:36] + [b"z"] + words[37:]  # Jaccard 63 / 73
        a, b = paragraphs.band_values([words, other], bands, rows)
        hits += bool((a == b).any())
    assert hits >= 396


# --- decontamination ---


def direct_containment(docs, items):
    def shingles(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    classes = defaultdict(list)
    for item_id, text in items:
        if shingles(text):
            classes[frozenset(shingles(text))].append(item_id)
    out = []
    for doc_id, text in docs:
        have = shingles(text)
        for wanted, ids in classes.items():
            n = len(wanted & have)
            if n >= 0.8 * len(wanted) - 1e-9:
                out.append((doc_id, min((i for i in ids if i is not None), default=None), len(ids), len(wanted), n))
    return sorted(out, key=str)


ITEMS = [
    (1, LOREM), (2, LOREM.upper()), (None, BON), (3, None), (4, ""), (5, "one"), (6, "!!"),
    (7, " ".join(f"w{i}" for i in range(40))), (8, "x" * 5000), (9, "the quick brown fox jumps over the lazy dog"),
]
SPLIT = [
    (30, " ".join(f"w{i}" for i in range(36)) + " tail"),  # 32 of 36 shingles
    (31, " ".join(f"w{i}" for i in range(31))),  # 27 of 36
    (32, "word " * 20_000 + " ".join(f"W{i}," for i in range(40)) + " word" * 20_000),
    (33, " ".join(f"w{i}" if i != 20 else "changed" for i in range(40))),  # 31 of 36
    (34, " ".join(f"w{i}" for i in range(20)) + " gap " + " ".join(f"w{i}" for i in range(19, 40))),
]


def found_items(found):
    return sorted([(r.doc_id, r.item_id, r["items"], r.n_shingles, r.n_found) for r in found.collect()], key=str)


def test_containment_odd(spark):
    rows = ODD + [(*r, "en", "a") for r in SPLIT]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = found_items(decontaminate.contained_items(odd_docs(spark, rows), items))
    assert got == direct_containment([r[:2] for r in rows], ITEMS)
    assert decontaminate.contained_items(no_docs(spark), items).collect() == []
    assert decontaminate.contained_items(odd_docs(spark), items.limit(0)).collect() == []


def test_sketch_never_misses(spark):
    """Every document that lacks the sketch of an item lacks more of it than containment allows."""
    rng, items = random.Random(8), []
    for k in range(60):
        items.append((k, " ".join(f"i{k}w{j}" for j in range(rng.randrange(5, 90)))))
    shingles = decontaminate.item_shingles(spark.createDataFrame(items, "item_id long, text string")).collect()
    by = defaultdict(list)
    for r in shingles:
        by[r.item_id].append(r)
    for rows in by.values():
        n, k = rows[0].n, sum(r.in_sketch for r in rows)
        assert len(rows) == n and n - k < 0.8 * n
        assert {r.hash for r in rows if r.in_sketch} == set(sorted(r.hash for r in rows)[:k])


def test_clean(spark):
    rows = ODD + [(*r, "en", "a") for r in SPLIT]
    docs, items = odd_docs(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.clean(docs, items)
    dirty = {(d, i) for d, i, *_ in direct_containment([r[:2] for r in rows], ITEMS)}
    texts = [r[1] for r in rows if not direct_containment([(r[0], r[1])], ITEMS)]
    assert got.columns == docs.columns and dirty
    assert sorted((r.text for r in got.collect()), key=str) == sorted(texts, key=str)


def test_containment_matches_sql(spark):
    difference, rows, _, _ = check(spark, connect(FOLDER), FOLDER, "op6_decontaminate")
    assert difference is None


def test_containment_plan_is_native(spark):
    plan = queries.op6_decontaminate(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
