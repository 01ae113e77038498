"""Mixing and language-model scoring against direct versions; the pipeline as a whole."""

import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from compare import check, connect
from llm_data import ODD, WORDS, lower, no_docs, odd_docs
from test_llm_near import direct_components, direct_containment, fingerprint

from ledgerloom.llm import common, kneser_ney, mixing, queries
from ledgerloom.session import reliable_checkpoint

FOLDER = "/root/testdata/sf0.001"


def direct_targets(sizes):
    """Resharing round by round until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in rest) for s in names}
        above = {s for s in rest if target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


def test_targets(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 30):
        sizes = {f"s{k}": int(x) for k, x in enumerate(rng.integers(0, 10 ** rng.integers(1, 6, n)))} | {None: 5}
        rows = [(s, x) for s, x in sizes.items()]
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
        want = direct_targets(sizes)
        assert set(got) == set(want)
        for s in want:
            assert got[s] == pytest.approx(want[s], rel=1e-9)


def test_plan_and_mix_agree(spark):
    docs = odd_docs(spark)
    plan = mixing.plan_mix(docs).collect()
    sizes = defaultdict(int)
    for r in ODD:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    want = direct_targets(sizes)
    assert sorted(((r.doc_id, r.size, r.source_size) for r in plan), key=str) == sorted(((r[0], len(WORDS.findall(r[1] or "")), sizes[r[3]]) for r in ODD), key=str)
    assert all(r.taken <= 3 * r.size for r in plan)
    assert sorted(round(r.target, 6) for r in plan) == sorted(round(want[r[3]], 6) for r in ODD)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORDS.findall(r.text or "")) for r in mixed.collect()) == sum(r.taken for r in plan)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(no_docs(spark)).collect() == [] and mixing.plan_mix(no_docs(spark)).collect() == []


def test_mixing_matches_sql(spark):
    difference, rows, _, _ = check(spark, connect(FOLDER), FOLDER, "op8_mixing")
    assert difference is None and rows == 200


def test_taken_words_come_near_targets(spark):
    folder = "/root/testdata/sf0.1"
    plan = mixing.plan_mix(queries.table(spark, folder, "documents"))
    rows = plan.groupBy("source_size", "target").agg({"taken": "sum"}).collect()
    assert sum(r["sum(taken)"] for r in rows) == pytest.approx(sum(r.target for r in rows), rel=0.01)
    for r in rows:
        assert r["sum(taken)"] == pytest.approx(r.target, rel=0.03)


def tokens(text):
    return [*WORDS.findall(lower(text)), None]


def direct_model(train, order):
    grams = Counter()
    for text in train:
        t = ["<"] * (order - 1) + tokens(text)
        grams.update(tuple(t[i - order + 1 : i + 1]) for i in range(order - 1, len(t)))
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    single = Counter(x for text in train for x in tokens(text))
    contexts, discounts = {}, {}
    for k, counts in levels.items():
        of = Counter(counts.values())
        discounts[k] = kneser_ney._discounts(of[1], of[2], of[3], of[4])
        contexts[k] = defaultdict(lambda: [0, 0, 0, 0])
        for g, n in counts.items():
            contexts[k][g[:-1]][0] += n
            contexts[k][g[:-1]][min(n, 3)] += 1

    def probability(gram):
        p = 1 / (len(single) + 1)
        for k in range(1, order + 1):
            g = gram[order - k :]
            if g[:-1] in contexts[k]:
                c, (total, *n), d = levels[k][g], contexts[k][g[:-1]], discounts[k]
                p = (c - (d[min(c, 3) - 1] if c else 0)) / total + sum(map(lambda a, b: a * b, d, n)) / total * p
        return p

    return single, probability


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order, monkeypatch):
    monkeypatch.setattr(kneser_ney, "TEXTS", 7)
    monkeypatch.setattr(kneser_ney, "SCORED", 7)
    docs = odd_docs(spark).select("doc_id", "text").union(queries.table(spark, FOLDER, "documents").select("doc_id", "text").where("doc_id < 60"))
    rows = docs.collect()
    model = kneser_ney.train(docs.where(common.id_remainder() != 1), order, part_bytes=20_000)
    train = [r.text for r in rows if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 != 1]
    single, probability = direct_model(train, order)
    n = sum(single.values())
    assert (model.train_tokens, model.vocabulary) == (n, len(single)) and model.parts > 4
    want = []
    for r in rows:
        t = tokens(r.text)
        padded = ["<"] * (order - 1) + t
        base = sum(math.log10((single[x] + 0.5) / (n + 0.5 * (len(single) + 1))) for x in t)
        own = sum(math.log10(probability(tuple(padded[i : i + order]))) for i in range(len(t)))
        want.append((str(r.doc_id), len(t), sum(single[x] > 0 for x in t), n, round(base, 6), round(own, 6)))
    got = [(str(r[0]), r[1], r[2], r[3], round(r[4], 6), round(r[5], 6)) for r in kneser_ney.score_texts(docs, model, "doc_id").collect()]
    assert sorted(got) == sorted(want)
    start = ("<",) * (order - 1)
    assert sum(probability((*start, x)) for x in single) + probability((*start, "never seen")) == pytest.approx(1)


def test_packed_figures():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 1000, 5000), np.where(rng.random(5000) < 0.01, 1 << 40, 3)]
    for some in (columns, [columns[0]], [columns[1] + (1 << 20)], [x[:0] for x in columns]):
        packed, rows = kneser_ney.pack([x.astype(np.uint64) for x in some]), rng.permutation(len(some[0]))
        assert (packed.at(rows) == np.stack(some)[:, rows]).all()


def test_found_hashes():
    # leading bits shared by several hashes: all are found, and nothing else
    mixed = np.sort(np.array([(h << 32) | (l << 16) for h in (0, 5, 5 << 20) for l in (0, 7, 9, 65535)], dtype=np.uint64))
    held = kneser_ney.Hashes(*kneser_ney._cut(mixed))
    hit, place = held.find(mixed)
    assert hit.tolist() == place.tolist() == list(range(len(mixed)))
    hit, _ = held.find(np.sort(np.concatenate([mixed + np.uint64(1 << 16), np.array([1 << 63], dtype=np.uint64)])))
    assert len(hit) == 0 and len(kneser_ney.Hashes(*kneser_ney._cut(mixed[:0])).find(mixed[:0])[0]) == 0


def test_model_of_nothing(spark):
    model = kneser_ney.train(no_docs(spark))
    rows = kneser_ney.score_texts(odd_docs(spark), model, "doc_id").collect()
    assert len(rows) == len(ODD) and all(r.n_known == 0 and r.score == 0 for r in rows)
    assert kneser_ney.score_texts(no_docs(spark), model, "doc_id").collect() == []


def test_language_model_query(spark):
    rows = queries.op10_language_model(spark, FOLDER).collect()
    assert len(rows) == 200 and all(r.score < 0 and r.n_known <= r.n_tokens for r in rows)
    assert np.mean([r.score / r.n_tokens for r in rows if not r.held_out]) > np.mean([r.base_score / r.n_tokens for r in rows if not r.held_out])


def test_pipeline_stages(spark):
    docs = queries.table(spark, FOLDER, "documents")
    items = [tuple(r) for r in queries.table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = reliable_checkpoint(stage(spark, docs, FOLDER))
        after = docs.collect()
        seen.append(len(after))
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            assert len(after) == len(before)  # every text here has letters
        if k == 1:
            want = direct_components([(r.doc_id, fingerprint(r.text, 4)) for r in before], 4)
            assert sorted(r.doc_id for r in after) == sorted({c for *_, c in want})
        if k == 2:
            leaks = {d for d, *_ in direct_containment([(r.doc_id, r.text) for r in before], items)}
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if r.doc_id not in leaks)
        if k == 3:
            taken = {r.doc_id: r.taken // max(r.size, 1) for r in mixing.plan_mix(spark.createDataFrame(before, docs.schema)).collect()}
            assert Counter(r.doc_id for r in after) == Counter({d: n for d, n in taken.items() if n})
        if k == 4:
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    assert seen[1] < seen[0] and seen[2] < seen[1]


def test_pipeline_on_odd_rows(spark):
    docs = odd_docs(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = reliable_checkpoint(stage(spark, docs, FOLDER))
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    empty = no_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        empty = reliable_checkpoint(stage(spark, empty, FOLDER))
    assert empty.collect() == []
