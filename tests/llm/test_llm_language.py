import numpy as np
import regex
from llm_data import BON, LOREM, no_docs, odd_docs

from ledgerloom.llm import language_id, queries

SAMPLES = {"en": [LOREM, "a second sample of plain words"], "fr": [BON], "de": ["der schnelle braune fuchs springt über den faulen hund"]}


def parse(text, lang):
    """Phrases of a text by looking for longest matches in the sample texts."""
    gaps = lambda x: regex.sub(r"[^\p{L}\p{M}]+", " ", x.lower())
    samples, text = [gaps(x) for x in SAMPLES[lang]], gaps(text)
    n = 0
    for at in range(0, len(text), language_id.PIECE):
        piece, i = text[at : at + language_id.PIECE], 0
        while i < len(piece):
            k = 1
            while i + k <= len(piece) and any(piece[i : i + k] in s for s in samples):
                k += 1
            i, n = i + max(k - 1, 1), n + 1
    return n


def test_phrases_are_longest_matches():
    model = language_id.fit(SAMPLES)
    assert model.langs == ["de", "en", "fr"]
    texts = ["quick wizards jump", "la rivière, blanche! et un fuchs", "zzz", "...", LOREM * 9, "a", "fox\njumps", ("den hund " + BON) * 20]
    raw = "".join(texts).encode("utf-32-le")
    codes = model.classes[np.frombuffer(raw, np.uint32)]
    sizes = np.array([len(x) for x in texts])
    kept = np.ones(len(codes), dtype=bool)
    kept[1:] = (codes[1:] != language_id.GAP) | (codes[:-1] != language_id.GAP)
    ends = np.cumsum(sizes)
    kept[ends[:-1]] = True
    got = language_id.phrases(model, codes[kept], np.diff(np.cumsum(kept)[ends - 1], prepend=0))
    # letters outside the samples share classes, so only texts of known letters are compared
    for k, lang in enumerate(model.langs):
        known = set(regex.sub(r"[^\p{L}\p{M}]+", "", "".join(x for s in SAMPLES.values() for x in s)).lower()) | {" "}
        for t, n in zip(texts, got[k]):
            if set(regex.sub(r"[^\p{L}\p{M}]+", " ", t.lower())) <= known:
                assert n == parse(t, lang), (lang, t)


def test_prediction_does_not_depend_on_neighbours():
    model = language_id.fit(SAMPLES)
    texts = [LOREM, " ...", BON, "", None, "12", "... der hund ...", "  den"]
    langs, score = language_id.predict(model, texts)
    assert langs == ["en", "und", "fr", "und", "und", "und", "de", "de"]
    for k, t in enumerate(texts):
        one, s = language_id.predict(model, [t])
        assert one == [langs[k]] and s[0] == score[k]
    assert ((score >= 0) & (score <= 1)).all()


def test_odd_documents(spark):
    docs = odd_docs(spark)
    model = language_id.learn(docs, ~language_id.held_out())
    rows = language_id.identify(docs, model, *docs.columns).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not regex.search(r"\p{L}", r.text or ""))
    nothing = language_id.learn(no_docs(spark))
    assert {r.lang_pred for r in language_id.identify(docs, nothing, "doc_id").collect()} == {"und"}
    assert language_id.identify(no_docs(spark), model, "doc_id").collect() == []


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op4_language(spark, folder).join(queries.table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").collect()
    assert len(held) > 100
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.97
