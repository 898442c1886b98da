import zlib

import edge
import numpy as np
import pytest

from lapse.llm import language

EN = "the and that with which there would their about other than these when them then"
DE = "der und dass mit welche dort wäre ihre über andere als diese wenn sie dann nicht"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(40)]
    return language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_known_texts(model):
    names, score = language.classify([EN, DE, "THERE WOULD!! ### then", "Wäre  über"], model)
    assert names == ["en", "de", "en", "de"] and (score > 0.8).all()


def test_texts_without_language(model):
    names, score = language.classify([None, "", " 12 !? \n", "…"], model)
    assert names == ["und"] * 4 and (score == 0).all()
    names, score = language.classify(["qqxqzz"], model)
    assert names[0] in model.languages and score[0] < 0.01


def test_each_text_stands_alone(model):
    alone = [language.classify([t], model) for t in edge.texts()]
    names, score = language.classify(edge.texts(), model)
    assert names == [n for (n,), _ in alone]
    assert np.allclose(score, [s for _, (s,) in alone])


def test_long_texts_are_cut_into_pieces(model, monkeypatch):
    whole = language.classify([EN * 50, DE, "x"], model)
    monkeypatch.setattr(language, "CHUNK", 300)
    names, score = language.classify([EN * 50, DE, "x"], model)
    assert names == whole[0] and np.allclose(score, whole[1], atol=0.05)


def test_false_positives_are_corrected(spark):
    """A filter so small that every language claims foreign n-grams still tells them apart."""
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(40)]
    small = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), slots=256)
    assert max(small.false_rate) > 0.05
    names, score = language.classify([EN, DE, "zzqx xqzz jjvq vqjj wxyz"], small)
    assert names[:2] == ["en", "de"] and score[2] < 0.3


def test_bounded_sample(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language.train(docs, rows_per_language=20).languages) == {"en", "de"}


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, model, extra):
    docs = edge.documents(spark, extra)
    rows = language.predict(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        assert 0 <= r["score"] <= 1
    nothing = language.train(edge.empty(spark))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(edge.empty(spark), model).collect() == []


@pytest.mark.skipif(not edge.have_data(), reason="test tables not present")
def test_held_out_accuracy(spark):
    from lapse.llm.queries import op5_language_id

    sf = edge.SMALL.replace("0.001", "0.01")
    truth = {r["doc_id"]: r["lang"] for r in edge.small(spark, sf=sf).collect()}
    rows = op5_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.98


def test_languages_with_many_ngrams_are_kept(spark):
    """Far more distinct n-grams than a list's least length: clean documents stay, labelled or not, others go."""
    import random

    import corpus_pipeline as pipeline

    rng = random.Random(12)
    words = ["".join(chr(rng.randint(0x4E00, 0x5600)) for _ in range(rng.randint(1, 3))) for _ in range(1500)]
    text = lambda: "".join(rng.choices(words, k=40))
    foreign = lambda: " ".join("".join(chr(rng.randint(0x430, 0x44F)) for _ in range(6)) for _ in range(20))
    rows = [(i, text(), "zh") for i in range(1500)] + [(2000 + i, EN, "en") for i in range(300)]
    rows += [(3000 + i, text(), None) for i in range(200)] + [(4000 + i, foreign(), None) for i in range(50)]
    docs = spark.createDataFrame([(*r, "s", len(r[1])) for r in rows], edge.COLUMNS)
    model = language.train(docs)
    assert len(model.masks) > 1 << 20 and dict(zip(model.languages, model.least, strict=True))["en"] == 0.5
    kept = {r["doc_id"] for r in pipeline.identify_language(spark, docs, "").collect()}
    assert len([i for i in kept if i < 1500]) >= 1480 and len([i for i in kept if 3000 <= i < 4000]) >= 190
    assert not [i for i in kept if i >= 4000] and len([i for i in kept if 2000 <= i < 3000]) == 300


def test_more_languages_than_bits_in_a_word(spark):
    """Every labelled language is learned, also the rarest of 150."""
    import random

    rng = random.Random(13)
    words = {f"l{i:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(8)] for i in range(150)}
    rows = [(n, " ".join(rng.choices(w, k=12)), name) for i, (name, w) in enumerate(words.items()) for n in range(3 + i % 2)]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(model.languages) == sorted(words) and model.masks.shape[1] == 3
    names, score = language.classify([" ".join(w) for w in words.values()], model)
    assert names == list(words) and (score > 0.5).all()
