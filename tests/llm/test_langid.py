import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import langid, queries

TEXTS = {
    "en": "the cat and the dog went out of the house with the old man who had been there before them all day long",
    "de": "der Hund und die Katze gingen aus dem Haus mit dem alten Mann der schon den ganzen Tag vor ihnen dort war",
    "fr": "le chat et le chien sont sortis de la maison avec le vieil homme qui avait été là avant eux toute la journée",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(t, k) for k, t in TEXTS.items()] + [(None, "en"), ("no label", None)]
    return langid.train(spark.createDataFrame(rows, "text string, lang string"))


def test_counts_equal_a_plain_count(model):
    assert model.languages == ("de", "en", "fr")
    for k, name in enumerate(model.languages):
        counts = np.bincount(langid._slots(TEXTS[name]), minlength=langid.SLOTS) + langid.SMOOTHING
        assert np.allclose(model.chances[:, k], counts / counts.sum(), rtol=1e-5)


def test_slices_change_nothing(monkeypatch):
    text = "Der Hund, le chat!  été 12 x " * 50
    whole = langid._slots(text)
    monkeypatch.setattr(langid, "SLICE", 7)
    assert np.array_equal(whole, langid._slots(text))


def mixture(model, text):
    """Expectation-maximisation for one text, plainly."""
    slots, counts = np.unique(langid._slots(text), return_counts=True)
    p = model.chances[slots].astype(float)

    def fit(langs):
        share = np.full(len(langs), 1 / len(langs))
        for _ in range(langid.ROUNDS):
            r = p[:, langs] * share
            share = (counts[:, None] * r / r.sum(axis=1, keepdims=True)).sum(axis=0) / counts.sum()
        return share, (counts * np.log((p[:, langs] * share).sum(axis=1))).sum()

    n = p.shape[1]
    chosen = [int(np.argmax([fit([k])[1] for k in range(n)]))]
    best = fit(chosen)
    while len(chosen) < n:
        full = fit(list(range(n)))[0]
        add = max((k for k in range(n) if k not in chosen), key=lambda k: full[k])
        wider = sorted([*chosen, add])
        new = fit(wider)
        if new[1] - best[1] <= 0.5 * np.log(max(counts.sum(), 2)) + 1:
            break
        chosen, best = wider, new
    return {model.languages[k]: s for k, s in zip(chosen, best[0], strict=True)}


def test_predictions_equal_plain_mixtures(spark, model):
    texts = [*TEXTS.values(), TEXTS["en"] + " " + TEXTS["de"], TEXTS["fr"] * 3 + TEXTS["de"], "cat", "Katze 12 chien"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.predict(df, model).collect():
        wanted = mixture(model, texts[r["doc_id"]])
        name = max(wanted, key=wanted.get)
        assert r["lang_pred"] == name and abs(r["score"] - wanted[name]) < 1e-6
        assert {x.split(":")[0] for x in r["mixture"].split(",")} == set(wanted)


def test_odd_texts(spark, model):
    rows = [(1, None, 1), (2, "", 1), (3, "12 --- _ ²", 1), (4, "日本語", 1), (5, "the dog " * 40_000, 1), (5, "the dog", 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = {(r["doc_id"], i): r for i, r in enumerate(langid.predict(df, model).collect())}
    und = {k[0] for k, r in got.items() if r["lang_pred"] == "und"}
    assert und == {1, 2, 3} and all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 7
    empty = langid.train(df.filter("doc_id > 99").withColumn("lang", F.lit("en")))
    assert {r["lang_pred"] for r in langid.predict(df, empty).collect()} == {"und"}
    assert langid.predict(df.filter("doc_id > 99"), model).count() == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    langs = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect())
    got = queries.QUERIES["op5_langid"](spark, sf_dir).collect()
    assert len(got) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_letters_by_category(spark):
    texts = ["µ ª", "— “ ×", "² ½ 7", "\u0301", "x", "नमस्ते", "𝒳", "😀 🎉", "Ⅷ", "e\u0301t\u00e9"]
    model = langid.Model(("a", "b"), np.full((langid.SLOTS, 2), 1 / langid.SLOTS, np.float32))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"] for r in langid.predict(df, model).collect() if r["lang_pred"] != "und"}
    assert got == {i for i, t in enumerate(texts) if any(c.isalpha() for c in t)} == {0, 4, 5, 6, 9}
    # dashes and signs are blanks like any other, marks belong to their letters
    assert np.array_equal(langid._slots("der — hund × 12"), langid._slots("der . hund ! 12"))
    assert not np.array_equal(langid._slots("नमस्ते"), langid._slots("नमसते"))
