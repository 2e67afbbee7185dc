import zlib

import numpy as np
import pytest

from canopy.llm import language_id as li

from .conftest import rows


def greedy(train, text):
    """Phrases of the longest matches in a training text; a letter that never occurs is one."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in train:
            size += 1
        n, at = n + 1, at + size
    return n


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.mark.parametrize("dense", [li.DENSE, 0])
def test_parser_matches_brute_force(real, dense, monkeypatch):
    """With the dense table, and with sorted edges."""
    monkeypatch.setattr(li, "DENSE", dense)
    samples = {r.lang: r.text for r in real.where("length(text) between 1500 and 3000").dropDuplicates(["lang"]).select("lang", "text").collect()}
    model = li.Model(samples)
    for r in real.where("length(text) < 500").limit(40).collect():
        codes = li.folded(r.text)
        text = "".join(map(chr, codes))
        steps = model.symbol[codes][:, None]
        for k, parser in zip(model.languages, model.parsers, strict=True):
            train = "".join(map(chr, li.folded(samples[k])))
            # the state machine carries a match over a phrase's end only from the root
            assert parser.phrases(steps, np.ones(len(codes), int))[0] == greedy(train, text)


def test_held_out_accuracy(real):
    out = li.language_id(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 150
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_awkward_rows(docs, texts, no_docs):
    got = rows(li.language_id(docs), "doc_id", "lang_pred")
    assert got == sorted(((i, "en" if any(c.isalpha() for c in t or "") else "und") for i, t in texts), key=repr)
    assert li.language_id(no_docs).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None), (None, None, "en")], "doc_id long, text string, lang string")
    assert rows(li.language_id(df), "doc_id", "lang_pred", "score") == [(1, "und", 0.0), (None, "und", 0.0)]


def test_long_texts_are_parsed_whole():
    model = li.Model({"a": "xyz " * 50, "b": "pqr " * 50})
    names, score, _ = model.predict(["pqr " * 5000 + "xyz " * 20000, "xyz " * 5000 + "pqr " * 20000, "123", None])
    assert names == ["a", "b", "und", "und"] and (score[:2] > 0.99).all() and (score[2:] == 0).all()


def test_learning_leaves_out_held_out_rows(spark):
    import zlib

    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    df = spark.createDataFrame([(i, f"text of {'secret' if i in out else 'plain'} rows {i}", "en") for i in range(200)], "doc_id long, text string, lang string")
    assert "secret" not in li.sample(df)["en"] and "plain" in li.sample(df)["en"]
    assert {r.doc_id for r in li.language_id(df).where("held_out").collect()} == set(out)


def test_many_languages_are_all_learned(spark):
    """Seventy languages, each with an alphabet of its own; the rarest ones too are told."""
    texts, i = [], 0
    for k in range(70):
        letters = [chr(0x4E00 + 5 * k + j) for j in range(5)]
        for n in range(2 if k % 2 else 4):
            while zlib.crc32(str(i).encode()) % 5 == 0:
                i += 1
            texts.append((i, " ".join("".join(letters[(n + a * b) % 5] for b in range(4)) for a in range(9)), f"l{k:02d}"))
            i += 1
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    assert rows(li.language_id(df), "doc_id", "lang_pred") == sorted(((i, k) for i, _, k in texts), key=repr)


def test_passes_agree_with_one_model(real, monkeypatch):
    some = real.where("length(text) < 3000").limit(60)
    samples = li.sample(real)
    assert len(samples) == 4
    whole = rows(li.identify(some, samples), "doc_id", "lang_pred", "score", "bits_per_letter")
    monkeypatch.setattr(li, "LANGUAGES", 1)
    parts = rows(li.identify(some, samples), "doc_id", "lang_pred", "score", "bits_per_letter")
    assert [r[:2] for r in whole] == [r[:2] for r in parts]
    assert np.allclose([r[2:] for r in whole], [r[2:] for r in parts], rtol=1e-9, atol=0)
