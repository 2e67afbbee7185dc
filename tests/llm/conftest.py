"""A small table of awkward documents."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, pos long, n long, fp string, key string, part string"


def awkward_texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["über", "Éa", "naïve"]
    shared = "This  line is shared by a good many of the documents here"
    passage = " ".join(f"passage{i % 23}x{i}" for i in range(60))
    texts = [None, "", " ", "\n", "\n\n", "a", "A", "a\tb", "a  b", "a b", "é" * 50, "x" * 5000, "日本語のテキスト" * 30, "\x00 odd \x1c\x85\xa0 blanks here"]
    for _ in range(40):
        t = " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 120)))
        if rng.random() < 0.5:
            t = f"{t}\n  {shared.upper() if rng.random() < 0.5 else shared}\t\n{t[:30]}\n{shared}"
        if rng.random() < 0.3:
            t += passage
        texts.append(t)
    texts += [texts[20], texts[21], texts[21] + " more", texts[22].replace(" ", "  ") if texts[22] else ""]
    texts += ["z " * 30000 + passage + " end"]
    return texts


@pytest.fixture(scope="session")
def texts():
    rows = list(enumerate(awkward_texts(), 3))
    return rows + [rows[30]]  # one row twice


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, 2, "f", "k", "p") for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *names):
    """Rows of the named columns, sorted."""
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
