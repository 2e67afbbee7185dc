import hashlib
import re

import pytest

from canopy.llm.decontaminate import ItemAutomaton, decontaminate, words_of

from .conftest import rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(texts, items, window=10):
    out = []
    for i, t in texts:
        w = words(t)
        hit, found = [0] * len(w), set()
        for name, item in items:
            x = words(item)
            if not x:
                continue
            for win in [x] if len(x) < window else [x[k : k + window] for k in range(len(x) - window + 1)]:
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        found.update([str(name)] if name is not None else [])
                        hit[k : k + len(win)] = [1] * len(win)
        out.append((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=repr)


ITEMS = [
    (1, " ".join(f"passage{i % 23}x{i}" for i in range(60))), (2, "w1 w2"), (3, "W7"), (4, None), (5, " ,. "), (10, "passage3x26 passage4x27"),
    (None, "w3"), (6, "nothing of this occurs anywhere in any of the documents that we have"), (7, "w1 w2"), (8, "naïve Über"), (9, "z " * 14),
]
COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("block_words", [200_000, 20])
def test_matches_brute_force(spark, docs, texts, block_words):
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id long")
    got = rows(decontaminate(docs, items, block_words=block_words), *COLS)
    assert got == brute(texts, ITEMS)
    assert any(r[5] for r in got)


def test_cleaning(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Clean words, in front here and more: {item.upper()}! And some words of its own behind."), (2, item), (3, "kept"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = dict(rows(decontaminate(docs, items), "doc_id", "clean_text"))
    assert got == {1: "Clean words, in front here and more: ! And some words of its own behind.", 2: None, 3: "kept", 4: None}
    assert dict(rows(decontaminate(docs, items, max_coverage=None), "doc_id", "clean_text"))[2] == ""


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "w3 w4", 5, "x")], "doc_id long, text string, n_words long, lang string")
    items = spark.createDataFrame([(None, "w3")], "item_id long, text string")
    out = decontaminate(docs, items, max_coverage=None, keep=("n_words", "lang", "text", "doc_id"))
    assert out.columns == [*COLS, "clean_text", "lang"]
    assert out.first().asDict() | {"items_sha256": ""} == {"doc_id": 1, "n_words": 2, "n_hit": 1, "n_items": 0, "items_sha256": "", "contaminated": True, "clean_text": " w4", "lang": "x"}


def test_empty_tables(spark, docs, no_docs, texts):
    items = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate(docs, items).collect())
    assert decontaminate(no_docs, items).count() == 0


def test_automaton_counts_all_items_of_a_window():
    same = "a b c d e f g h i j k"
    auto = ItemAutomaton([("x", same.encode()), ("y", same.encode()), ("z", b"b c d e f g h i j k l")])
    hit, found = auto.scan(words_of(b"q B C D E F G H I J K q"))
    assert list(hit) == [0] + [1] * 10 + [0]
    assert found == {"x", "y", "z"}
