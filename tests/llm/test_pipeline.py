"""The pipeline and each of its stages against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline as cp
from canopy.llm import language_id as li
from canopy.llm.pieces import SPACE, Pieces
from canopy.llm.queries import _vocabulary

from .test_decontaminate import words
from .test_dedup import BLANKS, fold
from .test_language_id import greedy
from .test_near_copies import brute_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, text_key long, n_words long, ids string"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def key(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def made_rows(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1200").orderBy("doc_id").collect()
    out = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in real[:70]]
    base = out[5][1]
    shared = "This line stands in more than five of the documents of this table"
    out += [(10_000 + i, f"{r.text[:200]}\n {shared.upper() if i % 2 else shared}\t\n{r.text[200:400]} own{i}", r.lang, "s", 1) for i, r in enumerate(real[10:18])]
    out += [(20_000, shared, "en", "s", 1), (20_001, shared, "en", "s", 1)]  # nothing is left of the smaller one
    out += [(20_002, None, "en", "s", None), (20_003, "", "en", "s", 0), (20_004, " \n\t", "en", "s", 3), (20_005, "12 34 !", "en", "s", 7)]
    out += [(20_006, base + " one", "en", "s", 1), (20_007, base + " one", "en", None, 1), (20_007, base + " one", "en", "b", 1), (20_008, base + " two", None, None, None)]
    out += [(None, base + " three", "en", "s", 1), (None, "a text without an id and without copies", "en", "s", 1), (None, "another such text, of which there are two", "en", "s", 1)] * 2
    out += [(20_009, "one of two different texts with this id here", "en", "s", 1), (20_009, base[::-1], "en", "s", 1)]
    out += [(20_010, "z " * 3000 + ITEM, "en", "s", 1), (20_011, f"Some words stand before this, and there are more of them than of {ITEM.upper()}! They go on behind it.", "en", "s", 1)]
    out += [(20_012, ITEM, "en", "s", 1), (20_013, "short here beta", "en", "s", 1), (20_014, "é" * 40 + " \x00 日本", "en", "s", 1)]
    return [(*r, 0.5, 7, 8, "x") for r in out]


ITEMS = [(1, ITEM), (None, "stand before this"), (2, "here beta"), (3, None), (4, "...")]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    rows = made_rows(spark)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), [r[:5] for r in rows]


def language(rows):
    texts = defaultdict(set)
    for i, t, lang, *_ in rows:
        if t is not None and lang is not None and (i is None or zlib.crc32(str(i).encode()) % 5):
            texts[lang].add(t)
    train = {}
    for lang, own in texts.items():
        joined = " \n".join(sorted(own, key=lambda t: (key(t) % (1 << 40), key(t)))[: li.SAMPLE_TEXTS])[: li.SAMPLE_CHARS]
        train[lang] = "".join(map(chr, li.folded(joined)))
    out = []
    for i, t, _, source, n in rows:
        letters = "".join(map(chr, li.folded(t or "")))
        if letters.strip():
            cut = [letters[k : k + li.PIECE] for k in range(0, len(letters), li.PIECE)]
            alone = set().union(*train.values())
            cut = ["".join(c if c in alone else "￿" for c in x) for x in cut]
            bits = {lang: sum(greedy(s, x) for x in cut) * math.log2(max(len(s), 2)) for lang, s in train.items()}
            out.append((i, t, min(sorted(bits), key=bits.get), source, n))
    return out


def lines(rows):
    holds = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if i is not None:
                holds[fold(line.strip(BLANKS))].add(i)
    out = []
    for i, t, lang, source, _ in rows:
        own = [(x, fold(x.strip(BLANKS))) for x in (t or "").split("\n")]
        text = "\n".join(x for x, k in own if i is None or len(k) < 40 or len(holds[k]) < 5 or max(holds[k]) == i)
        if text.strip(BLANKS):
            out.append((i, text, lang, source, len(text)))
    return out


def near(rows):
    groups = defaultdict(list)
    for name, r in zip(brute_groups([r[1] for r in rows]), rows, strict=True):
        groups[name].append(r)
    null_first = lambda x: (x is not None, x if x is not None else 0)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0, key(r[1] or ""), null_first(r[2]), null_first(r[3]), null_first(r[4]))) for g in groups.values()]


def benchmarks(rows):
    windows = []
    for _, t in ITEMS:
        w = words(t)
        windows += [w] if 0 < len(w) < 10 else [w[k : k + 10] for k in range(len(w) - 9)]
    out = []
    for i, t, lang, source, _ in rows:
        w, spans = words(t), [m.span() for m in WORD.finditer(t)]
        hit = [False] * len(w)
        for win in windows:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit[k : k + len(win)] = [True] * len(win)
        if sum(hit) * 2 > len(w):
            continue
        gone = set()
        for k, h in enumerate(hit):
            if h:
                gone.update(range(spans[k][0], spans[k + 1][0] if k + 1 < len(w) and hit[k + 1] else spans[k][1]))
        text = "".join(c for k, c in enumerate(t) if k not in gone)
        out.append((i, text, lang, source, len(text)))
    return out


def pieces(rows, vocabulary):
    table = {p: (v[1], v[2]) for p, v in vocabulary.automaton.items()}
    longest, out = max(map(len, table)), []
    for i, t, lang, source, *_ in rows:
        marked = SPACE + t.replace(" ", SPACE) if t else ""
        best = [(0.0, 0, None)] + [None] * len(marked)
        for at in range(len(marked)):
            for end in range(at + 1, min(len(marked), at + longest) + 1):
                got = table.get(marked[at:end]) or ((vocabulary.unknown_score, None) if end == at + 1 else None)
                if got and (best[end] is None or best[at][0] + got[0] > best[end][0]):
                    best[end] = best[at][0] + got[0], at, got[1]
        ids, at = [], len(marked)
        while at:
            _, start, x = best[at]
            ids += [x] if x is not None else [vocabulary.byte_ids[c] for c in reversed(marked[start].encode())]
            at = start
        raw = t.replace(SPACE, " ").encode()
        out.append((i, lang, source, len(ids), tuple(ids[::-1]), zlib.crc32(np.array(ids[::-1], "<u4").tobytes()), best[len(marked)][0], hashlib.sha256(raw).hexdigest(), raw == t.encode()))
    return out


def told(df):
    return Counter(tuple(r) for r in df.select(*cp.COLUMNS).collect())


def test_stages_and_run(spark, made):
    folder, want = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (_, stage), plain in zip(cp.STAGES[:4], (language, lines, near, benchmarks), strict=True):
        before = len(want)
        want = plain(want)
        got = stage(spark, docs, folder)
        assert got.columns == cp.COLUMNS
        assert told(got) == Counter(want), plain
        assert 0 < len(want) < before or plain is lines
        docs = spark.createDataFrame(want, "doc_id long, text string, lang string, source string, n_chars long")
    vocabulary = Pieces(_vocabulary("piece_bpe_32k.model"))
    want = Counter(pieces(want, vocabulary))
    got = cp.run(spark, folder).collect()
    assert Counter((r.doc_id, r.lang, r.source, r.n_pieces, tuple(r.ids), r.ids_crc32, r.nbest_scores[0], r.decoded_sha256, r.lossless) for r in got) == want


def test_stages_of_no_documents(spark, made):
    folder, _ = made
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in cp.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_names_and_columns():
    assert [n for n, _ in cp.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
