import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from canopy.llm import suffix_dedup as sd

from .conftest import rows

COLS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages")


def covered(texts, length):
    """Flags of the bytes of each text that lie in a string found elsewhere too."""
    raws = [(t or "").encode() for _, t in texts]
    seen = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, np.int8)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = 1
        out.append(gone)
    return out


def brute(texts, length=400):
    out = []
    for (d, t), gone, loose in zip(texts, covered(texts, length), covered(texts, sd.PASSAGE), strict=True):
        raw = (t or "").encode()
        left = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        edges = np.flatnonzero(np.diff(loose, prepend=0))
        passages = sum(len(raw[a:z].split()) > sd.WORDS for a, z in zip(edges[::2], edges[1::2], strict=True))
        out.append((d, len(raw), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest(), passages))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, [2, 3, 26, 256][seed % 4], rng.integers(1, 400)).astype(np.uint8)
    if seed % 3 == 0:
        s = np.tile(s[:7], 60)
    if seed == 5:
        s = np.zeros(300, np.uint8)
    raw = s.tobytes()
    sa = sd.suffix_array(s)
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: raw[i:])
    shared = sd.permuted_prefixes(s, sa, 50)
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
        n = 0
        while n < 50 and max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        assert shared[b] == n


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    long, short = text(150), text(90)[:405]
    docs = [text(rng.randrange(1, 200)) for _ in range(25)]
    docs += [text(30) + long + text(40), text(60) + long[:500] + text(5), long[100:], short + text(30), text(30) + short, text(30) + short[:403] + text(9)]
    docs += ["ab" * 700, "x" * 399, "x" * 400, "y" * 401, None, "", docs[3], docs[3] + docs[4], text(20) + short[1:] + text(20) + short]
    near = text(300).split(" ")
    for _ in range(12):
        copy = list(near)
        copy[rng.randrange(300)] = word()
        docs.append(" ".join(copy))
    return list(enumerate(docs))


@pytest.mark.parametrize("most", [512, 2])
def test_matches_brute_force(spark, most):
    """With 2 stretches to a shard most anchors go the way of crowded ones."""
    texts = corpus()
    got = rows(sd.suffix_dedup(spark.createDataFrame(texts, "doc_id long, text string"), most=most), *COLS)
    assert got == brute(texts)


def test_awkward_rows(docs, texts, no_docs):
    assert rows(sd.suffix_dedup(docs), *COLS) == brute(texts)
    assert sd.suffix_dedup(no_docs).count() == 0


def test_pieces_of_long_documents(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 700)
    texts = corpus()
    data = [(t or "").encode() for _, t in texts]
    assert any(len(sd.stretches(np.frombuffer(x, np.uint8), np.array([len(x)]))["lo"]) for x in data)
    got = rows(sd.suffix_dedup(spark.createDataFrame(texts, "doc_id long, text string")), *COLS)
    assert got == brute(texts)
