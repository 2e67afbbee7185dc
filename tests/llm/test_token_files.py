import random
import zlib

import numpy as np
import pytest

from canopy.llm import token_files as tf
from canopy.llm.queries import _vocabulary

from .conftest import rows


@pytest.fixture(scope="module")
def vocabulary():
    return _vocabulary("byte_bpe_50k.json")


def library(vocabulary, plain=False):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_buffer(vocabulary)
    if plain:
        tok.encode_special_tokens = True
    return lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 0]


def test_files_round_trip(docs, texts, vocabulary):
    back, encoded = tf.read_tokens(tf.write_tokens(docs, vocabulary)), library(vocabulary)
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32, np.frombuffer(r.ids, "<u4").tolist()) for r in back.collect()}
    start = 0
    for i, t in sorted(texts, key=lambda x: x[0]):
        ids = encoded(t)
        assert got.pop((i, start)) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    assert not got


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("cache", [40, 100_000])
def test_chunks_match_whole_texts(vocabulary, plain, cache, monkeypatch):
    """With a memory of 40 chunks it is trimmed all the time."""
    monkeypatch.setattr(tf, "CACHE", cache)
    rng = random.Random(3)
    alphabet = ["a", "é", "Z", " ", " ", "  ", "\n", "\t", "\r", "\x0b", "'s", "'", "7", "!", ",", "(", "…", "\x00", "\x85", "\xa0", "\u2028", "\x1c", "<|endoftext|>", "日", "longer than that"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(3000)] + ["x" * 3000, "", "y" * 23, "y" * 24, " " + "é" * 11 + "a"]
    encoder, encoded = tf.ChunkEncoder(vocabulary, specials_as_text=plain), library(vocabulary, plain)
    for at in range(0, len(texts), 700):
        for t, ids in zip(texts[at : at + 700], encoder.encode_all(texts[at : at + 700]), strict=True):
            assert ids.tolist() == encoded(t), repr(t)


def test_special_strings(spark, vocabulary, tmp_path):
    """The library's default, and a table that is read back from its files alone."""
    df = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, None), (3, "c")], "doc_id long, text string")
    path = str(tmp_path / "tokens")
    tf.write_tokens(df, vocabulary, path=path)
    got = rows(tf.read_tokens(spark.newSession().read.parquet(path)), "doc_id", "n_tokens", "ids_crc32")
    want = [library(vocabulary)(t) for t in ("a <|endoftext|> b", None, "c")]
    assert 50256 in want[0] and got == [(i, len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, w in enumerate(want, 1)]
    with pytest.raises(ValueError, match="no code"):
        tf.read_tokens(spark.read.parquet(path).where("first_token >= 0"))


@pytest.mark.parametrize(("n", "limit"), [(1, 18), (2, 18), (50, 18), (50, 6), (3000, 12)])
def test_code(n, limit):
    rng = np.random.default_rng(n)
    counts = np.floor(2.0 ** rng.uniform(0, 40, n)).astype(np.int64)
    lengths = tf.code_lengths(counts, limit)
    assert lengths.max() <= limit
    assert n == 1 or (2.0 ** -lengths.astype(float)).sum() == 1
    code = tf.Code(lengths)
    ids = rng.integers(0, n, 5001).astype(np.uint32)
    for m in (0, 1, 255, 256, 257, 5001):
        assert (code.unpack(*code.pack(ids[:m]), m) == ids[:m]).all()


def test_code_lengths_are_optimal():
    """Without a binding limit: the weight of Huffman's tree."""
    import heapq

    counts = np.array([5, 1, 1, 9, 3, 3, 0, 20, 7])
    heap, cost = [c for c in counts.tolist() if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    assert (tf.code_lengths(counts) * counts).sum() == cost


def test_empty(no_docs, vocabulary):
    assert tf.read_tokens(tf.write_tokens(no_docs, vocabulary)).count() == 0


def test_null_ids(spark, vocabulary):
    df = spark.createDataFrame([(2, "b"), (None, "a")], "doc_id long, text string")
    assert rows(tf.read_tokens(tf.write_tokens(df, vocabulary)), "doc_id", "start", "n_tokens") == [(2, 2, 2), (None, 0, 2)]
