import hashlib
import random
import time
import zlib
from itertools import product

import numpy as np
import pytest
import sentencepiece

from canopy.llm.pieces import FEW, LONG, SPACE, Pieces, Trie
from canopy.llm.queries import _vocabulary
from canopy.llm.sentence_pieces import Encoder, decode, encode, smallest_sums
from canopy.llm.token_counts import token_counts

from .conftest import rows


@pytest.fixture(scope="module")
def model():
    return _vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces(model):
    return Pieces(model)


def as_unigram(model):
    """The same pieces and scores, decoded by the library's unigram search."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(model)
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def all_segmentations(pieces, text):
    """(score, ids) of every segmentation of a marked text, by recursion from the front."""
    table = {p: (s, i) for p, s, i in plain(pieces)}

    def walk(at):
        if at == len(text):
            yield 0.0, []
            return
        for end in range(at + 1, len(text) + 1):
            got = table.get(text[at:end])
            if got is None and end == at + 1:
                got = pieces.unknown_score, None
            if got:
                ids = [got[1]] if got[1] is not None else [pieces.byte_ids[b] for b in text[at].encode()]
                for s, rest in walk(end):
                    yield got[0] + s, ids + rest

    return sorted(walk(0), key=lambda x: -x[0])


def first_met(pieces, text):
    """The tokenizer's search: starts from left to right, short pieces first, and only a better score replaces."""
    marked = SPACE + text.replace(" ", SPACE) if text else ""
    table = {p: (s, i) for p, s, i in plain(pieces)}
    best = {0: (0.0, 0, None)}
    for at in range(len(marked)):
        for end in range(at + 1, min(len(marked), at + 20) + 1):
            got = table.get(marked[at:end]) or ((pieces.unknown_score, -1) if end == at + 1 else None)
            if got and (end not in best or best[at][0] + got[0] > best[end][0]):
                best[end] = best[at][0] + got[0], at, got[1]
    out, at = [], len(marked)
    while at:
        out.append(best[at][2])
        at = best[at][1]
    return out[::-1]


def plain(pieces):
    return [(k, v[1], v[2]) for k, v in pieces.automaton.items()]


# The library adds scores of 32 bits, which are exact only while no piece of the file's score -1e9 is met.
WORDS = ["the", "of", "thatnd", "über", "mentoi", "a", "abcabcabc", "x.y,z", "tioning", "élaient"]


def test_best_is_the_librarys(model, pieces):
    sp = as_unigram(model)
    rng = random.Random(2)
    parts = [p[1:] for p in pieces.pieces if p[0] == SPACE and p[1:].isalpha()]
    words = WORDS + [rng.choice(parts) + rng.choice(parts) for _ in range(2000)]
    words = [w for w in words if pieces.count(SPACE + w)[1] > -1e5]
    assert len(words) > 1000
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(2000)]
    texts += ["", "a" * 60, "ab" * 40]
    enc = Encoder(pieces)
    scored = {i: s for _, s, i in plain(pieces)}
    for t, (ids, scores) in zip(texts, enc.encode_all(texts), strict=True):
        # encode() of the library takes a short cut for some words; its lattice search does not
        two = sp.nbest_encode(t, nbest_size=2) if t else [[], []]
        assert sum(scored[i] for i in two[0]) == scores[0]
        if sum(scored[i] for i in two[1]) < scores[0]:
            assert ids.tolist() == two[0], t
        assert ids.tolist() == first_met(pieces, t)
        n = sum(pieces.count(c)[0] for c in pieces.cells(t))
        assert n == len(ids)
        assert sum(pieces.count(c)[1] for c in pieces.cells(t)) == scores[0]
        assert enc.pieces.decode(ids.tolist()).decode() == t


def test_nbest_scores_match_enumeration(pieces):
    for cell in [SPACE + w for w in ("that", "menti", "abab", "é\x01a", "日x", "aaaa")] + ["\n", SPACE * 3]:
        want = all_segmentations(pieces, cell)
        ids, best, loss = pieces.best_two(cell)
        assert (ids, best) == pieces.nbest(cell, 1)[0][::-1]
        assert loss == (want[0][0] - want[1][0] if len(want) > 1 else float("inf"))
        for n in (1, 2, 5, 9):
            got = pieces.nbest(cell, n)
            assert [s for s, _ in got] == [s for s, _ in want[:n]]
            assert len({tuple(i) for _, i in got}) == len(got)
            for s, ids in got:
                assert (s, ids) in want


def test_text_scores_match_enumeration(pieces):
    for t in ("ab cd", "it is\nso", "a  b", "thé x"):
        want = [s for s, _ in all_segmentations(pieces, SPACE + t.replace(" ", SPACE))]
        assert Encoder(pieces, 6).encode_all([t])[0][1] == want[:6]


def test_smallest_sums():
    rng = random.Random(4)
    for _ in range(200):
        lists = [[0.0, *sorted(rng.randrange(0, 9) for _ in range(rng.randrange(0, 4)))] for _ in range(rng.randrange(0, 5))]
        want = sorted(sum(c) for c in product(*lists))
        for n in (1, 4, 12):
            assert smallest_sums(lists, n) == want[:n]


def test_tables(docs, texts, no_docs, model, pieces):
    out = encode(docs.withColumnRenamed("word", "ids"), model)
    assert {"n_pieces", "lang", "part"} <= set(out.columns) and out.columns.count("ids") == 1
    got = rows(out, "doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless")
    want = []
    for i, t in texts:
        ids = [x for c in pieces.cells(t or "") for x in pieces.nbest(c, 1)[0][1]]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert got == sorted(want, key=repr)
    assert rows(decode(out, model), "doc_id", "decoded") == sorted(((i, t or "") for i, t in texts), key=repr)
    counts = rows(token_counts(docs, model), "doc_id", "n_tokens", "score")
    best = {(r.doc_id, r.n_pieces, r.nbest_scores[0]) for r in out.collect()}
    assert set(counts) == best and len(counts) == len(texts)
    assert encode(no_docs, model).count() == 0 == token_counts(no_docs, model).count()


def test_space_mark_is_lossy(spark, model):
    df = spark.createDataFrame([(1, f"a{SPACE}b")], "doc_id long, text string")
    assert not encode(df, model).first().lossless


def test_memory_does_not_change_results(pieces, monkeypatch):
    from canopy.llm import sentence_pieces, token_counts

    rng = random.Random(9)
    batches = [[" ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(30)) for _ in range(5)] for _ in range(20)]
    want = [[(i.tolist(), s) for i, s in Encoder(pieces).encode_all(b)] for b in batches]
    monkeypatch.setattr(sentence_pieces, "CACHE", 20)
    monkeypatch.setattr(token_counts, "CACHE", 20)
    enc, cnt = Encoder(pieces), token_counts.Counter(pieces)
    for b, w in zip(batches, want, strict=True):
        assert [(i.tolist(), s) for i, s in enc.encode_all(b)] == w
        n, score = cnt.count_all(b)
        assert n.tolist() == [len(i) for i, _ in w] and score.tolist() == [s[0] for _, s in w]


def test_whole_segmentations(spark, model, pieces):
    """The n best of short texts with their ids: different, of the scores they are given, and none better is left out."""
    texts = ["the of", "ab cd", "mentoi a", "x.y", "", None, "é\n z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in encode(df, model, nbest=6, whole=True).collect():
        if not r.text:
            assert (r.nbest_scores, r.nbest_ids) == ([0.0], [[]])
            continue
        every = all_segmentations(pieces, SPACE + r.text.replace(" ", SPACE))
        assert r.nbest_scores == [s for s, _ in every[:6]] and r.nbest_ids[0] == r.ids
        score = {tuple(ids): s for s, ids in reversed(every)}
        assert [score[tuple(x)] for x in r.nbest_ids] == r.nbest_scores and len({tuple(x) for x in r.nbest_ids}) == len(r.nbest_ids)
        assert r.nbest_crc32 == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in r.nbest_ids]


def test_query_segments_the_n_best(spark, tmp_path, pieces):
    """The query makes the ids of each of the n best segmentations and tells them by their checksums."""
    from canopy.llm import queries
    from canopy.llm.sentence_pieces import NBEST, Encoder

    texts = ["the of and it", "ab cd", "", None, "mentoi a the of " * 30]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    whole = queries._vocabulary("piece_bpe_32k.model")
    own = Encoder(type(pieces)(whole), NBEST, True).segment_all([t or "" for t in texts])
    got = {r.doc_id: r for r in queries.op4_sentence_pieces(spark, str(tmp_path)).collect()}
    for i, (_, scores, ways) in enumerate(own):
        assert got[i].nbest_crc32 == [zlib.crc32(w.astype("<u4")) for w in ways] and len(ways) == len(scores) == len(got[i].nbest_scores)
    assert len(set(got[0].nbest_crc32)) == NBEST and len(got) == len(texts)


def odd_cells(rng, n):
    """Cells of pieces, of characters in and outside the vocabulary, and some too long for the search of many cells at a time."""
    cells = [SPACE + "".join(rng.choice("abehinorst") for _ in range(rng.randrange(1, 14))) for _ in range(n)]
    cells += ["".join(rng.choice("abthe▁日本ü\x01\x00😀x\n.\ud800") for _ in range(rng.randrange(1, LONG + 9))) for _ in range(n)]
    return cells + ["x" * LONG, "x" * (LONG + 1), "日" * 90, SPACE, "\n", SPACE * 40]


def told_apart(got, n):
    (flat, sizes), extra = got
    stops = np.append(0, np.cumsum(sizes))
    assert len(sizes) == n and stops[-1] == len(flat)
    return [(flat[stops[i] : stops[i + 1]].tolist(), *extra[:, i].tolist()) for i in range(n)]


@pytest.mark.parametrize("by_bytes", [True, False])
def test_many_cells_at_a_time(model, by_bytes):
    """Many cells at a time get the ids, scores and losses that each gets by itself."""
    pieces, rng = Pieces(model), random.Random(11)
    pieces.by_bytes = by_bytes
    for n in (0, FEW // 4, 3000):
        cells = odd_cells(rng, n) if n else []
        assert told_apart(pieces.best_two_all(cells), len(cells)) == [pieces.best_two(c) for c in cells]


def test_trie_holds_any_pieces():
    rng = random.Random(12)
    for letters in ("a", "ab", "abcdefghij", "日本語ab"):
        for most in (1, 9, 400):
            words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))): (float(i), i) for i in range(most)}
            trie = Trie({letters[0] + w: x for w, x in words.items()})  # the root may have fewer children than others
            for probe in [letters[0] + w for w in words] + ["".join(rng.choice(letters + "z") for _ in range(rng.randrange(1, 7))) for _ in range(300)]:
                at = 0
                for c in probe:
                    child = trie.base[at] + trie.codes(np.array(ord(c)))
                    at = child if at >= 0 and trie.owner[child] == at else -1
                    if at < 0:
                        break
                want = words.get(probe[1:]) if probe[0] == letters[0] else None
                assert (at >= 0 and trie.ids[at] >= 0) == (want is not None), (letters, probe)
                if want:
                    assert (trie.scores[at], trie.ids[at]) == want


def test_new_cells_cost_less_together(pieces):
    """An encoder learns new cells in less CPU time than one by one; it took as long before."""
    cells, enc = list(dict.fromkeys(odd_cells(random.Random(13), 15_000)[:15_000])), Encoder(pieces)
    enc.memo.learn(cells[:1000])
    took = []
    for work in (lambda: [pieces.best_two(c) for c in cells], lambda: enc.memo.learn(cells)):
        began = time.process_time()
        work()
        took.append(time.process_time() - began)
    assert took[1] < 0.7 * took[0]
