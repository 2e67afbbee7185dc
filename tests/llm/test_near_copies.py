import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from canopy.llm import near_copies as nc

from .conftest import rows
from .test_dedup import fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_set(t):
    words = [w for w in fold(t or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_groups(texts):
    sets = [brute_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def partition(pairs):
    out = {}
    for name, member in pairs:
        out.setdefault(name, set()).add(member)
    return sorted(map(sorted, out.values()))


def edited(rng, text, edits):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def mixed_texts():
    """Copies edited to similarities around 0.8, a shared passage, repeats, and texts under five words."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = ["", "a b", "A  b", "a b c d e", "x " * 40, "x " * 90]
    for k in range(12):
        base = " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 200)))
        base += " " + passage if k % 2 else ""
        texts += [base, *(edited(rng, base, max(1, len(base.split()) * e // 100)) for e in (1, 2, 2, 3, 3, 4))]
    return texts


@pytest.mark.parametrize("common", [1 << 17, 0])
def test_groups_match_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(nc, "COMMON", common)
    texts = mixed_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(nc.near_groups(df), "component", "doc_id")
    want = partition((r, i) for i, r in enumerate(brute_groups(texts)))
    assert partition(got) == want and 10 < len(want) < len(texts) - 20


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    for n in range(1, 60):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        for drop in range(n // 5 + 1):
            b = np.sort(rng.permutation(a)[drop:])
            none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if nc.similar(a, b):
                assert set(nc.prefix(a, *none)) & set(nc.prefix(b, *none))


def test_lists_across_batches():
    """Of each list the entries that may allow another, as plain Python has them; wherever batches end."""
    rng = random.Random(3)
    rows_ = sorted((rng.randrange(6), rng.randrange(8, 14), rng.randrange(6, 16), k) for k in range(60))
    rows_ = [(h, n, min(u, 5 * n // 4), k) for h, n, u, k in rows_]
    rows_.sort(key=lambda r: (r[0], r[1], r[3]))
    want = []
    for h in range(6):
        own = [r for r in rows_ if r[0] == h]
        kept = [r for i, r in enumerate(own) if max([x[2] for x in own[:i]], default=-1) >= r[1] or (i + 1 < len(own) and own[i + 1][1] <= r[2])]
        # no pair that allows each other is lost
        assert all(a in kept and b in kept for i, a in enumerate(own) for b in own[:i] if a[1] <= b[2] and b[1] <= a[2])
        want += [(*r, *kept[0][1:]) for r in kept if len(kept) > 1]
    table = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows_, strict=True)], names=["h", "n", "u", "set_key"])
    for step in (1, 2, 3, 7, 60):
        cut = [table.slice(i, step) for i in range(0, 60, step)]
        got = [tuple(r.values()) for b in nc._lists(cut) for r in b.to_pylist()]
        assert got == want


def test_stage_drops_copies_that_simhash_misses(spark):
    rng = random.Random(2)
    base = " ".join(f"word{rng.randrange(900)}" for _ in range(120))
    near = next(t for t in (edited(rng, base, 2) for _ in range(200)) if (nc.fingerprint(t.encode()) ^ nc.fingerprint(base.encode())).bit_count() > 4)
    far = edited(rng, base, 12)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate((base, near, far))], SCHEMA)
    assert rows(corpus_pipeline.near_copies(spark, df, ""), "doc_id") == [(0,), (2,)]


def test_stage_keeps_unrelated_texts_of_one_id(spark):
    def text(k):
        return " ".join(f"t{k}word{i}" for i in range(30))

    kept = [(None, text(1)), (None, text(2)), (5, text(3)), (5, text(4)), (6, text(5))]
    rows_in = [*kept, (7, text(5)), (6, text(5)), (None, text(3)), (4, text(6)), (5, text(6))]
    df = spark.createDataFrame([(i, t, "en", f"s{n}", len(t)) for n, (i, t) in enumerate(rows_in)], SCHEMA)
    got = rows(corpus_pipeline.near_copies(spark, df, ""), "doc_id", "text", "source")
    assert got == sorted([*((i, t, f"s{n}") for n, (i, t) in enumerate(kept)), (4, text(6), "s8")], key=repr)


def test_bins_leave_all_similar_pairs():
    """Sets that the bins tell apart are not similar; most unrelated ones are told apart."""
    rng = np.random.default_rng(6)
    left = []
    for n in (1, 3, 9, 40, 300, 900):
        a = np.unique(rng.integers(0, 2**63, n, np.uint64))
        for cut in range(0, n, max(1, n // 12)):
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, cut // 2, np.uint64)]))
            differ = int(np.bitwise_count(nc.parities(a) ^ nc.parities(b)).sum())
            assert 9 * differ <= len(a) + len(b) or not nc.similar(a, b)
        other = rng.integers(0, 2**63, n, np.uint64)
        left.append(9 * int(np.bitwise_count(nc.parities(a) ^ nc.parities(other)).sum()) <= 2 * n)
    assert not any(left)


def test_intermediate_tables_go(spark):
    """Tables as large as the texts, and lists and pairs, are deleted before the groups are read."""
    import os

    from canopy.functions.storage import shared_root

    root = shared_root(spark).removeprefix("file://") + "/canopy/"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(mixed_texts())], SCHEMA)
    groups = nc.near_groups(docs)
    names = {x.split("-")[0] for x in set(os.listdir(root)) - before}
    assert groups.count() == len(mixed_texts()) and not names & {"sets", "fps", "met", "pairs", "likely", "groups", "cross", "marks"}


def test_models_are_dropped_before_near_copies():
    from canopy.llm import common

    common.held(("test",), lambda: [0])
    list(nc._prints(iter(())))
    assert not common._held


def test_long_lists_do_not_meet_pair_by_pair(spark, monkeypatch):
    """Passages of 15 texts each, which a sample of the texts does not know, with near copies: few of the pairs that share a list meet."""
    monkeypatch.setattr(nc, "SAMPLE_SETS", 40)
    rng = random.Random(5)
    texts = []
    for k in range(450):
        own = [f"own{k}x{i}" for i in range(rng.randrange(30, 60))]
        texts.append(" ".join([f"p{k % 30}x{i}" for i in range(40)] + own))
    texts += [edited(rng, x, 1) for x in texts[:60]] + [" ".join(f"t{k}x{i}" for i in range(30)) for k in range(600)]
    seen, settle, meetings = {"pairs": 0, "met": 0, "again": 0}, nc.settle, nc.meetings

    def counted(groups):
        out = meetings(groups)
        seen["met"] += out.count()
        return out

    def settled(df, tag):
        out = settle(df, tag)
        if tag == "mixed" and not seen["pairs"]:
            seen["pairs"] = sum(n * (n - 1) // 2 for _, n in out.select("h", "root").distinct().groupBy("h").count().collect())
        seen["again"] += tag == "again"
        return out

    monkeypatch.setattr(nc, "meetings", counted)
    monkeypatch.setattr(nc, "settle", settled)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(nc.near_groups(df), "component", "doc_id")
    want = partition((r, i) for i, r in enumerate(brute_groups(texts)))
    assert partition(got) == want and len(want) < len(texts) - 40
    assert seen["again"] and 0 < 10 * seen["met"] < seen["pairs"], seen


def test_similar_sizes_are_of_neighbouring_classes():
    n = np.arange(1, 100_000)
    size = np.floor(np.log(n) / np.log(nc.CLASS))
    assert (size[np.minimum(n * 5 // 4, len(n)) - 1] - size <= 1).all()


def test_most_common_takes_whole_counts_within_its_room(spark, monkeypatch):
    often = spark.createDataFrame([(i, 2 + (i < 30) + (i < 10)) for i in range(100)], "h long, n long")
    for room, want in ((100, 100), (99, 30), (30, 30), (29, 10), (9, 0)):
        monkeypatch.setattr(nc, "COMMON", room)
        assert sorted(r.h for r in nc.most_common(often).collect()) == list(range(want))
