import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from canopy.llm import exact_dedup as ed
from canopy.llm import near_dedup as nd
from canopy.llm.exact_dedup import MODULUS, combine, exact_dedup, fingerprint
from canopy.llm.line_dedup import line_dedup

from .conftest import rows

BLANKS = " \t\n\x0b\x0c\r"


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_lines(texts, min_chars=40, min_docs=5):
    holds = defaultdict(set)
    for i, t in texts:
        for line in (t or "").split("\n"):
            holds[fold(line.strip(BLANKS))].add(i)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        keys = [fold(x.strip(BLANKS)) for x in lines]
        kept = [x for x, k in zip(lines, keys, strict=True) if not (len(k) >= min_chars and len(holds[k]) >= min_docs and max(holds[k]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_match_brute_force(docs, texts):
    got = rows(line_dedup(docs), "doc_id", "n_lines", "n_dropped", "kept_text")
    assert got == brute_lines(texts)
    assert any(r[2] for r in got)


def test_lines_long_documents_and_null_ids(spark):
    line = "a line that is repeated in all of these documents"
    texts = [(i, "\n".join([f"{j} {i}" if j % 3 else line for j in range(200)])) for i in range(6)]
    rows_in = [*texts, (None, line)]
    df = spark.createDataFrame(rows_in, "doc_id long, text string")
    got = rows(line_dedup(df), "doc_id", "n_lines", "n_dropped", "kept_text")
    assert got == sorted([*brute_lines(texts), (None, 1, 0, line)], key=repr)


def test_lines_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb", 5, "x")], "doc_id long, text string, n_lines long, lang string")
    assert line_dedup(docs, keep=("n_lines", "lang", "kept_text")).columns == ["doc_id", "n_lines", "n_dropped", "kept_text", "lang"]


def test_lines_empty(no_docs):
    assert line_dedup(no_docs).count() == 0


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute_exact(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[norm(t)].append(i)
    return sorted(((i, min(g), len(g), i == min(g), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in texts for g in [groups[norm(t)]]), key=repr)


@pytest.mark.parametrize("modulus", [MODULUS, 7])
def test_exact_matches_brute_force(docs, texts, modulus):
    """With modulus 7 most fingerprints collide, and the comparison has to tell texts apart."""
    got = rows(exact_dedup(docs, modulus), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute_exact(texts)


def test_exact_large_group(spark):
    texts = [(i, "same  text" if i % 2 else "same text") for i in range(1500)] + [(2000, "other")]
    got = rows(exact_dedup(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute_exact(texts)


def test_exact_repeated_rows(spark):
    """20,000 rows that are equal as a whole, the smallest or not the smallest of their group."""
    began = time.time()
    one = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a\t b").alias("text"))
    two = spark.range(20_000).select(F.lit(9).cast("long").alias("doc_id"), F.lit("a b").alias("text"))
    got = exact_dedup(one.unionByName(two).unionByName(spark.createDataFrame([(8, "a  b"), (3, "c")], "doc_id long, text string")))
    counts = got.groupBy("doc_id", "keep_id", "group_size", "kept").count().collect()
    assert sorted(map(tuple, counts)) == [(3, 3, 1, True, 1), (7, 7, 40_001, True, 20_000), (8, 7, 40_001, False, 1), (9, 7, 40_001, False, 20_000)]
    assert time.time() - began < 60


@pytest.mark.parametrize("part", [1, 7, 64])
def test_exact_huge_texts_in_parts(docs, texts, part):
    """With every text over 20 bytes taken apart, also between the blanks of a run."""
    few = [(i, t) for i, t in texts if len(t or "") < 3000]
    df = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 3000)
    assert rows(exact_dedup(df, huge=20, part=part), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(few)


def test_pieces_join():
    raw = b" \t a  b\n\n \x0bcd   "
    for a in range(len(raw) + 1):
        for b in range(a, len(raw) + 1):
            x, y, z = (ed.piece(ed.normalised(p)) for p in (raw[:a], raw[a:b], raw[b:]))
            assert ed.join(ed.join(x, y), z)[:2] == ed.join(x, ed.join(y, z))[:2] == ed.fingerprint(ed.normalised(raw))


def test_exact_empty(no_docs):
    assert exact_dedup(no_docs).count() == 0


def test_fingerprints_compose():
    text = bytes(range(256)) * 900
    whole = int.from_bytes(text, "big") % MODULUS, len(text)
    assert fingerprint(text) == whole == fingerprint(text, chunk=17)
    a, b, c = (fingerprint(x) for x in (text[:5], text[5:99], text[99:]))
    assert combine(combine(a, b), c) == combine(a, combine(b, c)) == whole


def brute_simhash(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(t or ""))
    sh = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def brute_components(pairs):
    """pairs: (id, fingerprint)."""
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(pairs):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", low[find(i)]) for i, (d, f) in enumerate(pairs)), key=repr)


def test_near_matches_brute_force(docs, texts):
    got = rows(nd.near_dedup(docs), "doc_id", "fingerprint", "component_id")
    assert got == brute_components([(i, brute_simhash(t)) for i, t in texts])


@pytest.mark.parametrize("block", [2048, 3])
def test_links_keep_components(spark, block):
    rng = np.random.default_rng(1)
    fps = set()
    for c in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(25):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                x ^= 1 << b
            fps.add(x)
    # a chain, four bits apart at each step, spoiling four bytes
    x = 0x0123456789ABCDEF
    for k in range(8):
        fps.add(x)
        for b in range(k % 4, 8, 2):
            x ^= 1 << (8 * b + k)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = [(u % (1 << 64), v % (1 << 64)) for u, v in nd.links(df, block=block).collect()]
    assert all((u ^ v).bit_count() <= 4 for u, v in edges)
    adj = defaultdict(set)
    for u, v in edges:
        adj[u].add(v)
        adj[v].add(u)
    got = {}
    for f in fps:
        if f not in got:
            todo, seen = [f], {f}
            while todo:
                for y in adj[todo.pop()] - seen:
                    seen.add(y)
                    todo.append(y)
            got |= dict.fromkeys(seen, f)
    want = {f: r for (f, _, r) in brute_components([(f, f) for f in fps])}
    assert Counter(got.values()) == Counter(want.values())


def test_near_empty(no_docs, spark):
    assert nd.near_dedup(no_docs).count() == 0
    none = spark.createDataFrame([(1, None), (2, " "), (None, "")], "doc_id long, text string")
    assert rows(nd.near_dedup(none), "doc_id", "component_id") == [(1, 1), (2, 1), (None, 1)]
