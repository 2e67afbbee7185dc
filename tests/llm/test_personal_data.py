import hashlib
import random
import re
import time

from canopy.llm.personal_data import personal_data

from .conftest import rows

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
COLS = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def luhn(d):
    return sum(v - 9 * (v > 9) for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0


def valid(kind, x):
    d = re.sub("[^0-9]", "", x)
    return {"email": True, "ip": all(int(p) <= 255 for p in x.split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def brute(i, text):
    text = text or ""
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if valid(kind, m[0])]
    listed = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found))
    return (i, *[sum(f[3] == kind for f in found) for kind in BASE], hashlib.sha256(listed.encode()).hexdigest())


def test_base_spans_match_brute_force(spark, docs, texts):
    rng = random.Random(1)
    bits = ["a@b.c", "x_y@", "@", ".", "..", "1", "255", "256", "1.2.3.4", "10.0.0.999", "+1 (499) 555-6503", "+", "4785 3805 9239 1139", "2669109448945250", " ", "-", "é", "日", "ab", "(", "000001.1.1.1", "\n", "_", "%"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    made += ["mail me at a@b.c.d_e@f.g or 1.2.3.4.5.6.7.8", "𝒳𝒴 a@b.c 😀 +49 30 1234567", "1 " * 4000 + "x", "a" * 20000 + "@", "+" + "1 " * 5000, "a@b.c " * 700 + "4785380592391139"]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert rows(personal_data(df), *COLS) == sorted((brute(i, t) for i, t in enumerate(made)), key=repr)
    assert rows(personal_data(docs), *COLS) == sorted((brute(i, t) for i, t in texts), key=repr)


def test_further_spans_and_scores(spark):
    texts = [
        (1, "our IBAN: GB82 WEST 1234 5698 7654 32, thanks"),
        (2, "our IBAN: GB83 WEST 1234 5698 7654 32, thanks"),
        (3, "call 555-123-4567 now"),
        (4, "item 555-123-4567 now"),
        (5, "server 10.1.2.3 and 10.1.2.4"),
    ]
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1].spans == "iban:10:37" and got[1].scored[0].score == 1.0
    assert got[2].spans == "" and got[4].spans == ""
    assert got[3].spans == "tel:5:17"
    assert [s.score > 0.8 for s in got[5].scored] == [True, False]
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_account_numbers_and_secrets(spark):
    texts = [
        (1, "IBAN GB82 WEST 1234 5698 7654 32 BIC NWBKGB2L"),
        (2, "IBAN DE89370400440532013000 BIC COBADEFFXXX"),
        (3, "GB82 WEST 1234 5698 7654 32 Bank and GB82WEST12345698765432X"),
        (4, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and TOKEN = "internationalisation", password: hunter2'),
        (5, "10.1.2.3 is our host"),
        (6, "ipsum 10.1.2.4 hostility"),
    ]
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [got[i].spans for i in (1, 2, 3, 4)] == ["iban:5:32", "iban:5:27", "iban:0:27", "secret:0:49"]
    assert [got[i].n_spans for i in (1, 2, 3, 4, 5, 6)] == [1, 1, 1, 1, 1, 1]
    assert [got[i].scored[0].score > 0.8 for i in (5, 6)] == [True, False]


def test_many_matches_in_one_text(spark):
    """50,000 of each of two kinds, and texts without end; the work must not grow with the square."""
    made = ["a@b.c 1.2.3.4 " * 50_000, "+1 (499) 555-6503, " * 20_000, "4785380592391139 x" * 5_000, "GB82 " * 20_000, "token = " * 20_000]
    began = time.time()
    got = rows(personal_data(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")), *COLS)
    assert got == [brute(i, t) for i, t in enumerate(made)]
    assert time.time() - began < 120


def test_empty(no_docs):
    assert personal_data(no_docs).count() == 0
