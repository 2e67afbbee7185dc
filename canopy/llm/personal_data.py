"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (ranges of address
parts, Luhn for cards, mod 97 for account numbers), and whole words in the text
just before or behind a span adjust its score.

The patterns of the base kinds are written without backtracking over runs, so
that long runs of digits or letters stay linear; they match what the plain
patterns in the comments match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import let

#: Characters before a span, and behind it, that count as its context.
CONTEXT = 40
#: Spans of kinds beyond the base need this score.
CONFIDENT = 0.5
#: Matches of one block in the running sum of positions.
BLOCK = 128


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: What any text with a match has, to pass over most texts cheaply; None if there is nothing.
    needs: str | None
    score: float
    #: Words whose presence in the context raises the score by ``boost``.
    words: str
    boost: float
    base: bool = True


#: The characters of an account number (IBAN) by country.
IBAN = {
    11: "NO", 12: "BE", 14: "DK FI FO FK GL NL SD", 15: "MK SI", 16: "AT BA EE KZ LT LU MN XK", 17: "CH HR LI LV",
    18: "BG BH CR DE GB GE IE ME RS VA", 19: "AE GI IL IQ OM SO TL", 20: "AD CZ ES MD PK RO SA SE SK TN VG", 21: "LY PT ST",
    22: "IS TR", 23: "BI DJ FR GR IT MC MR SM", 24: "AL AZ BY CY DO GT HU LB NI PL SV", 25: "BR EG PS QA UA", 26: "JO KW MU YE",
    27: "MT SC", 28: "LC", 29: "RU",
}


def _iban() -> str:
    """Country, check digits, and as many characters as that country has, with single spaces anywhere."""
    ways = [f"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n}}}" for n, names in IBAN.items()]
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(ways)})(?![A-Za-z0-9])"


_CALL = "phones?|telephone|telefon|tel|calls?|fax|mobile"
#: In the order in which spans of one start are listed.
KINDS = [
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "e-?mails?|mails?|contact|write", 0.1),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ips?|hosts?|servers?|address(?:es)?", 0.3),
    # [0-9]([\x20-]?[0-9])+ with at least 14 digits
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", None, 0.8, "cards?|visa|credit|karte|carte|tarjeta", 0.2),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, _CALL, 0.3),
    Kind("iban", _iban(), None, 0.7, "iban|accounts?|konto|bank|compte|cuenta", 0.3, base=False),
    # a national number is one only with a word for it beside it
    Kind("tel", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", None, 0.3, _CALL, 0.4, base=False),
    # a name for a secret and a long value with a digit that is set to it
    Kind("secret", r"(?i:token|secret|passw(?:or)?d|(?:api|access|private)[_-]?key)[\x22\x27]?\x20?[:=]\x20?[\x22\x27]?(?=[A-Za-z/+_-]*[0-9])[A-Za-z0-9/+_-]{16,}+", None, 0.9, "auth|login|key|secret", 0.1, base=False),
]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def of(d):
        n = F.length(d)

        def step(total, i):
            v = F.substr(d, n - i, F.lit(1)).cast("int") * (F.pmod(i, F.lit(2)) + 1)
            return total + F.when(v > 9, v - 9).otherwise(v)

        return F.pmod(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step), F.lit(10)) == 0

    return let(digits, of)


def _mod_97(account: Column) -> Column:
    def of(turned):
        def step(rest, i):
            code = F.ascii(F.substr(turned, i, F.lit(1)))
            v = F.when(code < 65, code - 48).otherwise(code - 55)
            return F.pmod(rest * F.when(v > 9, F.lit(100)).otherwise(F.lit(10)) + v, F.lit(97))

        return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1

    plain = F.replace(account, F.lit(" "), F.lit(""))
    return let(plain, lambda p: let(F.concat(F.substr(p, F.lit(5)), F.substr(p, F.lit(1), F.lit(4))), of))


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":

        def small(part):
            bare = F.ltrim(part, F.lit("0"))
            return (F.length(bare) <= 2) | ((F.length(bare) == 3) & (bare <= "255"))

        return F.forall(F.split(found, r"\."), small)
    if kind == "card":
        n = F.length(_digits(found))
        return n.between(14, 19) & F.when(n.between(14, 19), _luhn(_digits(found))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(10, 15)
    if kind == "iban":
        return _mod_97(found)
    return F.lit(True)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _starts(sizes: Column) -> Column:
    """Sums of the entries before each, in blocks: an entry is added with the entries of its block, and a block with the blocks."""

    def in_blocks(v):
        count = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count), lambda k: _sum(F.slice(v, k * BLOCK + 1, F.lit(BLOCK))))
        return let(blocks, lambda sums: let(_heads(sums), lambda heads: F.transform(F.sequence(F.lit(0), F.size(v) - 1), within(v, heads))))

    def _heads(sums):
        return F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda k: _sum(F.slice(sums, F.lit(1), k)))

    def within(v, heads):
        def start(i):
            k = F.floor(i / BLOCK).cast("int")
            return F.get(heads, k) + _sum(F.slice(v, k * BLOCK + 1, i - k * BLOCK))

        return start

    return let(sizes, in_blocks)


def _span(k: int, kind: Kind):
    near = rf"\b(?:{kind.words})\b"

    def span(x, at):
        start = at + x["gap"]
        score = F.lit(kind.score) + F.when(x["before"].rlike(near) | x["behind"].rlike(near), F.lit(kind.boost)).otherwise(F.lit(0.0))
        return F.struct(
            start.alias("start"), F.lit(k).alias("kind"), (start + x["size"]).alias("end"),
            F.when(_valid(kind.name, x["text"]), score).otherwise(F.lit(0.0)).alias("score"),
        )

    return span


def _kept(least: float):
    return lambda s: (s["score"] > 0) & (s["score"] >= least)


def _of_kind(k: int):
    return lambda s: s["kind"] == k


SPAN = "array<struct<start:int,kind:int,end:int,score:double>>"


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans), a row per row of ``docs``; a null text has none.

    ``spans`` is sorted by start, then kind: structs (start, kind, end, score) in
    code points, end exclusive, ``kind`` being a place in KINDS.  Base kinds hold
    leftmost non-overlapping matches of their pattern, less those that the
    validator refuses; no other match is tried in their place.  Spans of
    different kinds may overlap.
    """
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for k, kind in enumerate(KINDS):
        found = F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))
        found = F.when(F.contains("text", F.lit(kind.needs)), found) if kind.needs else found
        out = out.withColumn(f"m{k}", found)
    none = F.array().cast(SPAN)
    for k, kind in enumerate(KINDS):
        found = let(F.split("text", kind.pattern, -1), _spans(k, kind))
        out = out.withColumn(f"s{k}", F.when(F.size(f"m{k}") > 0, found.cast(SPAN)).otherwise(none))
    return out.select("doc_id", "text", F.array_sort(F.concat(*[f"s{k}" for k in range(len(KINDS))])).alias("spans"))


def _spans(k: int, kind: Kind):
    """Spans of one kind from the gaps between its matches; the text is gap, match, gap, match, ..., gap."""

    def of(gaps):
        def match(x, i):
            gap = F.get(gaps, i)
            near = F.lower(F.right(gap, F.lit(CONTEXT))).alias("before"), F.lower(F.left(F.get(gaps, i + 1), F.lit(CONTEXT))).alias("behind")
            return F.struct(x.alias("text"), F.length(x).alias("size"), F.length(gap).alias("gap"), *near)

        return let(F.transform(F.col(f"m{k}"), match), located)

    def located(m):
        starts = _starts(F.transform(m, lambda x: x["size"] + x["gap"]))
        return F.filter(F.zip_with(m, starts, _span(k, kind)), _kept(0.0 if kind.base else CONFIDENT))

    return of


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and lists of personal data.

    Returns (doc_id, n_email, n_ip, n_card, n_phone, n_spans, base_sha256, spans,
    scored), a row per row of ``docs``, of which other columns are not read.
    ``spans`` lists kind:start:end of all spans, of which there are n_spans;
    base_sha256 is the digest of such a list of the base kinds.  ``scored`` holds
    the spans with their scores.  Work grows with the length of a text and with
    the number of its matches.
    """
    base = [k for k, kind in enumerate(KINDS) if kind.base]
    found = find_spans(docs)
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{KINDS[k].name}") for k in base]
    return found.select(
        "doc_id", *counts, F.size("spans").cast("long").alias("n_spans"),
        F.sha2(_listed(F.filter("spans", lambda s: s["kind"] <= max(base))), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.col("spans").alias("scored"),
    )
