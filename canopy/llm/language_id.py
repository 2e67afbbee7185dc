"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A document is
parsed greedily against each automaton into longest matches; the language that
needs the fewest bits of phrases per letter wins.

All documents are learned from and predicted on the executors; the driver sees
only the bounded training texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.storage import settle
from canopy.llm.common import column, held, slices, small_batches, with_fields

#: Labelled texts of a language, and characters of them, that a model learns from at most.
SAMPLE_TEXTS, SAMPLE_CHARS = 200, 40_000
#: Languages a model has at most; more are met in several passes.
LANGUAGES = 64
#: Characters that are parsed as one piece; a phrase ends where its piece ends.
PIECE = 512
UNKNOWN = "und"
#: Cells of an automaton's dense table at most; with a larger alphabet its edges are kept sorted.
DENSE = 1 << 25


def _fold_table() -> np.ndarray:
    """For each code point its lower-case letter, or a space (32) if it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@lru_cache(1)
def fold_table() -> np.ndarray:
    return _fold_table()


def folded(text: str) -> np.ndarray:
    """Code points of the letters in lower case, with one space for whatever stands between words."""
    codes = fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep]


class Parser:
    """A suffix automaton as a table of (state, symbol), 0 where there is no such match: dense, or sorted edges if that is too large."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.bits = float(np.log2(max(len(symbols), 2)))
        nxt, link, length = [{}], [-1], [0]
        last = 0
        for c in symbols.tolist():
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    new = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[cur] = new
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = new
                        p = link[p]
            last = cur
        self.width, self.root = width, np.zeros(width, np.int64)
        for c, to in nxt[0].items():
            self.root[c] = to
        places = np.array([state * width + c for state, row in enumerate(nxt) for c in row], np.int64)
        ends = np.array([to for row in nxt for to in row.values()], np.int32)
        order = np.argsort(places)
        self.places, self.ends, self.table = places[order], ends[order], None
        if len(nxt) * width <= DENSE:
            self.table = np.zeros(len(nxt) * width, np.int32)
            self.table[self.places] = self.ends
            self.places = self.ends = None

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        place = state * self.width + symbol
        if self.table is not None:
            return self.table[place]
        if not len(self.places):
            return np.zeros(len(place), np.int32)
        at = np.minimum(np.searchsorted(self.places, place), len(self.places) - 1)
        return np.where(self.places[at] == place, self.ends[at], 0)

    def phrases(self, steps: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Phrases of each piece; ``steps[i]`` has the i-th symbols, of which the first ``active[i]`` exist."""
        state = np.zeros(steps.shape[1], np.int64)
        count = np.zeros(steps.shape[1], np.int32)
        for symbols, m in zip(steps, active.tolist(), strict=True):
            c = symbols[:m]
            to = self.step(state[:m], c)
            over = to == 0
            count[:m] += over | (state[:m] == 0)
            state[:m] = np.where(over, self.root[c], to)
        return count


class Model:
    """Parsers of all languages over one alphabet; symbol 0 is the space, the last one any unseen letter."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        texts = {k: folded(v) for k, v in samples.items()}
        letters = sorted(set(np.concatenate([*texts.values(), np.zeros(0, np.uint32)]).tolist()) - {32})
        self.symbol = np.full(0x110000, len(letters) + 1, np.int32)
        self.symbol[32] = 0
        self.symbol[letters] = np.arange(1, len(letters) + 1)
        self.parsers = [Parser(self.symbol[texts[k]], len(letters) + 2) for k in self.languages]

    def weigh(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Letters of each text, its best language, the bits of that, and the sum over all languages of 2 ** (those bits - theirs)."""
        codes = [folded(t or "") for t in texts]
        letters = np.array([int((c != 32).sum()) for c in codes], np.int64)
        if not self.parsers or not letters.any():
            return letters, [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        size = np.array([len(c) for c in codes], np.int64)
        pieces = -(-size // PIECE)
        doc = np.repeat(np.arange(len(codes)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (np.cumsum(size) - size)[doc] + nth * PIECE
        length = np.minimum(size[doc] - nth * PIECE, PIECE)
        order = np.argsort(-length, kind="stable")
        doc, start, length = doc[order], start[order], length[order]
        symbols = np.append(self.symbol[np.concatenate(codes)], np.zeros(PIECE, np.int32))
        steps = symbols[start[None, :] + np.arange(int(length[0]))[:, None]]
        active = len(length) - np.searchsorted(length[::-1], np.arange(1, int(length[0]) + 1))
        bits = np.zeros((len(self.parsers), len(codes)))
        for k, parser in enumerate(self.parsers):
            bits[k] = np.bincount(doc, parser.phrases(steps, active), len(codes)) * parser.bits
        low = bits.min(0)
        names = [self.languages[k] if n else UNKNOWN for k, n in zip(bits.argmin(0).tolist(), letters.tolist(), strict=True)]
        return letters, names, low, np.exp2(np.maximum(low - bits, -1000)).sum(0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (posterior of the bits) and bits per letter of each text."""
        letters, names, low, total = self.weigh(texts)
        return names, *_rated(letters, low, total)


def _rated(letters: np.ndarray, low: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    score, rate = np.zeros(len(letters)), np.zeros(len(letters))
    some = (letters > 0) & (total > 0)
    score[some], rate[some] = 1 / total[some], low[some] / letters[some]
    return score, rate


def _better(names: list[str], low: np.ndarray, total: np.ndarray, names2: list[str], low2: np.ndarray, total2: np.ndarray) -> tuple:
    """What two models over different languages find together; ties go to the first."""
    least = np.minimum(low, low2)
    total = total * np.exp2(np.maximum(least - low, -1000)) + total2 * np.exp2(np.maximum(least - low2, -1000))
    return [y if better else x for x, y, better in zip(names, names2, (low2 < low).tolist(), strict=True)], least, total


def learnable(docs: DataFrame) -> Column:
    """Rows that may be learned from: with a language and a text, and not held out."""
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Training text of each language, of bounded size.

    Texts of a language are ordered by a hash of the text, equal ones counted
    once; as many as make up ``chars`` characters are joined, ``texts`` at most.
    The share of hashes that is looked at follows from the counts of all labelled
    rows, so few texts of a language reach the driver whatever the size of the table.
    """
    labelled = docs.select("doc_id", "text", "lang").where(learnable(docs)).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = settle(labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "languages")
    share = F.least(F.lit(1.0), F.lit(1.3 * (texts + 30)) / F.greatest("n", F.lit(1)))
    place = F.pmod("h", F.lit(1 << 40))
    drawn = labelled.join(F.broadcast(counts), "lang").where(place < share * float(1 << 40))
    drawn = drawn.groupBy("lang", "h").agg(F.min(F.substring("text", 1, chars)).alias("text"))
    inner = Window.partitionBy("lang").orderBy(place, "h")
    # characters up to the text itself, with the two between texts
    before = F.sum(F.length("text") + 2).over(inner.rowsBetween(Window.unboundedPreceding, -1))
    drawn = drawn.select("lang", "text", F.row_number().over(inner).alias("nth"), F.coalesce(before, F.lit(0)).alias("before"))
    drawn = settle(drawn.where((F.col("nth") <= texts) & (F.col("before") < chars)), "language-sample")
    languages = sorted(r.lang for r in counts.select("lang").collect())
    out = {}
    for at in range(0, len(languages), LANGUAGES):
        found: dict[str, list] = {}
        for r in drawn.where(F.col("lang").isin(languages[at : at + LANGUAGES])).collect():
            found.setdefault(r.lang, []).append((r.nth, r.text))
        for lang, own in found.items():
            joined = " \n".join(x for _, x in sorted(own))[:chars]
            if any(x.isalpha() for x in joined):
                out[lang] = joined
    return out


def _model(raw: bytes) -> Model:
    return held(("op2", raw), lambda: Model(pickle.loads(raw)))


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """``docs`` (any columns, among them ``text``) with lang_pred, score and bits_per_letter.

    ``score`` is between 0 and 1.  A text that is null or has no letters gets
    ``und`` and score 0, as does every text if nothing was learned.  Ties go to
    the language whose name sorts first.  The result columns replace columns of the same name.
    More than LANGUAGES languages take a pass for each LANGUAGES of them, between
    which score has the sum of ``Model.weigh`` and bits_per_letter the bits of the text.
    """
    new = ("lang_pred", "score", "bits_per_letter")
    kept = [c for c in docs.columns if c not in new]
    docs = docs.select(*kept)
    small_batches(docs.sparkSession)
    schema = with_fields(docs.schema, "lang_pred string, score double, bits_per_letter double")
    languages = sorted(samples)
    starts = range(0, max(len(languages), 1), LANGUAGES)
    for at in starts:
        part = {k: samples[k] for k in languages[at : at + LANGUAGES]}
        shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(part))
        docs = docs.mapInArrow(_pass(shared, at == 0, at == starts[-1], kept), schema)
        if at != starts[-1]:
            docs = settle(docs, "languages-met")
    return docs


def _pass(shared, first: bool, last: bool, kept: list[str]):
    """Weigh the texts with one model, together with what earlier passes found."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for b in slices(batches):
            letters, names, low, total = model.weigh(column(b, "text").to_pylist())
            if not first:
                old = column(b, "lang_pred").to_pylist(), column(b, "bits_per_letter").to_numpy(), column(b, "score").to_numpy()
                names, low, total = _better(*old, names, low, total)
            score, rate = _rated(letters, low, total) if last else (total, low)
            new = [pa.array(names, pa.string()), pa.array(score), pa.array(rate)]
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in kept), *new], names=[*kept, "lang_pred", "score", "bits_per_letter"])

    return work


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows that are not held out, and predict every row.

    Returns (doc_id, held_out, lang_pred, score), a row per row of ``docs``.  A
    null doc_id is not held out.
    """
    samples = sample(docs)
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), samples).select("doc_id", "held_out", "lang_pred", "score")
