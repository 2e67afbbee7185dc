"""SentencePiece files as unigram vocabularies: cells, best and n-best segmentations.

The scores of the file are added up exactly.  No piece of a vocabulary may join
a character with a space mark or a line feed after it (checked on loading), so a
text falls into cells, runs of space marks with what follows, and the best
segmentation of a text joins the best ones of its cells.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from functools import cached_property

import ahocorasick
import numpy as np
import sentencepiece

SPACE = "▁"
#: Cells of more characters, and cells in smaller numbers, are searched one by one.
LONG, FEW = 32, 256
#: How much worse than the worst piece an unknown character scores.
UNKNOWN_PENALTY = 10.0
CELL = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Trie:
    """Pieces as a double array: the child of a node by a code is the node's base + the code, if the node owns that slot; the root is slot 0.

    Codes of characters start with 1; 0 is any character that no piece has.
    """

    def __init__(self, pieces: dict[str, tuple[float, int]]):
        kids: dict[str, list[str]] = defaultdict(list)
        nodes = {w[:i] for w in pieces for i in range(1, len(w) + 1)}
        for node in sorted(nodes):
            kids[node[:-1]].append(node[-1])
        # frequent characters have small codes, so that most nodes find room close to one another
        code = {c: i for i, (c, _) in enumerate(Counter(c for own in kids.values() for c in own).most_common(), 1)}
        taken, base, low, top = bytearray([1]), {}, 0, 0
        for node in sorted(kids, key=lambda x: (x != "", -len(kids[x]), x)):
            first, *others = sorted(code[c] for c in kids[node])
            at, tries = max(low, first), 0
            while True:
                room = max(at, top + 1) + len(code) + 1
                if len(taken) < room:
                    taken.extend(bytes(room))
                at = taken.find(0, at)
                if not any(taken[at - first + c] for c in others):
                    break
                at, tries = at + 1, tries + 1
            # slots that are passed over cost room, searching them again and again costs time
            low = at if tries > 16 or not others and low >= first else low
            base[node] = at - first
            for c in (first, *others):
                taken[at - first + c] = 1
                top = max(top, at - first + c)
        slot = {"": 0} | {x: base[x[:-1]] + code[x[-1]] for x in nodes}
        self.code = np.zeros(max(map(ord, code), default=0) + 2, np.int32)  # the last place is for all characters behind it
        self.code[[ord(c) for c in code]] = list(code.values())
        size = len(taken) + len(code)
        self.base, self.owner, self.ids = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.scores = np.zeros(size)
        self.base[[slot[x] for x in base]] = list(base.values())
        self.owner[[slot[x] for x in nodes]] = [slot[x[:-1]] for x in nodes]
        for w, (score, i) in pieces.items():
            self.scores[slot[w]], self.ids[slot[w]] = score, i
        self.depth = max(map(len, pieces), default=0)

    def codes(self, chars: np.ndarray) -> np.ndarray:
        return self.code[np.minimum(chars, len(self.code) - 1)]


class Pieces:
    """Pieces, scores and byte pieces of a SentencePiece file."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unknown_id = sp.unk_id()
        self.byte_ids: list[int] = [-1] * 256
        self.pieces: list[str] = []
        self.surface: list[bytes] = []
        self.automaton = ahocorasick.Automaton()
        self.singles: set[str] = set()
        low = 0.0
        for i in range(sp.vocab_size()):
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            self.pieces.append(piece)
            self.surface.append(piece.replace(SPACE, " ").encode())
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.surface[i] = bytes([int(piece[3:-1], 16)])
            elif sp.is_control(i) or sp.is_unknown(i):
                self.surface[i] = b""
            elif not sp.is_unused(i) and piece:
                if re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", piece, re.S):
                    raise ValueError(f"the piece {piece!r} joins two cells")
                low = min(low, score)
                self.automaton.add_word(piece, (len(piece), score, i))
                if len(piece) == 1:
                    self.singles.add(piece)
        self.automaton.make_automaton()
        self.unknown_score = low - UNKNOWN_PENALTY
        self.by_bytes = min(self.byte_ids) >= 0

    @staticmethod
    def cells(text: str) -> list[str]:
        """Cells of a text, with a space mark in front of it; none if it is empty."""
        return CELL.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def edges(self, cell: str) -> list[list[tuple[int, float, int]]]:
        """For each end: (start, score, id) of the pieces that end there, longest first; id -1 is an unknown character."""
        out: list[list[tuple[int, float, int]]] = [[] for _ in range(len(cell) + 1)]
        for end, (size, score, i) in self.automaton.iter(cell):
            out[end + 1].append((end + 1 - size, score, i))
        for at, c in enumerate(cell):
            if c not in self.singles:
                out[at + 1].append((at, self.unknown_score, -1))
        return out

    def spell(self, i: int, char: str) -> list[int]:
        """Ids of a piece; an unknown character falls back to its bytes."""
        if i >= 0:
            return [i]
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.by_bytes else [self.unknown_id]

    def count(self, cell: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation, carried forward without the path.

        Of equal scores the tokenizer keeps the one it meets first: the earliest
        start, which is the longest last piece.
        """
        n = len(cell)
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        reached = 0
        top, many = float("-inf"), 0
        # matches come by end, and of one end from the longest to the shortest
        for end, (size, score, _) in self.automaton.iter(cell):
            while reached < end:
                top, many = self._close(cell, reached, best, pieces, top, many)
                reached += 1
            at = end + 1 - size
            s = best[at] + score
            if s > top:
                top, many = s, pieces[at] + 1
        while reached < n:
            top, many = self._close(cell, reached, best, pieces, top, many)
            reached += 1
        return pieces[n], best[n]

    def _close(self, cell, at, best, pieces, top, many) -> tuple[float, int]:
        """Settle the end behind character ``at``."""
        if cell[at] not in self.singles:
            s = best[at] + self.unknown_score
            if s > top:
                top = s
                many = pieces[at] + (len(cell[at].encode("utf-8", "surrogatepass")) if self.by_bytes else 1)
        best[at + 1], pieces[at + 1] = top, many
        return float("-inf"), 0

    def best_two(self, cell: str) -> tuple[list[int], float, float]:
        """(ids, score) of the best segmentation as in ``count``, and how much the second best is worse."""
        n, low = len(cell), float("-inf")
        best, second, back = [0.0] + [low] * n, [low] * (n + 1), [(0, -1)] * (n + 1)
        singles, unknown = self.singles, self.unknown_score
        reached = 0
        for end, (size, score, i) in self.automaton.iter(cell):
            while reached < end:  # ends that have all their pieces
                if cell[reached] not in singles:
                    self._offer(best, second, back, reached, reached + 1, unknown, -1)
                reached += 1
            at, to = end + 1 - size, end + 1
            s = best[at] + score
            if s > best[to]:
                other, best[to], back[to] = best[to], s, (at, i)
            else:
                other = s
            also = second[at] + score
            if also > other:
                other = also
            if other > second[to]:
                second[to] = other
        while reached < n:
            if cell[reached] not in singles:
                self._offer(best, second, back, reached, reached + 1, unknown, -1)
            reached += 1
        path, at = [], n
        while at:
            path.append((back[at][0], 0.0, back[at][1]))
            at = back[at][0]
        return self._ids(cell, path), best[n], best[n] - second[n]

    @cached_property
    def trie(self) -> Trie:
        return Trie({piece: (score, i) for piece, (_, score, i) in self.automaton.items()})

    def best_two_all(self, cells: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """((ids, joined; their numbers), scores and losses) of ``best_two`` for each cell."""
        lens = np.fromiter(map(len, cells), np.int64, len(cells))
        short = np.flatnonzero((lens > 0) & (lens <= LONG))
        if len(short) < FEW:
            short = short[:0]
        numbers, extra, runs = np.zeros(len(cells), np.int64), np.zeros((2, len(cells))), {}
        one_by_one = np.ones(len(cells), bool)
        one_by_one[short] = False
        for i in np.flatnonzero(one_by_one).tolist():
            runs[i], *extra[:, i] = self.best_two(cells[i])
            numbers[i] = len(runs[i])
        ids = np.zeros(0, np.int32)
        if len(short):
            ids, numbers[short], extra[:, short] = self._best_two_short([cells[i] for i in short.tolist()], lens[short])
        flat = np.empty(int(numbers.sum()), np.int32)
        flat[np.repeat(~one_by_one, numbers)] = ids
        flat[np.repeat(one_by_one, numbers)] = [x for run in runs.values() for x in run]
        return (flat, numbers), extra

    def _best_two_short(self, cells: list[str], lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The forward pass of ``best_two`` over all cells at a time: ends from left to right, and of an end from the longest piece to the shortest."""
        trie, m, rows = self.trie, len(cells), int(lens.max())
        chars = np.frombuffer("".join(cells).encode("utf-32-le", "surrogatepass"), np.uint32)
        column = np.repeat(np.arange(m), lens)
        row = np.arange(len(chars)) - np.repeat(np.cumsum(lens) - lens, lens)
        # a row for each place of a character, a column for each cell
        text, codes, there = np.zeros((rows, m), np.uint32), np.zeros((rows, m), np.int32), np.zeros((rows, m), bool)
        text[row, column], codes[row, column], there[row, column] = chars, trie.codes(chars), True
        codes, at = codes.ravel(), np.flatnonzero(there)
        state = codes[at]
        state = np.where(trie.owner[state] == 0, state, 0)
        known = trie.ids[state] >= 0
        found = [(at, np.where(known, trie.scores[state], self.unknown_score), trie.ids[state])]
        at, state = at[state > 0], state[state > 0]
        for size in range(2, min(trie.depth, rows) + 1):
            inside = np.searchsorted(at, (rows - size + 1) * m)
            at, state = at[:inside], state[:inside]
            child = trie.base[state] + codes[at + (size - 1) * m]
            goes = trie.owner[child] == state
            at, state = at[goes], child[goes]
            ends = trie.ids[state] >= 0
            found.append((at[ends], trie.scores[state[ends]], trie.ids[state[ends]]))
        by_start = [(np.searchsorted(at, np.arange(rows + 1) * m).tolist(), at % m, score, i) for at, score, i in found]
        best, second = np.full((rows + 1, m), -np.inf), np.full((rows + 1, m), -np.inf)
        back, back_id = np.zeros((rows + 1, m), np.int8), np.zeros((rows + 1, m), np.int32)
        best[0] = 0.0
        for end in range(1, rows + 1):
            for size in range(min(len(found), end), 0, -1):
                bounds, columns, scores, ids = by_start[size - 1]
                start = end - size
                own = slice(bounds[start], bounds[start + 1])
                if own.start == own.stop:
                    continue
                j, score = columns[own], scores[own]
                s, also, top = best[start][j] + score, second[start][j] + score, best[end][j]
                better = s > top
                best[end][j] = np.maximum(s, top)
                second[end][j] = np.maximum(second[end][j], np.maximum(np.minimum(s, top), also))
                won = j[better]
                back[end][won], back_id[end][won] = size, ids[own][better]
        every = np.arange(m)
        extra = np.stack([best[lens, every], best[lens, every] - second[lens, every]])
        at, path, starts, steps = lens.copy(), [], [], np.zeros(m, np.int64)
        while at.any():
            steps += at > 0
            path.append(back_id[at, every])
            at = at - back[at, every]
            starts.append(at)
        # step k from the end of a cell is its k-th id from the end
        step, cell = np.nonzero(np.arange(len(path))[:, None] < steps)
        to = np.cumsum(steps)[cell] - 1 - step
        ids, places = np.empty(len(to), np.int32), np.empty(len(to), np.int64)
        ids[to], places[to] = np.array(path)[step, cell], np.array(starts)[step, cell] * m + cell
        if (unknown := np.flatnonzero(ids < 0)).size:
            spelled = [self.spell(-1, chr(c)) for c in text.ravel()[places[unknown]].tolist()]
            counts = np.ones(len(ids), np.int64)
            counts[unknown] = list(map(len, spelled))
            steps = np.add.reduceat(counts, np.cumsum(steps) - steps)
            ids = np.repeat(ids, counts)
            ids[ids < 0] = [x for own in spelled for x in own]
        return ids, steps, extra

    @staticmethod
    def _offer(best, second, back, at, to, score, i) -> None:
        s, also = best[at] + score, second[at] + score
        if s > best[to]:
            best[to], s, back[to] = s, best[to], (at, i)
        second[to] = max(second[to], s, also)

    def nbest(self, cell: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations, best first.

        Forward Viterbi scores of all ends are exact heuristics for a search from
        the end backwards: a partial path from position p to the end has priority
        (forward score of p) + (its own score).  The first result is the
        Viterbi path, with the tokenizer's rule for ties; further ones of
        equal score follow in the order in which the search completes them.
        """
        edges = self.edges(cell)
        size = len(cell)
        forward, back = [0.0] * (size + 1), [(0, 0.0, -1)] * (size + 1)
        for end in range(1, size + 1):
            top = float("-inf")
            for e in edges[end]:
                s = forward[e[0]] + e[1]
                if s > top:
                    top, back[end] = s, e
            forward[end] = top
        path, at = [], size
        while at:
            path.append(back[at])
            at = back[at][0]
        first = self._ids(cell, path)
        out = [(forward[size], first)]
        if n <= 1:
            return out
        viterbi = tuple((e[0], e[2]) for e in path)
        # (minus priority, position, order): of equal priority the path nearest to completion goes on
        agenda = [(-forward[size], size, 0, 0.0, None)]
        order = 0
        while agenda and len(out) < n:
            _, at, _, own, tail = heapq.heappop(agenda)
            if not at:
                walk = []
                while tail:
                    walk.append(tail[0])
                    tail = tail[1]
                walk.reverse()
                if tuple((e[0], e[2]) for e in walk) != viterbi:
                    out.append((own, self._ids(cell, walk)))
                continue
            for e in edges[at]:
                order += 1
                s = own + e[1]
                heapq.heappush(agenda, (-(forward[e[0]] + s), e[0], order, s, (e, tail)))
        return out

    def _ids(self, cell: str, path: list[tuple[int, float, int]]) -> list[int]:
        """Ids of a path given from its end."""
        return [x for start, _, i in reversed(path) for x in self.spell(i, cell[start] if i < 0 else "")]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, without the space that stands in front of every text."""
        surface = self.surface
        out = b"".join([surface[i] for i in ids])
        return out[1:] if out[:1] == b" " else out
