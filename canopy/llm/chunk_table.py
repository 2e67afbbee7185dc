"""A memory of what a function gives for short byte strings, looked up many at a time.

Strings of up to 23 bytes are their own keys: three words of 64 bits, the last
byte being the size, so a hit is a comparison of all bytes.  The table is an open
one with a few probes.  It only saves work: results do not depend on what is known.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Longest string that is remembered, in bytes.
MAX_BYTES = 23
#: Zero bytes that ``index`` needs behind the data.
PAD = 32
#: New strings that are learned at a time.
LEARN = 16_384
#: Slots that a string may be in, from its own on.
PROBES = 6
#: Integers that all runs together may have, for each string of the limit.
RUN = 12
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def words(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The keys of the strings of ``size`` bytes at ``at``; longer ones are cut."""
    view = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = np.empty((3, len(at)), np.uint64)
    for k, most in enumerate((8, 8, 7)):
        np.bitwise_and(view[at + 8 * k], _LOW[np.clip(size - 8 * k, 0, most)], out=out[k])
    out[2] |= np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
    return out


def _hash(keys: np.ndarray) -> np.ndarray:
    h = keys[0] * _ODD[0]
    h ^= h >> np.uint64(29)
    h += keys[1] * _ODD[1]
    h ^= h >> np.uint64(32)
    h += keys[2] * _ODD[2]
    h *= _ODD[3]
    return h ^ (h >> np.uint64(32))


class ChunkTable:
    """Remembers a run of integers for each of ``limit`` strings at most; when there are more, those used most stay.

    ``learn`` gives, for some strings, integers and where the run of each starts and how long it is.
    """

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]], limit: int, dtype: type):
        self.learn, self.limit = learn, limit
        bits = (2 * limit - 1).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.flat = np.zeros(0, dtype)
        self._empty()

    def _empty(self) -> None:
        self.table = np.zeros((self.mask + 1, 4), np.uint64)
        self.starts, self.sizes, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.keys, self.flat = np.zeros((3, 0), np.uint64), self.flat[:0]

    def _trim(self) -> None:
        order = np.argsort(-self.uses, kind="stable")
        order = order[(self.keys[2] >> np.uint64(56))[order] <= MAX_BYTES][: self.limit * 2 // 3]
        kept = np.sort(order[np.cumsum(self.sizes[order]) <= RUN * self.limit // 2])
        flat, sizes, uses, keys = self.runs(kept), self.sizes[kept], self.uses[kept] // 2, self.keys[:, kept]
        self._empty()
        self.flat, self.sizes, self.uses, self.keys = flat, sizes, uses, keys
        self.starts = np.cumsum(sizes) - sizes
        self._insert(keys, np.arange(len(sizes)))

    def _insert(self, keys: np.ndarray, place: np.ndarray) -> None:
        """Put new keys into free slots; one that finds none is not remembered."""
        slot = (_hash(keys) >> self.shift).astype(np.int64)
        rows = np.concatenate([keys, place.astype(np.uint64)[None]]).T
        for _ in range(PROBES):
            free = self.table[slot, 2] == 0
            self.table[slot[free]] = rows[free]
            mine = free & (self.table[slot, 3] == rows[:, 3])  # of several that want a slot, the last has it
            slot, rows = (slot[~mine] + 1) & self.mask, rows[~mine]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of known keys, -1 for others."""
        out, todo = np.full(keys.shape[1], -1, np.int64), None
        slot = (_hash(keys) >> self.shift).astype(np.int64)
        for _ in range(PROBES):
            row = self.table[slot]
            same = (row[:, 0] == keys[0]) & (row[:, 1] == keys[1]) & (row[:, 2] == keys[2])
            at = np.flatnonzero(same)
            out[at if todo is None else todo[at]] = row[at, 3]
            rest = np.flatnonzero(~same & (row[:, 2] != 0))
            todo = rest if todo is None else todo[rest]
            if not len(rest):
                break
            slot, keys = (slot[rest] + 1) & self.mask, keys[:, rest]
        return out

    def index(self, data: np.ndarray, raw: bytes | memoryview, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places of the strings of ``size`` bytes at ``at``; valid until the next call.

        ``data`` and ``raw`` are the same bytes, the first with PAD bytes behind.
        """
        if len(self.sizes) > self.limit or len(self.flat) > RUN * self.limit:
            self._trim()
        keys = words(data, at, size)
        out = self._find(keys)
        short = size <= MAX_BYTES
        out[~short] = -1
        new = np.flatnonzero(out < 0)
        if len(new):
            _, first, own = np.unique(_hash(keys[:, new]), return_index=True, return_inverse=True)
            head = new[first]
            same = short[new] & short[head][own] & (keys[:, new] == keys[:, head][:, own]).all(0)
            # a long string, or one whose hash meets another's, is learned for this call alone
            alone = np.flatnonzero(~same)
            head = head[short[head]]
            known: dict[bytes, int] = {}
            odd = [known.setdefault(bytes(raw[a : a + n]), len(known)) for a, n in zip(at[new[alone]].tolist(), size[new[alone]].tolist(), strict=True)]
            place = len(self.sizes)
            self._learn([bytes(raw[a : a + n]) for a, n in zip(at[head].tolist(), size[head].tolist(), strict=True)] + list(known), keys[:, head])
            self._insert(keys[:, head], np.arange(place, place + len(head)))
            got = np.full(len(first), -1, np.int64)
            got[short[new[first]]] = np.arange(place, place + len(head))
            out[new] = got[own]
            out[new[alone]] = place + len(head) + np.array(odd, np.int64)
        self.uses += np.bincount(out, minlength=len(self.uses))
        return out

    def _learn(self, new: list[bytes], keys: np.ndarray) -> None:
        flats, starts, sizes, have = [self.flat], [self.starts], [self.sizes], len(self.flat)
        for at in range(0, len(new), LEARN):
            flat, start, size = self.learn(new[at : at + LEARN])
            flats.append(flat)
            starts.append(have + start)
            sizes.append(size)
            have += len(flat)
        self.flat, self.starts, self.sizes = np.concatenate(flats), np.concatenate(starts), np.concatenate(sizes)
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        beyond = np.full((3, len(new) - keys.shape[1]), np.iinfo(np.uint64).max, np.uint64)
        self.keys = np.concatenate([self.keys, keys, beyond], axis=1)

    def runs(self, index: np.ndarray) -> np.ndarray:
        """The integers of the strings at ``index``, joined."""
        sizes = self.sizes[index]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[index] - ends + sizes, sizes) + np.arange(int(sizes.sum()))]
