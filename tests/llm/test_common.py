import numpy as np

from canopy.llm.chunk_table import PAD, ChunkTable
from canopy.llm.common import LETTERS, Memo


def test_memo_is_bounded_by_characters():
    """Strings without end do not stay, and results do not depend on what is known."""
    memo = Memo(lambda new: ([[len(x), x.count("a")] for x in new], np.array([[float(len(x)) for x in new]])), 10, np.int64, 1)
    rng = np.random.default_rng(1)
    for _ in range(60):
        lists = [["a" * int(n) + "b" for n in rng.integers(0, 400, 7)], [], ["ab", "b"]]
        index = memo.index(lists)
        flat = [x for own in lists for x in own]
        assert memo.runs(index).tolist() == [v for x in flat for v in (len(x), x.count("a"))]
        assert memo.extra[0, index].tolist() == [len(x) for x in flat]
        memo.index([[]])
        assert memo.letters <= 10 * LETTERS


def test_chunk_table():
    """Strings of all sizes, zero bytes among them, with a memory that is trimmed all the time; what is learned twice is the same."""
    asked = []

    def learn(new):
        asked.append(len(new))
        runs = [np.frombuffer(x, np.uint8)[::2] for x in new]
        sizes = np.array([len(r) for r in runs], np.int64)
        return np.concatenate([*runs, np.zeros(0, np.uint8)]).astype(np.uint16), np.cumsum(sizes) - sizes, sizes

    table = ChunkTable(learn, 50, np.dtype("<u2"))
    rng = np.random.default_rng(2)
    for _ in range(80):
        strings = [bytes(rng.integers(0, 3, rng.integers(1, 40)).astype(np.uint8)) for _ in range(40)] + [b"\0", b"\0\0", b"ab"] * 3
        raw = b"".join(strings)
        data = np.zeros(len(raw) + PAD, np.uint8)
        data[: len(raw)] = np.frombuffer(raw, np.uint8)
        size = np.array([len(x) for x in strings])
        index = table.index(data, raw, np.cumsum(size) - size, size)
        assert table.runs(index).tolist() == [v for x in strings for v in x[::2]]
    assert max(asked) <= 49 and len(table.sizes) <= 50 + 49
