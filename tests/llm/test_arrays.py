import random

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm import arrays
from siftline.llm.arrays import Words, blocks, span_hashes, span_ids
from siftline.llm.units import Memo


def strings():
    rng = random.Random(5)
    thue = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    out = [b"", b"a", b"a", b"ab" * 4, b"ab" * 4 + b"\x00", b"\x00", b"\x00\x00", thue.encode(), thue.translate(str.maketrans("ab", "ba")).encode()]
    return out + [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 20))) for _ in range(3000)]


def spans(items):
    data = np.frombuffer(b"".join(items), np.uint8)
    size = np.array([len(x) for x in items])
    return data, np.cumsum(size) - size, np.cumsum(size)


def with_few_hashes(monkeypatch, bits):
    """Hashes of a few bits, so that many different strings share one."""
    made = arrays.Strings.__init__

    def short(self, *args):
        made(self, *args)
        self.hash = self.hash >> np.uint64(64 - bits) << np.uint64(64 - bits)

    monkeypatch.setattr(arrays.Strings, "__init__", short)


@pytest.mark.parametrize("bits", [64, 2])
def test_numbers_are_equal_exactly_for_equal_strings(monkeypatch, bits):
    with_few_hashes(monkeypatch, bits)
    items = strings()
    ids = span_ids(*spans(items)).tolist()
    assert len(set(zip(ids, items, strict=True))) == len(set(ids)) == len(set(items))


@pytest.mark.parametrize("bits", [64, 8, 2])
@pytest.mark.parametrize("remembered", [1 << 19, 60])
def test_remembered_units_keep_their_ids(monkeypatch, bits, remembered):
    with_few_hashes(monkeypatch, bits)
    asked = []

    def encode(units):
        asked.extend(units)
        found = [[len(u), *u] for u in units]
        return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found])

    memo, rng = Memo(encode, remembered), random.Random(1)
    for _ in range(40):
        texts = ["".join(rng.choice("abcé") for _ in range(rng.choice([0, 1, 2, 3, 9, 20]))) for _ in range(rng.choice([1, 3, 40]))]
        (block,) = blocks(pa.array(texts, pa.string()))
        start, end = block.offsets[:-1], block.offsets[1:]
        ids, count = memo.ids_of(block, start, end)
        want = [[len(t.encode()), *t.encode()] for t in texts]
        assert ids.tolist() == [i for x in want for i in x] and count.tolist() == [len(x) for x in want]
    if remembered > 1000 and bits == 64:
        assert len(asked) == len(set(asked))


def test_hashes_part_all_strings():
    items = sorted(set(strings()))
    assert len(set(span_hashes(*spans(items)).tolist())) == len(items)


def test_words():
    texts = ["", " a  bc\n", None, "é x y"]
    (block,) = blocks(pa.array(texts, pa.string()))
    words = Words(block)
    found = [block.data[a:b].tobytes().decode() for a, b in zip(words.start, words.end, strict=True)]
    assert found == ["a", "bc", "é x", "y"] and words.count.tolist() == [0, 2, 0, 2]


def test_run_hashes_part_sequences_that_polynomials_confuse():
    order = np.array([bin(i).count("1") & 1 for i in range(4096)], np.uint64)
    both = np.concatenate((order, np.uint64(1) - order, order))
    runs = arrays.RunHash(both)
    at = np.array([0, 4096, 8192])
    one, two, three = runs.run(at, at + 4096).tolist()
    assert one == three != two
    # the plain polynomial takes both for one
    assert len(set(arrays.Prefix(both).run(at, at + 4096).tolist())) == 1
