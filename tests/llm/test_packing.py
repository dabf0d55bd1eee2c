import base64
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from siftline.llm.arrays import blocks
from siftline.llm.packing import END_ID, LENGTH, PATTERN, RANKS, RoomTree, Tokenizer, best_fit, op5_best_fit_packing, pack_tokens, unpack_tokens, write_packed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(encoding):
    rng = random.Random(3)
    bag = ["the", "don't", " ", "  ", "é", " ", "　", "à ", " ", "\n", "\r\n", "\t", "12", "!!", "中", "\U0001f600", "\x85", "Ω", "\x1f", "\x00"]
    texts = ["", " ", "a  b", "é é  x", "x　 y"] + ["".join(rng.choice(bag) for _ in range(rng.randint(0, 50))) for _ in range(600)]
    tokenizer = Tokenizer(open(RANKS, "rb").read())
    for block in blocks(pa.array(texts), limit=700):
        ids, counts = tokenizer.ids(block)
        for i, part in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
            assert part.tolist() == encoding.encode_ordinary(texts[block.rows.start + i]), texts[block.rows.start + i]


def plain_best_fit(sizes, length):
    rooms, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [r for r in rooms if r[0] >= sizes[i]]
        if fits:
            room = min(fits)
            rooms.remove(room)
        else:
            room = (length, len({b for b in out if b is not None}))
        out[i] = room[1]
        if room[0] > sizes[i]:
            rooms.append((room[0] - sizes[i], room[1]))
    return out


def test_packing_is_as_tight_as_plain_best_fit():
    rng = np.random.default_rng(1)
    for length in (1, 7, 64, 100):
        for _ in range(20):
            sizes = rng.integers(1, length + 1, 60)
            bins, n = best_fit(sizes, length)
            used = np.bincount(bins, sizes, n)
            assert used.max() <= length and n == len(set(plain_best_fit(sizes.tolist(), length)))


def test_room_tree_finds_the_closest():
    rng = random.Random(2)
    tree, rooms = RoomTree(50), []
    for step in range(500):
        room = rng.randint(1, 50)
        if rng.random() < 0.5:
            tree.add(room, step)
            rooms.append(room)
        else:
            want = min((r for r in rooms if r >= room), default=None)
            assert tree.closest(room) == want
            if want is not None:
                tree.take(want)
                rooms.remove(want)


def whole(packed):
    pieces = {}
    for r in unpack_tokens(packed).collect():
        pieces.setdefault(r["doc_id"], {})[r["piece"]] = r["ids"]
    return {i: [x for k in sorted(p) for x in p[k]] for i, p in pieces.items()}


def test_nothing_is_lost_and_rows_are_consistent(spark, documents, encoding, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 3, 30, 300])))) for i in range(200)]
    packed = pack_tokens(documents(rows), length=64, block_ids=3000)
    assert whole(packed) == {i: encoding.encode_ordinary(t) + [END_ID] for i, t in rows}
    total = 0
    for r in packed.collect():
        ids, places = np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["positions"], "<i4")
        ends = r["cu_seqlens"]
        assert len(ids) == len(places) == 64 and ends[0] == 0 and ends[-1] == r["n_tokens"] and len(ends) == len(r["doc_ids"]) + 1
        for a, b in zip(ends[:-1], ends[1:]):
            assert places[a:b].tolist() == list(range(b - a)) and b > a
        assert not ids[r["n_tokens"] :].any()
        total += 1
    assert packed.select("task", "bin").distinct().count() == total
    write_packed(packed, f"{tmp_path}/packed")
    assert whole(spark.read.parquet(f"{tmp_path}/packed")) == whole(packed)


def test_whole_table(spark, encoding):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    packed = op5_best_fit_packing(spark, SF)
    assert whole(packed) == {i: encoding.encode_ordinary(t) + [END_ID] for i, t in docs.items()}
    assert all(r["n_tokens"] <= LENGTH for r in packed.collect())


def test_edge_cases(spark, documents):
    docs = documents([(1, None), (2, ""), (None, "a"), (3, "a"), (3, "a")], partitions=1).withColumnRenamed("lang", "ids").withColumnRenamed("source", "bin")
    row = pack_tokens(docs).collect()
    assert len(row) == 1 and sorted(map(str, row[0]["doc_ids"])) == ["2", "3", "3", "None"] and row[0]["n_tokens"] == 7
    assert pack_tokens(documents([])).count() == 0


def test_words_that_polynomial_hashes_confuse(encoding):
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    (block,) = blocks(pa.array([one, two]))
    ids, counts = Tokenizer(open(RANKS, "rb").read()).ids(block)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [encoding.encode_ordinary(one), encoding.encode_ordinary(two)]
