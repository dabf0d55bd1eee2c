import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from siftline.llm.arrays import blocks
from siftline.llm.curve_packing import BITS, coordinates, grid, hilbert, op12_curve_packing, pack_along_curve, packed_sequences, projection, units


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def texts():
    rng = random.Random(12)
    marks = ["'", "'s", "'re", "''", "don't", "İ", "é", "é", "ß", "×", "÷", "—", ",", ".", "a", "B", "zu", "9", "42", " ", "  ", "\n", "\t", "\x0b", " ", " ", "日本", "ſ", "́",
             "<", "|", ">", "endoftext", "\x00", "\x1f", "🙂", "ǆ", "ﬁ", "Ω", "İ,", "º", "²", "½"]
    out = [None, "", " \n", "one", "<|endoftext|> a,b<|startoftext|>,c", "x,<|endoftext|"]
    out += ["".join(rng.choice(marks) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    out += [" ".join(rng.choice(["the", "of", "ones", "Und,", "pour"]) + str(rng.randrange(9)) for _ in range(rng.randint(1, 2000))) for _ in range(30)]
    return out + out[-2:]


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_units_are_tokenised_like_whole_texts(tokenizer):
    all_texts = [t or "" for t in texts()]
    for block in blocks(pa.array(all_texts)):
        start, end, owner = units(block, (b"<|endoftext|>", b"<|startoftext|>"))
        found = [[] for _ in range(len(block))]
        for a, b, i in zip(start.tolist(), end.tolist(), owner.tolist(), strict=True):
            found[i] += tokenizer.encode(block.data[a:b].tobytes().decode(), add_special_tokens=False).ids
        for i, ids in enumerate(found):
            assert ids + [1] == ids_of(tokenizer, all_texts[block.rows.start + i]), all_texts[block.rows.start + i]


def test_every_id_is_in_one_place(spark, documents, tokenizer):
    rows = list(enumerate(texts())) + [(7, "twice"), (7, "twice"), (None, "no id")]
    pieces = pack_along_curve(documents(rows)).cache()
    got = pieces.collect()
    filled = {}
    for p in got:
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] >= 1 and 0 <= p["offset"] and p["offset"] + p["length"] <= 2048
        filled.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in filled.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(places))
    sizes = [sum(n for _, n in filled[s]) for s in sorted(filled)]
    assert sorted(filled) == list(range(len(filled))) and set(sizes[:-1]) <= {2048}
    whole = {}
    for p in sorted(got, key=lambda p: (p["sequence_id"], p["offset"])):
        whole.setdefault(p["doc_id"], []).append((p["start"], p["doc_tokens"], np.frombuffer(p["ids"], "<u4").tolist()))
    once = {i: t for i, t in rows if i not in (7, None)}
    for i, text in once.items():
        want = ids_of(tokenizer, text)
        assert [x for _, _, ids in whole[i] for x in ids] == want
        assert [s for s, _, _ in whole[i]] == np.cumsum([0] + [len(x) for _, _, x in whole[i]])[:-1].tolist() and whole[i][0][1] == len(want)
    assert sorted(len(x) for _, _, x in whole[7]) == sorted(len(ids_of(tokenizer, t)) for t in ("twice", "twice", dict(rows[: len(rows) - 3])[7]))
    # matrices give the same segments back
    back = {}
    for row in packed_sequences(pieces).collect():
        ids, place = np.frombuffer(row["ids"], "<u4"), np.frombuffer(row["positions"], "<u4")
        assert len(ids) == 2048 and row["cu_seqlens"][-1] == row["n_tokens"]
        for a, b, doc, start in zip(row["cu_seqlens"], row["cu_seqlens"][1:], row["doc_ids"], row["starts"], strict=False):
            back[row["sequence_id"], a] = (doc, start, ids[a:b].tolist())
            assert place[a:b].tolist() == list(range(b - a))
    assert back == {(p["sequence_id"], p["offset"]): (p["doc_id"], p["start"], np.frombuffer(p["ids"], "<u4").tolist()) for p in got}


def test_result_does_not_depend_on_partitions(spark, documents):
    rows = list(enumerate(texts()))
    one, many = (pack_along_curve(documents(rows, n)) for n in (1, 7))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = hilbert(points, bits)
        assert sorted(key.tolist()) == list(range(len(points)))
        walk = points[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_alike_documents_are_near(spark, documents):
    rng = random.Random(3)
    bags = [[f"{a}{b}" for b in "abcdefghijklmnop"] for a in ("ka", "lu", "mi", "no")]
    rows = [(i, " ".join(rng.choice(bags[i % 4]) for _ in range(150))) for i in range(400)]
    seen = pack_along_curve(documents(rows)).orderBy("sequence_id", "offset").select("doc_id").collect()
    topics = [r["doc_id"] % 4 for r in seen]
    assert np.mean([a == b for a, b in itertools.pairwise(topics)]) > 0.9
    # copies have one key, and the vector does not depend on order or length
    matrix, none = projection(), np.zeros(0, np.int64)
    assert hilbert(grid(coordinates(none, none, none, 1, matrix)), BITS) >= 0
    one = coordinates(np.array([0, 0, 1, 1, 1, 1]), np.array([0, 1, 1, 0, 0, 1]), np.array([5, 9]), 2, matrix)
    assert np.allclose(one[0], one[1])


def test_query(spark, documents, tokenizer, tmp_path):
    rows = list(enumerate(texts()))
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_curve_packing(spark, str(tmp_path)).collect()
    want = {i: ids_of(tokenizer, t) for i, t in rows}
    assert sum(r["length"] for r in got) == sum(map(len, want.values()))
    for r in got:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and r["doc_tokens"] == len(want[r["doc_id"]])


def test_empty_table_extra_columns_and_long_text(spark, documents, tokenizer):
    assert pack_along_curve(documents([])).count() == 0
    text = "lorem ipsum, " * 200_000
    docs = documents([(1, text), (2, "x")]).withColumnRenamed("lang", "key").withColumnRenamed("source", "ids")
    got = {}
    for p in pack_along_curve(docs).orderBy("doc_id", "start").collect():
        got.setdefault(p["doc_id"], []).extend(np.frombuffer(p["ids"], "<u4").tolist())
    assert got == {1: ids_of(tokenizer, text), 2: ids_of(tokenizer, "x")}
