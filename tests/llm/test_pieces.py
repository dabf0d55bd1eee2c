import random

import numpy as np
import pytest
import sentencepiece

from siftline.llm.pieces import BYTE_PENALTY, MODEL, SPACE, Automaton, Vocabulary, decode_pieces, encode_pieces, op9_piece_viterbi

SF = "/root/testdata/sf0.001"


def brute(vocabulary, text):
    """Plain Viterbi over the whole text: best score, the longer last piece on ties."""
    if not text:
        return []
    data = bytes([SPACE]) + text.encode().replace(b" ", bytes([SPACE]))
    pieces = {p: (i, s) for p, i, s in vocabulary.pieces}
    longest = max(map(len, pieces))
    low = min(s for _, _, s in vocabulary.pieces) - BYTE_PENALTY
    best, back = [0.0] + [None] * len(data), [None] * (len(data) + 1)
    for end in range(1, len(data) + 1):
        found = None
        for size in range(min(longest, end), 0, -1):
            piece = data[end - size : end]
            if piece in pieces and (found is None or best[end - size] + pieces[piece][1] > found[0]):
                found = (best[end - size] + pieces[piece][1], size, pieces[piece][0])
        single = best[end - 1] + low
        if found is None or single > found[0]:
            found = (single, 1, vocabulary.byte_ids[data[end - 1]])
        best[end], back[end] = found[0], found[1:]
    out, at = [], len(data)
    while at:
        out.append(back[at][1])
        at -= back[at][0]
    return out[::-1]


TEXTS = ["", " ", "  two  spaces ", "Hello world", "naïve café ☃ \U0001f600", "a\tb\nc\r\n", "▁mark ▁▁", "\x00\x01", "日本語テキスト", "x" * 700, "aaaa bbbb " * 400]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read(MODEL)


def test_ids_equal_brute_force(spark, documents, vocabulary):
    rng = random.Random(2)
    bag = ["the", "ing", " ", "  ", "é", "Zw", "\n", "ß", "1", "▁", "qu", "中"]
    rows = list(enumerate(TEXTS + ["".join(rng.choice(bag) for _ in range(rng.randint(0, 60))) for _ in range(120)]))
    got = {r["doc_id"]: r for r in encode_pieces(documents(rows)).collect()}
    assert {i: r["ids"] for i, r in got.items()} == {i: brute(vocabulary, t) for i, t in rows}
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got.values())
    decoded = {r["doc_id"]: r["text"] for r in decode_pieces(encode_pieces(documents(rows))).collect()}
    assert decoded == dict(rows)


def test_toy_vocabulary_scores_decide():
    space = bytes([SPACE])
    pieces = [(space, 256, -1.0), (b"a", 257, -1.0), (b"b", 258, -1.0), (b"ab", 259, -2.0), (b"bab", 260, -1.5), (space + b"a", 261, -3.0), (b"abab", 262, -9.0)]
    vocabulary = Vocabulary(pieces, list(range(256)))
    automaton = Automaton(vocabulary)
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 12)))
        data = space + text.encode().replace(b" ", space)
        ids, count = automaton.encode([data])
        assert ids.tolist() == brute(vocabulary, text) and count.tolist() == [len(ids)]
        plain, bounds = automaton.decode(ids, np.array([len(ids)]))
        assert plain.tobytes().decode() == text and bounds.tolist() == [0, len(plain)]


def test_library_decodes_the_ids(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op9_piece_viterbi(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["round_trip"] and r["n_bytes"] == len(docs[r["doc_id"]].encode())
        assert model.decode(r["ids"]) == docs[r["doc_id"]]


def test_edge_cases(spark, documents):
    docs = documents([(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b")]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "n_tokens")
    encoded = encode_pieces(docs)
    got = sorted(((r["doc_id"] or 0, r["n_tokens"], r["ids"]) for r in encoded.collect()), key=str)
    assert got[0][1:] == got[3][1:] == got[4][1:] and got[1] == (1, 0, None) and got[2] == (2, 0, [])
    assert sorted(str(r["text"]) for r in decode_pieces(encoded).collect()) == ["", "None", "a b", "a b", "a b"]
    assert encode_pieces(documents([])).count() == 0


def test_long_unbroken_texts(spark, documents, vocabulary):
    import time

    rng = random.Random(5)
    rows = [(1, "a" * 30_000), (2, "".join(rng.choice(["ing", "the", "e", "zq"]) for _ in range(3000))), (3, "日本" * 2000)]
    got = {r["doc_id"]: r for r in encode_pieces(documents(rows)).collect()}
    for i, text in rows:
        assert got[i]["ids"] == brute(vocabulary, text) and got[i]["round_trip"]
    begin = time.time()
    (row,) = encode_pieces(documents([(1, "a" * 1_000_000)])).collect()
    assert row["round_trip"] and time.time() - begin < 60


def test_words_that_polynomial_hashes_confuse(spark, documents):
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{one} {two}"), (2, two), (3, one)]
    assert all(r["round_trip"] for r in encode_pieces(documents(rows, 1)).collect())
    back = {r["doc_id"]: r["text"] for r in decode_pieces(encode_pieces(documents(rows, 1))).collect()}
    assert back == dict(rows)
