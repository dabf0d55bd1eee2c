import hashlib
import random
import re

import pytest

from siftline.llm.debruijn import op2_debruijn, repeated_paths, word_repeat_report

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=50):
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(rng, n, vocabulary):
    words = [f"é{k}" for k in range(vocabulary)]
    passages = [[rng.choice(words) for _ in range(rng.randint(40, 300))] for _ in range(10)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            lo = rng.randint(0, len(p) // 2)
            parts += p[lo : lo + rng.randint(10, 300)] + [rng.choice(words) for _ in range(rng.randint(0, 30))]
        rows.append((i, rng.choice(["  ", "\n", " "]).join(parts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("vocabulary", [2, 3000])
def test_equals_brute_force(spark, documents, vocabulary):
    rows = corpus(random.Random(vocabulary), 90, vocabulary)
    rows += [(500, None), (501, ""), (502, "a " * 49), (503, "a " * 300), (504, "a " * 70), (505, rows[0][1]), (506, rows[0][1])]
    assert sorted(tuple(r) for r in word_repeat_report(documents(rows)).collect()) == brute(rows)


def test_whole_table_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op2_debruijn(spark, SF).collect()) == brute(rows)


def test_a_repeated_passage_is_one_path(spark, documents):
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(400)]
    own = lambda: [f"q{rng.randrange(10**9)}" for _ in range(80)]
    rows = [(i, " ".join(own() + passage + own())) for i in range(5)]
    paths = repeated_paths(documents(rows)).collect()
    assert {r["copies"] for r in paths} == {5} and max(r["n_words"] for r in paths) > 300
    assert {r["n_removed"] for r in word_repeat_report(documents(rows)).filter("doc_id > 0").collect()} == {400}


def test_ties_nulls_and_empty_table(spark, documents):
    text = " ".join(f"w{k}" for k in range(60))
    docs = documents([(1, text), (1, text), (None, text), (2, text)]).withColumnRenamed("lang", "start").withColumnRenamed("source", "first")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in word_repeat_report(docs).collect()) == [(0, 0), (1, 0), (1, 0), (2, 60)]
    assert word_repeat_report(documents([])).count() == 0


def test_words_that_polynomial_hashes_confuse(spark, documents):
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    words = [f"w{k}" for k in range(61)]
    rows = [(i, " ".join(words[:31] + [odd] + words[31:60])) for i, odd in ((1, one), (2, two))]
    assert [r["n_removed"] for r in word_repeat_report(documents(rows)).orderBy("doc_id").collect()] == [0, 0]
