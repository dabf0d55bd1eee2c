import random
import re

import numpy as np

from siftline.llm.cgk import benchmark_matches, decontaminated, edit_distances, op3_cgk_lsh

SF = "/root/testdata/sf0.001"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def best(item, text):
    row = [0] * (len(text) + 1)
    for w in item:
        new = [row[0] + 1]
        for j, x in enumerate(text):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (w != x)))
        row = new
    return min(row)


def benchmark(spark, items):
    return spark.createDataFrame(list(items), "item_id long, text string")


def edited(rng, item, k):
    out = list(item)
    for _ in range(k):
        p = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[p : p + (kind != 0)] = [] if kind == 2 else [f"new{rng.randrange(10**6)}"]
    return out


def test_finds_copies_and_edits_and_leaves_clean_texts(spark, documents):
    rng = random.Random(8)
    bag = ["the", "of", "and"] * 30 + [f"w{k}" for k in range(500)]
    items = {100 + i: [rng.choice(bag) for _ in range(rng.randint(12, 50))] for i in range(60)}
    rows, want = [], {}
    for i in range(400):
        body = [rng.choice(bag) for _ in range(rng.randint(30, 200))]
        if i % 2:
            item = rng.choice(list(items))
            k = 0 if i % 4 == 1 else max(1, len(items[item]) // 10)
            at = rng.randrange(len(body))
            body[at:at] = edited(rng, items[item], k)
            want[i] = (item, k)
        rows.append((i, " ".join(body).replace("w1 ", "W1, ")))
    bench = benchmark(spark, ((i, " ".join(w)) for i, w in items.items()))
    got = {(r["doc_id"], r["item_id"]): r for r in benchmark_matches(documents(rows), bench, items_at_once=25).collect()}
    texts = dict(rows)
    for (i, item), r in got.items():
        assert r["distance"] == best(items[item], words(texts[i])) <= len(items[item]) // 5 and r["item_words"] == len(items[item])
    assert all((i, item) in got for i, (item, k) in want.items() if k == 0)
    near = [(i, item) for i, (item, k) in want.items() if k]
    assert np.mean([x in got for x in near]) >= 0.95
    brute = {(i, item) for i in range(0, 60) for item in items if best(items[item], words(texts[i])) <= len(items[item]) // 5}
    assert {x for x in got if x[0] < 60} <= brute and len(brute & set(got)) >= 0.9 * len(brute)
    clean = {r["doc_id"] for r in decontaminated(documents(rows), bench, items_at_once=25).collect()}
    assert clean == set(texts) - {i for i, _ in got}


def test_verbatim_items_of_the_given_table_are_found(spark):
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    verbatim = {(d, b) for d, t in docs.items() for b, item in bench.items() if item in t and len(words(item)) >= 5}
    got = {(r["doc_id"], r["item_id"]) for r in op3_cgk_lsh(spark, SF).collect()}
    assert verbatim and verbatim <= got


def test_edge_cases(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, "x a b c d e f"), (4, "A,b;C d-e F end " * 5000)])
    docs = docs.withColumnRenamed("lang", "item_id").withColumnRenamed("source", "distance")
    bench = benchmark(spark, [(1, None), (2, ""), (3, "a z"), (4, "a b c d e f")])
    got = sorted((r["doc_id"] or 0, r["item_id"], r["distance"]) for r in benchmark_matches(docs, bench).collect())
    assert got == [(0, 4, 0), (3, 4, 0), (3, 4, 0), (4, 4, 0)]
    out = decontaminated(docs, bench)
    assert out.schema == docs.schema and sorted(r["doc_id"] for r in out.collect()) == [1, 2]
    assert benchmark_matches(documents([]), bench).count() == 0
    assert benchmark_matches(docs, benchmark(spark, [])).count() == 0


def test_edit_distance():
    item = np.array([1, 2, 3, 4], np.uint64)
    texts = np.array([[9, 1, 2, 3, 4, 9], [9, 1, 3, 4, 9, 9], [0, 0, 0, 0, 0, 0]], np.uint64)
    assert edit_distances(item, texts).tolist() == [0, 1, 4]


def test_all_matches_up_to_a_fifth_of_edits_are_found(spark, documents):
    rng = random.Random(12)
    items = {i: [f"w{rng.randrange(3000)}" for _ in range(m)] for i, m in enumerate([5, 9, 15, 20, 38, 58, 90, 150] * 6)}
    rows, at = [], {}
    for n, share in enumerate([0, 0.15, 0.2] * len(items)):
        item = n // 3
        body = [f"w{rng.randrange(3000)}" for _ in range(60)]
        body[30:30] = edited(rng, items[item], int(len(items[item]) * share))
        rows.append((n, " ".join(body)))
        at[n] = (item, 30 if share == 0 else None)
    bench = benchmark(spark, ((i, " ".join(w)) for i, w in items.items()))
    got = {(r["doc_id"], r["item_id"]): r for r in benchmark_matches(documents(rows), bench).collect()}
    want = {(n, item): best(items[item], words(text)) for n, text in rows for item in (at[n][0], (at[n][0] + 1) % len(items))}
    want = {x: d for x, d in want.items() if d <= len(items[x[1]]) // 5}
    assert {n for n, _ in want} == set(at) and want.keys() <= got.keys()
    assert all(got[x]["distance"] == d for x, d in want.items())
    assert all(got[n, item]["first_word"] == place for n, (item, place) in at.items() if place is not None)


def test_short_items_are_found_verbatim(spark, documents):
    rng = random.Random(15)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    items = {i: [rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(i % 4 + 1)] for i in range(20)}
    got = {(r["doc_id"], r["item_id"], r["first_word"], r["distance"]) for r in benchmark_matches(documents(rows), benchmark(spark, ((i, " ".join(w)) for i, w in items.items()))).collect()}
    want = set()
    for d, text in rows:
        have = text.split()
        for i, item in items.items():
            places = [k for k in range(len(have)) if have[k : k + len(item)] == item]
            if places:
                want.add((d, i, places[0], 0))
    assert got == want
