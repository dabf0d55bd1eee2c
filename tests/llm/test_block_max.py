import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from siftline.llm import block_max
from siftline.llm.arrays import blocks
from siftline.llm.block_max import Heaps, Statistics, build_index, decoded, encoded, search, search_shard, shard_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            n = sum(c.values())
            score = 0
            for t in set(terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // length)))
            if score > 0:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def corpus(n, seed=11):
    rng = random.Random(seed)
    bag = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(4000)] + ["Über", "É", "the", "THE"] * 200
    docs = [(i, " ".join(rng.choice(bag) for _ in range(rng.randint(1, 120)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "..."), (n + 3, docs[0][1]), (n + 4, docs[0][1]), (n + 4, docs[0][1])]
    items = [(100 + i, " ".join(docs[rng.randrange(n)][1].split()[:25]) + " the") for i in range(12)]
    items += [(1, None), (2, "..."), (3, "nowhere"), (4, "the the THE"), (5, docs[0][1])]
    return docs, items


def rows(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_against_brute_force(spark, documents):
    docs, items = corpus(400)
    index = build_index(documents(docs), shard_bytes=3000)
    assert index.select("shard").distinct().count() > 20
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows(search(index, asked)) == brute(docs, items)
    # items in several blocks, and fewer or more results
    assert rows(search(index, asked, k=3, item_bytes=200)) == brute(docs, items, 3)
    assert rows(search(index, asked, k=1000)) == brute(docs, items, 1000)


def test_blocks_are_skipped_and_results_whole():
    docs, items = corpus(4000)
    docs = [d for d in docs if d[0] <= 4000]
    column, ids = pa.array([t for _, t in docs], pa.string()), pa.array([i for i, _ in docs], pa.int64())
    (block,) = blocks(column, 1 << 30)
    table = pa.Table.from_batches(list(shard_rows(block, ids, 0)))
    sums = table.slice(0, 1)
    statistics = Statistics(sums.column("df")[0].as_py(), sums.column("occurrences")[0].as_py())
    df = dict(zip(table.column("term").to_pylist(), table.column("df").to_pylist(), strict=True))
    there = sum(-(-df[t] // block_max.BLOCK) for _, text in items for t in set(terms(text)) if t in df)
    opened = {}
    for k in (1, 10):
        want, opened[k] = brute(docs, items, k), 0
        for item, text in items:
            asked = [(t, statistics.weight(df[t])) for t in dict.fromkeys(terms(text)) if t in df]
            heaps = Heaps(1, k)
            opened[k] += search_shard(table, [asked], statistics, heaps)
            found = zip(*(x.tolist() for x in heaps.best[0]), strict=True)
            assert [(item, r, i, s) for r, (i, s) in enumerate(found, 1)] == [w for w in want if w[0] == item]
    assert opened[1] < 0.6 * there and opened[1] < opened[10] < there


def test_block_maxima_are_exact():
    docs, _ = corpus(600)
    (block,) = blocks(pa.array([t for _, t in docs], pa.string()), 1 << 30)
    table = pa.Table.from_batches(list(shard_rows(block, pa.array(range(len(docs)), pa.int64()), 0)))
    n = np.array([len(terms(t)) for _, t in docs])
    for row in table.slice(1).to_pylist():
        p = block_max.Postings(row["df"], row["blocks"], row["peaks"], row["postings"], n, Statistics(len(docs), int(n.sum())))
        doc, part = p.all()
        assert doc.tolist() == [i for i, (_, t) in enumerate(docs) if row["term"] in terms(t)]
        assert p.peak.tolist() == [int(part[b : b + block_max.BLOCK].max()) for b in range(0, len(part), block_max.BLOCK)]


def test_codec():
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 28) - 1, 1 << 28, (1 << 31) - 1])
    assert decoded(encoded(values)[0]).tolist() == values.tolist()
    assert len(decoded(encoded(values[:0])[0])) == 0


def test_empty_tables_null_ids_and_extra_columns(spark, documents):
    asked = spark.createDataFrame([(1, "a", 5), (None, "a", 5)], "item_id long, text string, score long")
    assert search(build_index(documents([])), asked).count() == 0
    docs = documents([(None, "a b"), (7, "a b"), (8, "c")]).withColumnRenamed("lang", "term").withColumnRenamed("source", "shard")
    assert [(r["item_id"], r["doc_id"]) for r in search(build_index(docs), asked).collect()] == [(1, 7)]
    assert search(build_index(docs), asked.filter("false")).count() == 0


def test_very_long_text(spark, documents):
    docs = [(1, "a b " * 400_000), (2, " ".join(f"w{i}" for i in range(200_000))), (3, "a w5")]
    items = [(1, "a w5 w199999")]
    assert rows(search(build_index(documents(docs), shard_bytes=1 << 16), spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)
