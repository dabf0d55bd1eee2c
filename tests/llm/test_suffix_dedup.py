import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm import suffix_dedup
from siftline.llm.arrays import Prefix, byte_values
from siftline.llm.frames import whole_groups
from siftline.llm.suffix_dedup import drop_repeats, op8_suffix_sort, repeat_report
from siftline.llm.suffixes import sorted_suffixes

SF = "/root/testdata/sf0.001"


def brute(rows, window=50):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        for p in range(len(t) - window + 1):
            first[t[p : p + window]] = min(i, first.get(t[p : p + window], i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if first[t[p : p + window]] < i:
                gone[p : p + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(docs, **options):
    return sorted(tuple(r) for r in repeat_report(docs, **options).collect())


def corpus(rng, n, alphabet):
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randint(30, 400))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            lo = rng.randint(0, len(p) // 2)
            parts.append(p[lo : lo + rng.randint(10, 400)])
            parts.append("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))))
        rows.append((i, "".join(parts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnopqrstuvwxyz é\n"])
def test_equals_brute_force(spark, documents, alphabet):
    rows = corpus(random.Random(len(alphabet)), 120, alphabet)
    rows += [(500, None), (501, ""), (502, "a" * 49), (503, "a" * 300), (504, "a" * 70), (505, rows[0][1]), (506, rows[0][1])]
    assert found(documents(rows)) == brute(rows)
    assert found(documents(rows), wide=1) == brute(rows)


def test_an_anchor_with_many_surroundings(spark, documents):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    own = lambda: "".join(rng.choice("ijklmnop ") for _ in range(60))
    rows = [(i, own() + passage + own()) for i in range(150)]
    assert found(documents(rows)) == brute(rows)


def test_whole_table_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op8_suffix_sort(spark, SF).collect()) == brute(rows)


def test_ties_nulls_and_empty_table(spark, documents):
    text = "0123456789" * 8
    docs = documents([(1, text), (1, text), (None, text), (2, text)]).withColumnRenamed("lang", "version").withColumnRenamed("source", "number")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in repeat_report(docs).collect()) == [(0, 0), (1, 0), (1, 0), (2, 80)]
    assert repeat_report(documents([])).count() == 0


def test_texts_stay_valid_and_columns_pass(spark, documents):
    text = "ä" * 25 + "".join(chr(0x100 + k) for k in range(60))
    docs = documents([(1, text), (2, "x" + text[3:50] + "y"), (3, None), (4, "short")]).withColumnRenamed("lang", "found")
    out = drop_repeats(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: text, 2: "xy", 3: None, 4: "short"}


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    start, bucket = np.arange(3000), rng.integers(0, 5, 3000).astype(np.uint64)
    order, common = sorted_suffixes(Prefix(byte_values(data)), data, start, 40, bucket)
    keys = [(int(bucket[i]), data[start[i] : start[i] + 40].tobytes()) for i in order]
    assert keys == sorted(keys)
    for n in range(1, 3000):
        a, b = keys[n - 1], keys[n]
        same = next((k for k in range(40) if a[1][k] != b[1][k]), 40) if a[0] == b[0] else 0
        assert same == common[n]


def test_a_task_takes_some_anchors_at_a_time_and_each_whole():
    anchor = np.sort(np.random.default_rng(5).integers(-40, 40, 3_000))
    batch = pa.RecordBatch.from_pydict({"anchor": pa.array(anchor, pa.int64()), "nth": pa.array(np.arange(3_000))})
    parts = list(whole_groups(iter([batch.slice(at, 70) for at in range(0, 3_000, 70)]), "anchor", 2_000))
    assert len(parts) > 10 and max(p.nbytes for p in parts) < 6_000
    assert [x for p in parts for x in p.column("nth").to_pylist()] == list(range(3_000))
    held = [set(p.column("anchor").to_pylist()) for p in parts]
    assert all(a.isdisjoint(b) for a, b in zip(held, held[1:]))
    # one group larger than that stays in one piece
    same = batch.set_column(0, "anchor", pa.array(np.zeros(3_000, np.int64)))
    assert [p.num_rows for p in whole_groups(iter([same.slice(at, 70) for at in range(0, 3_000, 70)]), "anchor", 2_000)] == [3_000]
    assert list(whole_groups(iter([batch.slice(0, 0)]), "anchor", 10)) == []


def test_a_short_string_in_many_documents_leaves_nothing_open(spark, documents, monkeypatch):
    rng = random.Random(6)
    own = lambda: "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows = [(i, own() + "thirty bytes that all of these" + own()) for i in range(100)]
    kept, seen = suffix_dedup.stored, {}
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, label, *size: seen.setdefault(label, kept(df, label, *size)))
    assert found(documents(rows)) == brute(rows)
    assert seen["contexts"].count() == 0


def test_windows_of_wide_anchors_hold_a_shared_side(spark, documents, monkeypatch):
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(120))
    own = lambda: "".join(rng.choice("ijklmnop ") for _ in range(60))
    rows = [(i, own() + passage[: rng.randint(60, 120)] + own()) for i in range(60)] + [(100 + i, own() + passage[rng.randint(0, 60) :] + own()) for i in range(60)]
    kept, seen = suffix_dedup.stored, {}
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, label, *size: seen.setdefault(label, kept(df, label, *size)))
    assert found(documents(rows), wide=1) == brute(rows)
    half = (suffix_dedup.WINDOW - suffix_dedup.ANCHOR) // 2
    of_one_side = seen["routes"].filter("open AND sides < 3").select("doc_id", "version", "number")
    each = seen["contexts"].join(of_one_side, ["doc_id", "version", "number"]).groupBy("doc_id", "version", "number").count().collect()
    assert each and max(r["count"] for r in each) <= half + 1


def test_buckets_of_anchors_are_even(spark, documents):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(4000)), 0) for i in range(40)]
    lots = suffix_dedup.segment_lots(spark.createDataFrame(rows, "doc_id long, text string, version int"), 50, 24, 16)
    sizes = [r["n"] for r in lots.selectExpr("bucket", "octet_length(data) n").groupBy("bucket").sum("n").withColumnRenamed("sum(n)", "n").collect()]
    assert len(sizes) == 16 and max(sizes) < 1.5 * min(sizes)
