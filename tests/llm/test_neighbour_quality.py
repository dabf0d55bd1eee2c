import random
import zlib

import numpy as np
import pyarrow as pa

from siftline.llm.arrays import blocks
from siftline.llm.frames import held_out
from siftline.llm.neighbour_quality import NEIGHBOURS, PRIOR, SHARPNESS, Neighbours, counts, op7_neighbour_quality, quality_scores, unit, weighted

SF = "/root/testdata/sf0.01"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in op7_neighbour_quality(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [i for i in known if got[i]["held_out"]]
    low = [got[i]["score"] for i in held if not known[i]]
    high = [got[i]["score"] for i in held if known[i]]
    assert np.mean([a < b for a in low for b in high]) > 0.95
    assert np.mean([got[i]["predicted"] == known[i] for i in held]) > 0.92


def test_votes_equal_brute_force():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a#", "B!", "cc", "d | e", "f\n"]) for _ in range(rng.randint(1, 80))) for _ in range(120)]
    raw = np.concatenate([counts(b) for b in blocks(pa.array(texts), texts=7)])
    assert np.array_equal(raw, np.concatenate([counts(b) for b in blocks(pa.array(texts))]))
    y = np.array([i % 2 for i in range(80)])
    model = Neighbours.fit(raw[:80], y, np.ones(raw.shape[1], np.float32))
    z = unit(weighted(raw, model.idf) @ model.directions)
    for i, score in enumerate(model.score(raw)):
        cosines = sorted(((float(z[i] @ v), int(label)) for v, label in zip(model.vectors, y)), reverse=True)[:NEIGHBOURS]
        w = [max(c, 0) ** SHARPNESS for c, _ in cosines]
        want = (sum(a * label for a, (_, label) in zip(w, cosines)) + PRIOR * y.mean()) / (sum(w) + PRIOR)
        assert abs(score - want) < 1e-3


def test_held_out_labels_are_not_learnt(spark, documents):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["x#", "y", "Z"]) for _ in range(40))) for i in range(60)]
    marks = [(i, i % 2, 0) for i in range(60)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in marks]
    one, two = (
        sorted(tuple(r) for r in quality_scores(documents(rows), labels(spark, m), hold_out=held_out(0)).collect()) for m in (marks, flipped)
    )
    assert one == two


def test_edge_cases(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a"), (4, "w " * 300_000)]).withColumnRenamed("lang", "score").withColumnRenamed("source", "held_out")
    marks = labels(spark, [(3, 1, None), (2, 0, 0), (None, 1, 0), (4, None, 0), (99, 1, 1), (3, 1, 0)])
    got = sorted((r["doc_id"] or 0, r["held_out"], r["score"]) for r in quality_scores(docs, marks).collect())
    assert [g[0] for g in got] == [0, 1, 2, 3, 3, 4] and got[3] == got[4] and got[3][2] > 0.5
    assert {r["score"] for r in quality_scores(docs, labels(spark, [])).collect()} == {0.5}
    assert quality_scores(documents([]), marks).count() == 0
