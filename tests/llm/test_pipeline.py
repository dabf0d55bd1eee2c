import random

import corpus_pipeline
import test_cgk
import test_lsh_forest
import test_pieces
import test_repetition
from siftline.llm.pieces import MODEL, Vocabulary

WINDOW = 50


def cut_repeats(rows):
    texts = {i: t.encode() for i, t in rows}
    first = {}
    for i, t in texts.items():
        for p in range(len(t) - WINDOW + 1):
            first[t[p : p + WINDOW]] = min(i, first.get(t[p : p + WINDOW], i))
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for p in range(len(t) - WINDOW + 1):
            if first[t[p : p + WINDOW]] < i:
                gone[p : p + WINDOW] = b"\1" * WINDOW
        kept, at = "", 0
        for c in t.decode():
            size = len(c.encode())
            kept += "" if all(gone[at : at + size]) else c
            at += size
        out[i] = kept
    return out


def corpus(rng):
    bag = [f"é{k}" for k in range(900)] + ["the", "of"] * 60
    own = lambda n: [rng.choice(bag) for _ in range(n)]
    items = {k: own(rng.randint(12, 30)) for k in range(6)}
    passage, rows = own(80), []
    for i in range(110):
        words = own(rng.randint(52, 150))
        kind = i % 10
        if kind == 1:
            words = words[:30]
        elif kind == 2:
            words = words[:3] * 40
        elif kind == 3 and rows:
            words = rows[rng.randrange(len(rows))][1].split(" ")
        elif kind == 4 and rows:
            words = rows[rng.randrange(len(rows))][1].split(" ")
            words[rng.randrange(len(words))] = "new"
        elif kind == 5:
            words[10:10] = passage
        elif kind == 6:
            words[20:20] = items[rng.randrange(6)]
        rows.append((i, " ".join(words)))
    return rows, items


def test_pipeline_equals_brute_force(spark, documents, tmp_path):
    rows, items = corpus(random.Random(13))
    documents(rows + [(500, None), (501, "")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(i, t) for i, t in rows if test_repetition.brute(t)[-1]]
    near = test_lsh_forest.brute(left, 5)
    left = [(i, t) for i, t in left if near[i][2]]
    cut = cut_repeats(left)
    clean = {i: t for i, t in cut.items() if all(test_cgk.best(w, test_cgk.words(t)) > len(w) // 5 for w in items.values())}
    vocabulary = Vocabulary.read(MODEL)
    want = {i: test_pieces.brute(vocabulary, t) for i, t in clean.items()}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == want
    assert all(r["round_trip"] for r in got) and 20 < len(got) < len(rows) - 40


def test_stages_keep_the_columns_and_take_odd_rows(spark, documents, tmp_path):
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"w{k}" for k in range(60))
    docs = documents([(1, None), (2, ""), (None, long), (3, long), (3, long), (4, long)])
    docs = docs.withColumnRenamed("lang", "kept").withColumnRenamed("source", "version")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0, name
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).orderBy("doc_id").collect()] == [None, 1, 2, 3, 3]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
