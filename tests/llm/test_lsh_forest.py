import random
import re

from siftline.llm.lsh_forest import near_duplicates


def shingles(text, size):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if len(words) >= size else frozenset([tuple(words)])


def brute(rows, size, per_cent=80):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(rng, groups, copies, length):
    rows = []
    for g in range(groups):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(8, length))]
        for _ in range(rng.randint(1, copies)):
            mine = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                mine[rng.randrange(len(mine))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(mine))
    rng.shuffle(rows)
    return rows


def result(docs, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, **options).collect()}


def test_components_equal_brute_force(spark, documents):
    rng = random.Random(11)
    texts = corpus(rng, 40, 9, 160) + corpus(rng, 2, 120, 200)
    texts += ["", None, "one", "One", "a b", "a  b", "a b c d", "A b c D", "x y z u v"]
    rows = list(enumerate(texts))
    assert result(documents(rows), shingle=4) == brute(rows, 4)


def test_shared_passage_does_not_link(spark, documents):
    rng = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(80))) for i in range(300)]
    got = result(documents(rows), shingle=4)
    assert all(kept for _, _, kept in got.values())


def test_ties_nulls_and_empty_table(spark, documents):
    assert near_duplicates(documents([])).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"), (None, None), (9, None)]
    docs = documents(rows).withColumnRenamed("lang", "low").withColumnRenamed("source", "component")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_duplicates(docs, shingle=4).collect())
    assert got == [(-1, None, True), (-1, None, True), (3, 3, True), (5, 3, False), (5, 3, False), (9, 9, True)]


def test_texts_under_one_id_are_linked(spark, documents):
    rows = [(1, "a b c d e"), (7, "a b c d e"), (7, "k l m n o"), (8, "k l m n o")]
    got = [(r["doc_id"], r["component_id"]) for r in near_duplicates(documents(rows)).collect()]
    assert sorted(got) == [(1, 1), (7, 1), (7, 1), (8, 1)]


def test_very_long_text(spark, documents):
    long = " ".join(f"w{k}" for k in range(200_000))
    assert result(documents([(1, long), (2, long + " end"), (3, long[:500])])) == {1: (199_996, 1, True), 2: (199_997, 1, False), 3: (len(long[:500].split()) - 4, 3, True)}


def test_star_whose_centre_has_a_middle_id(spark, documents):
    rng = random.Random(6)
    rows = []
    for star in range(2):
        hub = [f"s{star}w{k}" for k in range(400)]
        rows.append((1000 * star + 50, " ".join(hub)))
        for i in range(100):
            mine = list(hub)
            for at in rng.sample(range(0, 400, 4), 10):
                mine[at + 1] = f"x{rng.randrange(10**9)}"
            rows.append((1000 * star + (i if i < 50 else i + 1), " ".join(mine)))
    want = brute(rows, 4)
    assert {c for _, c, _ in want.values()} == {0, 1000}
    assert result(documents(rows), shingle=4) == want


def near_copies(n, words=300, edits=12, seed=4):
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    rows = []
    for _ in range(n):
        mine = list(base)
        for at in rng.sample(range(words), edits):
            mine[at] = f"x{rng.randrange(10**9)}"
        rows.append(" ".join(mine))
    return list(enumerate(rows))


def placed_alone(spark, documents, rows, shingle=4):
    """Classes as the regions get them, each a component of its own."""
    from pyspark.sql import functions as F

    from siftline.llm.frames import keyed_texts
    from siftline.llm.lsh_forest import set_table, signature_table

    docs = keyed_texts(documents(rows), "text", "doc_id")
    placed = signature_table(docs, shingle).withColumnRenamed("doc_id", "rep").withColumn("component", F.col("rep")).cache()
    return placed, lambda wanted: set_table(docs.withColumnRenamed("doc_id", "rep").join(wanted.distinct(), "rep", "left_semi"), shingle)


def test_regions_alone_find_every_link(spark, documents, monkeypatch):
    from siftline.llm import lsh_forest
    from siftline.llm.components import components

    rng = random.Random(8)
    rows = list(enumerate(corpus(rng, 25, 8, 120) + [t for _, t in near_copies(150, edits=9)]))
    want = {i: c for i, (_, c, _) in brute(rows, 4).items()}
    # regions in one cell, and dealt into many cells
    for block in (1 << 12, 16):
        monkeypatch.setattr(lsh_forest, "BLOCK", block)
        placed, sets_of = placed_alone(spark, documents, rows)
        got = {r["node"]: r["component"] for r in components(lsh_forest.still_apart(placed, sets_of, 80)).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_rows_grow_with_members_not_with_pairs(spark, documents):
    from siftline.llm.lsh_forest import cells, joined_components, near_members

    # 2 000 near copies of which many pairs are just under the threshold
    rows = near_copies(2000, words=200, edits=3)
    placed, sets_of = placed_alone(spark, documents, rows)
    from pyspark.sql import functions as F

    members = placed.withColumn("heads", F.concat(*(F.substring("paths", i * 24 + 1, 4) for i in range(16))))
    dealt = cells(members).cache()
    assert dealt.count() <= 2 * 16 * 2000
    near = near_members(dealt.join(members, ["rep", "low", "high"]), 80).cache()
    assert near.count() <= dealt.count()
    links = joined_components(near.join(members, ["rep", "low", "high"]).join(sets_of(near.select("rep")), ["rep", "low", "high"]), 80)
    assert 0 < links.count() <= near.count()


def test_words_that_polynomial_hashes_confuse(spark, documents):
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    assert result(documents([(1, one), (2, two)])) == {1: (1, 1, True), 2: (1, 2, True)}
