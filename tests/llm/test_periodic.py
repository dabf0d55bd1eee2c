import hashlib
import random
import re
import zlib

from siftline.llm.periodic import op13_periodic_runs, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """Runs by comparing every word with the one q before it, for every q."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i - q, j), q)
            i = max(j, i) + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def texts():
    rng = random.Random(13)
    out = [None, "", " \n", "a", "a " * 11, "a " * 12, "a b " * 6, "é " * 40 + "b " + "é " * 40, "a\tb\nc " * 30]
    for letters in (2, 3, 5):
        for _ in range(40):
            out.append(" ".join(rng.choice("abcdefgh"[:letters]) for _ in range(rng.randint(1, 90))))
    for _ in range(40):
        words = [rng.choice("abc") + str(rng.randrange(4)) for _ in range(rng.randint(5, 60))]
        lag = rng.randint(1, len(words))
        for _ in range(rng.randint(30, 200)):
            words.append(words[-lag] if rng.random() < 0.99 else "x")
        out.append(" ".join(words))
    # words by the Thue-Morse sequence hold no run of three copies, and defeat polynomial hashes
    out.append(" ".join("ab"[bin(i).count("1") & 1] for i in range(256)))
    return out


def test_against_brute_force(spark, documents):
    rows = list(enumerate(texts() + texts()[-3:]))
    got = {r["doc_id"]: r for r in periodic_runs(documents(rows)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        words = WORD.findall(text or "")
        runs = brute(words)
        assert [tuple(r) for r in got[i]["runs"]] == runs, text
        assert got[i]["n_words"] == len(words) and got[i]["collapsed"] == collapsed(words, runs)


def test_words_that_polynomial_hashes_confuse(spark, documents):
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    row = periodic_runs(documents([(1, f"{one} {two} " * 6)])).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 12, 2)]


def test_query(spark, documents, tmp_path):
    rows = list(enumerate(texts() * 3))
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        words = periodic(i, text)
        runs = brute(words)
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        assert got[i] == {
            "doc_id": i, "n_runs": len(runs), "start": s, "length": length, "period": q, "exponent_milli": 1000 * length // q if q else None,
            "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(collapsed(words, runs).encode()).hexdigest(),
        }


def test_empty_table_extra_columns_and_null_id(spark, documents):
    assert periodic_runs(documents([])).count() == 0
    docs = documents([(None, "a b " * 10), (1, "x"), (1, "x")]).withColumnRenamed("lang", "runs").withColumnRenamed("source", "collapsed")
    assert sorted((len(r["runs"]), r["collapsed"]) for r in periodic_runs(docs).collect()) == [(0, "x"), (0, "x"), (1, "a b")]


def test_very_long_texts(spark, documents):
    long = " ".join(f"w{k % 70_000}" for k in range(300_000))
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic_runs(documents([(1, "a " * 300_000), (2, long)])).collect()}
    assert got == {1: [(0, 300_000, 1)], 2: [(0, 300_000, 70_000)]}
