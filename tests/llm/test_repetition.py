import random
import re
from collections import Counter

from siftline.llm.repetition import MAX_COVERED, MAX_REPEAT, MIN_REPEAT, repetition_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    triples = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    repeated = {k for i in range(n - 2) if triples[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    spanned = {k for i in range(n) if longest[i] >= MIN_REPEAT for k in range(i, i + longest[i])}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
        seen.add(line)
    failed = n < 50 or 100 * len(repeated) > 50 * n
    over = len(spanned) > MAX_COVERED * n or max(longest, default=0) > MAX_REPEAT
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), len(spanned),
        max(longest, default=0), failed, not failed and not over,
    )


def test_against_brute_force(spark, documents):
    rng = random.Random(7)
    texts = [None, "", " \n\t", "one", "a b c a b c", "# | é\n# | é\n", "x\n" * 200]
    for words in (3, 8, 60):
        bag = [rng.choice(["é", "zu", "#", "a|", "die", "of"]) + str(k) for k in range(words)]
        texts += ["".join(rng.choice(bag) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randint(40, 160))) for _ in range(25)]
    texts += [texts[-1], texts[-1]]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: tuple(r)[1:] for r in repetition_rules(documents(rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}
    assert {v[-1] for v in got.values()} == {True, False}


def test_empty_table_and_extra_columns(spark, documents):
    assert repetition_rules(documents([])).count() == 0
    docs = documents([(1, "a b")]).withColumnRenamed("lang", "kept").withColumnRenamed("source", "n_words")
    assert [r["n_words"] for r in repetition_rules(docs).collect()] == [2]


def test_very_long_text_keeps_its_counts(spark, documents):
    text = " ".join(f"w{k}" for k in range(300_000))
    row = repetition_rules(documents([(1, text), (2, text + " " + text)])).orderBy("doc_id").collect()
    assert (row[0]["longest_repeat"], row[0]["kept"]) == (0, True)
    assert (row[1]["longest_repeat"], row[1]["n_repeat_words"], row[1]["kept"]) == (300_000, 600_000, False)


def test_lines_and_words_that_polynomial_hashes_confuse(spark, documents):
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    texts = [f"{one}\n{two}\n{one}", f"x {one} y x {two} y", " ".join(one) + " z " + " ".join(two)]
    got = {r["doc_id"]: r for r in repetition_rules(documents(list(enumerate(texts)))).collect()}
    assert (got[0]["n_dup_lines"], got[1]["n_repeat_words"]) == (1, 0)
    assert got[2]["longest_repeat"] < 2048
    long = next(k for k in range(2047, 0, -1) if any(" ".join(one[i : i + k]) in " ".join(two) or one.find(one[i : i + k], i + 1) >= 0 for i in range(2048 - k + 1)))
    assert got[2]["longest_repeat"] == long
