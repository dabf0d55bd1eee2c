"""What rules and terms cost a text, counted in steps."""

import numpy as np

from siftline.operators import rulepass
from siftline.operators.cases import match_case_keys
from siftline.operators.matcher import TermIndex
from siftline.operators.patterns import Pattern
from siftline.operators.rulepass import RuleIndex, Rules


def test_windows_of_all_words_are_found_at_once(monkeypatch):
    calls = []
    one = rulepass._Windows.bits
    monkeypatch.setattr(rulepass._Windows, "bits", lambda self, *a: calls.append(a) or one(self, *a))
    words = [f"w{i:03d}x" for i in range(200)]
    patterns = tuple(
        Pattern(f"P{i:03d}", "C", 10.0, None, ("sentence",), False, None, [("term", [a]), ("term", [b])]) for i, (a, b) in enumerate(zip(words, words[1:]))
    )
    text = "none here\n" + "\n".join(" ".join(words[k : k + 5]) for k in range(0, 200, 5))
    hits, _, _ = RuleIndex(Rules(patterns=patterns), "!").apply([text, None, ""], *([[None] * 3] * 3), [False] * 3, *([[None] * 3] * 2))
    # neighbours stand in one line unless the first ends a line
    assert [(h[0], h[4], h[5]) for h in hits[0]] == [(f"P{i:03d}", 1 + i // 5, [words[i], words[i + 1]]) for i in range(199) if i % 5 < 4]
    assert hits[1:] == [[], []] and not calls


def test_terms_of_one_beginning_are_told_apart_by_more_of_it():
    index = TermIndex(f"abcd{i:04d}" for i in range(500))
    assert all(np.diff(c.first).max() == 1 for c in index.classes.values())
    found = index.grouped(["abcd0007 abcd000 abcd0499", "", "xabcd0499abcd0499"])
    assert [(t, index.surfaces[k]) for t, k in zip(found.text.tolist(), found.term.tolist())] == [(0, "abcd0007"), (0, "abcd0499"), (2, "abcd0499")]
    assert found.place.tolist() == [0, 17, 1, 9]


def test_entities_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(i, "NAME", w) for i in range(20) for w in ("Anna", "Berlin", "Q")], "doc_id int, type string, text string")
    keys = spark.createDataFrame([(1, "NAME", "Ann"), (2, "NAME", "Berlin"), (2, "NAME", "Annabel"), (3, "CITY", "Berlin")], "case_id int, type string, key string")
    found = match_case_keys(rows.mapInArrow(counted, rows.schema), keys).collect()
    assert sorted((r.doc_id, r.case_id, r.matched_keys, r.n_keys, r.relation) for r in found) == sorted(
        x for i in range(20) for x in ((i, 1, ["Anna"], 1, "CONTAINS"), (i, 2, ["Anna", "Berlin"], 2, "EQUAL"))
    )
    assert read.value == 60
