import random
import re

from siftline.llm.license_rules import BASE, LICENSES, rules
from siftline.llm.license_scan import REACH, detect, license_scan, op4_license_rules, surviving

SF = "/root/testdata/sf0.001"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def base(text):
    w = words(text)
    at = [(i, label) for label, _, phrase in BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def labels(docs):
    return {r["doc_id"]: r["labels"] for r in license_scan(docs).collect()}


def test_base_columns_equal_brute_force(spark, documents):
    rng = random.Random(4)
    bag = ["CC", "by", "general", "Public", "license", "all", "rights", "reserved", "é", "x", "cc-by", "GNU", "(all", "3.0"]
    rows = [(i, rng.choice([" ", "\n", ", "]).join(rng.choice(bag) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "cc"), (903, "x " * 50_000 + "cc by"), (904, rows[5][1]), (905, rows[5][1])]
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in license_scan(documents(rows)).collect()}
    assert got == {i: base(t) for i, t in rows}


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op4_license_rules(spark, SF).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got} == {i: base(t) for i, t in docs.items()}
    for r in got:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_labels_priority_and_containment(spark, documents):
    got = labels(documents([
        (1, "Licensed under CC BY-NC 4.0."), (2, "Released under the MIT License."), (3, "Licensed under the Apache License, Version 2.0."),
        (4, "This work is licensed under the GNU General Public License, version 3."), (5, "All rights reserved."),
        (6, "SPDX-License-Identifier: MIT"), (7, "the mitigation of a license"), (8, "under the terms of the GNU Lesser General Public License 2.1"),
    ]))
    assert got == {1: "cc-by,cc-by-nc-4.0", 2: "mit", 3: "apache-2.0", 4: "gpl,gpl-3.0", 5: "reserved", 6: "mit", 7: "", 8: "gpl,lgpl-2.1"}


def test_gate_and_pieces_lose_nothing(spark, documents):
    rng = random.Random(6)
    phrases = [name.replace("(?: ", " (").split("(")[0] for _, _, name, _ in LICENSES if name[0].isalpha()]
    rows = []
    for i in range(200):
        parts = [f"w{rng.randrange(9)}"] * rng.randint(0, 90)
        for _ in range(rng.randint(0, 4)):
            parts.insert(rng.randrange(len(parts) + 1), "licensed under the " + rng.choice(phrases) + rng.choice(["", " 2 0", " license"]))
        rows.append((i, " ".join(parts)))
    everything = set(range(len({r.gate for r in rules()})))
    want = {i: sorted((r.order, a, b - 1) for r, a, b in surviving(detect(words(t), everything))) for i, t in rows}
    got = {r["doc_id"]: sorted((d["rule"], d["first_word"], d["last_word"]) for d in r["detections"]) for r in license_scan(documents(rows)).collect()}
    assert got == want and any(want.values())


def sample(rng, parsed):
    """A random text that a parsed pattern matches."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "SUBPATTERN":
            out += sample(rng, arg[3])
        elif name == "BRANCH":
            out += sample(rng, rng.choice(arg[1]))
        elif name == "MAX_REPEAT":
            out += "".join(sample(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], 2))))
        elif name == "IN":
            kind, value = rng.choice(arg)
            out += chr(value) if str(kind) == "LITERAL" else "7"
        else:
            raise AssertionError(name)
    return out


def test_every_match_holds_its_gate_and_is_short():
    rng = random.Random(1)
    assert len(rules()) > 300
    for rule in rules():
        for _ in range(40):
            text = sample(rng, re._parser.parse(rule.pattern)).split()
            assert rule.gate in text and len(text) < REACH, (rule, text)


def test_empty_table_and_clashing_columns(spark, documents):
    assert license_scan(documents([])).count() == 0
    docs = documents([(1, "cc by")]).withColumnRenamed("lang", "labels").withColumnRenamed("source", "score")
    assert [r["base_labels"] for r in license_scan(docs).collect()] == ["cc-by"]
