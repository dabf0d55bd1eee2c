import random
import re

from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.functions.sql import string_array
from siftline.operators import cases as CS
from siftline.operators import matcher as MT
from siftline.operators import negatives as NG
from siftline.operators import patterns as PT
from siftline.operators import rulepass as RP
from siftline.operators import score as A
from siftline.operators import terms as R
from siftline.plans import packs as K
from siftline.plans import triage as TR

DOCS = "/root/testdata/sf0.001/documents.parquet"


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def pack_rows(pid, groups, windows=None, allow_full=False, base=80.0, cap=None, category="C"):
    return [
        (pid, category, g, i, t, "term", windows, allow_full, base, cap)
        for g, terms in enumerate(groups) for i, t in enumerate(terms)
    ]


def found(spark, docs, rows, **kw):
    hits = PT.match_patterns(docs, spark.createDataFrame(rows, K.PATTERNS_SCHEMA), **kw)
    return {(r.doc_id, r.pattern_id): (r.level, r.window_no, list(r.matched_terms)) for r in hits.collect()}


def test_windows_in_order(spark):
    docs = docs_of(
        spark,
        "red and blue。 other",           # one sentence
        "red。blue",                       # one paragraph
        "red\n\nmid\n\nblue",              # three sentences in a row
        "red\n\na\n\nb\n\nblue",           # further apart
        "nothing",
    )
    got = found(spark, docs, pack_rows("P", [["red"], ["blue", "azure"]]))
    assert got == {
        (0, "P"): ("sentence", 0, ["red", "blue"]), (1, "P"): ("paragraph", 0, ["red", "blue"]), (2, "P"): ("context3", 0, ["red", "blue"]),
    }


def test_full_window_needs_three_groups_and_keeps_the_packs_limit(spark):
    far = "red\n\na\n\nb\n\nblue\n\nc\n\nd\n\ngreen"
    docs = docs_of(spark, far, far + "\n\n" + "x" * 8000)
    whole = ("full", 0, ["red", "blue", "green"])
    rows = pack_rows("P", [["red"], ["blue"], ["green"]])
    assert found(spark, docs, rows) == {(0, "P"): whole, (1, "P"): whole}
    limited = spark.createDataFrame([(*r, 8000) for r in rows], K.PATTERNS_SCHEMA + ", full_limit int")
    assert {(r.doc_id, r.level) for r in PT.match_patterns(docs, limited).collect()} == {(0, "full")}


def test_listed_windows(spark):
    docs = docs_of(spark, "red。blue", "red\n\na\n\nb\n\nblue")
    assert found(spark, docs, pack_rows("P", [["red"], ["blue"]], ["sentence"])) == {}
    assert found(spark, docs, pack_rows("P", [["red"], ["blue"]], ["full"])) == {}
    both = found(spark, docs, pack_rows("P", [["red"], ["blue"]], ["full", "paragraph"], True))
    assert {k: v[0] for k, v in both.items()} == {(0, "P"): "full", (1, "P"): "full"}


def test_dynamic_groups_and_cap(spark):
    rows = [("P", "C", 0, 0, "paid", "term", None, False, 80.0, 35.0), ("P", "C", 1, 0, None, "amount", None, False, 80.0, 35.0),
            ("Q", "C", 0, 0, "paid", "term", None, False, 80.0, None), ("Q", "C", 1, 0, None, "reversal", None, False, 80.0, None),
            ("E", "C", 0, 0, "paid", "term", None, False, 80.0, None), ("E", "C", 1, 0, None, "entity", None, False, 80.0, None),
            ("F", "C", 0, 0, "paid", "term", None, False, 80.0, None), ("F", "C", 1, 0, None, "flag", None, False, 80.0, None)]
    docs = docs_of(spark, "paid 300 today", "paid but closed by acme", "unpaid")
    signals = PT.Signals(reversals=string_array(["closed"]), entities="array('acme')", flag="doc_id = 2")
    got = PT.match_patterns(docs, spark.createDataFrame(rows, K.PATTERNS_SCHEMA), signals=signals).collect()
    assert {(r.doc_id, r.pattern_id, r.score, tuple(r.matched_terms)) for r in got} == {
        (0, "P", 35.0, ("paid", "300")), (1, "Q", 80.0, ("paid", "closed")), (1, "E", 80.0, ("paid", "acme")), (2, "F", 80.0, ("paid",)),
    }


def test_passes_over_slices_give_the_same(spark):
    docs = docs_of(spark, "red and blue", "green or red")
    rows = pack_rows("P1", [["red"], ["blue"]]) + pack_rows("P2", [["red"], ["green"]]) + pack_rows("P3", [["blue"], ["red"]])
    assert found(spark, docs, rows, per_pass=1) == found(spark, docs, rows)


def test_exclusions_count_every_occurrence(spark):
    docs = docs_of(spark, "copy the manual" + " " * 60 + "copy the letter", "copy manual", "no", "manual" + " " * 26 + "copy")
    rules = spark.createDataFrame([("copy", ["manual"], 25, 45)], K.EXCLUSIONS_SCHEMA)
    got = PT.apply_context_exclusions(docs, rules).collect()
    assert {(r.doc_id, r.term, r.total, r.kept) for r in got} == {(0, "copy", 2, 1), (1, "copy", 1, 0), (3, "copy", 1, 1)}
    pack = {"h": [MT.Surface("copy", "copy", "H", "C", ""), MT.Surface("letter", "letter", "M", "C", "")]}
    kept = MT.attach_hits(docs, pack, exclusions=RP.exclusion_rules(rules.collect()))
    assert {r.doc_id: [(h["term"], h["count"]) for h in r.h] for r in kept.collect()} == {0: [("copy", 1), ("letter", 1)], 1: [], 2: [], 3: [("copy", 1)]}


def brute(texts, words):
    return sorted((i, w, t.count(w)) for i, t in texts for w in words if w in t)


def test_all_pack_sizes_agree(spark, monkeypatch):
    docs = spark.read.parquet(DOCS).select("doc_id", F.expr(T.normalize_text("text", True)).alias("norm"))
    texts = [(r.doc_id, r.norm) for r in docs.collect()]
    rng = random.Random(3)
    words = {"the", "ti", "that", "license", "e", "an an", "é"}
    for _, t in texts[:40]:
        for n in (2, 3, 5, 7, 30, 400):
            if len(t) > n:
                at = rng.randrange(len(t) - n)
                words.add(t[at : at + n])
    words = {w for w in words if "…" not in w}
    rows = [(w, "H", "C", None if len(w) % 2 else "") for w in sorted(words)]
    terms = spark.createDataFrame(rows, "term string, ktype string, category string, stage string")
    want = brute(texts, {w for w in words if len(w) > 1})
    whole = sorted(map(tuple, R.match_terms(docs, terms, "norm").collect()))
    assert sorted((r[0], r[1], r[6]) for r in whole) == want
    pack = R.pack_literal(R.resolve_small(terms.collect()))
    in_plan = docs.select("doc_id", F.explode(F.expr(R.hits_sql("norm", pack))).alias("h")).select("doc_id", "h.*")
    assert sorted(map(tuple, in_plan.collect())) == whole
    monkeypatch.setattr(MT, "TERMS_AT_ONCE", 10)
    monkeypatch.setattr(MT, "CHARS_AT_ONCE", 3000)
    monkeypatch.setattr(MT.in_blocks, "__defaults__", (10,))
    assert sorted(map(tuple, R.match_terms(docs, terms, "norm").collect())) == whole
    attached = MT.attach_hits(docs, {"a": R.resolve_small(terms.collect()), "b": []}, "norm")
    assert sorted(map(tuple, attached.select("doc_id", F.explode("a").alias("h")).select("doc_id", "h.*").collect())) == whole
    assert {tuple(r.b) for r in attached.collect()} == {()}


def test_overlapping_occurrences_and_null_texts(spark):
    docs = spark.createDataFrame([(1, "aaaaa"), (2, None), (3, ""), (4, "\U0001f600aa\U0001f600")], "doc_id int, text string")
    terms = spark.createDataFrame([("aa", "H", "C", ""), ("aaa", "M", "C", ""), ("aa", "E", "D", "x")], "term string, ktype string, category string, stage string")
    got = sorted((r.doc_id, r.surface, r.ktype, r.stage, r["count"], r.snippet) for r in R.match_terms(docs, terms).collect())
    face = "…\U0001f600aa\U0001f600…"
    assert got == [(1, "aa", "E", "x", 2, "…aaaaa…"), (1, "aa", "H", "", 2, "…aaaaa…"), (1, "aaa", "M", "", 1, "…aaaaa…"), (4, "aa", "E", "x", 1, face), (4, "aa", "H", "", 1, face)]


def test_known_cases(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    extra = docs.filter("doc_id < 5").select((F.col("doc_id") + 900).alias("item_id"), F.concat(F.lit("before "), "text", F.lit(" after")).alias("text"))
    same = docs.filter("doc_id = 7").select(F.lit(990).cast("long").alias("item_id"), "text")
    cases = bench.select("item_id", "text").unionByName(extra).unionByName(same)
    d, c = docs.collect(), cases.collect()
    want = sorted(
        (x.doc_id, y.item_id, "EQUAL" if x.text == y.text else "QUOTES" if y.text in x.text else "PART_OF")
        for x in d for y in c if len(x.text) >= 24 and len(y.text) >= 24 and (x.text in y.text or y.text in x.text)
    )
    assert sorted(map(tuple, R.known_case_match(docs, cases).collect())) == want
    assert {"EQUAL", "QUOTES", "PART_OF"} == {w[2] for w in want}


def test_negative_rules(spark):
    rules = spark.createDataFrame(
        [("N1", ["bad", "worse"], 2, [], [], ["H"], [], -40.0, 30.0), ("N2", ["deny"], 1, ["charged"], [], [], [], 0.0, None),
         ("N3", ["old"], 1, [], ["new"], [], ["no_new"], -10.0, 45.0)], K.NEGATIVES_SCHEMA)
    docs = docs_of(spark, "bad and worse", "bad", "deny and charged", "old", "old but new", "bad worse old")
    hits = NG.match_negative_rules(docs, rules, types="CASE WHEN doc_id = 5 THEN array('H') ELSE array('C') END", flags="array('no_new')")
    assert {(r.doc_id, r.rule_id) for r in hits.collect()} == {(0, "N1"), (2, "N2"), (3, "N3"), (5, "N3")}
    both = NG.sum_negatives(hits.unionByName(hits.filter("rule_id = 'N1'").withColumn("cap", F.lit(20.0))))
    assert {(r.doc_id, r.delta, r.cap) for r in both.collect()} == {(0, -80.0, 20.0), (2, 0.0, None), (3, -10.0, 45.0), (5, -10.0, 45.0)}


def test_domain_list(spark):
    docs = spark.createDataFrame([(1, "A <x@mail.shop.com>", "bill", 50.0), (2, "y@notshop.com", "bill", 50.0), (3, "z@shop.com", "hello", 50.0)],
                                 "doc_id int, sender string, text string, score double")
    domains = spark.createDataFrame([("shop.com",), ("other.org",)], "domain string")
    out = NG.bulk_mail_filter(docs, domains, ["bill"], ["receipt"])
    assert {(r.doc_id, r.is_bulk, r.score) for r in out.collect()} == {(1, True, 15.0), (2, False, 50.0), (3, False, 50.0)}


def test_rule_score_invariants(spark):
    docs = spark.read.parquet(DOCS)
    pack = K.demo_pack(spark).compile()
    out = TR.triage(docs, pack).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r.rule_score >= 0 and 0 <= r.score <= 100
        caps = [n.cap for n in r.negatives if n.cap is not None]
        assert (r.cap is None and not caps) or r.cap == min(caps)
        if caps:
            assert r.rule_score <= min(caps) and r.score <= min(caps)
        if r.rule_score < 45:
            assert r.score <= 38
        assert all(h["count"] > 0 for h in r.hits) and len({p.pattern_id for p in r.patterns}) == len(r.patterns)


def test_categories(spark):
    hit = "named_struct('surface', '{0}', 'term', '{0}', 'ktype', '{1}', 'category', '{2}', 'count', {3})"

    def cats(hits, patterns="cast(array() AS array<struct<category:string,matched_terms:array<string>>>)"):
        rows = "array(" + ", ".join(hit.format(*h) for h in hits) + ")"
        return spark.range(1).select(F.expr(A.assign_categories(rows, patterns))).first()[0]

    assert cats([("a", "H", "C1", 1), ("b", "H", "C2", 5), ("c", "M", "C3", 9), ("d", "E", "C4", 3)]) == ["C2", "C1", "C3"]
    assert cats([("a", "C", "C1", 1), ("b", "C", "C2", 5), ("c", "C", "C3", 3)]) == ["C2", "C3"]
    assert cats([("a", "H", "C9", 1), ("red", "C", "C5", 1)], "array(named_struct('category', 'C2|C1|GLOBAL', 'matched_terms', array('red')))") == ["C1", "C2", "C5"]


def test_small_packs_resolve_like_large_ones(spark):
    pack = K.demo_pack(spark)
    slots = pack.terms.filter("role = 'slot'")
    want = {(r.surface, r.term, r.ktype, r.category, r.stage) for r in R.map_variants(slots, pack.variants).collect()}
    assert {tuple(r) for r in R.resolve_small(slots.collect(), pack.variants.collect())} == want


def brute_windows(text, level):
    out, piece = [], ""
    for c in text:
        if c == "\n":
            out, piece = [*out, piece], ""
        elif c in T.SENTENCE_ENDS:
            out, piece = [*out, piece + c], ""
        else:
            piece += c
    kept = [s.strip(T.BLANKS) for s in [*out, piece] if s not in list(T.SENTENCE_ENDS)]
    kept = [s for s in kept if s]
    if level == "paragraph":
        return [p.strip(T.BLANKS) for p in re.split(r"\n[ \t\n\x0b\f\r]*\n", text) if p.strip(T.BLANKS)]
    return {"sentence": kept, "context3": ["\n".join(kept[i : i + 3]) for i in range(len(kept))], "full": [text]}[level]


def brute_patterns(text, patterns, dynamic):
    """Every window of every level, with plain substring tests."""
    out = set()
    for p in patterns:
        for level in p.levels():
            if level == "full" and p.full_limit is not None and len(text) > p.full_limit:
                continue
            hit = None
            for k, window in enumerate(brute_windows(text, level)):
                found = []
                for kind, terms in p.groups:
                    if kind == "flag":
                        found.append([""] if dynamic["flag"] else [])
                    elif kind == "amount":
                        numbers = re.findall(r"[0-9][0-9,，.]*[ \t\n\x0b\f\r]*(?:万亿|萬億|万|萬|亿|億)?", window)
                        found.append([t for t in dynamic["amount"] if t in window] + [n.replace(" ", "") for n in numbers])
                    else:
                        found.append([t for t in (terms if kind == "term" else dynamic[kind]) if t in window])
                if all(found):
                    hit = (p.pattern_id, level, k, tuple(f[0] for f in found if f[0]))
                    break
            if hit:
                out.add(hit)
                break
    return out


def test_patterns_against_brute_force(spark):
    rng = random.Random(17)
    words = ["red", "blue", "a b", "aa", "a", "é", "x\ny", "12", "3,4 万", "zz"]
    texts = ["".join(rng.choice([*words, " ", "\n", "\n\n", "。", "!", "!!", " \n \n", "　"]) for _ in range(rng.randint(0, 60))) for _ in range(250)] + [None, ""]
    rows = []
    for p in range(60):
        windows = rng.choice([None, ["sentence"], ["full", "paragraph"], ["context3", "sentence"], ["context3"]])
        for g in range(rng.randint(1, 4)):
            kind = rng.choice(["term"] * 5 + ["amount", "reversal", "entity", "flag"])
            for t in range(rng.randint(1, 3) if kind == "term" else 1):
                rows.append((f"P{p:02}", "C", g, t, rng.choice(words) if kind == "term" else None, kind, windows, rng.random() < 0.5, 50.0, None))
    table = spark.createDataFrame(rows, K.PATTERNS_SCHEMA)
    docs = docs_of(spark, *texts)
    given = {"amount": ["4 万"], "reversal": ["blue", "zz"], "entity": ["a b"]}
    signals = PT.Signals(amounts="array('4 万')", reversals="array('blue', 'zz')", entities="array('a b')", flag="doc_id % 3 = 0")
    want = {i: brute_patterns(t, PT.patterns_from_rows(table.collect()), {**given, "flag": i % 3 == 0}) for i, t in enumerate(texts) if t is not None}
    for words_at_once in (None, 80):
        got = {}
        for r in PT.match_patterns(docs, table, signals=signals, per_pass=words_at_once).collect():
            got.setdefault(r.doc_id, set()).add((r.pattern_id, r.level, r.window_no, tuple(r.matched_terms)))
        assert {i: got.get(i, set()) for i in want} == want and set(got) <= set(want)


def test_exclusions_and_negatives_against_brute_force(spark):
    rng = random.Random(18)
    words = ["aa", "ab", "a", "b a", "ccc", "é"]
    texts = ["".join(rng.choice([*words, " ", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    docs = docs_of(spark, *texts)
    rules = [(rng.choice(["aa", "ab", "b a", "ccc"]), rng.sample(words, rng.randint(1, 3)), rng.randint(0, 6), rng.randint(0, 6)) for _ in range(40)]
    want = set()
    for i, t in enumerate(texts):
        for term, near, before, after in rules:
            at, total, kept = t.find(term), 0, 0
            while at >= 0:
                around = t[max(0, at - before) : at + len(term) + after]
                total, kept = total + 1, kept + (not any(w in around for w in near))
                at = t.find(term, at + len(term))
            if total:
                want.add((i, term, total, kept))
    got = PT.apply_context_exclusions(docs, spark.createDataFrame(rules, K.EXCLUSIONS_SCHEMA)).collect()
    assert {(r.doc_id, r.term, r.total, r.kept) for r in got} == want and len(got) >= len(want)

    negatives = [(f"N{k:02}", rng.sample(words, rng.randint(0, 3)), rng.randint(0, 2), rng.sample(words, rng.randint(0, 2)), rng.sample(words, rng.randint(0, 1)),
                  rng.sample(["H", "E"], rng.randint(0, 1)), rng.sample(["f", "g"], rng.randint(0, 1)), -1.0, None) for k in range(60)]
    want = set()
    for i, t in enumerate(texts):
        for rid, require, n, also, forbid, types, flags, _, _ in negatives:
            there = [w for w in require if w in t]
            if len(there) >= n and (not also or any(w in t for w in also)) and not any(w in t for w in forbid) and not ("H" in types and i % 2) and set(flags) <= {"f"}:
                want.add((i, rid, tuple(there)))
    hits = NG.match_negative_rules(docs, spark.createDataFrame(negatives, K.NEGATIVES_SCHEMA), types="CASE WHEN doc_id % 2 = 1 THEN array('H') ELSE array() END", flags="array('f')")
    assert {(r.doc_id, r.rule_id, tuple(r.matched_terms)) for r in hits.collect()} == want


def test_large_packs_cost_about_the_same(spark):
    """20 000 exclusions and 5 000 patterns plan and run."""
    docs = spark.read.parquet(DOCS).select("doc_id", F.expr(T.normalize_text("text", True)).alias("norm"))
    rows = [r for k in range(5000) for r in pack_rows(f"P{k:05}", [[f"word{k}", "the"], ["and", f"other{k}"]])]
    got = PT.match_patterns(docs, spark.createDataFrame(rows, K.PATTERNS_SCHEMA), "norm").groupBy("doc_id").count().collect()
    assert got and {r["count"] for r in got} == {5000}
    rules = [(f"word{k}", ["the"], 25, 45) for k in range(20_000)] + [("the", ["and"], 25, 45)]
    found = PT.apply_context_exclusions(docs, spark.createDataFrame(rules, K.EXCLUSIONS_SCHEMA), "norm").collect()
    assert {r.term for r in found} == {"the"}


def test_case_keys_both_ways(spark):
    rng = random.Random(9)
    parts = ["Acme", "Ac", "me", "North", "Bridge", "é", "Works", "x"]
    names = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    entities = [(i % 60, rng.choice("CP"), n) for i, n in enumerate(names)] + [(3, "C", None), (4, "C", ""), (5, "C", "Acme"), (5, "C", "Acme")]
    keys = [(i % 17, rng.choice("CP"), "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))) for i in range(60)] + [(1, "C", None), (2, "C", "")]
    want = {}
    for d, kind, e in entities:
        for c, other, k in keys:
            if kind == other and e and k and (e in k or k in e):
                near = 0 if e == k else 1 if k in e else 2
                found, least = want.get((d, c), (set(), 2))
                want[d, c] = found | {e}, min(least, near)
    e = spark.createDataFrame(entities, "doc_id int, type string, text string")
    k = spark.createDataFrame(keys, "case_id int, type string, key string")
    got = {(r.doc_id, r.case_id): (set(r.matched_keys), CS.RELATIONS.index(r.relation)) for r in CS.match_case_keys(e, k).collect()}
    assert got == want
    assert CS.match_case_keys(e.filter("false"), k).count() == CS.match_case_keys(e, k.filter("false")).count() == 0


def test_shared_footers_make_no_candidates(spark):
    """Texts with one footer, needles that end in it: each needle is looked up by what it has of its own."""
    footer = "sent by the common desk of the house, do not answer"
    hay = spark.createDataFrame([(i, f"letter number {i * 7919:09d} {footer}") for i in range(400)], "doc_id int, text string")
    needles = spark.createDataFrame([(i, f"number {i * 7919:09d} {footer}") for i in range(0, 800, 2)], "item_id int, needle string")
    sides = (hay, "doc_id", "text", needles, "item_id", "needle", 8, 17)
    assert sorted(map(tuple, R.contains_join(*sides).collect())) == [(i, i) for i in range(0, 400, 2)]
    # a few candidates for each needle, not 400 x 400
    assert R.containment_candidates(*sides).count() < 400 * 10
    strings = [f"Desk {chr(0x4E00 + i)}{chr(0x5E00 + i)} of the common house" for i in range(400)]
    names = spark.createDataFrame([("N", s) for s in strings], "type string, hay string")
    keys = spark.createDataFrame([("N", s[:14]) for s in strings], "type string, needle string")
    assert CS.short_candidates(names, keys, ["type"]).count() == CS.short_contains_join(names, keys, ["type"]).count() == 400


def test_python_tasks_take_few_rows_at_once(spark):
    import pyarrow as pa

    from siftline.operators import matcher, terms
    from siftline.operators.rulepass import Rules, attach_rules
    from siftline.sources.readers import parse_mail

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    word = matcher.Surface("a", "a", "H", "C", "")
    rules = matcher.Exclusion("aa", ("b",), 5, 5)
    for build in (
        lambda: matcher.attach_hits(docs, {"hits": [word]}), lambda: attach_rules(docs, [Rules(exclusions=(rules,))], exclusions="x"),
        lambda: parse_mail(docs.selectExpr("text AS path", "encode(text, 'UTF-8') AS content")), lambda: terms._marks(docs, "doc_id", "text", 8, 17),
    ):
        spark.conf.unset(key)
        build()
        rows = spark.range(1000).coalesce(1).mapInArrow(sizes, "n long").collect()
        assert sum(r.n for r in rows) == 1000 and max(r.n for r in rows) <= 250
