from pyspark.sql import functions as F

from siftline.functions import scoring as S
from siftline.operators import quality as Q
from siftline.operators import score as A
from siftline.plans import packs as K


def ask(spark, *sqls):
    return tuple(spark.range(1).select(*(F.expr(s) for s in sqls)).first())


def test_bands_and_gates(spark):
    scores = [100, 90, 89.9, 75, 74, 60, 59, 40, 39, 0]
    assert ask(spark, *(S.band(f"{float(s)}D") for s in scores)) == tuple("SSAABBCCDD"[i] if i not in (2,) else "A" for i in range(10))
    assert ask(spark, *(S.signal_gate_cap(f"{s}D") for s in (44.9, 45, 69, 70, 89, 90))) == (38.0, 65.0, 65.0, 80.0, 80.0, 100.0)
    assert ask(spark, S.signal_gate_cap("95D", "CAST(NULL AS double)", "30D")) == (30.0,)
    assert ask(spark, S.stage_adjust("'EX'", "true"), S.stage_adjust("'EX'", "false"), S.stage_adjust("'E3'", "true"), S.stage_adjust("'?'", "true")) == (-8, -25, 8, 0)


def test_tracks(spark):
    none, one = "cast(array() AS array<string>)", "array('X')"
    cases = [(one, 50, one, 50), (one, 50, one, 10), (none, 90, one, 50), (one, 10, none, 90)]
    got = [ask(spark, S.assign_track(a, f"{x}D", b, f"{y}D"), S.fuse_scores(a, f"{x}D", b, f"{y}D")) for a, x, b, y in cases]
    assert got == [("MIXED", 55.0), ("FIRST", 50.0), ("SECOND", 90.0), ("NONE", 90.0)]
    assert ask(spark, S.track_confidence("'MIXED'", "60D", "80D"), S.track_confidence("'NONE'", "60D", "80D"), S.track_confidence("'FIRST'", "55D", "0D")) == (0.9, 0.0, 0.55)
    assert ask(spark, S.novelty_score("true", "true", "false", "false", "false"), S.novelty_score("true", "false", "false", "false", "false"),
               S.novelty_score("false", "false", "true", "false", "true"), S.novelty_score("false", "false", "false", "false", "false")) == (5.0, 0.0, 5.0, 10.0)


def complaint(spark, **given):
    base = dict(n_h=0, n_m=0, n_e=0, n_repeat=0, n_group=0, n_loss=0, n_failed=0, n_patterns=0, n_strong_patterns=0)
    base = {k: str(v) for k, v in base.items()}
    base |= {k: "cast(NULL AS double)" for k in ("duration_days", "approximate_days", "population", "money_loss", "waiting_days", "frequency", "complaint_count", "delta", "cap")}
    base |= {"population_confidence": "0D", "deadline": "false", "has_attachment": "false", "marks": "cast(array() AS array<string>)", "pattern_marks": "cast(array() AS array<string>)"}
    base |= {k: str(v) for k, v in given.items()}
    row = A.complaint_score(spark.range(1).selectExpr(*(f"{v} AS {k}" for k, v in base.items()))).first()
    return row.complaint_score, row.complaint_band, row.bonus


def test_complaint_score(spark):
    assert complaint(spark) == (0.0, "D", 0.0)
    # 12 severity, 9 duration, 10 group, 2 evidence, 3 + 5 public interest, 6 bonus
    assert complaint(spark, n_h=1, duration_days="30D", population="500D", population_confidence="0.95D") == (47.0, "C", 6.0)
    assert complaint(spark, n_h=1, duration_days="30D", population="500D", population_confidence="0.95D", cap="30D")[0] == 30.0
    assert complaint(spark, n_h=1, duration_days="7D") == (40.0, "C", 0.0)  # raised to the floor
    assert complaint(spark, n_m=1, marks="array('money', 'lasting')")[0] <= 38.0
    strong = dict(n_h=3, n_e=3, duration_days="400D", population="5000D", population_confidence="0.95D", money_loss="1000000D", frequency="9D", marks="array('care', 'safety')")
    assert complaint(spark, **strong)[:2] == (100.0, "S")
    assert complaint(spark, **strong, delta="-30D")[0] < 100.0


def test_every_dimension_is_bounded(spark):
    dims = [A.Dimension("a", 10, (("id >= 0", 7), ("id < 5", 7)), base=1.0)]
    assert {r.total for r in A.score_dimensions(spark.range(10).withColumnRenamed("id", "doc_id"), [A.Dimension("a", 10, (("doc_id >= 0", 7), ("doc_id < 5", 7)), 1.0)]).collect()} == {10.0, 8.0}
    assert A.dimension_value(dims[0]).startswith("least(10.0D")


def test_pack_problems_are_found(spark):
    pack = K.demo_pack(spark)
    assert Q.validate_pack(pack.categories, pack.terms.filter("role = 'slot'"), pack.patterns, pack.negatives).count() == 0
    cats = spark.createDataFrame([("A", ""), ("A", "")], K.CATEGORIES_SCHEMA)
    terms = spark.createDataFrame([("x", "H", "B", "", ""), (" ", "H", "A", "", "")], K.TERMS_SCHEMA)
    pats = spark.createDataFrame([("P", "A|Z", 0, 0, " ", "term", ["page"], False, 120.0, None)], K.PATTERNS_SCHEMA)
    negs = spark.createDataFrame([("N", [], 1, [], [], [], [], None, 200.0), ("N", [], 1, [], [], [], [], 1.0, None)], K.NEGATIVES_SCHEMA)
    assert {tuple(r) for r in Q.validate_pack(cats, terms, pats, negs).collect()} == {
        ("DUPLICATE_CATEGORY", "A"), ("UNKNOWN_CATEGORY", "x:B"), ("BLANK_TERM", "A"), ("UNKNOWN_CATEGORY", "P:Z"), ("EMPTY_GROUP", "P:0"),
        ("BAD_WINDOW", "P:page"), ("BAD_SCORE", "P"), ("DUPLICATE_RULE", "N"), ("BAD_DELTA", "N"), ("BAD_CAP", "N"),
    }


def test_checklist(spark):
    docs = spark.createDataFrame([(1, ["C01", "C03"]), (2, []), (3, ["?"])], "doc_id int, categories array<string>")
    got = {r.doc_id: r.tasks for r in A.verification_checklist(docs, spark.createDataFrame(K.DEMO_TASKS, K.TASKS_SCHEMA), K.DEMO_FALLBACK_TASKS).collect()}
    assert got == {1: ["read the passage in context", "check the speaker", "revoke the credential"], 2: K.DEMO_FALLBACK_TASKS, 3: K.DEMO_FALLBACK_TASKS}
