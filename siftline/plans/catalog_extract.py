"""Queries for extraction, scoring expressions and privacy.

``documents`` holds no amounts or dates, so the extraction queries read
notices that Spark writes from ``orders`` and ``lineitem``; the expected
values are then the columns the notices were written from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import numbers as N
from siftline.functions import privacy as P
from siftline.functions import scoring as S
from siftline.operators import extract as X
from siftline.operators import privacy as PV
from siftline.operators import quality as Q
from siftline.operators import score as A
from siftline.operators.rows import explode_structs
from siftline.plans import packs as K
from siftline.plans.catalog import query, sql_values
from siftline.plans.catalog_text import O_DOCS, O_SURF, o_norm, prepared
from siftline.sources import writers as WR
from siftline.sources.readers import read_table


def _orders(spark, sf_dir, text: str):
    return read_table(spark, sf_dir, "orders", "o_orderkey").select(
        F.col("o_orderkey").alias("doc_id"), "o_totalprice", "o_orderdate", "o_orderpriority", "o_custkey", F.expr(text).alias("text")
    )


# --- X: extraction --------------------------------------------------------------
@query(
    "extract_amounts",
    """SELECT o_orderkey AS doc_id, CAST(floor(o_totalprice) AS DOUBLE) AS amount, 'TWD' AS currency FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT o_orderkey, CAST(floor(o_totalprice) * 10000 AS DOUBLE), 'USD' FROM orders WHERE o_orderkey % 2 = 1""",
)
def _(spark, sf_dir):
    text = (
        "CASE WHEN o_orderkey % 2 = 0 THEN concat('Notice: NT$', cast(floor(o_totalprice) AS string), ' due, ref x', o_orderkey)"
        " ELSE concat('Notice: ', cast(floor(o_totalprice) AS string), '万美元 due in 3 parts') END"
    )
    found = explode_structs(_orders(spark, sf_dir, text), N.extract_amounts("text"), ["doc_id"])
    return found.select("doc_id", "amount", "currency")


WORDS = "零一二三四五六七八九"


@query("parse_number_words", "SELECT o_orderkey AS doc_id, CAST(o_custkey % 10000 AS DOUBLE) AS n FROM orders")
def _(spark, sf_dir):
    """Customer numbers written out in number words and read back."""
    digit = f"substring('{WORDS}', {{0}} + 1, 1)"
    n = "o_custkey % 10000"
    parts = []
    for unit, factor in (("千", 1000), ("百", 100), ("十", 10)):
        d = f"cast(floor({n} / {factor}) % 10 AS int)"
        parts.append(f"CASE WHEN {d} > 0 THEN concat({digit.format(d)}, '{unit}') ELSE '零' END")
    last = digit.format(f"cast({n} % 10 AS int)")
    docs = _orders(spark, sf_dir, f"concat({', '.join(parts)}, {last})")
    return docs.select("doc_id", F.expr(N.number_words("text")).alias("n"))


@query(
    "extract_dates",
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y年%-m月%-d日') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS mention,
    strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""",
)
def _(spark, sf_dir):
    text = (
        "CASE WHEN o_orderkey % 2 = 0 THEN concat('于', date_format(o_orderdate, 'yyyy年 M月 d日'), '收到, 又 ', date_format(o_orderdate, 'yyyy年M月d日'))"
        " ELSE concat('on ', date_format(o_orderdate, 'yyyy-MM-dd'), ' and ', date_format(o_orderdate, 'yyyy-MM-dd')) END"
    )
    docs = _orders(spark, sf_dir, text)
    found = docs.select("doc_id", F.explode(F.expr(N.extract_dates("text"))).alias("mention"))
    return found.withColumn("day", F.date_format(F.expr(N.parse_date("mention")), "yyyy-MM-dd"))


@query(
    "extract_identifiers",
    r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[\pL\pN_.+-]+@[\pL\pN_-]+(?:\.[\pL\pN_-]+)+'))), '|') AS emails,
    array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b[0-9]{10,20}\b'))), '|') AS accounts FROM documents""",
)
def _(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id")
    return docs.select(
        "doc_id",
        F.expr(f"array_join(array_sort({N.extract_emails('text')}), '|')").alias("emails"),
        F.expr(f"array_join(array_sort({N.extract_accounts('text')}), '|')").alias("accounts"),
    )


@query(
    "extract_population",
    """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS line, CAST(l_quantity * 10 AS DOUBLE) AS value,
    CAST(CASE l_linenumber % 3 WHEN 0 THEN 0.8 WHEN 1 THEN 0.75 ELSE 0.95 END AS DOUBLE) AS confidence FROM lineitem""",
)
def _(spark, sf_dir):
    text = (
        "concat('case ', l_orderkey, ': ', CASE l_linenumber % 3 WHEN 0 THEN '至少' WHEN 1 THEN '约' ELSE '' END,"
        " cast(cast(l_quantity * 10 AS int) AS string), '户受影响, 其中 3人')"
    )
    rows = read_table(spark, sf_dir, "lineitem", "l_orderkey").select("l_orderkey", "l_linenumber", F.expr(text).alias("text"))
    out = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.expr(N.extract_population("text")).alias("p"))
    return out.select("doc_id", "line", "p.value", "p.confidence")


@query(
    "extract_duration",
    """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS line, CAST(greatest(l_quantity * 7, 30) AS DOUBLE) AS days,
    CAST(CASE WHEN l_linenumber % 2 = 0 THEN 1095 END AS DOUBLE) AS approximate_days FROM lineitem""",
)
def _(spark, sf_dir):
    text = "concat('2024年起 ', cast(cast(l_quantity AS int) AS string), '周未处理, 一个月', CASE WHEN l_linenumber % 2 = 0 THEN ' 多年' ELSE '' END)"
    rows = read_table(spark, sf_dir, "lineitem", "l_orderkey").select("l_orderkey", "l_linenumber", F.expr(text).alias("text"))
    out = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.expr(N.extract_duration("text")).alias("d"))
    return out.select("doc_id", "line", "d.days", "d.approximate_days")


@query(
    "extract_frequency",
    """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS line,
    CAST(CASE l_linenumber % 3 WHEN 0 THEN l_quantity WHEN 1 THEN 3 ELSE 2 END AS DOUBLE) AS frequency,
    CAST(CASE WHEN l_linenumber % 3 = 2 THEN 2 END AS DOUBLE) AS complaint_count FROM lineitem""",
)
def _(spark, sf_dir):
    text = "CASE l_linenumber % 3 WHEN 0 THEN concat('来电', cast(cast(l_quantity AS int) AS string), '次') WHEN 1 THEN '屡次反映' ELSE '陈情, 投诉' END"
    rows = read_table(spark, sf_dir, "lineitem", "l_orderkey").select("l_orderkey", "l_linenumber", F.expr(text).alias("text"))
    out = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.expr(N.extract_frequency("text")).alias("f"))
    return out.select("doc_id", "line", "f.frequency", "f.complaint_count")


@query(
    "extract_loss_waiting_deadline",
    """SELECT o_orderkey AS doc_id, CAST(floor(o_totalprice) * CASE WHEN o_orderkey % 2 = 0 THEN 10000 ELSE 1 END AS DOUBLE) AS money_loss,
    CAST((o_custkey % 50 + 1) * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 30 END AS DOUBLE) AS waiting_days,
    o_orderpriority LIKE '1%' AS deadline FROM orders""",
)
def _(spark, sf_dir):
    text = (
        "concat('损失', cast(floor(o_totalprice) AS string), CASE WHEN o_orderkey % 2 = 0 THEN '万元' ELSE '元' END, ', 已等候', o_custkey % 50 + 1,"
        " CASE o_orderkey % 3 WHEN 0 THEN '天' WHEN 1 THEN '周' ELSE '个月' END, CASE WHEN o_orderpriority LIKE '1%' THEN ', 补件期限将至' ELSE '' END)"
    )
    docs = _orders(spark, sf_dir, text)
    return docs.select(
        "doc_id", F.expr(N.extract_loss("text")).alias("money_loss"), F.expr(N.extract_waiting("text")).alias("waiting_days"),
        F.expr(N.deadline_pressure("text")).alias("deadline"),
    )


ENTITY_PATTERNS = [("VERSION", r"[Vv]ersion [0-9]+(?:\.[0-9]+)?")]
ENTITY_NAMES = [("ORGANIZATION", "Apache"), ("ORGANIZATION", "GNU"), ("ROLE", "clown")]


@query(
    "extract_entities",
    rf"""WITH e AS (SELECT doc_id, 'VERSION' AS type, unnest(regexp_extract_all(text, '[Vv]ersion [0-9]+(?:\.[0-9]+)?')) AS text FROM documents),
    n AS (SELECT doc_id, v.type, v.name AS text, (length(d.text) - length(replace(d.text, v.name, ''))) // length(v.name) AS k
      FROM documents d JOIN {sql_values(ENTITY_NAMES, ['type', 'name'])} v ON contains(d.text, v.name)),
    a AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(generate_series(1, len(l))) AS i, unnest(l) AS x FROM
      (SELECT doc_id, list_distinct(regexp_extract_all(text, '\b[0-9]{{10,20}}\b')) AS l FROM documents)))
    SELECT doc_id, type, text, CAST(count(*) AS BIGINT) AS count FROM e GROUP BY ALL
    UNION ALL SELECT doc_id, type, text, CAST(k AS BIGINT) FROM n
    UNION ALL SELECT doc_id, 'BANK_ACCOUNT', x, CAST(1 AS BIGINT) FROM a""",
)
def _(spark, sf_dir):
    return X.extract_entities(read_table(spark, sf_dir, "documents", "doc_id"), ENTITY_PATTERNS, ENTITY_NAMES)


@query(
    "evidence_shapes",
    """WITH s AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ['OFFICIAL_DOCUMENT', 'SPREADSHEET'] WHEN 1 THEN ['PHOTO'] WHEN 2 THEN ['INTERNAL_DOCUMENT']
      ELSE [] END AS s, contains(text, 'token') AS e FROM documents)
    SELECT doc_id, array_to_string(list_concat(s, CASE WHEN e THEN ['MULTI_SOURCE_PACKAGE'] ELSE [] END), '|') AS shapes FROM s""",
)
def _(spark, sf_dir):
    types = (
        "CASE doc_id % 5 WHEN 0 THEN array('PDF', 'csv', 'xlsx') WHEN 1 THEN array('jpg', 'png') WHEN 2 THEN array('docx', 'eml')"
        " WHEN 3 THEN array('exe') ELSE cast(array() AS array<string>) END"
    )
    docs = read_table(spark, sf_dir, "documents", "doc_id").withColumn("types", F.expr(types))
    return docs.select("doc_id", F.array_join(F.expr(S.evidence_shapes("types", "contains(text, 'token')")), "|").alias("shapes"))


@query("json_field", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def _(spark, sf_dir):
    """One field of a JSON column, with a default where it is missing or broken."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    parsed = F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})
    return events.select("event_id", F.coalesce(parsed.getField("k"), F.lit(-1)).alias("k"))


@query(
    "fit_summary",
    """SELECT doc_id, CASE WHEN length(x) > 120 THEN substr(x, 1, 117) || '…' ELSE x END AS summary
    FROM (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS x FROM documents)""".replace("\\\\", "\\"),
)
def _(spark, sf_dir):
    from siftline.functions.text import fit

    return read_table(spark, sf_dir, "documents", "doc_id").select("doc_id", F.expr(fit("text", 120)).alias("summary"))


# --- A: scoring expressions, over two scores of every document --------------------
PAIR = (
    "SELECT doc_id, CAST((doc_id * 37) % 101 AS DOUBLE) AS a, CAST((doc_id * 53 + 11) % 101 AS DOUBLE) AS b, n_chars,"
    " doc_id % 3 <> 0 AS has_a, doc_id % 4 <> 0 AS has_b FROM documents"
)
CATS = "CASE WHEN {} THEN array('X') ELSE cast(array() AS array<string>) END"


def _pair(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "doc_id", "cast((doc_id * 37) % 101 AS double) AS a", "cast((doc_id * 53 + 11) % 101 AS double) AS b", "n_chars",
        "doc_id % 3 <> 0 AS has_a", "doc_id % 4 <> 0 AS has_b",
    )
    return docs.withColumn("cats_a", F.expr(CATS.format("has_a"))).withColumn("cats_b", F.expr(CATS.format("has_b")))


O_BAND = "CASE WHEN {0} >= 90 THEN 'S' WHEN {0} >= 75 THEN 'A' WHEN {0} >= 60 THEN 'B' WHEN {0} >= 40 THEN 'C' ELSE 'D' END"


@query("band", f"SELECT doc_id, a AS score, {O_BAND.format('a')} AS band FROM ({PAIR})")
def _(spark, sf_dir):
    return _pair(spark, sf_dir).select("doc_id", F.col("a").alias("score"), F.expr(S.band("a")).alias("band"))


@query(
    "stage_adjust",
    f"""SELECT doc_id, CAST(CASE doc_id % 7 WHEN 0 THEN -20 WHEN 1 THEN 0 WHEN 2 THEN 5 WHEN 3 THEN 8 WHEN 4 THEN 10 WHEN 5 THEN 12
    ELSE CASE WHEN has_a THEN -8 ELSE -25 END END AS DOUBLE) AS delta FROM ({PAIR})""",
)
def _(spark, sf_dir):
    staged = _pair(spark, sf_dir).withColumn("stage", F.expr("CASE WHEN doc_id % 7 = 6 THEN 'EX' ELSE concat('E', doc_id % 7) END"))
    return staged.select("doc_id", F.expr(S.stage_adjust("stage", "has_a")).alias("delta"))


@query(
    "signal_gate_cap",
    f"""SELECT doc_id, CAST(least(CASE WHEN a < 45 THEN 38 WHEN a < 70 THEN 65 WHEN a < 90 THEN 80 ELSE 100 END,
    CASE WHEN has_a THEN 50 ELSE 1000 END) AS DOUBLE) AS cap FROM ({PAIR})""",
)
def _(spark, sf_dir):
    return _pair(spark, sf_dir).select("doc_id", F.expr(S.signal_gate_cap("a", "CASE WHEN has_a THEN 50D END")).alias("cap"))


O_TRACK = (
    "CASE WHEN has_a AND a >= 40 AND has_b AND b >= 40 THEN 'MIXED' WHEN has_a AND a >= 40 THEN 'FIRST'"
    " WHEN has_b AND b >= 40 THEN 'SECOND' ELSE 'NONE' END"
)


@query(
    "assign_track",
    f"""SELECT doc_id, track, CASE WHEN track = 'FIRST' AND has_b THEN 'SECOND' WHEN track = 'SECOND' AND has_a THEN 'FIRST' ELSE '' END AS second_track
    FROM (SELECT *, {O_TRACK} AS track FROM ({PAIR}))""",
)
def _(spark, sf_dir):
    tracked = _pair(spark, sf_dir).withColumn("track", F.expr(S.assign_track("cats_a", "a", "cats_b", "b")))
    return tracked.select("doc_id", "track", F.expr(S.secondary_track("track", "cats_a", "cats_b")).alias("second_track"))


@query(
    "track_confidence",
    f"""SELECT doc_id, CAST(CASE track WHEN 'NONE' THEN 0 WHEN 'MIXED' THEN round(least(1, (a + b) / 200.0 + 0.1 + CASE WHEN a >= 60 THEN 0.05 ELSE 0 END
    + CASE WHEN b >= 60 THEN 0.05 ELSE 0 END) + 1e-9, 2) ELSE round(least(1, greatest(a, b) / 100.0), 2) END AS DOUBLE) AS confidence
    FROM (SELECT *, {O_TRACK} AS track FROM ({PAIR}))""",
)
def _(spark, sf_dir):
    tracked = _pair(spark, sf_dir).withColumn("track", F.expr(S.assign_track("cats_a", "a", "cats_b", "b")))
    return tracked.select("doc_id", F.expr(S.track_confidence("track", "a", "b")).alias("confidence"))


@query(
    "fuse_scores",
    f"""SELECT doc_id, fused, CASE WHEN aa AND NOT bb THEN {O_BAND.format('a')} WHEN bb AND NOT aa THEN {O_BAND.format('b')} ELSE {O_BAND.format('fused')} END AS band
    FROM (SELECT *, has_a AND a >= 40 AS aa, has_b AND b >= 40 AS bb,
      CAST(least(100, greatest(a, b) + CASE WHEN has_a AND a >= 40 AND has_b AND b >= 40 THEN 5 ELSE 0 END) AS DOUBLE) AS fused FROM ({PAIR}))""",
)
def _(spark, sf_dir):
    fused = _pair(spark, sf_dir).withColumn("fused", F.expr(S.fuse_scores("cats_a", "a", "cats_b", "b")))
    band = S.fused_band("cats_a", "a", S.band("a"), "cats_b", "b", S.band("b"), "fused")
    return fused.select("doc_id", "fused", F.expr(band).alias("band"))


@query(
    "risk_flags",
    f"""SELECT doc_id, array_to_string(list_concat(CASE WHEN has_a THEN ['N01'] ELSE [] END, CASE WHEN has_b THEN ['N02', 'C01'] ELSE ['C01'] END), '|') AS flags
    FROM ({PAIR})""",
)
def _(spark, sf_dir):
    ids = "filter(array(CASE WHEN has_a THEN 'N01' END, CASE WHEN has_b THEN 'N02' END, CASE WHEN has_b THEN 'N02' END), _x -> _x IS NOT NULL)"
    return _pair(spark, sf_dir).select("doc_id", F.array_join(F.expr(S.risk_flags(ids, "array('C01', '', 'C01')")), "|").alias("flags"))


@query(
    "score_dimensions",
    f"""SELECT doc_id, CAST(least(20, 2 + CASE WHEN a >= 40 THEN 10 ELSE 0 END + CASE WHEN a >= 80 THEN 12 ELSE 0 END) AS DOUBLE) AS severity,
    CAST(least(15, CASE WHEN n_chars > 2000 THEN 8 ELSE 0 END + CASE WHEN has_b THEN 4.5 ELSE 0 END) AS DOUBLE) AS context,
    CAST(least(20, 2 + CASE WHEN a >= 40 THEN 10 ELSE 0 END + CASE WHEN a >= 80 THEN 12 ELSE 0 END)
      + least(15, CASE WHEN n_chars > 2000 THEN 8 ELSE 0 END + CASE WHEN has_b THEN 4.5 ELSE 0 END) AS DOUBLE) AS total FROM ({PAIR})""",
)
def _(spark, sf_dir):
    dims = [
        A.Dimension("severity", 20, (("a >= 40", 10), ("a >= 80", 12)), base=2.0),
        A.Dimension("context", 15, (("n_chars > 2000", 8), ("has_b", 4.5))),
    ]
    return A.score_dimensions(_pair(spark, sf_dir), dims).selectExpr("doc_id", "dimensions['severity'] AS severity", "dimensions['context'] AS context", "total")


@query(
    "complaint_score",
    """WITH m AS (SELECT *, o_orderkey AS doc_id, o_orderkey % 4 AS n_h, o_custkey % 3 AS n_m, o_orderkey % 5 AS n_e, o_custkey % 400 AS days,
      (o_custkey * 7) % 1500 AS pop, o_totalprice AS money, o_custkey % 8 AS freq, o_orderpriority LIKE '1%' AS dl, o_orderkey % 6 = 0 AS safety FROM orders),
    d AS (SELECT *, CASE WHEN n_h >= 3 THEN 17 WHEN n_h = 2 THEN 15 WHEN n_h = 1 THEN 12 ELSE 4 END AS sev,
      CASE WHEN days >= 180 THEN 11 WHEN days >= 30 THEN 9 WHEN days >= 7 THEN 7 WHEN days > 0 THEN 6 ELSE 0 END AS dur,
      CASE WHEN pop >= 1000 THEN 12 WHEN pop >= 100 THEN 10 WHEN pop > 0 THEN 7 ELSE 0 END AS grp,
      CASE WHEN money >= 100000 THEN 11 WHEN money >= 10000 THEN 9 WHEN money > 0 THEN 7 ELSE 0 END AS loss,
      CASE WHEN n_e >= 3 THEN 12 WHEN n_e > 0 THEN 6 + n_e * 1.5 ELSE 2 END AS ev,
      CASE WHEN freq >= 5 THEN 7 WHEN freq >= 2 THEN 6 ELSE 0 END AS fail FROM m),
    p AS (SELECT *, CASE WHEN grp >= 12 OR (dl AND pop >= 100) THEN 9 WHEN grp >= 9 THEN 8 ELSE 3 END AS pub FROM d),
    b AS (SELECT *, CASE WHEN n_h > 0 AND dur >= 6 AND grp >= 7 THEN 6 ELSE 0 END + CASE WHEN safety AND (sev >= 14 OR pub >= 7) THEN 4 ELSE 0 END AS bonus FROM p),
    t AS (SELECT *, least(sev + dur + grp + loss + ev + fail + pub + bonus,
      CASE WHEN n_h = 0 THEN CASE WHEN n_m <= 1 AND n_e = 0 AND grp < 7 THEN 38 ELSE 55 END ELSE 1000 END) AS t0 FROM b),
    u AS (SELECT *, least(t0, CASE WHEN grp < 7 AND dur < 6 AND loss < 7 AND fail < 6 AND t0 > 68 THEN CASE WHEN n_e > 0 OR n_h > 0 THEN 68 ELSE 55 END ELSE 1000 END) AS t1 FROM t),
    f AS (SELECT doc_id, CAST(CASE WHEN n_h = 0 AND n_m = 0 THEN 0 ELSE greatest(0, least(100, round_even(CASE WHEN n_h > 0 AND dur >= 6 AND t1 < 40 THEN 40 ELSE t1 END, 0))) END AS DOUBLE) AS s FROM u)
    SELECT doc_id, s AS complaint_score, CASE WHEN s >= 90 THEN 'S' WHEN s >= 75 THEN 'A' WHEN s >= 60 THEN 'B' WHEN s >= 40 THEN 'C' ELSE 'D' END AS complaint_band FROM f""",
)
def _(spark, sf_dir):
    """Complaint measures taken from the columns of orders."""
    measured = read_table(spark, sf_dir, "orders", "o_orderkey").selectExpr(
        "o_orderkey AS doc_id", "o_orderkey % 4 AS n_h", "o_custkey % 3 AS n_m", "o_orderkey % 5 AS n_e",
        "0 AS n_repeat", "0 AS n_group", "0 AS n_loss", "0 AS n_failed",
        "cast(o_custkey % 400 AS double) AS duration_days", "cast(NULL AS double) AS approximate_days",
        "cast((o_custkey * 7) % 1500 AS double) AS population", "0.95D AS population_confidence",
        "o_totalprice AS money_loss", "cast(NULL AS double) AS waiting_days", "cast(o_custkey % 8 AS double) AS frequency",
        "cast(NULL AS double) AS complaint_count", "o_orderpriority LIKE '1%' AS deadline", "false AS has_attachment",
        "CASE WHEN o_orderkey % 6 = 0 THEN array('safety') ELSE cast(array() AS array<string>) END AS marks",
        "cast(array() AS array<string>) AS pattern_marks", "0 AS n_patterns", "0 AS n_strong_patterns",
        "cast(NULL AS double) AS delta", "cast(NULL AS double) AS cap",
    )
    return A.complaint_score(measured).select("doc_id", "complaint_score", "complaint_band")


@query(
    "verification_checklist",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'read the passage in context|check the speaker|find the licence text|check the version named'
    WHEN 1 THEN 'revoke the credential|check the speaker' WHEN 2 THEN 'check the dates|check the source'
    ELSE 'read the passage in context|check the speaker|revoke the credential' END AS tasks FROM documents""",
)
def _(spark, sf_dir):
    cats = (
        "CASE doc_id % 4 WHEN 0 THEN array('C01', 'C02') WHEN 1 THEN array('C03') WHEN 2 THEN array('C99') ELSE array('C01', 'C03') END"
    )
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(cats).alias("categories"))
    found = A.verification_checklist(docs, spark.createDataFrame(K.DEMO_TASKS, K.TASKS_SCHEMA), K.DEMO_FALLBACK_TASKS)
    return found.withColumn("tasks", F.array_join("tasks", "|"))


@query(
    "escalation_predicate",
    f"""SELECT doc_id, CASE WHEN a >= 60 THEN 'SCORE' WHEN b >= 70 THEN 'PATTERN' WHEN has_a AND has_b AND n_chars > 1000 THEN 'EVIDENCE_ENTITY_AMOUNT' END AS reason
    FROM ({PAIR})""",
)
def _(spark, sf_dir):
    return _pair(spark, sf_dir).select(
        "doc_id", F.expr(A.escalation("a", "array(named_struct('score', b))", "has_a", "has_b", "n_chars > 1000")).alias("reason")
    )


# --- P: privacy -----------------------------------------------------------------
KINDS = ("EMAIL", "BANK_ACCOUNT", "IP", "PASSWORD_SECRET")
PLAIN = tuple(p for p in P.SENSITIVE if p.kind in KINDS)
# the same patterns without look around, for ASCII neighbours
O_RX = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "BANK_ACCOUNT": r"\b[0-9]{10,20}\b",
    "IP": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "PASSWORD_SECRET": r"(?i)\b(?:password|passwd|pwd|secret|token|api[_ -]?key)\s*[:=：]\s*([^\s,;，；]+)",
}
_PIECES = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, regexp_extract_all(text, '{rx}') AS m, regexp_split_to_array(text, '{rx}') AS g FROM documents WHERE regexp_matches(text, '{rx}')"
    for k, rx in O_RX.items()
)
_PRIO = "CASE kind WHEN 'PASSWORD_SECRET' THEN 12 WHEN 'EMAIL' THEN 14 WHEN 'BANK_ACCOUNT' THEN 18 ELSE 19 END"
_FOUND = f"""pc AS ({_PIECES}),
    pu AS (SELECT doc_id, kind, unnest(generate_series(1, len(m))) AS i, unnest(m) AS m, unnest(g[1:len(m)]) AS g FROM pc),
    po AS (SELECT doc_id, kind, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM pu),
    cand AS (SELECT doc_id, kind, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, m, {_PRIO} AS prio FROM po)"""


@query("scan_sensitive", f"WITH {_FOUND} SELECT doc_id, kind, s AS start_pos, e AS end_pos FROM cand")
def _(spark, sf_dir):
    """Findings of four kinds before overlaps are resolved."""
    docs = read_table(spark, sf_dir, "documents", "doc_id")
    found = PV.scan_sensitive(docs, "text", PLAIN, resolve=False)
    return found.select("doc_id", "kind", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


_KEPT = f"""{_FOUND}, kept AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand o WHERE o.doc_id = c.doc_id AND o.prio < c.prio
      AND o.s < c.e AND c.s < o.e))"""


@query(
    "resolve_overlaps",
    f"""WITH {_KEPT} SELECT doc_id, kind, s AS start_pos, e AS end_pos, CASE WHEN length(m) <= 4 THEN repeat('*', length(m))
    ELSE substr(m, 1, 2) || repeat('*', length(m) - 4) || substr(m, length(m) - 1, 2) END AS preview FROM kept""",
)
def _(spark, sf_dir):
    found = PV.scan_sensitive(read_table(spark, sf_dir, "documents", "doc_id"), "text", PLAIN)
    return found.select("doc_id", "kind", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "preview")


@query(
    "redact",
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
      '(?i)\b(?:password|passwd|pwd|secret|token|api[_ -]?key)\s*[:=：]\s*([^\s,;，；]+)', '[REDACTED_SECRET]', 'g'),
      '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[REDACTED_EMAIL]', 'g'),
      '\b[0-9]{10,20}\b', '[REDACTED_ACCOUNT]', 'g'), '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b', '[REDACTED_IP]', 'g') AS text FROM documents""",
)
def _(spark, sf_dir):
    return PV.redact(read_table(spark, sf_dir, "documents", "doc_id"), "text", PLAIN).select("doc_id", "text")


@query("redact_all_kinds")
def _(spark, sf_dir):
    """All kinds, name patterns included."""
    return PV.redact(read_table(spark, sf_dir, "documents", "doc_id"))


@query(
    "mask_identifiers",
    """SELECT o_orderkey AS doc_id, 'acct ' || substr(x, 1, 3) || repeat('*', length(x) - 3) || ' id K****, sent by us***@example.org' AS masked
    FROM (SELECT o_orderkey, CAST(1000000000000 + o_custkey * 1000003 AS VARCHAR) AS x FROM orders)""",
)
def _(spark, sf_dir):
    text = "concat('acct ', cast(1000000000000 + o_custkey * 1000003 AS string), ' id K123456789')"
    docs = _orders(spark, sf_dir, text).withColumn("sender", F.expr("concat('user', o_custkey, '@example.org')"))
    return docs.select("doc_id", F.expr(f"concat({P.mask_identifiers('text')}, ', sent by ', {P.mask_sender('sender')})").alias("masked"))


@query(
    "pseudonymize",
    """WITH f AS (SELECT o_custkey AS doc_id, o_orderpriority AS text, min(o_orderkey) AS pos FROM orders GROUP BY ALL),
    r AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos, text) AS n FROM f)
    SELECT doc_id, 'COMPANY' AS kind, text, 'COMPANY_' || lpad(CAST(n AS VARCHAR), 2, '0') AS token FROM r""",
)
def _(spark, sf_dir):
    mentions = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").alias("doc_id"), F.lit("company").alias("kind"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("pos")
    )
    return PV.pseudonymize(mentions)


@query(
    "outbound_check",
    f"""WITH {_FOUND}, k AS (SELECT doc_id, kind FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand o WHERE o.doc_id = c.doc_id AND o.prio < c.prio AND o.s < c.e AND c.s < o.e)
      UNION SELECT doc_id, 'WINDOWS_PATH' FROM documents WHERE doc_id % 5 = 0),
    r AS (SELECT doc_id, string_agg(DISTINCT 'SENSITIVE_CONTENT:' || kind, '|' ORDER BY 'SENSITIVE_CONTENT:' || kind) AS r FROM k GROUP BY doc_id)
    SELECT d.doc_id, r IS NULL AND d.doc_id % 7 <> 0 AS allowed, concat_ws('|', CASE WHEN d.doc_id % 7 = 0 THEN 'FORBIDDEN_NAME:body_text' END, r) AS reasons
    FROM documents d LEFT JOIN r USING (doc_id)""",
)
def _(spark, sf_dir):
    """Whole texts as they are, with paths, quotes, tabs and map keys beside them."""
    docs = read_table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", F.col("text").alias("summary"),
        F.expr(r"""array(named_struct('place', CASE WHEN doc_id % 5 = 0 THEN concat('C:\\temp\\notes', doc_id) END, 'quoted', concat('"', lang, '"\t', source)))""").alias("notes"),
        F.expr("map(CASE WHEN doc_id % 7 = 0 THEN 'body_text' ELSE 'lang' END, lang)").alias("extra"),
    )
    patterns = tuple(p for p in PV.P.SENSITIVE if p.kind in (*KINDS, "WINDOWS_PATH"))
    found = PV.outbound_check(docs, patterns, max_bytes=1 << 40)
    return found.select("doc_id", "allowed", F.array_join("reasons", "|").alias("reasons"))


@query("hash_ref", "SELECT doc_id, 'REF:' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 20) AS ref FROM documents")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(P.hash_ref("cast(doc_id AS string)")).alias("ref"))


@query(
    "safe_entity",
    r"""WITH w AS (SELECT DISTINCT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM documents)
    SELECT word, trim(word) <> '' AND NOT (contains(lower(word), '@') OR contains(word, '\') OR contains(lower(word), '/home/') OR contains(lower(word), 'sk-')
      OR contains(lower(word), 'line-') OR contains(lower(word), 'http://') OR contains(lower(word), 'https://'))
      AND length(regexp_replace(word, '[^0-9]', '', 'g')) < 6 AS safe FROM w""",
)
def _(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id")
    words = docs.select(F.explode(F.split(F.translate("text", "\n", " "), " ")).alias("word")).distinct()
    return words.select("word", F.expr(P.safe_entity("word")).alias("safe"))


@query(
    "secret_scan",
    r"""WITH l AS (SELECT doc_id, unnest(generate_series(1, len(x))) AS line_no, unnest(x) AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
    e AS (SELECT doc_id, line_no, unnest(regexp_extract_all(value, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS m FROM l)
    SELECT 'doc' || doc_id AS path, CAST(line_no AS BIGINT) AS line_no, 'PRIVATE_EMAIL' AS kind FROM e
    WHERE NOT regexp_matches(m, '@example\.(com|org|net|local)\b')""",
)
def _(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id")
    lines = docs.select(F.expr("concat('doc', doc_id)").alias("path"), F.posexplode(F.split("text", "\n")).alias("pos", "value"))
    found = PV.secret_scan(lines.select("path", (F.col("pos") + 1).alias("line_no"), "value"))
    return found.select("path", "line_no", "kind")


@query("public_projection", "SELECT doc_id, lang, n_chars FROM documents")
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("sender", F.lit("x")).withColumn("api_key", F.lit("y"))
    return WR.public_projection(docs, ["doc_id", "lang", "n_chars", "sender", "api_key"])


# --- Q: quality -----------------------------------------------------------------
_RUDE = ["worthless", "stupid", "idiot", "trash", "clown", "disgusting"]
_ISRUDE = " OR ".join(f"contains(t, '{w}')" for w in _RUDE)


@query(
    "quality_gates",
    f"""WITH {O_DOCS}, p AS (SELECT toxic = 1 AS want, ({_ISRUDE}) AS got FROM labels JOIN d USING (doc_id)),
    c AS (SELECT count(*) FILTER (want) AS positives, count(*) FILTER (want AND got) AS hits, count(*) FILTER (NOT want) AS negatives,
      count(*) FILTER (NOT want AND got) AS false_hits FROM p)
    SELECT *, coalesce(round(hits / positives, 4), 1) AS recall, coalesce(round(false_hits / negatives, 4), 0) AS false_rate,
      coalesce(hits / positives, 1) >= 0.9 AS recall_ok, coalesce(false_hits / negatives, 0) <= 0.1 AS false_ok FROM c""",
)
def _(spark, sf_dir):
    from siftline.functions.sql import any_contains

    predicted = prepared(spark, sf_dir).select("doc_id", F.expr(any_contains("norm", _RUDE)).alias("rude"))
    return Q.gates(predicted, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic = 1", "rude")


@query(
    "explainability_gate",
    f"""WITH {O_DOCS}, r AS (SELECT ({_ISRUDE}) AS hit, length(text) >= 400 AS long, doc_id % 10 <> 0 AS tasks FROM d WHERE (doc_id * 37) % 101 >= 60)
    SELECT 'has_hits' AS rule, CAST(count(*) FILTER (NOT hit) AS BIGINT) AS violations FROM r
    UNION ALL SELECT 'has_snippet', CAST(count(*) FILTER (NOT hit) AS BIGINT) FROM r
    UNION ALL SELECT 'has_summary', CAST(count(*) FILTER (NOT long) AS BIGINT) FROM r
    UNION ALL SELECT 'has_tasks', CAST(count(*) FILTER (NOT tasks) AS BIGINT) FROM r""",
)
def _(spark, sf_dir):
    from siftline.functions.sql import any_contains

    rude = any_contains("norm", _RUDE)
    records = prepared(spark, sf_dir).select(
        F.expr(S.band("cast((doc_id * 37) % 101 AS double)")).alias("band"), F.expr(f"cast({rude} AS int)").alias("n_hits"),
        F.expr(f"cast({rude} AS int)").alias("n_snippets"), F.col("text").alias("summary"), F.expr("cast(doc_id % 10 <> 0 AS int)").alias("n_tasks"),
    )
    return Q.explainability_gate(records, min_summary=400)


@query(
    "validate_pack",
    """SELECT 'DUPLICATE_TERM' AS problem, p_brand || ':H:' || p_name AS item FROM part GROUP BY p_brand, p_name HAVING count(*) > 1
    UNION ALL SELECT 'UNKNOWN_CATEGORY', p_name || ':' || p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 45)
    UNION ALL SELECT 'BAD_CAP', CAST(p_partkey AS VARCHAR) FROM part WHERE p_retailprice > 100""",
)
def _(spark, sf_dir):
    """A pack read from ``part``: names as terms, brands as categories, prices as caps."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    categories = part.filter("p_size > 45").select(F.col("p_brand").alias("category")).distinct()
    terms = part.select(F.col("p_name").alias("term"), F.lit("H").alias("ktype"), F.col("p_brand").alias("category"))
    negatives = part.select(F.col("p_partkey").cast("string").alias("rule_id"), F.lit(-1.0).alias("delta"), F.col("p_retailprice").alias("cap"))
    patterns = spark.createDataFrame([], K.PATTERNS_SCHEMA)
    return Q.validate_pack(categories, terms, patterns, negatives)
