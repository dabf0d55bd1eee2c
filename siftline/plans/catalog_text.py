"""Queries for text preparation, matching and scoring over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import scoring as S
from siftline.functions import text as T
from siftline.functions.sql import string_array
from siftline.operators import cases as CS
from siftline.operators import extract as X
from siftline.operators import negatives as NG
from siftline.operators import patterns as PT
from siftline.operators import score as A
from siftline.operators import terms as R
from siftline.operators.matcher import attach_hits
from siftline.operators.rows import explode_structs
from siftline.operators.rulepass import attach_rules, rule_blocks
from siftline.plans import packs as K
from siftline.plans import records as RC
from siftline.plans import triage as TR
from siftline.plans.catalog import query, sql_values
from siftline.sources.readers import html_to_text, read_table


# --- SQL text of the preparation steps ---------------------------------------
def o_clean(t: str) -> str:
    x = f"replace(replace(coalesce({t}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    x = rf"regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    x = f"translate({x}, '　“”‘’​﻿', ' \"\"''''')"
    x = rf"regexp_replace({x}, '[ \t]{{2,}}', ' ', 'g')"
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def o_norm(t: str, keep_newlines: bool = True) -> str:
    x = f"regexp_replace(lower({o_clean(t)}), '[{T.FOLDED_PUNCTUATION}]', ' ', 'g')"
    x = f"translate({x}, '{T.WIDE_CHARS}', '{T.NARROW_CHARS}')"
    if keep_newlines:
        x = rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    else:
        x = rf"regexp_replace({x}, '\s+', ' ', 'g')"
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


O_DOCS = f"d AS (SELECT doc_id, lang, source, n_chars, text, {o_norm('text')} AS t FROM documents)"
O_SENT = (
    r"[regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN regexp_extract_all(t, '[^。！？!?\n]+[。！？!?]?')"
    r" IF regexp_replace(x, '^\s+|\s+$', '', 'g') <> '']"
)
O_PARA = (
    r"[regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN regexp_split_to_array(t, '\n\s*\n')"
    r" IF regexp_replace(x, '^\s+|\s+$', '', 'g') <> '']"
)


def o_count(t: str, s: str) -> str:
    return f"CAST((length({t}) - length(replace({t}, {s}, ''))) // length({s}) AS BIGINT)"


def o_snippet(t: str, s: str, radius: int = 25) -> str:
    start = f"greatest(strpos({t}, {s}) - {radius}, 1)"
    cut = f"substr({t}, {start}, strpos({t}, {s}) + length({s}) + {radius} - {start})"
    return f"'…' || regexp_replace({cut}, '^…+|…+$', '', 'g') || '…'"


def prepared(spark, sf_dir):
    return TR.prepare(read_table(spark, sf_dir, "documents", "doc_id"))


# --- T: text ------------------------------------------------------------------
@query("clean_text", f"SELECT doc_id, {o_clean('text')} AS clean FROM documents")
def _(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", "doc_id").select("doc_id", F.expr(T.clean_text("text")).alias("clean"))


@query(
    "normalize_text",
    f"SELECT doc_id, {o_norm('text')} AS lines, {o_norm('text', False)} AS flat FROM documents",
)
def _(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", F.expr(T.normalize_text("text", True)).alias("lines"), F.expr(T.normalize_text("text")).alias("flat")
    )


@query(
    "split_sentences",
    f"""WITH {O_DOCS}, p AS (SELECT doc_id, regexp_extract_all(t, '[^。！？!?\\n]+[。！？!?]?|[。！？!?]|\\n+') AS p FROM d),
    u AS (SELECT doc_id, unnest(generate_series(1, len(p))) AS i, unnest(p) AS x FROM p),
    o AS (SELECT doc_id, i, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM u)
    SELECT doc_id, CAST(e - length(x) AS BIGINT) AS start_pos, CAST(e AS BIGINT) AS end_pos,
           regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS sentence
    FROM o WHERE regexp_matches(x, '[^。！？!?\\n]') AND regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> ''""",
)
def _(spark, sf_dir):
    found = explode_structs(prepared(spark, sf_dir), T.sentences("norm"), ["doc_id"])
    return found.select("doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), F.col("text").alias("sentence"))


@query(
    "split_paragraphs",
    # single line breaks are doubled, so that every line of a document is a paragraph
    f"""WITH {O_DOCS}, p AS (SELECT doc_id, replace(t, chr(10), chr(10) || chr(10)) AS t FROM d),
    s AS (SELECT doc_id, {O_PARA} AS ps FROM p)
    SELECT doc_id, CAST(unnest(generate_series(0, len(ps) - 1)) AS BIGINT) AS window_no, unnest(ps) AS text FROM s""",
)
def _(spark, sf_dir):
    doubled = prepared(spark, sf_dir).withColumn("norm", F.expr("replace(norm, '\\n', '\\n\\n')"))
    return PT.text_windows(doubled, "norm", "paragraph")


@query(
    "context_windows",
    f"""WITH {O_DOCS}, s AS (SELECT doc_id, {O_SENT} AS ss FROM d)
    SELECT doc_id, CAST(unnest(generate_series(0, len(ss) - 1)) AS BIGINT) AS window_no,
           unnest([array_to_string(ss[i:i + 2], chr(10)) FOR i IN generate_series(1, len(ss))]) AS text FROM s""",
)
def _(spark, sf_dir):
    return PT.text_windows(prepared(spark, sf_dir), "norm", "context3")


@query(
    "find_occurrences",
    f"""WITH {O_DOCS}, p AS (SELECT doc_id, string_split(t, 'that') AS p FROM d WHERE contains(t, 'that')),
    u AS (SELECT doc_id, unnest(generate_series(1, len(p))) AS i, unnest(p) AS x, len(p) AS n FROM p),
    o AS (SELECT doc_id, i, n, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) + 4 * (i - 1) AS s FROM u)
    SELECT doc_id, CAST(s AS BIGINT) AS start_pos, CAST(s + 4 AS BIGINT) AS end_pos FROM o WHERE i < n""",
)
def _(spark, sf_dir):
    found = explode_structs(prepared(spark, sf_dir), T.find_occurrences("norm", "'that'"), ["doc_id"])
    return found.select("doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@query("snippet", f"WITH {O_DOCS} SELECT doc_id, {o_snippet('t', "'license'")} AS snippet FROM d WHERE contains(t, 'license')")
def _(spark, sf_dir):
    return prepared(spark, sf_dir).filter("contains(norm, 'license')").select("doc_id", F.expr(T.snippet("norm", "'license'")).alias("snippet"))


@query(
    "html_to_text",
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html,
        '(?is)<script[\s/>][^>]*>.*?</script\s*>|(?is)<script>.*?</script\s*>', '', 'g'),
        '(?is)<style[\s/>][^>]*>.*?</style\s*>|(?is)<style>.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h,
        '(?i)<(p|div|br|tr|li|h1|h2|h3|h4|blockquote|table)(\s[^>]*|/[^>]*)?>|</(p|div|tr|li|h1|h2|h3|h4|blockquote|table)(\s[^>]*)?>', chr(10), 'g'),
        '(?i)<(td|th)(\s[^>]*)?>', ' | ', 'g'), '</?[A-Za-z!?][^>]*>', '', 'g') AS h FROM a),
    c AS (SELECT page_id, replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS h FROM b)
    SELECT page_id, array_to_string([trim(regexp_replace(x, '[ \t]+', ' ', 'g')) FOR x IN string_split(h, chr(10))
        IF trim(regexp_replace(x, '[ \t]+', ' ', 'g')) <> ''], chr(10)) AS text FROM c""",
)
def _(spark, sf_dir):
    return html_to_text(read_table(spark, sf_dir, "pages", "page_id")).select("page_id", "text")


# --- R: rules -----------------------------------------------------------------
def _surfaces() -> list[tuple]:
    slots = [r for r in K.DEMO_TERMS if r[4] == "slot"]
    rows = [(t, t, k, c, s) for t, k, c, s, _ in slots]
    taken = {t for t, *_ in slots}
    rows += [(v, t, k, c, s) for v, canon in K.DEMO_VARIANTS if v not in taken for t, k, c, s, _ in slots if t == canon]
    return rows


O_SURF = "s AS " + sql_values(_surfaces(), ["surface", "term", "ktype", "category", "stage"])
O_HITS = (
    f"h AS (SELECT doc_id, surface, term, ktype, category, stage, {o_count('t', 'surface')} AS count,"
    f" {o_snippet('t', 'surface')} AS snippet FROM d JOIN s ON contains(t, surface))"
)


@query(
    "map_variants",
    f"WITH {O_SURF}, w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS surface FROM documents)"
    " SELECT s.surface, s.term, s.ktype, s.category, CAST(count(*) AS BIGINT) AS n FROM w JOIN s USING (surface) GROUP BY ALL",
)
def _(spark, sf_dir):
    """Words of the documents that are dictionary terms or their variants."""
    pack = K.demo_pack(spark)
    surfaces = R.map_variants(pack.terms.filter("role = 'slot'"), pack.variants)
    # count words where they lie; only distinct words meet the dictionary
    words = read_table(spark, sf_dir, "documents", "doc_id").select(F.explode(F.split(F.lower("text"), " ")).alias("surface"))
    return words.groupBy("surface").agg(F.count("*").alias("n")).join(surfaces, "surface").select("surface", "term", "ktype", "category", "n")


@query("match_terms", f"WITH {O_DOCS}, {O_SURF}, {O_HITS} SELECT * FROM h")
def _(spark, sf_dir):
    pack = K.demo_pack(spark)
    return R.match_terms(prepared(spark, sf_dir), pack.terms.filter("role = 'slot'"), "norm", pack.variants)


@query(
    "match_terms_large",
    f"""WITH {O_DOCS}, s AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[^ \n.,]+')) AS surface FROM benchmark)
    SELECT doc_id, surface, surface AS term, 'H' AS ktype, 'bench' AS category, '' AS stage, {o_count('t', 'surface')} AS count,
      {o_snippet('t', 'surface')} AS snippet FROM d JOIN s ON length(surface) >= 2 AND contains(t, surface)""",
)
def _(spark, sf_dir):
    """A pack read from a table: every word of ``benchmark`` in every document."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[^ \\n.,]+"), F.lit(0)))
    terms = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(words.alias("term")).distinct()
    terms = terms.select("term", F.lit("H").alias("ktype"), F.lit("bench").alias("category"), F.lit(None).cast("string").alias("stage"))
    return R.match_terms(prepared(spark, sf_dir), terms, "norm")


def _role(role: str) -> str:
    return sql_values([r[:4] for r in K.DEMO_TERMS if r[4] == role], ["term", "ktype", "category", "stage"])


@query(
    "match_terms_slotted",
    f"""WITH {O_DOCS}, a AS (SELECT doc_id, term, ktype, category, {o_count('t', 'term')} AS count FROM d JOIN {_role('slot')} s ON contains(t, term)),
    g AS (SELECT doc_id, term, ktype, category, {o_count('t', 'term')} AS count FROM d JOIN {_role('evidence')} s ON contains(t, term)),
    x AS (SELECT doc_id, term, ktype, category, {o_count('t', 'term')} AS count FROM d JOIN {_role('reversal')} s ON contains(t, term)),
    b AS (SELECT doc_id, term, ktype, category, CAST(1 AS BIGINT) AS count FROM d JOIN {_role('boost')} s ON contains(t, term))
    SELECT * FROM a UNION ALL SELECT * FROM g ANTI JOIN a USING (doc_id, term, ktype)
    UNION ALL SELECT * FROM x ANTI JOIN a USING (doc_id, term, ktype) UNION ALL SELECT * FROM b""",
)
def _(spark, sf_dir):
    found = R.match_terms_slotted(prepared(spark, sf_dir), K.demo_pack(spark).terms, "norm")
    return found.select("doc_id", "term", "ktype", "category", "count")


@query(
    "match_reversal_terms",
    f"WITH {O_DOCS} SELECT doc_id, array_to_string([x FOR x IN ['other', 'than'] IF contains(t, x)], '|') AS x_terms,"
    " contains(t, 'other') OR contains(t, 'than') AS reversed FROM d",
)
def _(spark, sf_dir):
    found = R.match_reversal_terms(prepared(spark, sf_dir), K.DEMO_REVERSALS, "norm")
    return found.withColumn("x_terms", F.array_join("x_terms", "|"))


def _pattern_sql(rows=K.DEMO_PATTERNS) -> str:
    groups = sql_values([(p, g, k, t) for p, _, g, _, t, k, *_ in rows], ["pattern_id", "group_no", "kind", "term"])
    sizes: dict[str, set] = {}
    for p, _, g, *_ in rows:
        sizes.setdefault(p, set()).add(g)
    heads = {}
    for p, cat, _, _, _, _, windows, allow, base, cap in rows:
        pattern = PT.Pattern(p, cat, base, cap, tuple(windows) if windows else None, allow, [("term", [])] * len(sizes[p]))
        heads[p] = (p, cat, pattern.score(), len(sizes[p]), 2**31 - 1, pattern.levels())
    levels = sql_values([(h[0], lvl, i) for h in heads.values() for i, lvl in enumerate(h[5])], ["pattern_id", "level", "ord"])
    head = sql_values([h[:5] for h in heads.values()], ["pattern_id", "category", "score", "n_groups", "full_limit"])
    number = PT.NUMBER_REGEX
    return f"""WITH {O_DOCS}, w0 AS (SELECT doc_id, t, split_part(t, ' ', 2) AS src, {O_SENT} AS ss, {O_PARA} AS ps FROM d),
    w AS (SELECT doc_id, src, 'sentence' AS level, unnest(generate_series(0, len(ss) - 1)) AS window_no, unnest(ss) AS x FROM w0
      UNION ALL SELECT doc_id, src, 'paragraph', unnest(generate_series(0, len(ps) - 1)), unnest(ps) FROM w0
      UNION ALL SELECT doc_id, src, 'context3', unnest(generate_series(0, len(ss) - 1)),
        unnest([array_to_string(ss[i:i + 2], chr(10)) FOR i IN generate_series(1, len(ss))]) FROM w0
      UNION ALL SELECT doc_id, src, 'full', 0, t FROM w0),
    g AS {groups}, l AS {levels}, p AS {head},
    m AS (SELECT w.doc_id, l.pattern_id, w.level, l.ord, w.window_no FROM w JOIN l ON l.level = w.level JOIN p ON p.pattern_id = l.pattern_id
      JOIN g ON g.pattern_id = l.pattern_id AND CASE g.kind WHEN 'term' THEN contains(w.x, g.term)
        WHEN 'amount' THEN regexp_matches(w.x, '{number}') WHEN 'reversal' THEN contains(w.x, 'other') OR contains(w.x, 'than')
        WHEN 'entity' THEN contains(w.x, w.src) OR contains(w.x, 'gnu') WHEN 'flag' THEN w.doc_id % 3 = 0 ELSE FALSE END
      WHERE w.level <> 'full' OR length(w.x) <= p.full_limit
      GROUP BY ALL HAVING count(DISTINCT g.group_no) = max(p.n_groups)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pattern_id ORDER BY ord, window_no) AS rn FROM m)
    SELECT r.doc_id, r.pattern_id, p.category, CAST(p.score AS DOUBLE) AS score, r.level, CAST(r.window_no AS BIGINT) AS window_no
    FROM r JOIN p USING (pattern_id) WHERE rn = 1"""


@query("match_patterns", _pattern_sql())
def _(spark, sf_dir):
    docs = prepared(spark, sf_dir)
    signals = PT.Signals(reversals=string_array(K.DEMO_REVERSALS))
    found = PT.match_patterns(docs, K.demo_pack(spark).patterns, "norm", signals)
    return found.select("doc_id", "pattern_id", "category", "score", "level", "window_no")


@query("match_patterns_windows", _pattern_sql().replace("WHERE rn = 1", "WHERE rn = 1 AND r.pattern_id IN ('P02', 'P03')"))
def _(spark, sf_dir):
    """Patterns that name the windows they may be matched in."""
    listed = K.demo_pack(spark).patterns.filter("windows IS NOT NULL")
    found = PT.match_patterns(prepared(spark, sf_dir), listed, "norm")
    return found.select("doc_id", "pattern_id", "category", "score", "level", "window_no")


#: Two patterns with a group that the entities of a document fill, and two that need a flag of it.
DYNAMIC_PATTERNS = [
    *(r for r in K.DEMO_PATTERNS if r[0] in ("P02", "P04")),
    ("P05", "C04", 0, 0, "that", "term", ["sentence"], False, 30.0, None), ("P05", "C04", 1, 0, None, "entity", ["sentence"], False, 30.0, None),
    ("P06", "C02", 0, 0, None, "entity", None, False, 35.0, 20.0), ("P06", "C02", 1, 0, "license", "term", None, False, 35.0, 20.0),
    ("P06", "C02", 1, 1, "with", "term", None, False, 35.0, 20.0), ("P06", "C02", 2, 0, None, "reversal", None, False, 35.0, 20.0),
    ("P07", "C04", 0, 0, "nicht", "term", ["paragraph", "context3"], False, 25.0, None), ("P07", "C04", 1, 0, None, "flag", ["paragraph", "context3"], False, 25.0, None),
    ("P08", "C01", 0, 0, None, "flag", None, False, 15.0, None), ("P08", "C01", 1, 0, "worthless", "term", None, False, 15.0, None),
    ("P08", "C01", 1, 1, "the", "term", None, False, 15.0, None), ("P08", "C01", 2, 0, None, "entity", None, False, 15.0, None),
]


@query("match_patterns_dynamic", _pattern_sql(DYNAMIC_PATTERNS))
def _(spark, sf_dir):
    """Patterns with a group that is filled by numbers, by reversal terms, by the document's entities or by a flag of it."""
    table = spark.createDataFrame(DYNAMIC_PATTERNS, K.PATTERNS_SCHEMA).coalesce(1)
    signals = PT.Signals(reversals=string_array(K.DEMO_REVERSALS), entities="array(split_part(norm, ' ', 2), 'gnu')", flag="doc_id % 3 = 0")
    found = PT.match_patterns(prepared(spark, sf_dir), table, "norm", signals)
    return found.select("doc_id", "pattern_id", "category", "score", "level", "window_no")


def _neighbours(spark, sf_dir):
    """Words of ``benchmark`` that stand side by side there."""
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)).alias("w"))
    return words.select(F.explode(F.expr("transform(sequence(1, size(w) - 1), i -> struct(w[i - 1] AS one, w[i] AS two))")).alias("p")).select("p.*").distinct()


O_NEIGHBOURS = "nb AS (SELECT DISTINCT w[i] AS one, w[i + 1] AS two FROM (SELECT w, unnest(generate_series(1, len(w) - 1)) AS i FROM (SELECT regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM benchmark)))"


@query(
    "match_patterns_large",
    f"""WITH {O_DOCS}, {O_NEIGHBOURS}, s AS (SELECT doc_id, unnest(generate_series(0, len(ss) - 1)) AS window_no, unnest(ss) AS x FROM (SELECT doc_id, {O_SENT} AS ss FROM d))
    SELECT doc_id, one || '+' || two AS pattern_id, CAST(min(window_no) AS BIGINT) AS window_no FROM s JOIN nb ON contains(x, one) AND contains(x, two) GROUP BY ALL""",
)
def _(spark, sf_dir):
    """A pack read from a table: every two neighbouring words of ``benchmark`` in one sentence."""
    groups = "array(struct(0 AS group_no, one AS term), struct(1 AS group_no, two AS term))"
    rows = _neighbours(spark, sf_dir).select(F.expr("one || '+' || two").alias("pattern_id"), F.explode(F.expr(groups)).alias("g")).selectExpr(
        "pattern_id", "'bench' AS category", "g.group_no", "0 AS term_no", "g.term", "'term' AS group_kind", "array('sentence') AS windows",
        "false AS allow_full", "10D AS base_score", "cast(null AS double) AS cap",
    )
    return PT.match_patterns(prepared(spark, sf_dir), rows, "norm").select("doc_id", "pattern_id", "window_no")


def _exclusion_sql(rules: str = sql_values([(t, x) for t, xs, _, _ in K.DEMO_EXCLUSIONS for x in xs], ["term", "x"])) -> str:
    return f"""{O_DOCS}, e AS {rules}, et AS (SELECT DISTINCT term FROM e),
    sp AS (SELECT doc_id, t, term, string_split(t, term) AS p FROM d JOIN et ON contains(t, term)),
    su AS (SELECT doc_id, t, term, unnest(generate_series(1, len(p))) AS i, unnest(p) AS x, len(p) AS n FROM sp),
    so AS (SELECT doc_id, t, term, i, n, sum(length(x)) OVER (PARTITION BY doc_id, term ORDER BY i) + length(term) * (i - 1) AS s FROM su),
    sw AS (SELECT doc_id, term, i, substr(t, CAST(greatest(s - 25, 0) AS BIGINT) + 1,
        CAST(s - greatest(s - 25, 0) AS BIGINT) + length(term) + 45) AS win FROM so WHERE i < n),
    sk AS (SELECT doc_id, term, i, bool_or(contains(win, e.x)) AS excluded FROM sw JOIN e USING (term) GROUP BY ALL),
    ex AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (NOT excluded) AS BIGINT) AS kept FROM sk GROUP BY ALL)"""


@query("apply_context_exclusions", f"WITH {_exclusion_sql()} SELECT * FROM ex")
def _(spark, sf_dir):
    return PT.apply_context_exclusions(prepared(spark, sf_dir), K.demo_pack(spark).exclusions, "norm")


@query(
    "apply_context_exclusions_large",
    f"WITH {O_NEIGHBOURS}, {_exclusion_sql('(SELECT one AS term, two AS x FROM nb WHERE length(one) >= 5)')} SELECT * FROM ex",
)
def _(spark, sf_dir):
    """Rules read from a table: every word of ``benchmark`` is taken off near a word that follows it there."""
    rules = _neighbours(spark, sf_dir).filter("length(one) >= 5").groupBy(F.col("one").alias("term")).agg(F.sort_array(F.collect_set("two")).alias("exclude_if"))
    rules = rules.withColumns({"before": F.lit(25), "after": F.lit(45)})
    return PT.apply_context_exclusions(prepared(spark, sf_dir), rules, "norm")


def _negative_sql() -> str:
    """One SELECT per rule over documents with their hit types."""
    parts = []
    for rid, require, n, also, forbid, types, flags, delta, cap in K.DEMO_NEGATIVES:
        count = " + ".join(f"CAST(contains(t, '{x}') AS INT)" for x in require)
        cond = [f"({count}) >= {n}"]
        if also:
            cond.append("(" + " OR ".join(f"contains(t, '{x}')" for x in also) + ")")
        cond += [f"NOT contains(t, '{x}')" for x in forbid]
        for k in types:
            words = [s[0] for s in _surfaces() if s[2] == k]
            cond.append("NOT (" + " OR ".join(f"contains(t, '{x}')" for x in words) + ")")
        if flags:
            cond.append("FALSE")  # no amounts occur in documents
        found = ", ".join(f"CASE WHEN contains(t, '{x}') THEN '{x}' END" for x in require)
        parts.append(
            f"SELECT doc_id, '{rid}' AS rule_id, CAST({delta} AS DOUBLE) AS delta, CAST({cap if cap is not None else 'NULL'} AS DOUBLE) AS cap,"
            f" array_to_string([x FOR x IN [{found}] IF x IS NOT NULL], '|') AS matched_terms FROM d WHERE {' AND '.join(cond)}"
        )
    return f"WITH {O_DOCS}, n AS ({' UNION ALL '.join(parts)})"


def _negatives(spark, sf_dir):
    pack = K.demo_pack(spark)
    compiled = pack.compile()
    docs = attach_hits(prepared(spark, sf_dir), {"hits": compiled.terms}, "norm")
    return NG.match_negative_rules(docs, pack.negatives, "norm", "array_distinct(transform(hits, _h -> _h.ktype))")


@query("match_negative_rules", _negative_sql() + " SELECT * FROM n")
def _(spark, sf_dir):
    return _negatives(spark, sf_dir).withColumn("matched_terms", F.array_join("matched_terms", "|"))


@query("sum_negatives", _negative_sql() + " SELECT doc_id, sum(delta) AS delta, min(cap) AS cap FROM n GROUP BY doc_id")
def _(spark, sf_dir):
    return NG.sum_negatives(_negatives(spark, sf_dir))


def _scored(spark, sf_dir):
    """Documents with hits and patterns of the demo pack, without exclusions."""
    pack = K.demo_pack(spark).compile()
    docs = attach_hits(prepared(spark, sf_dir), {"hits": pack.terms}, "norm")
    return attach_rules(docs, rule_blocks("patterns", pack.patterns), "norm", patterns="patterns", reversals=string_array(K.DEMO_REVERSALS))


_P = _pattern_sql().split("WITH ", 1)[1]
_P_CTE, _P_SELECT = _P[: _P.rindex("SELECT r.doc_id")].rstrip(), _P[_P.rindex("SELECT r.doc_id"):]
_MATCHED = f"{_P_CTE}, pm AS ({_P_SELECT}), {O_SURF}, {O_HITS}"


@query(
    "assign_categories",
    f"""WITH {_MATCHED}, pc AS (SELECT DISTINCT doc_id, unnest(string_split(category, '|')) AS c FROM pm),
    hs AS (SELECT doc_id, category AS c, sum(count) AS n FROM h WHERE ktype = 'H' GROUP BY ALL),
    me AS (SELECT doc_id, category AS c, sum(count) AS n FROM h WHERE ktype IN ('M', 'E') GROUP BY ALL),
    cs AS (SELECT doc_id, category AS c, sum(count) AS n FROM h WHERE ktype = 'C' GROUP BY ALL),
    rest AS (SELECT doc_id, c, n FROM me ANTI JOIN hs USING (doc_id, c)),
    nh AS (SELECT doc_id, count(*) AS k FROM hs GROUP BY doc_id),
    rr AS (SELECT doc_id, c, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, c) AS rn FROM rest),
    np AS (SELECT doc_id, c, 0 AS part, -n AS o FROM hs UNION ALL
           SELECT rr.doc_id, c, 1, -n FROM rr LEFT JOIN nh USING (doc_id) WHERE rn <= 3 - coalesce(k, 0)),
    cf AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, c) AS rn, -n AS o FROM cs),
    a AS (SELECT doc_id, c, 0 AS part, 0 AS o FROM pc
          UNION ALL SELECT doc_id, c, part, o FROM np ANTI JOIN pc USING (doc_id)
          UNION ALL SELECT doc_id, c, 2, o FROM cf ANTI JOIN pc USING (doc_id) ANTI JOIN np USING (doc_id) WHERE rn <= 2)
    SELECT d.doc_id, coalesce(string_agg(a.c, '|' ORDER BY part, o, a.c), '') AS categories FROM d LEFT JOIN a USING (doc_id) GROUP BY d.doc_id""",
)
def _(spark, sf_dir):
    # matched context terms of the demo patterns are in no dictionary category of their own
    docs = _scored(spark, sf_dir).withColumn("patterns", F.expr(
        "transform(patterns, _p -> named_struct('category', _p.category, 'matched_terms', cast(array() AS array<string>)))"
    ))
    return docs.select("doc_id", F.array_join(F.expr(A.assign_categories("hits", "patterns")), "|").alias("categories"))


_W = " ".join(f"WHEN '{k}' THEN {w}" for k, w in A.TYPE_WEIGHT.items())
_C = " ".join(f"WHEN '{k}' THEN {w}" for k, w in A.TYPE_CAP.items())


@query(
    "rule_score",
    f"""WITH {_MATCHED}, ht AS (SELECT doc_id, ktype, least(sum((CASE ktype {_W} END) * (1 + 0.2 * (least(count, 3) - 1))), max(CASE ktype {_C} END)) AS v,
      count(*) AS k FROM h GROUP BY ALL),
    tv AS (SELECT doc_id, sum(v) AS v, coalesce(sum(k) FILTER (ktype = 'E'), 0) AS e, coalesce(sum(k) FILTER (ktype = 'M'), 0) AS m,
      coalesce(sum(k) FILTER (ktype = 'C'), 0) AS c FROM ht GROUP BY doc_id),
    pb AS (SELECT doc_id, c, max(score) AS s FROM (SELECT doc_id, unnest(string_split(category, '|')) AS c, score FROM pm) GROUP BY ALL),
    pv AS (SELECT doc_id, sum(s * 0.6) AS v FROM pb GROUP BY doc_id)
    SELECT d.doc_id, CAST(round(greatest(0, coalesce(tv.v, 0) + coalesce(pv.v, 0) + CASE WHEN e >= 3 THEN 4 ELSE 0 END
      + CASE WHEN m >= 2 AND c >= 1 AND e >= 1 AND pv.v IS NULL THEN least(30, 12 + 4 * (m - 2) + 3 * least(e, 3)) ELSE 0 END
      + CASE WHEN m >= 3 AND c >= 2 THEN 8 ELSE 0 END), 2) AS DOUBLE) AS rule_score
    FROM d LEFT JOIN tv USING (doc_id) LEFT JOIN pv USING (doc_id)""",
)
def _(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "doc_id", F.expr(A.rule_score("hits", "patterns", "0", "false", "0D", "CAST(NULL AS double)")).alias("rule_score")
    )


@query(
    "known_case_match",
    """SELECT d.doc_id, b.item_id, CASE WHEN d.text = b.text THEN 'EQUAL' WHEN contains(d.text, b.text) THEN 'QUOTES' ELSE 'PART_OF' END AS relation
    FROM documents d JOIN benchmark b ON contains(d.text, b.text) OR contains(b.text, d.text)
    WHERE length(d.text) >= 24 AND length(b.text) >= 24""",
)
def _(spark, sf_dir):
    return R.known_case_match(read_table(spark, sf_dir, "documents", "doc_id"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


CASE_ENTITY = "[A-Z][a-z]{3,}"


@query(
    "known_case_keys",
    f"""WITH e AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{CASE_ENTITY}')) AS text FROM documents),
    k AS (SELECT DISTINCT item_id AS case_id, unnest(regexp_extract_all(text, '[A-Za-z]{{2,40}}')) AS key FROM benchmark),
    kk AS (SELECT * FROM k WHERE regexp_full_match(key, '[A-Z][a-z]{{1,39}}')),
    p AS (SELECT t.text, q.key FROM (SELECT DISTINCT text FROM e) t, (SELECT DISTINCT key FROM kk) q WHERE contains(t.text, q.key) OR contains(q.key, t.text)),
    m AS (SELECT e.doc_id, kk.case_id, e.text, min(CASE WHEN e.text = kk.key THEN 0 WHEN contains(e.text, kk.key) THEN 1 ELSE 2 END) AS near
      FROM e JOIN p USING (text) JOIN kk USING (key) GROUP BY ALL)
    SELECT doc_id, case_id, array_to_string(list_sort(list(text)), '|') AS matched_keys, CAST(count(*) AS BIGINT) AS n_keys,
      ['EQUAL', 'CONTAINS', 'PART_OF'][min(near) + 1] AS relation FROM m GROUP BY doc_id, case_id""",
)
def _(spark, sf_dir):
    """Capitalised names of every document against those of every case, 2 to 40 characters long, in both directions."""
    docs = read_table(spark, sf_dir, "documents", "doc_id")
    entities = X.extract_entities(docs, [("NAME", CASE_ENTITY)], facts=False)
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,40}"), F.lit(0)))
    keys = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("case_id"), F.lit("NAME").alias("type"), words.alias("key"))
    found = CS.match_case_keys(entities, keys.filter("key RLIKE '^[A-Z][a-z]+$'"))
    return found.withColumn("matched_keys", F.array_join("matched_keys", "|"))


@query(
    "novelty_score",
    f"""WITH {O_DOCS}, k AS (SELECT DISTINCT d.doc_id FROM d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) >= 24),
    f AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM k) AS known, contains(t, 'token') AS ev, contains(t, 'than') AS oldish FROM d)
    SELECT doc_id, known, CAST(CASE WHEN known THEN CASE WHEN ev THEN 5 ELSE 0 END WHEN oldish THEN CASE WHEN ev THEN 5 ELSE 0 END ELSE 10 END AS DOUBLE) AS novelty FROM f""",
)
def _(spark, sf_dir):
    docs = prepared(spark, sf_dir)
    matches = R.known_case_match(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("relation <> 'PART_OF'")
    flags = docs.select("doc_id", "norm").join(R.known_flags(docs, matches), "doc_id")
    return flags.select("doc_id", "known", F.expr(S.novelty_score("known", "false", "contains(norm, 'token')", "false", "contains(norm, 'than')")).alias("novelty"))


BULK = ["license", "version", "released", "apache", "gnu"]


@query(
    "promo_filter",
    f"""WITH {O_DOCS}, m AS (SELECT doc_id, [x FOR x IN {BULK} IF contains(t, x)] AS m, contains(t, 'token') AS sig FROM d)
    SELECT doc_id, array_to_string(m, '|') AS markers, len(m) >= 3 OR (len(m) >= 2 AND NOT sig) AS is_promo FROM m""",
)
def _(spark, sf_dir):
    found = NG.promo_filter(prepared(spark, sf_dir), "norm", BULK, "contains(norm, 'token')")
    return found.withColumn("markers", F.array_join("markers", "|"))


@query(
    "bulk_mail_filter",
    f"""WITH {O_DOCS}, m AS (SELECT doc_id, [x FOR x IN ['license', 'version'] IF contains(t, x)] AS m, contains(t, 'apache') AS wide,
      doc_id % 7 IN (0, 3) AS listed, CAST(doc_id % 101 AS DOUBLE) AS s FROM d),
    b AS (SELECT *, (listed AND len(m) > 0) OR (len(m) >= 2 AND wide) AS is_bulk FROM m)
    SELECT doc_id, is_bulk, array_to_string(m, '|') AS signals, CASE WHEN is_bulk THEN least(s, 15.0) ELSE s END AS score FROM b""",
)
def _(spark, sf_dir):
    docs = prepared(spark, sf_dir).select(
        "doc_id", "norm", F.expr("concat('desk', doc_id, '@mail.host', doc_id % 7, '.example.com')").alias("sender"),
        F.expr("cast(doc_id % 101 AS double)").alias("score"),
    )
    domains = spark.createDataFrame([("host0.example.com",), ("mail.host3.example.com",)], "domain string")
    found = NG.bulk_mail_filter(docs, domains, ["license", "version"], ["apache"], "norm")
    return found.withColumn("signals", F.array_join("signals", "|"))


@query(
    "no_new_information",
    f"""WITH {O_DOCS} SELECT doc_id, (contains(t, 'than') OR contains(t, 'then')) AND (contains(t, 'this') OR contains(t, 'that'))
      AND NOT contains(t, 'token') AS no_new FROM d""",
)
def _(spark, sf_dir):
    rule = NG.no_new_information("norm", "false", "contains(norm, 'token')", ["than", "then"], ["this", "that"])
    return prepared(spark, sf_dir).select("doc_id", F.expr(rule).alias("no_new"))


# --- whole job ------------------------------------------------------------------
def _triaged(spark, sf_dir):
    return TR.triage(read_table(spark, sf_dir, "documents", "doc_id"), K.demo_pack(spark).compile())


def triage_ctes(novelty: str = "10", stage: str = "0", bulk: str = "FALSE") -> str:
    """Common table expressions of the whole triage of ``documents`` with the demo pack; the last is ``t``.

    No amounts and no markers of old news occur in the documents.
    """
    terms = sql_values([(p, g, n, x) for p, _, g, n, x, k, *_ in K.DEMO_PATTERNS if k == "term"], ["pattern_id", "group_no", "term_no", "term"])
    exclusions = _exclusion_sql().removeprefix(f"{O_DOCS}, ")
    negatives = []
    for rid, require, n, also, forbid, types, flags, delta, cap in K.DEMO_NEGATIVES:
        cond = ["(" + " + ".join(f"CAST(contains(t, '{x}') AS INT)" for x in require) + f") >= {n}"]
        if also:
            cond.append("(" + " OR ".join(f"contains(t, '{x}')" for x in also) + ")")
        cond += [f"NOT contains(t, '{x}')" for x in forbid]
        cond += [f"doc_id NOT IN (SELECT doc_id FROM hx WHERE ktype = '{k}')" for k in types]
        cond += ["FALSE" for f in flags if f == "amounts"]
        negatives.append(f"SELECT doc_id, '{rid}' AS rule_id, CAST({delta} AS DOUBLE) AS delta, CAST({'NULL' if cap is None else cap} AS DOUBLE) AS cap FROM d WHERE {' AND '.join(cond)}")
    return f"""{_P_CTE}, pm AS (SELECT r.doc_id, r.pattern_id, p.category, CAST(p.score AS DOUBLE) AS score, r.level, r.window_no FROM r JOIN p USING (pattern_id) WHERE rn = 1),
    gt AS {terms}, pt AS (SELECT pm.doc_id, gt.term, row_number() OVER (PARTITION BY pm.doc_id, pm.pattern_id, gt.group_no ORDER BY gt.term_no) AS n FROM pm
      JOIN w ON w.doc_id = pm.doc_id AND w.level = pm.level AND w.window_no = pm.window_no JOIN gt ON gt.pattern_id = pm.pattern_id AND contains(w.x, gt.term)),
    {O_SURF}, {O_HITS}, {exclusions},
    hx AS (SELECT h.doc_id, h.surface, h.ktype, h.category, coalesce(ex.kept, h.count) AS count FROM h LEFT JOIN ex ON ex.doc_id = h.doc_id AND ex.term = h.surface
      WHERE coalesce(ex.kept, h.count) > 0),
    n AS ({' UNION ALL '.join(negatives)}),
    ng AS (SELECT doc_id, sum(delta) AS delta, min(cap) AS cap, string_agg(rule_id, '|' ORDER BY rule_id) AS ids FROM n GROUP BY doc_id),
    pc AS (SELECT doc_id, unnest(string_split(category, '|')) AS c FROM pm UNION SELECT hx.doc_id, hx.category FROM hx JOIN pt ON pt.doc_id = hx.doc_id AND pt.term = hx.surface
      WHERE pt.n = 1 AND ktype = 'C'),
    hs AS (SELECT doc_id, category AS c, sum(count) AS n FROM hx WHERE ktype = 'H' GROUP BY ALL),
    me AS (SELECT doc_id, category AS c, sum(count) AS n FROM hx WHERE ktype IN ('M', 'E') GROUP BY ALL),
    cs AS (SELECT doc_id, category AS c, sum(count) AS n FROM hx WHERE ktype = 'C' GROUP BY ALL),
    nh AS (SELECT doc_id, count(*) AS k FROM hs GROUP BY doc_id),
    rr AS (SELECT doc_id, c, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, c) AS rn FROM me ANTI JOIN hs USING (doc_id, c)),
    np AS (SELECT doc_id, c, 0 AS part, -n AS o FROM hs UNION ALL SELECT rr.doc_id, c, 1, -n FROM rr LEFT JOIN nh USING (doc_id) WHERE rn <= 3 - coalesce(k, 0)),
    cf AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, c) AS rn, -n AS o FROM cs),
    ac AS (SELECT doc_id, c, 0 AS part, 0 AS o FROM pc UNION ALL SELECT doc_id, c, part, o FROM np ANTI JOIN pc USING (doc_id)
      UNION ALL SELECT doc_id, c, 2, o FROM cf ANTI JOIN pc USING (doc_id) ANTI JOIN np USING (doc_id) WHERE rn <= 2),
    ca AS (SELECT doc_id, string_agg(c, '|' ORDER BY part, o, c) AS categories, count(*) AS n_cat FROM ac GROUP BY doc_id),
    ht AS (SELECT doc_id, ktype, least(sum((CASE ktype {_W} END) * (1 + 0.2 * (least(count, 3) - 1))), max(CASE ktype {_C} END)) AS v, count(*) AS k FROM hx GROUP BY ALL),
    tv AS (SELECT doc_id, sum(v) AS v, coalesce(sum(k) FILTER (ktype = 'H'), 0) AS n_h, coalesce(sum(k) FILTER (ktype = 'E'), 0) AS e,
      coalesce(sum(k) FILTER (ktype = 'M'), 0) AS m, coalesce(sum(k) FILTER (ktype = 'C'), 0) AS c FROM ht GROUP BY doc_id),
    pb AS (SELECT doc_id, c, max(score) AS s FROM (SELECT doc_id, unnest(string_split(category, '|')) AS c, score FROM pm) GROUP BY ALL),
    pv AS (SELECT doc_id, sum(s * 0.6) AS v FROM pb GROUP BY doc_id),
    pl AS (SELECT doc_id, string_agg(pattern_id, '|' ORDER BY pattern_id) AS patterns, max(score) AS best FROM pm GROUP BY doc_id),
    b AS (SELECT d.doc_id, categories, coalesce(n_cat, 0) AS n_cat, patterns, best, ids, coalesce(delta, 0) AS delta, cap, coalesce(n_h, 0) AS n_h, coalesce(e, 0) AS e, coalesce(c, 0) AS c,
      round(greatest(0, least(coalesce(tv.v, 0) + coalesce(pv.v, 0) + CASE WHEN e >= 3 THEN 4 ELSE 0 END
        + CASE WHEN m >= 2 AND c >= 1 AND e >= 1 AND pv.v IS NULL THEN least(30, 12 + 4 * (m - 2) + 3 * least(e, 3)) ELSE 0 END
        + CASE WHEN m >= 3 AND c >= 2 THEN 8 ELSE 0 END + coalesce(delta, 0), coalesce(cap, 1e9))), 2) AS rule_score
      FROM d LEFT JOIN tv USING (doc_id) LEFT JOIN pv USING (doc_id) LEFT JOIN ng USING (doc_id) LEFT JOIN ca USING (doc_id) LEFT JOIN pl USING (doc_id)),
    dm AS (SELECT *, least(20, CASE WHEN n_h >= 3 THEN 17 WHEN n_h = 2 THEN 15 WHEN n_h = 1 THEN 12 ELSE 0 END + CASE WHEN patterns IS NOT NULL THEN 3 ELSE 0 END)
      + 2 + CASE WHEN e >= 3 THEN 12 WHEN e >= 1 THEN 8 ELSE 0 END + CASE WHEN c >= 2 THEN 12 WHEN c = 1 THEN 8 ELSE 0 END + CASE WHEN n_cat >= 2 THEN 3 ELSE 0 END + {novelty}
      + CASE WHEN rule_score >= 90 THEN 35 WHEN rule_score >= 70 THEN 20 WHEN rule_score >= 45 THEN 10 ELSE 0 END AS total,
      least(CASE WHEN rule_score < 45 THEN 38 WHEN rule_score < 70 THEN 65 WHEN rule_score < 90 THEN 80 ELSE 100 END, coalesce(cap, 100), CASE WHEN {bulk} THEN 15 ELSE 100 END) AS gate FROM b JOIN d USING (doc_id)),
    sc AS (SELECT *, greatest(0, least(100, round_even(least(total + {stage} + delta, gate), 0))) AS score FROM dm),
    t AS (SELECT *, CASE WHEN score >= 90 THEN 'S' WHEN score >= 75 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END AS band FROM sc)"""


@query(
    "triage_documents",
    f"""WITH {triage_ctes()} SELECT doc_id, coalesce(categories, '') AS categories, coalesce(patterns, '') AS patterns, coalesce(ids, '') AS negatives,
      CAST(rule_score AS DOUBLE) AS rule_score, CAST(total AS DOUBLE) AS total, CAST(score AS DOUBLE) AS score, band,
      CASE WHEN rule_score >= 60 THEN 'SCORE' WHEN best >= 70 THEN 'PATTERN' END AS escalation FROM t""",
)
def _(spark, sf_dir):
    """Every signal of every document; lists are shown as text."""
    return _triaged(spark, sf_dir).select(
        "doc_id", F.array_join("categories", "|").alias("categories"), F.expr("array_join(transform(patterns, _p -> _p.pattern_id), '|')").alias("patterns"),
        F.expr("array_join(transform(negatives, _n -> _n.rule_id), '|')").alias("negatives"), "rule_score", "total", "score", "band", "escalation",
    )


KNOWN = "doc_id IN (SELECT x.doc_id FROM documents x JOIN benchmark y ON contains(x.text, y.text) WHERE length(y.text) >= 24)"


@query(
    "triage_in_context",
    "WITH " + triage_ctes(
        f"CASE WHEN NOT {KNOWN} THEN 10 WHEN e > 0 THEN 5 ELSE 0 END",
        "CASE WHEN lang = 'de' THEN 8 WHEN lang = 'fr' AND e > 0 THEN -8 WHEN lang = 'fr' THEN -25 ELSE 0 END",
        "contains(t, 'license') AND contains(t, 'released')",
    ) + " SELECT doc_id, CAST(total AS DOUBLE) AS total, CAST(score AS DOUBLE) AS score, band FROM t",
)
def _(spark, sf_dir):
    """Triage with known cases from ``benchmark``, an evidence stage and a cap on notices."""
    docs = read_table(spark, sf_dir, "documents", "doc_id")
    matches = R.known_case_match(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("relation <> 'PART_OF'")
    known = R.known_flags(docs, matches).select("doc_id", "known")
    markers = "contains(norm, 'license') AND contains(norm, 'released')"
    context = TR.Context(known="known", stage="CASE lang WHEN 'de' THEN 'E3' WHEN 'fr' THEN 'EX' ELSE '' END", bulk=markers)
    out = TR.triage(docs.join(known, "doc_id"), K.demo_pack(spark).compile(), context=context)
    return out.select("doc_id", "total", "score", "band")


@query("triage_summaries")
def _(spark, sf_dir):
    """The summary line of every document."""
    return _triaged(spark, sf_dir).select("doc_id", "summary")


@query(
    "triage_bands",
    f"WITH {triage_ctes()} SELECT band, CAST(count(*) AS BIGINT) AS n_docs, round(CAST(avg(rule_score) AS DOUBLE), 4) AS avg_rule_score FROM t GROUP BY band",
)
def _(spark, sf_dir):
    return TR.band_summary(_triaged(spark, sf_dir))


@query("two_track_records")
def _(spark, sf_dir):
    """Both tracks of every document, fused."""
    docs = read_table(spark, sf_dir, "documents", "doc_id")
    out = RC.two_track_records(docs, K.demo_pack(spark).compile(), K.demo_complaint_pack(spark).compile())
    lists = {c for c, t in out.dtypes if t.startswith("array")}
    return out.select(*(F.array_join(c, "|").alias(c) if c in lists else F.col(c) for c in out.columns))


NOTICES = (
    "concat('本社区', CASE WHEN o_orderkey % 3 = 0 THEN '停电' ELSE '停水' END, '反复发生。', '影响约', o_custkey % 900 + 1, '户，已', o_orderkey % 60 + 1, '天。"
    "\n损失', cast(floor(o_totalprice) AS string), '元，投诉', o_orderkey % 9 + 1, '次', CASE WHEN o_orderkey % 4 = 0 THEN '仍未改善' ELSE '' END)"
)


@query(
    "complaint_triage",
    """WITH m AS (SELECT o_orderkey AS doc_id, CAST(o_custkey % 900 + 1 AS DOUBLE) AS population, CAST(o_orderkey % 60 + 1 AS DOUBLE) AS duration_days,
      CAST(floor(o_totalprice) AS DOUBLE) AS money_loss, CAST(greatest(o_orderkey % 9 + 1, 3) AS DOUBLE) AS frequency FROM orders)
    SELECT doc_id, population, duration_days, money_loss, frequency, 'G08' AS categories, 'GP05' AS patterns FROM m""",
)
def _(spark, sf_dir):
    """Measures and categories found in complaint notices that are written from orders."""
    docs = read_table(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), F.expr(NOTICES).alias("text"))
    out = RC.complaint_triage(docs, K.demo_complaint_pack(spark).compile())
    return out.select(
        "doc_id", "population", "duration_days", "money_loss", "frequency", F.array_join("categories", "|").alias("categories"),
        F.expr("array_join(transform(patterns, _p -> _p.pattern_id), '|')").alias("patterns"),
    )


MINIMUM = ["worthless", "stupid", "idiot", "trash", "clown", "disgusting", "license", "token", "that", "with"]


@query(
    "band_of_rule_score",
    f"""WITH {O_DOCS}, h AS (SELECT doc_id, x, {o_count('t', 'x')} AS c FROM d, (SELECT unnest({MINIMUM}) AS x) WHERE contains(t, x)),
    s AS (SELECT doc_id, round(least(60, sum(14 * (1 + 0.2 * (least(c, 3) - 1)))), 2) AS s FROM h GROUP BY doc_id),
    b AS (SELECT CASE WHEN coalesce(s, 0) >= 90 THEN 'S' WHEN s >= 75 THEN 'A' WHEN s >= 60 THEN 'B' WHEN s >= 40 THEN 'C' ELSE 'D' END AS band,
      coalesce(s, 0) AS s FROM d LEFT JOIN s USING (doc_id))
    SELECT band, CAST(count(*) AS BIGINT) AS n_docs, round(CAST(sum(s) AS DOUBLE), 2) AS total FROM b GROUP BY band""",
)
def _(spark, sf_dir):
    """The shortest whole path: clean, match ten terms, score, band, count."""
    pack = "array(" + ", ".join(
        f"named_struct('surface', '{w}', 'term', '{w}', 'ktype', 'H', 'category', 'C01', 'stage', '')" for w in MINIMUM
    ) + ")"
    docs = prepared(spark, sf_dir).withColumn("hits", F.expr(R.hits_sql("norm", pack)))
    scored = docs.select(F.round(F.expr(A.type_score("hits", "H")), 2).alias("s")).withColumn("band", F.expr(S.band("s")))
    return scored.groupBy("band").agg(F.count("*").alias("n_docs"), F.round(F.sum("s"), 2).alias("total"))
