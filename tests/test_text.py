import re

from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.functions import html as H
from siftline.functions import text as T

ENDS = "。！？!?"


def one(spark, sql, text):
    from pyspark.sql import functions as F

    return spark.createDataFrame([(text,)], "text string").select(F.expr(sql)).first()[0]


def sentences(text):
    return [(m.start(), m.end(), m.group(0).strip()) for m in re.finditer(rf"[^{ENDS}\n]+[{ENDS}]?", text) if m.group(0).strip()]


def test_clean(spark):
    got = one(spark, T.clean_text("text"), " a\r\nb\rc\x07 “q” ‘r’　　x​\n\n\n\ny \t z ")
    assert got == "a\nb\nc \"q\" 'r' x\n\ny z"
    assert one(spark, T.clean_text("text"), None) == ""


def test_normalize(spark):
    text = "Ａ，Ｂ Ｃ。 １２ ABC\n\n\nnext、line"
    assert one(spark, T.normalize_text("text"), text) == "ａ ｂ ｃ 12 abc next line"
    assert one(spark, T.normalize_text("text", True), text) == "ａ ｂ ｃ 12 abc\n\nnext line"
    assert one(spark, T.normalize_text("text", fold=("臺萬", "台万")), "臺北 三萬") == "台北 三万"


def test_sentences_and_paragraphs(spark):
    text = "甲。乙！ !x? !\n \nsecond one\nthird"
    got = [tuple(r) for r in one(spark, T.sentences("text"), text)]
    assert got == sentences(text)
    assert one(spark, T.sentence_texts("text"), text) == [s for *_, s in sentences(text)]
    assert [tuple(r) for r in one(spark, T.paragraphs("text"), text)] == [(0, 10, "甲。乙！ !x? !"), (13, 29, "second one\nthird")]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab 。！?\n", max_size=40), min_size=20, max_size=40))
def test_sentences_any_text(spark, texts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", F.expr(T.sentences("text")).alias("s"), F.expr(T.sentence_texts("text")).alias("t")).collect():
        assert [tuple(w) for w in r.s] == sentences(r.text)
        assert r.t == [s for *_, s in sentences(r.text)]


def test_long_text_offsets(spark):
    text = "".join(f"line {i}! " for i in range(500))
    got = [tuple(r) for r in one(spark, T.sentences("text"), text)]
    assert got == sentences(text) and len(got) == 500
    found = one(spark, T.find_occurrences("text", "'line'"), text)
    assert [tuple(r) for r in found] == [m.span() for m in re.finditer("line", text)]


def test_occurrences_do_not_overlap(spark):
    assert [tuple(r) for r in one(spark, T.find_occurrences("text", "'aa'"), "aaaaa")] == [(0, 2), (2, 4)]
    assert one(spark, T.count_occurrences("text", "'aa'"), "aaaaa") == 2
    assert [tuple(r) for r in one(spark, T.find_occurrences("text", "'a.b'"), "a.b axb a.b")] == [(0, 3), (8, 11)]


def test_snippet_and_fit(spark):
    assert one(spark, T.snippet("text", "'x'", 2), "abcxdef") == "…bcxde…"
    assert one(spark, T.fit("text", 5), "a b c d e f g") == "ab…"
    assert one(spark, T.fit("text", 5), "a b c") == "abc"


def test_html_against_a_parser(spark):
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")
            if tag in H.LINE_TAGS.split("|"):
                self.out.append("\n")
            if tag in H.CELL_TAGS.split("|"):
                self.out.append(" | ")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style") and self.skip > 0
            if tag in H.LINE_END_TAGS.split("|"):
                self.out.append("\n")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    def read(page):
        reader = Reader()
        reader.feed(page)
        lines = (re.sub(r"[ \t]+", " ", x).strip(" ") for x in "".join(reader.out).split("\n"))
        return "\n".join(x for x in lines if x)

    from pyspark.sql import functions as F

    made = "<p>a &lt;b&gt; &#65;&#x42; &amp;lt; &nope; <table><tr><td>1</td><th>2</th></tr></table><STYLE>x</STYLE><pre>k</pre>z<br/>q"
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html")
    df = pages.unionByName(spark.createDataFrame([(made,)], "html string"))
    for r in df.select("html", F.expr(H.html_to_text("html")).alias("t")).collect():
        assert r.t == read(r.html)
