"""Rows on which text was lost or decoded wrongly once."""

from pyspark.sql import functions as F

from loomdown.functions.text import clean_title, decode_entities, strip_conversation_with
from loomdown.operators.chrome import clean_page
from loomdown.operators.nodes import build_nodes, html_tokens
from loomdown.sources.files import decode_files


def test_tokens_keep_all_text(spark, opts):
    pages = [
        (1, "<main><p>before</p><script>x=1</script" + " " * 60 + "><p>after</p></main>"),
        (2, "<main><a title=it's>don't</a><p>rest</p></main>"),
        (3, "<main><p>one</p><script>never closed <p>two</p></main>"),
        (4, "<main><a title='a > b' href=\"x>y\">three</a></main>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, html string")
    toks = html_tokens(df).orderBy("page_id", "pos").collect()
    for i, html in pages:
        assert "".join(t.tok for t in toks if t.page_id == i) == html
    live = clean_page(build_nodes(df, opts), opts).where(F.col("in_region") & (F.col("ord") == 0) & (F.coalesce(F.col("piece"), F.lit("")) != ""))
    text = {}
    for r in live.orderBy("page_id", "pos").collect():
        text.setdefault(r.page_id, []).append(r.piece)
    assert text[1] == ["before", "after"] and text[2] == ["don't", "rest"] and text[4] == ["three"]
    assert text[3][0] == "one"


def test_entities(spark):
    cases = {"&#00000065;": "A", "&#38;lt;": "&lt;", "caf&eacute; a&rarr;b": "café a→b", "&#x80;&#150;": "€–", "&copy 2020 &amp;amp;": "© 2020 &amp;",
             "&#0;&#x110000;&#99999999999999;": "\ufffd" * 3, "a & b &nosuch; &#; &": "a & b &nosuch; &#; &", "&#65&#x42": "AB"}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    assert {r.c: r.d for r in df.select("c", decode_entities(F.col("c")).alias("d")).collect()} == cases


def test_white_space(spark):
    df = spark.createDataFrame([("My Chat\u00a0- ChatGPT", "## Conversation\u00a0with Gemini\nx")], "t string, m string")
    r = df.select(clean_title(F.col("t")).alias("t"), strip_conversation_with(F.col("m")).alias("m")).first()
    assert (r.t, r.m) == ("My Chat", "\nx")
    f = spark.createDataFrame([("/a.html", None, 1, bytearray(b"a\r\nb\rc"))], "path string, modificationTime timestamp, length long, content binary")
    assert decode_files(f).first().html == "a\nb\nc"
