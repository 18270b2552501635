"""S7 options and the switches they drive (T12, R1 heading style, F2 strip_buttons, R8 date format, front matter)."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from loomdown.functions import text as T
from loomdown.operators.chrome import clean_page
from loomdown.operators.markdown import render
from loomdown.operators.nodes import build_nodes
from loomdown.plans.materialize import materialize
from loomdown.options import Options, load_options


def test_load_options_defaults_and_values():
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    assert load_options(os.path.join(d, "missing.json")) == Options()
    bad = os.path.join(d, "bad.json")
    with open(bad, "w") as f:
        f.write("{not json")
    assert load_options(bad) == Options()
    good = os.path.join(d, "good.json")
    with open(good, "w") as f:
        json.dump({"version": "3.2.0", "settings": {"heading_style": "SETEXT", "max_filename_length": 20, "smart_titles": False}}, f)
    o = load_options(good)
    assert (o.heading_style, o.max_filename_length, o.smart_titles, o.version) == ("SETEXT", 20, False, "3.2.0")
    assert o.strip_buttons is True


def test_smart_titles_switch(spark):
    df = spark.createDataFrame([("can you explain recursion please",)], "q string")
    on = df.select(T.smart_title(F.col("q"), Options()).alias("t")).first().t
    off = df.select(T.smart_title(F.col("q"), Options(smart_titles=False)).alias("t")).first().t
    assert on == "Recursion" and off == "can you explain recursion please"


def _md(spark, html, opts):
    n = materialize(build_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"), opts))
    return render(materialize(clean_page(n, opts).where("in_region")), opts).first().markdown


def test_heading_styles_and_inline(spark):
    html = ("<main><h1>Top</h1><h2>Sub</h2><h3>Third</h3><p>a <b>bold</b> and <i>it</i> with <code>x</code> "
            "<a href='/u'>link</a><br>next</p><ul><li>one</li><li>two</li></ul><ol><li>first</li><li>second</li></ol>"
            "<blockquote>quoted</blockquote><hr><img alt='pic' src='p.png'></main>")
    atx = _md(spark, html, Options())
    assert atx.startswith("# Top\n\n## Sub\n\n### Third")
    assert "a **bold** and *it* with `x` [link](/u)\nnext" in atx
    assert "- one\n\n- two" in atx and "1. first\n\n2. second" in atx and "> quoted" in atx and "---" in atx
    assert "![pic](p.png)" in atx
    setext = _md(spark, html, Options(heading_style="SETEXT"))
    assert setext.startswith("Top\n===\n\nSub\n---\n\n### Third")


def test_strip_buttons_switch(spark):
    html = "<main><div class='toolbar'>tools</div><a class='copy-btn' href='/c'>copy</a><p>keep</p></main>"
    assert "tools" not in _md(spark, html, Options()) and "copy" not in _md(spark, html, Options())
    off = _md(spark, html, Options(strip_buttons=False))
    assert "tools" in off and "copy" in off


def test_date_format_and_front_matter(spark):
    assert T.spark_date_pattern("%Y-%m-%d") == "yyyy-MM-dd"
    assert T.spark_date_pattern("%d.%m.%Y") == "dd.MM.yyyy"
    with pytest.raises(ValueError):
        T.spark_date_pattern("%Q")
    df = spark.createDataFrame([("T", "body")], "t string, b string")
    tags = F.array(F.lit("ai-chat"), F.lit("python"))
    full = df.select(T.note_text(F.col("t"), F.col("b"), tags, Options(date_format="%d/%m/%Y")).alias("x")).first().x
    assert full == '---\ntitle: "T"\ndate: 01/01/2026\ntags: [ai-chat, python]\nsource: "Local File"\n---\n\n# T\n\nbody'
    bare = df.select(T.note_text(F.col("t"), F.col("b"), tags, Options(include_metadata=False)).alias("x")).first().x
    assert bare == "# T\n\nbody"


def test_merge_target_name(spark):
    df = spark.createDataFrame([("notes",), ("all.md",)], "t string")
    assert [r.x for r in df.select(T.merge_target_name(F.col("t")).alias("x")).collect()] == ["notes.md", "all.md"]
