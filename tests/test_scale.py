"""What lets the page plans grow with their input: rows dealt by page stay where they are, and few phrases need no index."""

from pyspark.sql import functions as F

from loomdown.operators.chrome import clean_page
from loomdown.operators.markdown import prepare_rows, render_prepared, with_piece
from loomdown.operators.nodes import build_nodes, without_closes
from loomdown.operators.phrases import first_hits
from loomdown.operators.titles import page_titles
from loomdown.plans.materialize import WHILE, materialize

HTML = ("<html><head><title>Notes</title></head><body><nav><a class='active'>x</a></nav><main><h1>Head</h1><p>python code</p>"
        "<section><pre><code>x = 1</code></pre></section><ol><li>a <b>b</b></li></ol></main></body></html>")


def _pages(spark):
    return spark.createDataFrame([(i, HTML) for i in range(40)], "page_id long, html string")


def _exchanges(spark, df):
    """Exchanges of the plan as ``materialize`` runs it."""
    before = {k: spark.conf.get(k, "true") for k in WHILE}
    for k, v in WHILE.items():
        spark.conf.set(k, v)
    try:
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_page_rows_are_dealt_once(spark, opts):
    """A table of pages whose key is named page_id already: its nodes keep their partitioning through the checkpoint; clean-up moves only
    the swept intervals (one Exchange), titles and rendering move nothing."""
    nodes = materialize(build_nodes(_pages(spark), opts))
    assert _exchanges(spark, nodes.groupBy("page_id").agg(F.count("*"))) == 0
    assert _exchanges(spark, page_titles(nodes)) == 0
    cleaned = clean_page(nodes, opts)
    moved = cleaned._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression")
    assert _exchanges(spark, clean_page(nodes, opts)) == moved > 0
    rows = materialize(prepare_rows(with_piece(cleaned.where("in_region").drop("piece"))))
    assert _exchanges(spark, render_prepared(rows, opts)) == 0
    assert {r.markdown for r in render_prepared(rows, opts).collect()} == {"# Head\n\npython code\n\n```python\nx = 1\n```\n\n1. a **b**"}


def test_few_phrases_need_no_index(spark):
    """Pages with few phrases are searched without postings of their strings; a busy page beside them goes through the index."""
    strings = spark.createDataFrame([(p, k, f"Line {k} of page {p}") for p in range(6) for k in range(30)], "page_id int, pos int, text string")
    few = [(p * 10 + k, p, f"LINE {k + 5} of") for p in range(6) for k in range(2)]
    asked = spark.createDataFrame(few, "phrase_id int, page_id int, phrase string")
    hits = first_hits(strings, asked)
    assert "gram" not in hits._jdf.queryExecution().analyzed().toString()
    want = {p * 10 + k: k + 5 for p in range(6) for k in range(2)}
    assert {r.phrase_id: r.hit for r in hits.collect()} == want
    busy = [(1000 + k, 3, f"line {k} ") for k in range(25)]
    both = first_hits(strings, spark.createDataFrame(few + busy, "phrase_id int, page_id int, phrase string"))
    assert "gram" in both._jdf.queryExecution().analyzed().toString()
    assert {r.phrase_id: r.hit for r in both.collect()} == want | {1000 + k: k for k in range(25)}


def test_close_tags_carry_nothing(spark, opts):
    """The page plans drop the rows of close tags: notes and labels are the same without them. A label block's text ends at its end
    marker, whatever token lies before it, and an empty block has no text."""
    pages = [(1, HTML, "python"),
             (2, "<main><p>rust</p><p></p><section><pre><code>python x</code></pre></section></main>", "rust"),
             (3, "<main><p>rust <nav>gone</nav><section><pre>x</pre></section></p></main>", "rust")]
    nodes = build_nodes(spark.createDataFrame(pages, "page_id long, html string, lang string"), opts)
    assert without_closes(nodes).where("kind = 'close'").isEmpty() and not nodes.where("kind = 'close'").isEmpty()
    notes = []
    for n in (nodes, without_closes(nodes)):
        rows = materialize(prepare_rows(with_piece(clean_page(materialize(n), opts).where("in_region").drop("piece"))))
        notes.append({r.page_id: r.markdown for r in render_prepared(rows, opts).collect()})
    assert notes[0] == notes[1]
    assert {i: m.split("```")[1].split("\n")[0] for i, m in notes[0].items()} == {i: lang for i, _, lang in pages}


def test_answers_sort_places_only(spark, opts):
    """Rows of other elements and further copies of a string stay out of the search for an answer; places found are the same."""
    from loomdown.plans.answers import answer_nodes, answer_places, container_and_answer

    html = ("<title>T</title><!-- note --><div><p>ask <b>this</b></p><br></div><section><ul><li><i>x</i></li></ul></section>"
            "<div/><div><p>an answer of more than <b>twenty</b> characters</p></div><script>find()</script>")
    nodes = answer_nodes(build_nodes(spark.createDataFrame([(1, html), (2, HTML)], "page_id long, html string"), opts)).cache()
    assert not {"any_text", "piece", "depth", "role"} & set(nodes.columns)
    places = answer_places(nodes)
    assert places.where("tag in ('p', 'b', 'i', 'br', 'ul') or (ord = 1 and tag <> 'div')").isEmpty() and places.count() < 0.7 * nodes.count()
    want, got = ({(r.page_id, r.pos): (r.cont, r.next_div) for r in container_and_answer(n).where("ord = 0").collect()} for n in (nodes, places))
    read = {(r.page_id, r.pos) for r in nodes.where("ord = 0 and (text is not null or other is not null or tag in ('div', 'li', 'article', 'section'))").collect()}
    assert got == {k: want[k] for k in read}
    assert any(v[1] for v in got.values())
