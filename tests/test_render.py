"""Lists, tables and paragraphs in the Markdown contract."""

from loomdown.operators.chrome import clean_page
from loomdown.operators.markdown import render
from loomdown.operators.nodes import build_nodes
from loomdown.plans.materialize import materialize
from pyspark.sql import functions as F

CASES = {
    "<ul><li><p>one</p></li><li><p>two</p><p>more</p></li></ul>": "- one\n\n- two\n\n  more",
    "<ol><li><p>first</p></li><li>second<ul><li><p>inner</p></li></ul>tail</li></ol>": "1. first\n\n2. second\n\n  - inner\n\n  tail",
    "<ul><li></li></ul><p>after</p>": "after",
    "<ul><li><pre>x = 1</pre></li></ul>": "- ```\n  x = 1\n  ```",
    "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>x|y</td></tr></table>": "| a | b |\n| --- | --- |\n| 1 | x\\|y |",
    "<table><tr><td>1</td><td></td></tr></table><table><tr><td>2</td></tr></table>": "| 1 | |\n| --- | --- |\n\n| 2 |\n| --- |",
    "<table><tr><td><p>wide</p></td><td>cell</td></tr></table>": "wide\n\ncell",
    "<p>a|b</p>": "a|b",
    "<p>press <kbd>Esc</kbd>, read <samp>log</samp>, <del>out</del> <s>old</s><del> </del></p>": "press `Esc`, read `log`, ~~out~~ ~~old~~",
    '<table><tr><td colspan="2">both</td><td>c</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>': "| both | | c |\n| --- | --- | --- |\n| 1 | 2 | 3 |",
    "<table><tr><td>a</td><td colspan=3><b>x|y</b></td></tr></table>": "| a | **x\\|y** | | |\n| --- | --- | --- | --- |",
    "<table><tr><td colspan=0>a</td><td colspan=none>b</td></tr></table>": "| a | b |\n| --- | --- |",
    "<blockquote><table><tr><td>q</td></tr></table></blockquote>": "> | q |\n> | --- |",
}


def test_render_contract(spark, opts):
    df = spark.createDataFrame([(i, f"<main>{h}</main>") for i, h in enumerate(CASES)], "page_id long, html string")
    rows = materialize(clean_page(materialize(build_nodes(df, opts)), opts).where(F.col("in_region")))
    got = {r.page_id: r.markdown for r in render(rows, opts, with_languages=False).collect()}
    want = dict(enumerate(CASES.values()))
    code = next(i for i, w in want.items() if "```" in w)
    assert got.pop(code).replace("```text", "```").replace("```plaintext", "```") == want.pop(code)
    assert got == want
