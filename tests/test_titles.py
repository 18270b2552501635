"""Title cases, as rows of one table through T2-T9."""

from cases import TITLE_CASES

from loomdown.operators.nodes import build_nodes
from loomdown.operators.titles import page_titles


def test_title_cases(spark, opts):
    df = spark.createDataFrame([(a, b) for a, b, _ in TITLE_CASES], "page_id long, html string")
    got = {r.page_id: r.title for r in page_titles(build_nodes(df, opts)).collect()}
    for case_id, _, expected in TITLE_CASES:
        assert got.get(case_id) == expected, (case_id, got.get(case_id), expected)


def _titles(spark, opts, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return {r.page_id: (r.title, r.source) for r in page_titles(build_nodes(df, opts)).collect()}


def test_headings_and_meta(spark, opts):
    """The first usable of three h1; T8: og:title before twitter:title, property before name."""
    meta = '<meta {a}="{n}" content="{c}">'.format
    got = _titles(spark, opts, [
        "<h1>Gemini</h1><h1> Bread at high altitude </h1><h1>Third</h1>",
        "<h1>Gemini</h1><h1></h1><h1>Chats</h1><h1>Too late</h1>" + meta(a="property", n="twitter:title", c="Second choice"),
        meta(a="name", n="og:title", c="By name") + meta(a="property", n="og:title", c="By property - ChatGPT") + meta(a="property", n="twitter:title", c="Other"),
        meta(a="name", n="twitter:title", c="Fence posts") + meta(a="property", n="og:title", c=""),
        meta(a="name", n="description", c="No title"),
    ])
    assert got == {0: ("Bread at high altitude", "h1"), 1: ("Second choice", "meta"), 2: ("By property", "meta"), 3: ("Fence posts", "meta")}


def test_many_active_items(spark, opts):
    """T3/T4 on a page with 10,000 active items: only the first five of each of the first containers are read."""
    names = "".join(f'<a class="active">{"Chats" if k < 4 else f"Item {k}"}</a>' for k in range(10_000))
    late = '<aside><b class="active">Chats</b></aside>' * 5 + f"<nav>{names}</nav>"  # the sixth container counts no more
    roles = f'<div role="complementary">{"".join(chr(60) + "i class=current>Gemini</i>" for _ in range(5))}<i class="current">Sixth item</i></div><p role="navigation">{names}</p>'
    nested = f'<aside class="active">Chats<nav>{names}</nav></aside>'
    got = _titles(spark, opts, [f"<aside>{names}</aside>", late, roles, nested, late + roles])
    assert got == {0: ("Item 4", "class"), 2: ("Item 4", "role"), 3: ("Item 4", "class"), 4: ("Item 4", "role")}
