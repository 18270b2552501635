"""End-to-end plans: non-vacuity on the derived chat pages, every failure kind, merging, oracle agreement."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(df.columns) >= {"page_id", "title", "markdown", "status"}
    assert all(r.status in ("ok", "empty") for r in rows)


def test_chat_notes_non_vacuous(spark):
    rows = E.q_chat_notes(spark, SF01).collect()
    assert any(r.removed_code > 0 for r in rows) and any(r.removed_code == 0 for r in rows)
    assert any("```python" in r.markdown for r in rows) and any("```rust" in r.markdown for r in rows)
    assert any("```sql" in r.markdown for r in rows)
    # chrome is gone: no modal text, textarea text, header or platform heading line
    for r in rows:
        assert "dialog" not in r.markdown and "\nask" not in r.markdown and "top\n" not in r.markdown
        assert "## ChatGPT" not in r.markdown and "## Gemini" not in r.markdown


def test_code_language_rules_all_fire(spark):
    rules = {r.rule for r in E.q_code_languages(spark, SF01).collect()}
    assert rules == {"class", "label", "syntax"}


def test_answer_failure_kinds(spark):
    kinds = {r.status for r in E.q_page_answers(spark, SF01).collect()}
    assert {"ok", "phrase_not_found", "no_answer"} <= kinds
    kinds = {r.status for r in E.q_turn_answers(spark, SF01).collect()}
    assert {"ok", "phrase_not_found", "no_answer"} <= kinds


def test_no_container_and_title_hit(spark, opts):
    from loomdown.operators.nodes import build_nodes
    from loomdown.plans.answers import page_answers

    pages = spark.createDataFrame([(1, "<html><head><title>alpha beta</title></head><body><p>x</p></body></html>"),
                                   (2, "<div><p>hello world question</p></div><div>short</div>")], "page_id long, html string")
    req = spark.createDataFrame([(11, 1, "alpha"), (21, 2, "hello world")], "phrase_id long, page_id long, phrase string")
    got = {r.phrase_id: r.status for r in page_answers(build_nodes(pages, opts), req, opts).collect()}
    assert got == {11: "no_container", 21: "no_answer"}


def test_merged_notes_shape(spark):
    rows = sorted(E.q_merged_notes(spark, SF01).collect(), key=lambda r: (r.page_id, r.phrase_id))
    assert rows[0].piece.startswith("---\ntitle: ") and all(r.piece.startswith("\n\n---\n\n# ") for r in rows[1:])
    assert {r.merge_target for r in rows} == {"All Chats.md"}


def test_note_files_last_wins(spark):
    notes = E._page_notes(spark, SF01)
    dup = notes.groupBy("file_name").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    files = E.q_note_files(spark, SF01)
    j = dup.join(files, "file_name")
    assert j.count() > 0 and j.where("last <> page_id").count() == 0


def _duck(sf):
    con = duckdb.connect()
    for t in ["pages", "conversations", "documents"]:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["html_tokens", "html_nodes", "page_titles", "live_text", "chat_live_text", "chat_titles",
                                  "user_code_removed", "turn_answers", "merged_notes", "heuristic_titles", "turn_tags"])
def test_oracle_match(spark, name):
    con = _duck(SF)
    sdf = E.queries()[name](spark, SF)
    s = sorted(tuple(str(v) for _, v in sorted(r.asDict().items())) for r in sdf.collect())
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    d = sorted(tuple(str(v) for _, v in sorted(zip(cols, row))) for row in res.fetchall())
    assert sorted(sdf.columns) == sorted(cols)
    assert s == d


def _first(strings, phrase):
    return min((pos for pos, text in strings if phrase.lower() in text.lower()), default=None)


def test_phrase_index_equals_scan(spark):
    """Short and long phrases, phrases in other letter case, beyond the basic plane, spanning nothing, repeated requests."""
    import random

    from loomdown.operators.phrases import first_hits

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcÄß\U0001F600 ") for _ in range(rnd.randint(0, 12)))
    pages = {p: [(k, word()) for k in range(rnd.randint(0, 30))] for p in range(12)}
    asked = [(i, rnd.randint(0, 13), rnd.choice([word()[:rnd.randint(0, 5)], "ab", "B", "\U0001F600", "ä", "abc"])) for i in range(400)]
    strings = spark.createDataFrame([(p, k, t) for p, s in pages.items() for k, t in s], "page_id int, pos int, text string")
    got = {r.phrase_id: r.hit for r in first_hits(strings, spark.createDataFrame(asked, "phrase_id int, page_id int, phrase string")).collect()}
    want = {i: _first(pages.get(p, []), t) for i, p, t in asked if t}
    assert got == {i: h for i, h in want.items() if h is not None}
    assert first_hits(strings, spark.createDataFrame([], "phrase_id int, page_id int, phrase string")).count() == 0


def test_ten_thousand_requests_on_one_page(spark, monkeypatch):
    """The index tests a phrase only against strings that hold its rarest gram, and one page's work lies in many tasks."""
    from loomdown.operators import phrases as P

    strings = [(1, k, f"item {k:05d} of the list") for k in range(10_000)]
    asked = [(k, 1, f"ITEM {k:05d} of" if k % 2 else f"item {k}x") for k in range(10_000)]
    s = spark.createDataFrame(strings, "page_id int, pos int, text string")
    r = spark.createDataFrame(asked, "phrase_id int, page_id int, phrase string")
    hits = P.first_hits(s, r)
    got = {x.phrase_id: x.hit for x in hits.collect()}
    assert got == {k: k for k in range(1, 10_000, 2)}
    tested = P.candidates(s, r)
    assert tested.count() < 10_000 * 150  # a scan tests 100,000,000 pairs
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [x["count"] for x in tested.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 4 and max(sizes) < 0.6 * sum(sizes)


def test_blank_phrases_ask_nothing(spark, opts):
    from loomdown.operators.nodes import build_nodes
    from loomdown.plans.answers import page_answers, turn_answers

    req = spark.createDataFrame([(1, 7, " \n"), (2, 7, ""), (3, 7, None), (4, 7, "hello")], "phrase_id long, page_id long, phrase string")
    pages = spark.createDataFrame([(7, "<div><p>hello</p></div>")], "page_id long, html string")
    assert [r.phrase_id for r in page_answers(build_nodes(pages, opts), req, opts).collect()] == [4]
    conv = spark.createDataFrame([(7, 0, "user", "hello"), (7, 1, "assistant", "a" * 30)], "conv_id long, turn long, role string, text string")
    assert [(r.phrase_id, r.status, r.answer_turn) for r in turn_answers(conv, req, opts).collect()] == [(4, "ok", 1)]


def test_many_phrases_on_a_page(spark, opts):
    """A page with 150 requests: hits equal a brute-force scan."""
    from loomdown.operators.nodes import build_nodes
    from loomdown.plans.answers import phrase_hits

    words = [f"w{i:03d}" for i in range(120)]
    html = "<div>" + "".join(f"<p>{' '.join(words[i:i + 10])}</p>" for i in range(0, 120, 10)) + "</div>"
    phrases = [(k, 7, f"{words[k]} {words[k + 1]}") for k in range(119)] + [(1000 + k, 7, f"zz{k}") for k in range(31)]
    pages = spark.createDataFrame([(7, html)], "page_id long, html string")
    req = spark.createDataFrame(phrases, "phrase_id long, page_id long, phrase string")
    got = {r.phrase_id: r.hit for r in phrase_hits(build_nodes(pages, opts), req).collect()}
    # brute force: token positions of the <p> texts (each text node follows its <p> open tag)
    want = {}
    for k in range(119):
        block = k // 10
        if (k + 1) // 10 == block:  # both words inside one paragraph
            want[k] = 2 + 3 * block
    assert got == want
