"""Scalar rules (T1, T5, T10, T11, T13, L3, L5-L7, R3-R7, N7) on literal rows: hit and near miss."""

import pytest
from pyspark.sql import functions as F

from loomdown.functions import text as T


def one(spark, col_fn, value):
    return spark.createDataFrame([(value,)], "x string").select(col_fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw,expected", [
    ("Merge Sort Explanation - ChatGPT", "Merge Sort Explanation"),
    ("Google Gemini", None),
    ("Chats", None),
    ("Topic 3 Pinned Chat", "Topic 3"),
    ("Overdraft", "Over"),
    ("Conversation with Gemini", None),
    ("Gemini: Hello there", "Hello there"),
    ("Notes 2 days ago", "Notes"),
    ("My Chat | Claude", "My Chat"),
    ("  ", None),
])
def test_clean_title(spark, raw, expected):
    assert one(spark, T.clean_title, raw) == expected


@pytest.mark.parametrize("q,expected", [
    ("can you please explain how to sort in C++?", "Explain How to Sort in C++"),
    ("please can you X", "Can You X"),
    ("only fillers please", "Only Fillers"),
    ("a" * 51, "A" + "a" * 49),
    ("ßtraße is the best way to do it thanks", "Sstraße is the Best Way to Do it"),
    ("what is the SQL for me", "The Sql"),
    ("please", "Please"),
])
def test_heuristic_title(spark, q, expected):
    assert one(spark, lambda c: T.heuristic_title(c, 50), q) == expected


def test_user_turn_title(spark):
    long = "word " * 40
    out = one(spark, T.user_turn_title, long)
    assert out.endswith("…") and len(out) <= 118
    assert one(spark, T.user_turn_title, "How do I sort in C++? Thanks") == "How do I sort in C++"
    assert one(spark, T.user_turn_title, "Gemini") is None


def test_file_name(spark):
    assert one(spark, T.file_name, 'a<b>c:d"e/f\\g|h?i*j k') == "abcdefghij_k.md"
    assert one(spark, T.file_name, " _x_ ") == "x.md"
    assert one(spark, lambda c: T.file_name(c, 5), "abcd efgh") == "abcd_.md"


@pytest.mark.parametrize("code,lang", [
    ("#include <x>", "cpp"), ("std::sort(a)", "cpp"), ("cout << 1", "cpp"), ("int main() {", "cpp"),
    ("def f(x): return x", "python"), ("from a import b", "python"), ("fn f() -> i32 { let x = 1; }", "rust"),
    ("func main() { fmt.Println(1) }", "go"), ("export interface A { a: string }", "typescript"),
    ("console.log(1)", "javascript"), ("SELECT a FROM b", "sql"), ("<div>x</div>", "html"), ("loop {}", ""),
])
def test_syntax_language(spark, code, lang):
    assert one(spark, T.syntax_language, code) == lang


def test_tags(spark):
    assert one(spark, T.auto_tags, "```json\n{}\n```") == ["ai-chat", "javascript"]
    assert one(spark, T.auto_tags, "```ruby\nputs 1") == ["ai-chat", "r", "ruby"]
    assert one(spark, T.auto_tags, "```javascript\nx") == ["ai-chat", "java", "javascript"]
    assert one(spark, T.auto_tags, "we use func here") == ["ai-chat", "go"]
    assert one(spark, T.auto_tags, "plain prose") == ["ai-chat"]


def test_markdown_postprocess(spark):
    from loomdown.plans.full_page import postprocess_full_page

    md = "\n\n## Gemini\n\nHello\n\n\n\n\nConversation with Gemini today\nBye"
    out = one(spark, postprocess_full_page, md)
    assert "Gemini\n" not in out and "Conversation with" not in out and "\n\n\n\n" not in out and not out.startswith("\n")
    assert one(spark, T.word_count, " a  b c\n") == 3


def test_entities(spark):
    assert one(spark, T.decode_entities, "a &amp;lt; &#65;&#x263A; &quot;q&quot;") == 'a &lt; A☺ "q"'
