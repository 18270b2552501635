"""Table inputs: the driver's parquet tables and tables Spark derives from them (chat pages, phrases, titles)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def chat_pages(conversations: DataFrame) -> DataFrame:
    """Deterministic chat pages built from parsed conversations (one page per conversation).

    Each turn becomes a ``data-message-author-role`` div; some turns carry a code block (class-, label- or
    syntax-detectable) or lists and tables; the page has an aside with an active item for every third conversation, a header, a
    history panel (long for every seventh), a platform heading, a modal and a textarea, chrome inside the region, and one of
    six main-region elements. The ordered concatenation is ``listagg ... within group (order by turn)`` per conversation."""
    esc = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    k = (F.col("conv_id") * 7 + F.col("turn")) % 5
    code = (F.when(k == 0, F.lit('<pre class="language-python"><code>def f(x): return x</code></pre>'))
            .when(k == 1, F.lit("<p>rust code</p><section><pre><code>loop {}</code></pre></section>"))
            .when(k == 2, F.lit("<section><pre><code>SELECT a FROM b</code></pre></section>"))
            .when(k == 3, F.lit("<ul><li><p>one</p><p>more</p></li><li>two<ol><li><p>in <b>bold</b> <kbd>Esc</kbd> <samp>log</samp> <del>out</del> <s>old</s></p></li></ol></li></ul>"
                                "<table><thead><tr><th>k</th><th>v|w</th></tr></thead><tbody><tr><td>a</td><td></td></tr><tr><td colspan=\"2\">both</td></tr></tbody></table>"
                                "<table><tr><th colspan=3>x|y</th><th>z</th></tr></table>"
                                "<table><tr><td><p>wide</p></td><td>cell</td></tr></table>"))
            .otherwise(F.lit("")))
    t = conversations.select("conv_id", "turn", F.concat(
        F.lit('<div data-message-author-role="'), F.col("role"), F.lit('"><p>'), esc, F.lit("</p>"), code, F.lit("</div>")).alias("h"))
    p = t.groupBy("conv_id").agg(F.expr("listagg(h, '') within group (order by turn)").alias("body"))
    cid = F.col("conv_id")
    pf = (F.when(cid % 5 == 0, "ChatGPT").when(cid % 5 == 1, "Gemini").when(cid % 5 == 2, "Google Gemini")
          .when(cid % 5 == 3, "Copilot").otherwise("DeepSeek"))
    region = (F.when(cid % 6 == 0, "main").when(cid % 6 == 1, "bard-sidenav-content").when(cid % 6 == 2, "article")
              .when(cid % 6 == 3, "chat-window-content").when(cid % 6 == 4, "div").otherwise("span"))
    role = F.when(cid % 6 == 4, ' role="main"').otherwise("")
    # one piece of chrome inside the region for every clean-up rule; the guarded ones are long on every eleventh page
    long = F.when(cid % 11 == 0, F.repeat(F.lit("stay "), 1100)).otherwise(F.lit("gone"))
    chrome = F.concat(
        F.lit('<nav>links</nav><button>press</button><svg><text>icon</text></svg><script>var s = 1;</script><div class="toolbar">tools</div>'
              '<a class="copy-link">copy</a><aside>margin</aside><div role="complementary">'), long,
        F.lit('<div role="navigation">inner way</div></div><div role="navigation">'), long, F.lit('</div><div class="sidebar">'), long,
        F.lit('</div><div aria-label="sidebar">'), long,
        F.lit('</div><title>second title</title><div contenteditable="true">draft</div><div role="dialog">ask again</div>'))
    title = F.when(cid % 2 == 0, F.concat(F.lit("Chat "), cid.cast("string"), F.lit(" - "), pf)).otherwise(pf)
    pinned = F.when(cid % 3 == 0, F.concat(F.lit('<a aria-selected="true">Topic '), cid.cast("string"), F.lit(" Pinned Chat</a>"))).otherwise(F.lit(""))
    panel = F.when(cid % 7 == 0, F.repeat(F.lit("keep "), 1100)).otherwise(F.lit("short"))
    html = F.concat(
        F.lit("<html><head><title>"), title, F.lit("</title></head><body>"),
        F.lit("<aside><h1>Chats</h1><a>Old</a>"), pinned, F.lit("</aside>"),
        F.lit('<header>top</header><div class="history-panel">'), panel, F.lit("</div>"),
        F.lit("<"), region, role, F.lit("><h2>"), pf, F.lit("</h2>"), chrome, F.col("body"),
        F.lit('<div class="modal">dialog</div><textarea>ask</textarea></'), region, F.lit("></body></html>"))
    return p.select(F.col("conv_id").alias("page_id"), html.alias("html"))


def phrases(conversations: DataFrame) -> DataFrame:
    """Search requests (phrase_id, page_id, phrase) derived from the turns, each asked on its own conversation's page:
    words 2-4 of the first user turn (kind 1), words 2-4 of a final unanswered user turn (kind 2), and a phrase that
    matches nothing (kind 3). phrase_id = conv_id * 10 + kind."""
    words = F.slice(F.split(F.col("text"), " "), 2, 3)
    u = conversations.where(F.col("role") == "user")
    first = u.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text")).select(
        (F.col("conv_id") * 10 + 1).alias("phrase_id"), F.col("conv_id").alias("page_id"), F.array_join(words, " ").alias("phrase"))
    last_turn = conversations.groupBy("conv_id").agg(F.max_by(F.struct("role", "text", "turn"), "turn").alias("l"),
                                                     F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("fu"))
    last = last_turn.where((F.col("l.role") == "user") & (F.col("l.turn") != F.col("fu"))).select(
        (F.col("conv_id") * 10 + 2).alias("phrase_id"), F.col("conv_id").alias("page_id"),
        F.array_join(F.slice(F.split(F.col("l.text"), " "), 2, 3), " ").alias("phrase"))
    none = conversations.select("conv_id").distinct().select(
        (F.col("conv_id") * 10 + 3).alias("phrase_id"), F.col("conv_id").alias("page_id"), F.lit("zq no such phrase qz").alias("phrase"))
    return first.unionByName(last).where(F.col("phrase") != "").unionByName(none)


def supplied_titles(conversations: DataFrame, phrase_df: DataFrame) -> DataFrame:
    """J6 input (phrase, title): a model-written title stands in as the first sentence of the conversation's system
    turn, for phrases taken from conversations that have one; other phrases have none."""
    from loomdown.functions.text import user_turn_title

    sys_turn = conversations.where(F.col("role") == "system").groupBy("conv_id").agg(F.min_by("text", "turn").alias("sys"))
    p = phrase_df.withColumn("conv_id", F.floor(F.col("phrase_id") / 10))
    return p.join(sys_turn, "conv_id").groupBy("phrase").agg(F.max(user_turn_title(F.col("sys"))).alias("title"))
