"""E2 phrase extraction: phrase x page -> first text hit (J1) -> message container (J2) -> answer block (J3) -> clean
(F13) -> Markdown (R1, R5) -> tags and words (L7, R7) -> title from the phrase (T10, J6); and J4 on parsed turns.

Physical notes
* A request is (page, phrase): phrases are asked on a page, as in the interactive tool. J1 goes through an n-gram index of
  the page's strings (``operators.phrases``): no cross join, and no string is tested that lacks the phrase's rarest gram.
* J2 is read off the nesting walk, whose stack holds every token's ancestors; J3 is a reverse running window (nearest following
  qualifying div). No range joins. Only rows that can hold a hit, a container or a div's end are sorted for it.
* The node table is kept without what answers do not read, and each string once (``answer_nodes``).
* An answer block's rows are fetched by exploding its position range and equi-joining on (page_id, pos).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdown.functions import constants as K
from loomdown.functions import text as T
from loomdown.operators.chrome import drop_subtrees, element_measure, with_live
from loomdown.operators.markdown import RENDER_COLS, render, with_piece
from loomdown.operators.nodes import without_closes
from loomdown.operators.phrases import answerable, first_hits
from loomdown.plans.materialize import materialize

ORDER = ["pos", "ord", "sub"]
TITLE_SALTS = 32

MESSAGES = {
    "ok": "Extraction successful.",
    "phrase_not_found": "Phrase not found in the document.",
    "no_container": "Could not determine message container.",
    "no_answer": "Found question, but couldn't isolate the AI answer.",
    "empty": "Nothing to export: empty Markdown.",
    "missing": "File not found.",
    "bad_encoding": "Failed to read file — encoding issue.",
}


def message_of(status) -> F.Column:
    m = F.create_map(*[x for k, v in MESSAGES.items() for x in (F.lit(k), F.lit(v))])
    return m[status]


def phrase_hits(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """(page_id, phrase_id, hit) = first node (document order, before clean-up) whose string contains the phrase,
    case-insensitively. Every string counts: text, title/script/style bodies, comments, declarations."""
    return first_hits(_searched(nodes.select("page_id", "pos", "ord", F.col("any_text").alias("string"))), requests)


def _searched(strings: DataFrame) -> DataFrame:
    return strings.where((F.col("ord") == 0) & F.col("string").isNotNull()).select("page_id", "pos", F.col("string").alias("text"))


def answer_nodes(nodes: DataFrame) -> DataFrame:
    """What page answers read of the node table: the renderer's columns, the containers, ``plen`` = length of the stripped text, and
    ``other`` = a searched string that is not the row's text. Text rows would hold their text three times."""
    other = F.when(F.col("text").isNull(), F.col("any_text"))
    return without_closes(nodes).select(*RENDER_COLS, "box", other.alias("other"), F.length("piece").alias("plen"))


def answer_places(nodes: DataFrame) -> DataFrame:
    """The rows of ``answer_nodes`` that J1-J3 look at: those with a string, containers, and ends of divs."""
    string = F.coalesce("text", "other").isNotNull()
    box = F.when(F.col("ord") == 0, F.col("tag").isin(K.CONTAINER_TAGS)).otherwise(F.col("tag") == "div")
    return nodes.where(string | box)


def container_and_answer(nodes: DataFrame) -> DataFrame:
    """Per token row: ``cont`` = innermost enclosing div/li/article/section (J2, the walk's ``box``) and ``next_div`` = first later
    div with more than 20 stripped characters (J3), on the original tree."""
    n = element_measure(with_live(nodes), F.coalesce(F.col("plen"), F.lit(0)), "_tlen")
    qual = (F.col("ord") == 0) & (F.col("kind") == "open") & (F.col("tag") == "div") & (F.col("_tlen") > K.ANSWER_MIN_TEXT)
    rev = Window.partitionBy("page_id").orderBy(*[F.col(c).desc() for c in ORDER]).rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("next_div", F.last(F.when(qual, F.struct(F.col("pos").alias("apos"), F.col("end").alias("aend"))), ignorenulls=True).over(rev))
    return n.withColumn("cont", F.col("box")).drop("_tlen", "live")


def page_answers(nodes: DataFrame, requests: DataFrame, opts, titles: DataFrame | None = None) -> DataFrame:
    """One row per request (phrase_id, page_id, phrase) that is not blank: status, message, title, file_name, markdown, word_count, tags."""
    requests = materialize(answerable(requests).select("page_id", "phrase_id", "phrase"), opts.materialize)
    nodes = materialize(answer_nodes(nodes), opts.materialize)
    # the nodes are dealt by page, and the pages' requests come to them
    strings = _searched(nodes.select("page_id", "pos", "ord", F.coalesce("text", "other").alias("string")))
    hits = materialize(first_hits(strings, requests), opts.materialize, readers=1)
    ca = materialize(container_and_answer(answer_places(nodes)).where(F.col("ord") == 0).select("page_id", "pos", "cont", "next_div"), opts.materialize)
    h = hits.join(ca.select("page_id", F.col("pos").alias("hit"), "cont"), ["page_id", "hit"], "left")
    h = h.join(ca.select("page_id", F.col("pos").alias("cont"), "next_div"), ["page_id", "cont"], "left")
    # one small row a request; read by several branches below, each of which would else search the strings again
    h = materialize(h.select("page_id", "phrase_id", "hit", "cont", F.col("next_div.apos").alias("apos"), F.col("next_div.aend").alias("aend")), opts.materialize)
    # answer blocks: explode their position range, equi-join the node rows (no range join)
    blocks = h.where(F.col("apos").isNotNull()).select("page_id", "apos", "aend").distinct()
    rng = blocks.select("page_id", "apos", "aend", F.explode(F.sequence("apos", F.col("aend") - 1)).alias("pos"))
    # rows before a page's first block or after its last meet none: dropped where they lie, they need not move
    span = blocks.groupBy("page_id").agg(F.min("apos").alias("lo"), F.max("aend").alias("hi"))
    near = nodes.select(*RENDER_COLS).join(span, "page_id").where((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi"))).drop("lo", "hi")
    rows = rng.join(near, ["page_id", "pos"]).where((F.col("ord") == 0) | (F.col("elem") >= F.col("apos")))
    rows = rows.withColumn("page_id", F.struct(F.col("page_id").alias("p"), F.col("apos").alias("a")))
    live = drop_subtrees(with_live(rows), (F.col("kind") != "end") & F.col("tag").isin(K.DROP_TAGS_ANSWER))
    live = live.where("live").drop("aend", "live")
    md = materialize(render(with_piece(live), opts), opts.materialize, readers=1).select(F.col("page_id.p").alias("page_id"), F.col("page_id.a").alias("apos"),
                                                 T.squeeze_blank(F.col("markdown")).alias("markdown"))
    out = with_supplied(requests, titles).join(h, ["page_id", "phrase_id"], "left").join(md, ["page_id", "apos"], "left")
    status = (F.when(F.col("hit").isNull(), "phrase_not_found").when(F.col("cont").isNull(), "no_container")
              .when(F.col("apos").isNull(), "no_answer").when(F.coalesce(F.col("markdown"), F.lit("")) == "", "empty").otherwise("ok"))
    return finish_answers(out.withColumn("status", status), opts)


def with_supplied(requests: DataFrame, titles: DataFrame | None) -> DataFrame:
    """Requests with their ``supplied`` title. A phrase may be asked by a third of all requests: its requests are dealt over
    TITLE_SALTS keys, each title is there once a salt, and only the small request rows are shuffled, not the answers."""
    if titles is None:
        return requests.withColumn("supplied", F.lit(None).cast("string"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(TITLE_SALTS - 1)))
    given = titles.select("phrase", F.col("title").alias("supplied"), salts.alias("salt"))
    salted = requests.withColumn("salt", F.pmod(F.xxhash64("page_id", "phrase_id"), F.lit(TITLE_SALTS)).cast("int"))
    return salted.join(given, ["phrase", "salt"], "left").drop("salt")


def finish_answers(df: DataFrame, opts, also: list[str] | None = None) -> DataFrame:
    """Title (the supplied one, else T10 of the phrase), file name, tags, words and message for answer rows; columns ``also`` stay."""
    title = F.coalesce(F.when(F.col("supplied") != "", F.col("supplied")), T.smart_title(F.col("phrase"), opts))
    ok = F.col("status") == "ok"
    md = F.when(ok, F.col("markdown"))
    return df.select(
        "page_id", "phrase_id", "status", message_of(F.col("status")).alias("message"),
        F.when(ok, title).alias("title"), F.when(ok, T.file_name(title, opts.max_filename_length)).alias("file_name"),
        md.alias("markdown"), F.when(ok, T.word_count(F.col("markdown"))).alias("word_count"),
        F.when(ok, T.auto_tags(F.col("markdown"))).alias("tags"), *(also or []),
    )


def turn_answers(conversations: DataFrame, requests: DataFrame, opts, titles: DataFrame | None = None) -> DataFrame:
    """J4 on parsed turns: first user turn containing the phrase (case-insensitive) -> next assistant turn with more
    than 20 stripped characters; no hit / no such turn -> failed row. The next qualifying turn is a reverse running
    window (linear in the conversation), the phrase look-up the n-gram index of J1. Blank phrases ask nothing."""
    rev = Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, -1)
    qual = (F.col("role") == "assistant") & (F.length(T.strip_ws(F.col("text"))) > K.ANSWER_MIN_TEXT)
    turns = conversations.withColumn("next_ans", F.last(F.when(qual, F.struct("turn", "text")), ignorenulls=True).over(rev))
    users = turns.where(F.col("role") == "user").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("pos"), "text", "next_ans")
    req = materialize(answerable(requests).select("page_id", "phrase_id", "phrase"), opts.materialize)
    found = materialize(first_hits(users, req), opts.materialize)
    met = users.withColumnRenamed("pos", "hit").join(found.select("page_id", "hit").distinct(), ["page_id", "hit"], "left_semi")
    answers = met.groupBy("page_id", "hit").agg(F.min("next_ans").alias("a"))
    hits = materialize(found.join(answers, ["page_id", "hit"]), opts.materialize, readers=1)
    out = with_supplied(req, titles).join(hits, ["page_id", "phrase_id"], "left")
    status = F.when(F.col("hit").isNull(), "phrase_not_found").when(F.col("a").isNull(), "no_answer").otherwise("ok")
    out = out.select("page_id", "phrase_id", "phrase", "supplied", status.alias("status"), F.col("a.text").alias("markdown"),
                     F.col("a.turn").alias("answer_turn"))
    return finish_answers(out, opts, ["answer_turn"])
