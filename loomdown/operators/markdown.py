"""R1-R2 Markdown rendering and L1-L4 code languages on a cleaned node table (our rendering contract, README §Markdown).

Rendering is set-at-a-time:

1. *segments* - a block element (p, div, h1-h6, li, pre, ...) starts a segment at its open tag and another one at its
   end; an element's end is a synthetic marker row at position ``end`` (union, same partitioning, no Exchange).
   ``seg`` = running count of boundaries in (pos, ord, sub) order.
2. each row yields a piece (collapsed text, ``**`` for bold, ``[``/``](href)`` for links, ...). Inline markers are
   kept only when the element stays inside one segment and holds some text.
3. ``groupBy(page_id, seg)`` concatenates pieces in order; the segment's first row decides the prefix (heading,
   list item, quote, fenced code with its language).
4. ``groupBy(page_id)`` joins the non-empty segments with a blank line (rows of one table with a line end).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdown.functions import constants as K
from loomdown.functions.text import collapse_ws, label_language, let, strip_ws, syntax_language
from loomdown.operators.nodes import attr
from loomdown.plans.materialize import materialize

ORDER = ["pos", "ord", "sub"]


def RUNW() -> Window:
    return Window.partitionBy("page_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)


INLINE_MARK = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "kbd": "`", "samp": "`", "del": "~~", "s": "~~"}
MAX_COLSPAN = 1000  # what HTML allows


RENDER_COLS = ["page_id", "pos", "ord", "sub", "elem", "end", "parent", "kind", "tag", "amap", "cls", "text"]  # what render reads, but for ``piece``


def with_piece(rows: DataFrame) -> DataFrame:
    """``piece`` again, for rows kept without it: it repeats the text."""
    return rows.withColumn("piece", F.when(F.col("text").isNotNull(), strip_ws(F.col("text"))))


def _is(tag_list) -> Column:
    return F.col("tag").isin(list(tag_list))


def prepare_rows(rows: DataFrame, region: Column | None = None) -> DataFrame:
    """Rows of a node table (live, incl. end markers) + ``in_pre`` (strictly inside a pre; a marker takes its element's flag) and the
    running numbers by which ``code_languages`` finds labels: ``bidx`` of label blocks, ``k`` of texts, ``plen`` of characters.
    All in one pass in document order, whose order the rows keep. Rows that ``region`` excludes pass through and count for nothing.

    A pre counts one from its open row to its end marker. Without content (end = start + 1) it holds nothing and counts nothing, so a
    marker, which no longer tells an open tag from a void one, can be read by its interval."""
    here = F.lit(True) if region is None else region
    is_open = F.col("ord") == 0
    pre = here & (F.col("tag") == "pre") & (F.col("end") > F.col("elem") + 1)
    step = F.when(F.coalesce(pre & is_open & (F.col("kind") == "open"), F.lit(False)), 1).when(F.coalesce(pre & ~is_open, F.lit(False)), -1).otherwise(0)
    elem = F.col("kind").isin("open", "void", "raw")
    lab = F.coalesce(here & is_open & elem & _is(K.LABEL_BLOCK_TAGS), F.lit(False)).cast("int")
    hp = (here & is_open & (F.coalesce(F.col("piece"), F.lit("")) != "")).cast("int")
    pl = F.when(here & is_open, F.coalesce(F.length("piece"), F.lit(0))).otherwise(0)
    r = rows.select("*", step.alias("_step"), lab.alias("_lab"), hp.alias("_hp"), pl.alias("_pl"))
    r = r.select("*", F.sum("_step").over(RUNW()).alias("_depth"), F.sum("_lab").over(RUNW()).alias("bidx"), F.sum("_hp").over(RUNW()).alias("k"),
                 F.sum("_pl").over(RUNW()).alias("plen"))
    around = F.when(F.col("_step") == 1, F.col("_depth") - 1).otherwise(F.col("_depth"))
    return r.withColumn("in_pre", around > 0).drop("_step", "_depth")


def code_languages(rows: DataFrame) -> DataFrame:
    """L1-L4 inputs per top-level pre: (page_id, pre_pos, class_lang, label_lang). L3 needs the code text and is
    applied in ``render``. ``rows`` = prepared region rows."""
    # a block's text ends at its end marker, which is there whether or not the token before it is left
    ends = rows.where((F.col("ord") == 1) & _is(K.LABEL_BLOCK_TAGS))
    rows = rows.where(F.col("ord") == 0)
    pres = rows.where((F.col("kind") == "open") & (F.col("tag") == "pre") & ~F.col("in_pre")).select(
        "page_id", F.col("pos").alias("pre_pos"), F.col("parent").alias("pp"), F.col("cls").alias("pre_cls"))
    # L1: classes of pre, its parent, then its first code child
    opens = rows.where(F.col("kind") == "open")
    par = opens.select("page_id", F.col("pos").alias("pp"), F.col("cls").alias("par_cls"))
    code_child = opens.where(F.col("tag") == "code").groupBy("page_id", F.col("parent").alias("pre_pos")).agg(
        F.min_by("cls", "pos").alias("code_cls"))
    p = pres.join(par, ["page_id", "pp"], "left").join(code_child, ["page_id", "pre_pos"], "left")
    classes = F.concat(
        F.split(F.coalesce(F.col("pre_cls"), F.lit("")), " "), F.split(F.coalesce(F.col("par_cls"), F.lit("")), " "),
        F.split(F.coalesce(F.col("code_cls"), F.lit("")), " "))
    first = F.try_element_at(F.filter(classes, lambda c: c.startswith("language-") | c.startswith("lang-")), F.lit(1))
    p = p.withColumn("class_lang", F.regexp_extract(first, r"^[^-]*-(.*)$", 1).alias("x")).withColumn(
        "class_lang", F.when(first.isNotNull(), F.col("class_lang")))

    # L2 (J5): the 4 nearest label blocks starting before the pre's parent, inside the region
    r = rows
    at_parent = opens.select("page_id", F.col("pos").alias("pp"), (F.col("bidx") - F.col("_lab")).alias("B"))
    cand = p.join(at_parent, ["page_id", "pp"]).select(
        "page_id", "pre_pos", F.explode(F.sequence(F.lit(0), F.lit(K.LABEL_SEARCH_LIMIT - 1))).alias("j"), "B")
    cand = cand.withColumn("bidx", F.col("B") - F.col("j")).where(F.col("bidx") >= 1)
    blocks = r.where(F.col("_lab") == 1).select(
        "page_id", "bidx", F.col("pos").alias("bpos"),
        (F.col("k") - F.col("_hp")).alias("k_before"), (F.col("plen") - F.col("_pl")).alias("len_before"))
    blocks = blocks.join(ends.select("page_id", F.col("elem").alias("bpos"), F.col("k").alias("k_end"), F.col("plen").alias("len_end")), ["page_id", "bpos"])
    blocks = blocks.withColumn("blen", F.col("len_end") - F.col("len_before"))
    # at most 120 pieces are needed (all text when <= 120 chars, else the last 60 chars)
    k_lo = F.when(F.col("blen") > 120, F.greatest(F.col("k_before") + 1, F.col("k_end") - 59)).otherwise(F.col("k_before") + 1)
    cb = cand.join(blocks, ["page_id", "bidx"]).where(F.col("k_end") > F.col("k_before"))
    cbk = cb.select("page_id", "pre_pos", "j", "blen", F.explode(F.sequence(k_lo, F.col("k_end"))).alias("k")).where(F.col("k") >= 1)
    pieces = r.where(F.col("_hp") == 1).select("page_id", "k", "piece")
    txt = cbk.join(pieces, ["page_id", "k"]).groupBy("page_id", "pre_pos", "j", "blen").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "").alias("btext"))
    # the 60-character cut is decided on the block's whole text length
    txt = txt.withColumn("btext", F.when(F.col("blen") > 120, F.substr(F.col("btext"), F.length("btext") - 59)).otherwise(F.col("btext")))
    # blocks with no text still count as searched (they just never match)
    found = let(label_language(F.col("btext")), lambda v: F.when(v.isNotNull(), F.struct(F.col("j"), v.alias("lang"))))
    lab = txt.groupBy("page_id", "pre_pos").agg(F.min(found)["lang"].alias("label_lang"))
    return p.join(lab, ["page_id", "pre_pos"], "left").select("page_id", "pre_pos", "class_lang", "label_lang")


def render(rows: DataFrame, opts, with_languages: bool = True) -> DataFrame:
    """(page_id, markdown, n_code) from live region rows of a node table."""
    # read by the renderer and by each look-up of code languages
    return render_prepared(materialize(prepare_rows(rows), opts.materialize), opts, with_languages)


def render_prepared(rows: DataFrame, opts, with_languages: bool = True) -> DataFrame:
    """``render`` of rows that ``prepare_rows`` has seen."""
    is_open = F.col("ord") == 0
    elem = F.col("kind").isin("open", "void", "raw") | (F.col("kind") == "end")
    block = elem & _is(K.BLOCK_TAGS) & ~F.col("in_pre")
    href = attr("href")
    fmt = elem & ~F.col("in_pre") & (_is(INLINE_MARK) | ((F.col("tag") == "a") & (F.coalesce(href, F.lit("")) != "")))
    cell = elem & ~F.col("in_pre") & _is(["td", "th"])
    span = F.coalesce(F.regexp_extract(attr("colspan"), r"^[ \t\n\r\f]*([0-9]{1,6})", 1).try_cast("int"), F.lit(1))
    img = F.concat(F.lit("!["), F.coalesce(attr("alt"), F.lit("")), F.lit("]("), F.coalesce(attr("src"), F.lit("")), F.lit(")"))
    u = rows.select("page_id", "pos", "ord", "sub", "elem", "kind", "tag", "text", "in_pre", "parent", F.when(F.col("tag") == "img", img).alias("img"),
                    block.alias("blk"), fmt.alias("fmt"), cell.alias("cell"), href.alias("href"),
                    F.when(cell, F.greatest(F.lit(1), F.least(span, F.lit(MAX_COLSPAN)))).alias("span"))
    is_li = is_open & (F.col("kind") == "open") & (F.col("tag") == "li")
    bnd = F.col("blk").cast("int")
    nonempty = ((F.col("kind") == "text") & F.col("text").rlike(r"[^ \t\n\r\f]")).cast("int")
    delta = F.when(is_open, 1).otherwise(-1)
    u = (u.withColumn("seg", F.sum(bnd).over(RUNW()))
         .withColumn("cnt", F.sum(nonempty).over(RUNW()))
         .withColumn("bq", F.sum(F.when(F.col("blk") & (F.col("tag") == "blockquote"), delta).otherwise(0)).over(RUNW()))
         .withColumn("ld", F.sum(F.when(F.col("blk") & _is(["ul", "ol"]), delta).otherwise(0)).over(RUNW()))
         .withColumn("lid", F.sum(F.when(F.col("blk") & (F.col("tag") == "li"), delta).otherwise(0)).over(RUNW())))
    # What needs another order than the document's is found on the few rows concerned, and meets the rows again in theirs, so the
    # whole rows are not sorted. Ordered-list item numbers: an li row joins its parent's group.
    group = F.when(is_li, F.col("parent")).when(is_open & F.col("tag").isin("ul", "ol"), F.col("pos"))
    lists = u.where(is_open & F.col("tag").isin("li", "ul", "ol")).select("page_id", *ORDER, "kind", "tag", group.alias("_g"), is_li.alias("_li"))
    gw = Window.partitionBy("page_id", "_g")
    ptag = F.max(F.when(F.col("pos") == F.col("_g"), F.col("tag"))).over(gw)
    num = F.sum(F.col("_li").cast("int")).over(gw.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    lists = lists.select("page_id", *ORDER, F.when(F.col("_li") & (ptag == "ol"), num).alias("li_num"))
    # an inline element or a cell: whether it stays inside one segment and holds text
    ew = Window.partitionBy("page_id", "elem")
    inline = u.where(F.col("fmt") | F.col("cell")).select(
        "page_id", *ORDER, (F.min("seg").over(ew) == F.max("seg").over(ew)).alias("one_seg"), (F.max("cnt").over(ew) - F.min("cnt").over(ew) > 0).alias("_held"))
    u = u.join(lists.where("li_num is not null"), ["page_id", *ORDER], "left").join(inline, ["page_id", *ORDER], "left")
    # a pre's language, at its open row
    if with_languages:
        langs = code_languages(rows).select("page_id", F.col("pre_pos").alias("pos"), F.lit(0).alias("ord"), F.lit(0).alias("sub"), F.coalesce("class_lang", "label_lang").alias("lang"))
        u = u.join(langs, ["page_id", *ORDER], "left")
    else:
        u = u.withColumn("lang", F.lit(None).cast("string"))
    one_seg = F.col("one_seg")
    u = u.withColumn("ok", F.when(F.col("fmt"), one_seg & F.col("_held")).otherwise(F.lit(False)))
    u = u.withColumn("wide", F.when(F.col("cell") & is_open, ~one_seg))  # a cell that holds block elements

    tag = F.col("tag")
    mark = F.create_map(*[x for k, v in INLINE_MARK.items() for x in (F.lit(k), F.lit(v))])[tag]
    open_piece = (
        F.when(F.col("kind") == "text", F.when(F.col("in_pre"), F.col("text")).otherwise(collapse_ws(F.col("text"))))
        .when(~F.col("kind").isin("open", "void", "raw"), F.lit(None))
        .when(tag == "br", F.lit("\n"))
        .when(F.col("in_pre"), F.lit(None))
        .when(tag == "hr", F.lit("---"))
        .when(tag == "img", F.col("img"))
        .when(F.col("cell"), F.lit(" "))
        .when(F.col("ok") & (tag == "a"), F.lit("["))
        .when(F.col("ok"), mark)
    )
    close_piece = F.when(F.col("cell"), F.lit(" ")).when(F.col("ok") & (tag == "a"), F.concat(F.lit("]("), F.col("href"), F.lit(")"))).when(F.col("ok"), mark)
    u = u.withColumn("piece", F.when(is_open, open_piece).otherwise(close_piece))
    # borders a row shows here: one before a cell, and after a cell of several columns one for each further column
    u = u.withColumn("bars", F.when(F.col("cell"), F.when(is_open, F.lit(1)).otherwise(F.col("span") - 1)).otherwise(F.lit(0)))
    u = u.withColumn("o_tag", F.when(is_open & F.col("blk"), tag))

    # A segment's rows lie together in document order already: sorted so, each segment is put together in one streaming pass, and
    # neighbouring segments meet in their order. Rows without a piece that start no segment add nothing.
    u = u.where(F.col("blk") | F.col("piece").isNotNull()).sortWithinPartitions("page_id", "seg", *ORDER)
    segs = u.groupBy("page_id", "seg").agg(
        F.min(F.struct(*ORDER, "o_tag", "bq", "ld", "lid", "li_num", "lang")).alias("first"),
        F.collect_list(F.when(F.col("piece").isNotNull(), F.struct(*ORDER, "piece", "bars"))).alias("ps"),
        F.coalesce(F.sum(F.when(F.col("wide").isNotNull(), F.col("span"))), F.lit(0)).alias("cells"), F.coalesce(F.max("wide"), F.lit(False)).alias("wide"),
    )
    joined = F.array_join(F.transform(F.col("ps"), lambda x: x["piece"]), "")
    piped = F.array_join(F.transform(F.col("ps"), lambda x: F.when(
        x["bars"] > 0, F.concat(F.lit(" "), F.repeat(F.lit("| "), x["bars"]))).otherwise(F.replace(x["piece"], F.lit("|"), F.lit("\\|")))), "")
    is_row = (F.col("o_tag") == "tr") & (F.col("cells") > 0) & ~F.col("wide")
    segs = segs.withColumn("ps", F.array_sort("ps")).select(
        "page_id", "seg", *[F.col(f"first.{c}").alias(c) for c in ("o_tag", "bq", "ld", "lid", "li_num", "lang")], "cells", "wide", "ps")
    segs = segs.withColumn("is_row", F.coalesce(is_row, F.lit(False)))
    segs = segs.withColumn("raw", F.when(F.col("is_row"), piped).otherwise(joined)).drop("ps", "wide")
    is_pre_seg = F.col("o_tag") == "pre"
    lang = F.coalesce(F.col("lang"), syntax_language(F.col("raw")))
    code = F.regexp_replace(F.col("raw"), r"^\n+|\n+$", "")
    fenced = F.concat(F.lit("```"), lang, F.lit("\n"), code, F.lit("\n```"))
    t = F.regexp_replace(F.regexp_replace(F.col("raw"), " {2,}", " "), " *\n *", "\n")
    t = F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")
    level = F.regexp_extract(F.coalesce(F.col("o_tag"), F.lit("")), r"^h([1-6])$", 1)
    if opts.heading_style.upper() == "SETEXT":
        heading = (F.when(level == "1", F.concat(t, F.lit("\n"), F.repeat(F.lit("="), F.length(t))))
                   .when(level == "2", F.concat(t, F.lit("\n"), F.repeat(F.lit("-"), F.length(t))))
                   .otherwise(F.concat(F.repeat(F.lit("#"), F.when(level == "", 1).otherwise(level.cast("int"))), F.lit(" "), t)))
    else:
        heading = F.concat(F.repeat(F.lit("#"), F.when(level == "", 1).otherwise(level.cast("int"))), F.lit(" "), t)
    body = F.when(t == "", F.lit("")).when(F.col("is_row"), F.concat(t, F.lit(" |"))).when(level != "", heading).otherwise(t)
    segs = segs.withColumn("md", F.when(is_pre_seg, fenced).otherwise(body)).withColumn("is_code", is_pre_seg)
    return _join_segments(segs)


def _join_segments(segs: DataFrame) -> DataFrame:
    """List markers, table rules, quotes and blank lines: (page_id, markdown, n_code) from rendered segments.

    The first text inside an li takes its marker, whatever block holds it; the li's other segments are indented. Rows that
    follow each other directly are lines of one table, whose first row is its head."""
    run = Window.partitionBy("page_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("page_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    full = F.col("md") != ""
    segs = (segs.withColumn("li", F.last(F.when(F.col("o_tag") == "li", F.struct("seg", "lid", "li_num")), ignorenulls=True).over(run))
            .withColumn("prev", F.last(F.when(full, F.struct("seg", "is_row")), ignorenulls=True).over(before)).where(full))
    # two boundaries lie between neighbouring rows: the end of one and the start of the next
    follows = F.col("is_row") & F.coalesce(F.col("prev.is_row") & (F.col("prev.seg") == F.col("seg") - 2), F.lit(False))
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("cells").cast("int")))
    marked = F.coalesce((F.col("lid") > 0) & (F.col("li.lid") == F.col("lid")) & (F.coalesce(F.col("prev.seg"), F.lit(-1)) < F.col("li.seg")), F.lit(False))
    inner = F.repeat(F.lit("  "), F.greatest(F.col("ld"), F.lit(1)).cast("int"))
    outer = F.repeat(F.lit("  "), F.greatest(F.col("ld") - 1, F.lit(0)).cast("int"))
    number = F.coalesce(F.concat(F.col("li.li_num").cast("string"), F.lit(". ")), F.lit("- "))
    segs = segs.withColumn("follows", follows).withColumn("md", F.when(F.col("is_row") & ~follows, F.concat("md", rule)).otherwise(F.col("md")))
    indented = F.replace(F.col("md"), F.lit("\n"), F.concat(F.lit("\n"), inner))
    segs = segs.withColumn("md", F.when(marked, F.concat(outer, number, indented)).when(F.col("lid") > 0, F.concat(inner, indented)).otherwise(F.col("md")))
    segs = segs.withColumn("md", F.when(F.col("bq") > 0, F.regexp_replace("md", "(?m)^", "> ")).otherwise(F.col("md")))
    segs = segs.withColumn("md", F.concat(F.when(F.col("prev").isNull(), "").when(F.col("follows"), "\n").otherwise("\n\n"), F.col("md")))
    return segs.groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "md"))), lambda x: x["md"]), "").alias("markdown"),
        F.sum(F.col("is_code").cast("int")).alias("n_code"),
    )
