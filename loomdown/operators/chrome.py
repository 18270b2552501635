"""Page-chrome removal on the node table, stage by stage, plus the main-region choice.

Every stage is a set operation over the page's rows in ``(pos, ord, sub)`` order, a pass over partitions that are already
clustered by ``page_id``, without self-joins:

* N6 drop-subtree: running ``max(end of doomed elements) > pos`` -> dead.
* The 5000-character guards (F4-F6) read the text left by earlier stages: running sum of live piece lengths; the
  element's length = value at its end marker - value before its open row (an element's open row and its end marker share
  ``elem``). The four guarded stages are resolved in one exact sweep over the page's candidates (``guard_sweep``).
* F8 (branding) groups each candidate parent with its direct text children (window over ``(page_id, parent)``) and
  resolves the few candidates of a page in platform-name order.
* F14 takes the page minimum of ``(priority, pos)`` with an unbounded window.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdown.functions import constants as K
from loomdown.operators.nodes import attr, page_partitions

ORDER = ["pos", "ord", "sub"]


def RUN() -> Window:
    """Running frame over a page in (pos, ord, sub) order (inclusive)."""
    return Window.partitionBy("page_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)


def BEFORE() -> Window:
    """Running frame over a page, rows strictly before."""
    return Window.partitionBy("page_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)


def PAGE() -> Window:
    return Window.partitionBy("page_id")


def ELEMW() -> Window:
    """An element's open row together with its end marker."""
    return Window.partitionBy("page_id", "elem")


def IS_ELEM() -> Column:
    return (F.col("ord") == 0) & F.col("kind").isin("open", "void", "raw")


def with_live(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("live", F.lit(True))


def _span(start: Column, end: Column) -> Column:
    """An interval as one number, by its end and among equal ends the outermost last, so that a running maximum is the interval that
    reaches furthest."""
    return F.shiftleft(end.cast("long"), 32) - start


def covered(spans: Column) -> Column:
    """Is the row inside one of the elements whose ``_span`` stands at their open rows? An end marker is if its element is."""
    cover = F.max(spans).over(RUN())
    at = F.when(F.col("ord") == 1, _span(F.col("elem"), F.col("end"))).otherwise(F.shiftleft(F.col("pos").cast("long"), 32) + 1)
    return F.coalesce(cover >= at, F.lit(False))


def drop_subtrees(nodes: DataFrame, doomed: Column) -> DataFrame:
    """Kill every live row inside a live doomed element (the element and its end marker included)."""
    return nodes.withColumn("live", F.col("live") & ~covered(F.when(F.col("live") & IS_ELEM() & doomed, _span(F.col("pos"), F.col("end")))))


def element_measure(nodes: DataFrame, measure: Column, name: str) -> DataFrame:
    """Adds ``name`` = sum of ``measure`` over the live rows inside each element (on its open row and end marker)."""
    own = F.when(F.col("live") & (F.col("ord") == 0), measure).otherwise(F.lit(0))
    n = nodes.withColumn("_own", own).withColumn("_cum", F.sum("_own").over(RUN()))
    tot = F.max(F.when(F.col("ord") == 1, F.col("_cum"))).over(ELEMW()) - F.max(
        F.when(F.col("ord") == 0, F.col("_cum") - F.col("_own"))).over(ELEMW())
    return n.withColumn(name, F.when(F.col("elem").isNotNull(), tot)).drop("_own", "_cum")


def text_len() -> Column:
    return F.coalesce(F.length("piece"), F.lit(0))


def guard_sweep(cands: list[tuple[int, int, int, int]], stages: int, max_text: int) -> list[tuple[int, int]]:
    """(pos, end) of the elements that the guarded stages remove, one stage after another, from a page's candidates
    (pos, end, stages as bits, live text before the first stage).

    A stage reads its candidates in document order. What earlier stages took away lies in a list by position with a prefix sum of
    its text and a running maximum of its ends, so a candidate's remaining text and whether it is gone already are two look-ups;
    within a stage an outer element is judged before anything inside it, and what it covers is skipped. Linear in the candidates but for the look-ups."""
    cands = sorted(cands)
    gone: list[tuple[int, int, int]] = []
    for stage in range(stages):
        at = [g[0] for g in gone]
        text = list(accumulate((g[2] for g in gone), initial=0))
        reach = list(accumulate((g[1] for g in gone), max, initial=0))
        cover, new = 0, []
        for pos, end, bits, total in cands:
            if not bits >> stage & 1 or cover > pos:
                continue
            k = bisect_right(at, pos)
            if reach[k] > pos:
                continue
            left = total - (text[bisect_left(at, end)] - text[bisect_left(at, pos)])
            if left <= max_text:
                new.append((pos, end, left))
                cover = end
        gone = sorted(gone + new)
    return [(p, e) for p, e, _ in gone]


def _interval_rows(kills: DataFrame) -> DataFrame:
    """Removed intervals (page_id, pos, kill) as rows that come before the element's own, dealt by page."""
    return kills.select("page_id", "pos", F.lit(-1).alias("ord"), F.lit(0).alias("sub"), F.col("kill").cast("int").alias("kill"))


def _with_intervals(nodes: DataFrame, *kills: DataFrame) -> DataFrame:
    n = nodes.withColumn("kill", F.lit(None).cast("int"))
    for k in kills:
        n = n.unionByName(_interval_rows(k), allowMissingColumns=True)
    return n


def _killed() -> Column:
    return F.when(F.col("ord") == -1, _span(F.col("pos"), F.col("kill")))


def guarded_kills(nodes: DataFrame, stages: int, max_text: int = K.SIDEBAR_MAX_TEXT) -> DataFrame:
    """F4-F6, exactly equal to running the guarded stages one after another, by one sweep over each page's candidates: the removed
    intervals (page_id, pos, kill). ``nodes`` has ``live``, ``bits`` (the stages a row's element is a candidate of) and ``plen``.

    A candidate's live text before the first stage is the running sum of live text at its end less that before its start; only
    these two rows of the few candidates are gathered per page, and ``guard_sweep`` judges them. No row ever carries the page's candidates."""
    own = F.when(F.col("live") & (F.col("ord") == 0), F.col("plen")).otherwise(F.lit(0))
    r = nodes.select("page_id", "ord", "elem", "end", "live", "bits", own.alias("own"), F.sum(own).over(RUN()).alias("cum"))
    r = r.where((F.col("bits") > 0) & (F.col("live") | (F.col("ord") == 1)))
    r = r.groupBy("page_id", "elem").agg(
        F.max("end").alias("end"), F.max("bits").alias("bits"), F.max(F.when(F.col("ord") == 0, F.col("cum") - F.col("own"))).alias("a"),
        F.max(F.when(F.col("ord") == 1, F.col("cum"))).alias("z")).where("a is not null")
    per_page = r.groupBy("page_id").agg(F.collect_list(F.struct(F.col("elem").alias("p"), F.col("end").alias("e"), "bits", (F.col("z") - F.col("a")).alias("n"))).alias("c"))

    @F.arrow_udf("array<struct<pos:int,kill:int>>")
    def sweep(col: pa.Array) -> pa.Array:
        out = [[{"pos": p, "kill": e} for p, e in guard_sweep([(x["p"], x["e"], x["bits"], x["n"]) for x in c], stages, max_text)] for c in col.to_pylist()]
        return pa.array(out, pa.list_(pa.struct([("pos", pa.int32()), ("kill", pa.int32())])))

    kills = per_page.select("page_id", F.inline(sweep("c")))
    # Python drops the partitioning of these few rows; dealt by page again they meet the page's rows without an Exchange of those
    return kills.repartition(page_partitions(nodes.sparkSession), "page_id")


def _ci_search(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike("(?i)" + pattern), F.lit(False))


def branding_kills(nodes: DataFrame) -> DataFrame:
    """F8: a live text node equal (case/outer space ignored) to a platform name whose parent is a heading, span, div,
    a, p or label and whose parent's whole text is that name -> drop the parent. One pass per name, in list order: (page_id, pos, kill).
    ``nodes`` has ``live``, ``full`` (1 if the row has text), ``rank`` (of the name a text node is, else 0) and ``holder`` (may be dropped).

    A parent's text equals the name exactly when the name's text node is its only non-empty live piece, and every
    earlier removal took exactly one piece away, so the passes reduce to a fold over the page's few candidates."""
    own = F.when(F.col("live") & (F.col("ord") == 0), F.col("full")).otherwise(F.lit(0))
    named = F.col("live") & (F.col("rank") > 0)
    r = nodes.select("page_id", "pos", "ord", "end", "live", "rank", "holder", own.alias("own"), F.sum(own).over(RUN()).alias("cum"),
                     F.when(named, F.col("parent")).otherwise(F.col("elem")).alias("g"), named.alias("named"))
    r = r.where(F.col("named") | (F.col("holder") & (F.col("live") | (F.col("ord") == 1))))
    element = ~F.col("named")
    first = F.when(F.col("named"), F.shiftleft(F.col("rank").cast("long"), 32) + F.col("pos"))
    c = r.groupBy("page_id", "g").agg(
        F.min(first).alias("hit"), F.max(F.when(element, F.col("end"))).alias("end"),
        F.max(F.when(element & (F.col("ord") == 0), F.col("cum") - F.col("own"))).alias("a"),
        F.max(F.when(element & (F.col("ord") == 1), F.col("cum"))).alias("z")).where("hit is not null and a is not null")
    cand = F.struct("hit", F.col("g").alias("pos"), "end", (F.col("z") - F.col("a")).alias("cnt"))
    pages = c.groupBy("page_id").agg(F.array_sort(F.collect_list(cand)).alias("_cands"))
    removed = F.expr("""aggregate(_cands, cast(array() as array<struct<pos:int,kill:int>>),
        (acc, x) -> case
          when exists(acc, r -> r.pos <= x.pos and x.pos < r.kill) then acc
          when x.cnt - size(filter(acc, r -> x.pos <= r.pos and r.pos < x.end)) = 1
            then array_append(acc, named_struct('pos', x.pos, 'kill', x.end))
          else acc end)""")
    return pages.select("page_id", F.inline(removed))


def strip_chrome(nodes: DataFrame, opts) -> DataFrame:
    """F1-F10 in the order that matters; input rows all live; output keeps dead rows with live=False.

    The stages without a guard are read off the row itself. What the guarded ones (F4-F6) and the branding rule (F8) remove is found on
    narrow rows, a few numbers each, and joins the page's rows as intervals, so the whole rows are sorted once."""
    elem = IS_ELEM()
    cls = F.coalesce(F.col("cls"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    # Phase 1: F1 tags (+ F2 toolbars/copy links); phase 2 starts with F3 aside. No guard, so one pass.
    phase1 = elem & F.col("tag").isin(K.DROP_TAGS_FULL_PAGE)
    if opts.strip_buttons:
        phase1 = phase1 | (elem & (((F.col("tag") == "div") & cls.contains("toolbar")) | ((F.col("tag") == "a") & cls.contains("copy"))))
    phase1 = phase1 | (elem & (F.col("tag") == "aside"))
    # F4 role=complementary, then role=navigation, F5 sidebar classes, F6 sidebar aria-labels: each with the
    # 5000-char guard on the text left by the stages before it (one exact pass, see guarded_kills)
    guarded = [role == "complementary", role == "navigation", _ci_search(F.col("cls"), K.SIDEBAR_CLASS_RE), _ci_search(attr("aria-label"), K.SIDEBAR_ARIA_RE)]
    bits = F.lit(0)
    for i, c in enumerate(guarded):
        bits = bits + F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0)
    # F7 title, F8 branding
    title = elem & (F.col("tag") == "title")
    names = [n.lower() for n in K.PLATFORM_NAMES]
    is_text = (F.col("ord") == 0) & (F.col("kind") == "text")
    rank = F.when(is_text & F.col("piece").isNotNull(), F.array_position(F.array(*[F.lit(x) for x in names]), F.lower(F.col("piece")))).otherwise(F.lit(0))
    holder = F.col("tag").isin(K.BRANDING_PARENTS) & F.col("kind").isin("open", "end")
    flag = lambda c: F.coalesce(c, F.lit(False))
    narrow = nodes.select("page_id", *ORDER, "elem", "end", "parent", flag(phase1).alias("phase1"), flag(phase1 | title).alias("phase7"), bits.alias("bits"),
                          text_len().alias("plen"), (F.coalesce(F.col("piece"), F.lit("")) != "").cast("int").alias("full"), rank.cast("int").alias("rank"),
                          flag(holder).alias("holder"))
    own_span = _span(F.col("pos"), F.col("end"))
    guard = guarded_kills(narrow.withColumn("live", ~covered(F.when(F.col("phase1"), own_span))), len(guarded))
    left = _with_intervals(narrow, guard)
    left = left.withColumn("live", ~covered(F.coalesce(_killed(), F.when(F.col("phase7"), own_span)))).where("ord >= 0")
    brand = branding_kills(left)
    # F9 inputs, F10 overlays (no guard)
    f9 = elem & ((F.coalesce(attr("contenteditable"), F.lit("")) == "true") | F.col("tag").isin("textarea", "input"))
    f10 = elem & (role.isin(K.OVERLAY_ROLES) | _ci_search(F.col("cls"), K.OVERLAY_CLASS_RE))
    n = _with_intervals(nodes, guard, brand)
    n = n.withColumn("live", ~covered(F.coalesce(_killed(), F.when(flag(phase1 | title | f9 | f10), own_span))))
    return n.where("ord >= 0").drop("kill")


def is_user_container() -> Column:
    """user-turn containers by data attribute or class."""
    by_attr = None
    for a, v in K.USER_ATTRS:
        c = F.coalesce(attr(a) == v, F.lit(False))
        by_attr = c if by_attr is None else (by_attr | c)
    return IS_ELEM() & (by_attr | _ci_search(F.col("cls"), K.USER_MSG_CLASS_RE))


def drop_user_code(nodes: DataFrame) -> DataFrame:
    """every live `pre` inside a live user container is dropped; ``user_code`` flags them (A4 counts them)."""
    inside = F.max(F.when(F.col("live") & is_user_container(), F.col("end"))).over(BEFORE()) > F.col("pos")
    flag = F.col("live") & IS_ELEM() & (F.col("kind") == "open") & (F.col("tag") == "pre") & F.coalesce(inside, F.lit(False))
    n = nodes.withColumn("user_code", flag)
    return drop_subtrees(n, F.col("user_code"))


def main_region(nodes: DataFrame) -> DataFrame:
    """first live element of the priority list; ``in_region`` marks live rows inside it (whole page when none).
    End markers take the liveness of their element."""
    prio = (
        F.when(F.col("tag") == "bard-sidenav-content", 1)
        .when(F.col("tag") == "chat-window-content", 2)
        .when(F.col("tag") == "main", 3)
        .when((F.col("tag") == "div") & (F.coalesce(F.col("role"), F.lit("")) == "main"), 4)
        .when(F.col("tag") == "article", 5)
        .when(F.col("tag") == "body", 6)
    )
    cand = F.when(F.col("live") & IS_ELEM() & prio.isNotNull(), F.struct(prio.alias("prio"), F.col("pos").alias("rpos"), F.col("end").alias("rend")))
    n = nodes.withColumn("_r", F.min(cand).over(PAGE()))
    inside = F.col("_r").isNull() | ((F.col("pos") >= F.col("_r.rpos")) & (F.col("pos") < F.col("_r.rend")))
    return n.withColumn("in_region", F.col("live") & inside).withColumn("region_pos", F.col("_r.rpos")).drop("_r")


def clean_page(nodes: DataFrame, opts) -> DataFrame:
    """F1-F12 + F14: the node rows that F1-F10 leave, with ``live``, ``user_code`` and ``in_region``."""
    # what the first stages removed is read by no later one
    return main_region(drop_user_code(strip_chrome(nodes, opts).where("live")))
