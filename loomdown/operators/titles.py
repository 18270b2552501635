"""The page title, from the node table *before* clean-up.

Strategy order (first non-NULL wins): active item by attribute (T2), active item by class inside the first 5
aside/nav (T3), inside the first 3 role=complementary / role=navigation containers (T4), first user message (T5),
``<title>`` (T6), first 3 ``h1`` (T7), og:title / twitter:title meta (T8).

Element text is assembled from the page's non-empty text pieces: every piece gets a running index ``k`` and an
element owns the contiguous range ``(k_before(pos), k(end - 1)]``; the range is exploded and equi-joined on
``(page_id, k)``, so there is no range join. All candidate elements of all strategies share one such lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdown.functions import constants as K
from loomdown.functions.text import clean_title, user_turn_title
from loomdown.operators.nodes import attr



def PAGE_RUN() -> Window:
    return Window.partitionBy("page_id").orderBy("pos", "ord", "sub").rowsBetween(Window.unboundedPreceding, 0)


def ELEM():
    return F.col("kind").isin("open", "void", "raw")


def with_piece_index(nodes: DataFrame) -> DataFrame:
    hp = (F.coalesce(F.col("piece"), F.lit("")) != "").cast("int")
    return nodes.withColumn("_hp", hp).withColumn("k", F.sum("_hp").over(PAGE_RUN()))


def element_texts(indexed: DataFrame, elems: DataFrame) -> DataFrame:
    """elems(page_id, pos, end, src, r1, r2) -> + text_sp (pieces joined by ' '), text_nosp (joined by '')."""
    at_pos = indexed.where(F.col("ord") == 0).select("page_id", "pos", (F.col("k") - F.col("_hp")).alias("k_before"))
    at_end = indexed.where(F.col("ord") == 1).select("page_id", F.col("elem").alias("pos"), F.col("k").alias("k_end"))
    e = elems.join(at_pos, ["page_id", "pos"]).join(at_end, ["page_id", "pos"])
    pieces_of = F.when(F.col("k_end") > F.col("k_before"), F.sequence(F.col("k_before") + 1, F.col("k_end")))  # an empty element has none
    ek = e.select("page_id", "pos", "src", "r1", "r2", F.explode_outer(pieces_of).alias("k"))
    pieces = indexed.where(F.col("_hp") == 1).select("page_id", "k", "piece")
    j = ek.join(pieces, ["page_id", "k"], "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("k", "piece")))), lambda x: x["piece"])
    return j.groupBy("page_id", "pos", "src", "r1", "r2").agg(
        F.array_join(ordered, " ").alias("text_sp"), F.array_join(ordered, "").alias("text_nosp"))


def first_inside(rows: DataFrame, containers: list[tuple[str, Column, int]], item: str, items: int) -> DataFrame:
    """Structural join of containers and the items inside them in one ordered pass: (page_id, k, src, crank, pos, end) of the first
    ``items`` item rows inside each of the page's first n containers, for every (src, condition, n) of ``containers``.

    Each page's containers and items are read once in document order. As intervals nest, an item lies inside a container met
    before it exactly if that one's end is still ahead; the ends of the first n containers of a kind are running values beside
    the row. No container row meets an item row in a join, so a page's cost is its items times the (fixed) number of containers."""
    run = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    is_box = [F.col(f"_c{k}") for k in range(len(containers))]
    r = rows.select("page_id", "pos", "end", F.col(item).alias("_item"), *[c.alias(f"_c{k}") for k, (_, c, _) in enumerate(containers)])
    any_box = is_box[0]
    for c in is_box[1:]:
        any_box = any_box | c
    r = r.where(F.col("_item") | any_box)
    ranks = [F.sum(c.cast("int")).over(run).alias(f"_n{k}") for k, c in enumerate(is_box)]
    r = r.select("*", *ranks)
    places = [(k, src, i) for k, (src, _, n) in enumerate(containers) for i in range(1, n + 1)]
    r = r.select("*", *[F.max(F.when(is_box[k] & (F.col(f"_n{k}") == i), F.col("end"))).over(before).alias(f"_e{k}_{i}") for k, _, i in places])
    inside = {(k, i): F.col("_item") & F.coalesce(F.col(f"_e{k}_{i}") > F.col("pos"), F.lit(False)) for k, _, i in places}
    r = r.select("*", *[F.sum(inside[k, i].cast("int")).over(run).alias(f"_i{k}_{i}") for k, _, i in places])
    hits = [F.when(inside[k, i] & (F.col(f"_i{k}_{i}") <= items), F.struct(F.lit(k).alias("k"), F.lit(src).alias("src"), F.lit(i).alias("crank"))) for k, src, i in places]
    return r.select("page_id", "pos", "end", F.inline(F.filter(F.array(*hits), lambda h: h.isNotNull())))


def title_candidates(nodes: DataFrame) -> DataFrame:
    """All elements any strategy may read, tagged (src, r1, r2) with their within-strategy order.

    The single-element strategies (T2 attributes, T5 user attributes, T6 title, T7 first three h1) come from one
    aggregate per page; T3/T4 are a structural join of each page's first containers and the active-class items in them."""
    el = nodes.where(ELEM())
    pe = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("end")  # one number: its least is kept in place, a struct's by sorting the rows
    unpack = lambda c: F.when(c.isNotNull(), F.struct(F.shiftright(c, 32).cast("int").alias("pos"), c.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("end")))
    aggs = []
    for i, (a, v) in enumerate(K.ACTIVE_ATTRS, start=1):
        aggs.append(F.min(F.when(F.coalesce(attr(a) == v, F.lit(False)), pe)).alias(f"attr{i}"))
    for i, (a, v) in enumerate(K.USER_ATTRS, start=1):
        aggs.append(F.min(F.when(F.coalesce(attr(a) == v, F.lit(False)), pe)).alias(f"user{i}"))
    aggs.append(F.min(F.when(F.col("tag") == "title", pe)).alias("title1"))
    firsts = el.groupBy("page_id").agg(*aggs)
    h1s = el.where(F.col("tag") == "h1").groupBy("page_id").agg(F.slice(F.array_sort(F.collect_list(pe)), 1, 3).alias("h1s"))

    def cand(packed, src, r1):
        c = unpack(packed)
        return F.when(c.isNotNull(), F.struct(c["pos"].alias("pos"), c["end"].alias("end"), F.lit(src).alias("src"),
                                              F.lit(r1).alias("r1"), F.lit(0).alias("r2")))

    items = [cand(F.col(f"attr{i}"), "attr", i) for i in range(1, len(K.ACTIVE_ATTRS) + 1)]
    items += [cand(F.col(f"user{i}"), "user", i) for i in range(1, len(K.USER_ATTRS) + 1)]
    items += [cand(F.col("title1"), "title", 1)]
    heads = [cand(F.try_element_at(F.col("h1s"), F.lit(i)), "h1", i) for i in range(1, 4)]
    singles = firsts.select("page_id", F.inline(F.filter(F.array(*items), lambda x: x.isNotNull()))).unionByName(
        h1s.select("page_id", F.inline(F.filter(F.array(*heads), lambda x: x.isNotNull()))))

    # Active-class items in the first containers (r1 = container order, r2 = item position)
    role = F.coalesce(F.col("role"), F.lit(""))
    active = F.coalesce(F.col("cls").rlike("(?i)" + K.ACTIVE_CLASS_RE), F.lit(False))
    found = first_inside(el.withColumn("_active", active), [("class", F.col("tag").isin("aside", "nav"), 5), ("role", role == "complementary", 3),
                                                            ("role", role == "navigation", 3)], "_active", 5)
    boxed = found.select("page_id", "pos", "end", "src", (F.col("crank") + F.when(F.col("k") == 2, 10).otherwise(0)).alias("r1"), F.col("pos").alias("r2"))
    return singles.unionByName(boxed)


def meta_titles(nodes: DataFrame) -> DataFrame:
    """Og:title then twitter:title; per name the first meta with property=name, else with name=name."""
    meta = nodes.where(ELEM() & (F.col("tag") == "meta"))
    aggs = []
    for i, nm in enumerate(["og:title", "twitter:title"], start=1):
        aggs.append(F.min(F.when(F.coalesce(attr("property") == nm, F.lit(False)), F.struct("pos", attr("content").alias("c")))).alias(f"p{i}"))
        aggs.append(F.min(F.when(F.coalesce(attr("name") == nm, F.lit(False)), F.struct("pos", attr("content").alias("c")))).alias(f"n{i}"))
    m = meta.groupBy("page_id").agg(*aggs)
    outs = []
    for i in (1, 2):
        content = F.when(F.col(f"p{i}").isNotNull(), F.col(f"p{i}.c")).otherwise(F.col(f"n{i}.c"))
        outs.append(F.when(F.coalesce(content, F.lit("")) != "", clean_title(content)))
    return m.select("page_id", F.coalesce(*outs).alias("t_meta"))


def page_titles(nodes: DataFrame) -> DataFrame:
    """(page_id, title, source) for every page that has one strategy answer; pages without any are absent.

    A page's few candidates are collected in strategy order (hash aggregate, no sort) and the title rules run inside a
    lambda over that short list; the first non-NULL answer wins."""
    idx = with_piece_index(nodes)
    texts = element_texts(idx, title_candidates(nodes))
    prio = F.create_map(*[x for i, s in enumerate(["attr", "class", "role", "user", "title", "h1"]) for x in (F.lit(s), F.lit(i))])[F.col("src")]
    per_page = texts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(
        prio.alias("prio"), "r1", "r2", "src", "text_sp", "text_nosp"))).alias("cs"))

    def value(c):
        boxed = c["src"].isin("attr", "class", "role")
        clean = clean_title(F.when(boxed, c["text_sp"]).otherwise(c["text_nosp"]))
        return F.struct(c["src"].alias("source"), F.when(c["src"] == "user", user_turn_title(c["text_sp"])).otherwise(clean).alias("title"))

    vals = F.filter(F.transform("cs", value), lambda v: v["title"].isNotNull())
    best = per_page.select("page_id", F.try_element_at(vals, F.lit(1)).alias("b")).where(F.col("b").isNotNull())
    best = best.select("page_id", "b.title", "b.source")
    meta = meta_titles(nodes).where(F.col("t_meta").isNotNull()).select("page_id", F.col("t_meta").alias("mt"))
    j = best.join(meta, "page_id", "full_outer")
    return j.select("page_id", F.coalesce("title", "mt").alias("title"),
                    F.when(F.col("title").isNotNull(), F.col("source")).otherwise(F.lit("meta")).alias("source"))
