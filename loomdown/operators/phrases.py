"""Which string of a page holds a phrase first.

Pages with at most FEW distinct phrases test each string against these, beside the string, in one pass. The strings of busier
pages go through an n-gram inverted index, so that no page costs its strings times its phrases.

The index holds only what is asked for: a posting (page, gram, place) for every gram that some request on that page
contains. A request is looked up by the one of its grams that fewest of the page's strings hold, and only those strings are
tested against it; a request with a gram that no string holds is settled by the index alone. All joins are keyed by page and gram or by
page and string, so the requests and strings of one busy page spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdown.functions.text import strip_ws

GRAM = 3
FEW = 16


def with_grams(rows: DataFrame, text: str) -> DataFrame:
    """Each row once per distinct ``gram`` of its ``text``, of ``size`` characters (1 to GRAM). The text is cut into characters once, so
    the cost is linear in it."""
    r = rows.withColumn("chars", F.filter(F.split(text, ""), lambda c: c != ""))
    piece = lambda i, k: F.when(F.col("size") > k, F.get("chars", i + k)).otherwise("")
    places = F.when(F.size("chars") >= F.col("size"), F.sequence(F.lit(0), F.size("chars") - F.col("size")))
    return r.withColumn("gram", F.explode(F.array_distinct(F.transform(places, lambda i: F.concat(*[piece(i, k) for k in range(GRAM)])))))


def answerable(requests: DataFrame) -> DataFrame:
    """Requests that ask something: a blank phrase asks nothing."""
    return requests.where(strip_ws(F.col("phrase")) != "")


def _lowered(strings: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (strings.select("page_id", "pos", F.lower("text").alias("low")),
            requests.select("page_id", "phrase_id", F.lower("phrase").alias("lp")).where("lp != ''"))


def candidates(strings: DataFrame, requests: DataFrame) -> DataFrame:
    """(page_id, lp, pos): the strings that hold the rarest gram of a phrase asked on their page."""
    low, req = _lowered(strings, requests)
    asked = req.select("page_id", "lp").distinct()
    needed = with_grams(asked.withColumn("size", F.least(F.length("lp"), F.lit(GRAM))), "lp").select("page_id", "lp", "gram")
    # phrases shorter than GRAM need shorter grams, on their pages only: at most GRAM sizes a page
    sizes = asked.groupBy("page_id").agg(F.collect_set(F.least(F.length("lp"), F.lit(GRAM))).alias("sizes"))
    indexed = with_grams(low.join(sizes, "page_id").withColumn("size", F.explode("sizes")).drop("sizes"), "low").select("page_id", "gram", "pos")
    postings = indexed.join(needed.select("page_id", "gram").distinct(), ["page_id", "gram"], "left_semi")
    held = postings.groupBy("page_id", "gram").agg(F.count("*").alias("n"))
    rarest = needed.join(held, ["page_id", "gram"], "left").groupBy("page_id", "lp").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    lookup = rarest.where("r.n > 0").select("page_id", "lp", F.col("r.gram").alias("gram"))
    return lookup.join(postings, ["page_id", "gram"]).select("page_id", "lp", "pos")


def _found_few(strings: DataFrame, requests: DataFrame) -> DataFrame:
    low, req = _lowered(strings, requests)
    asked = req.groupBy("page_id").agg(F.collect_set("lp").alias("lps"))
    held = F.filter("lps", lambda p: F.contains(F.col("low"), p))
    return low.join(asked, "page_id").select("page_id", "pos", F.explode(held).alias("lp"))


def _found_many(strings: DataFrame, requests: DataFrame) -> DataFrame:
    low, _ = _lowered(strings, requests)
    found = candidates(strings, requests).join(low, ["page_id", "pos"]).where(F.col("low").contains(F.col("lp")))
    return found.select("page_id", "pos", "lp")


def first_hits(strings: DataFrame, requests: DataFrame, few: int = FEW) -> DataFrame:
    """(page_id, phrase_id, hit): the least ``pos`` of the strings (page_id, pos, text) that contain the request's phrase
    (page_id, phrase_id, phrase), letter case aside. Requests without a hit, or with an empty phrase, have no row."""
    req = _lowered(strings, requests)[1]
    busy = req.select("page_id", "lp").distinct().groupBy("page_id").count().where(F.col("count") > few).select("page_id")
    if busy.isEmpty():  # one look at the requests saves the index
        found = _found_few(strings, requests)
    else:
        few_s, few_r = (d.join(busy, "page_id", "left_anti") for d in (strings, requests))
        many_s, many_r = (d.join(busy, "page_id", "left_semi") for d in (strings, requests))
        found = _found_few(few_s, few_r).unionByName(_found_many(many_s, many_r))
    hits = found.groupBy("page_id", "lp").agg(F.min("pos").alias("hit"))
    return req.join(hits, ["page_id", "lp"]).select("page_id", "phrase_id", "hit")
