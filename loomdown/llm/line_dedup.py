"""Operator 5, line dedup by distinct-site spread.

Every line's hash gets a HyperLogLog sketch of the sites it occurs on; sketches merge by aggregation (map-side first, so
a line found everywhere is one small row per task). Lines whose estimate is clearly above the threshold are
boilerplate; lines near it get an exact distinct count. Then boilerplate lines leave all documents of all sites.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdown.llm.common import written

MIN_SITES = 10
BAND = 0.3
LG_K = 10


def _key(line: Column) -> Column:
    """Lines are compared without leading and trailing spaces, tabs and carriage returns."""
    return F.btrim(line, F.lit(" \t\r"))


def _occurrences(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, tk, site, pos, h1, h2): a row per line that is not blank; 128 bits of hash name the line."""
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tk"), F.col(site_col).alias("site"),
                    F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    d = d.select("id", "tk", "site", "pos", _key(F.col("line")).alias("k")).where(F.col("k") != "")
    return d.select("id", "tk", "site", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), F.col("k")).alias("h2"))


def boilerplate_lines(occ: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2, sites) of the lines on at least ``min_sites`` distinct sites (a null site is no site)."""
    spread = occ.where(F.col("site").isNotNull()).groupBy("h1", "h2").agg(
        F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(lg_k)).alias("sk"))
    # a line cannot be on more sites than it has occurrences
    est = spread.where(F.col("n") >= min_sites).select("h1", "h2", F.hll_sketch_estimate("sk").alias("est"))
    est = written(est.where(F.col("est") >= min_sites * (1 - band)))
    sure = est.where(F.col("est") > min_sites * (1 + band)).select("h1", "h2", F.col("est").alias("sites"))
    near = est.where(F.col("est") <= min_sites * (1 + band)).select("h1", "h2")
    # the distinct step before the count pre-aggregates (line, site) pairs map-side
    pairs = occ.where(F.col("site").isNotNull()).join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.unionByName(exact)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
               min_sites: int = MIN_SITES, band: float = BAND, lg_k: int = LG_K) -> DataFrame:
    """The input's columns with ``text_col`` cleaned, plus ``n_lines`` and ``n_removed_lines``.

    Null text stays null (0 lines); an empty text has one blank line. Blank lines are kept. Rows repeating one id and
    text get the same result each. An empty table gives no rows. Clashing columns named like the two counts are
    replaced.
    """
    occ = _occurrences(docs, id_col, text_col, site_col)
    marked = written(boilerplate_lines(occ, min_sites, band, lg_k).select("h1", "h2"))
    hits = occ.select("id", "tk", "pos", "h1", "h2").join(marked, ["h1", "h2"], "left_semi")
    drops = hits.groupBy("id", "tk").agg(F.collect_set("pos").alias("drop_pos"))
    base = docs.drop("n_lines", "n_removed_lines")
    names = base.columns
    d = base.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("jid"), F.xxhash64(F.col(text_col)).alias("jtk"))
    j = d.join(drops, d.jid.eqNullSafe(drops.id) & (d.jtk == drops.tk), "left")

    @F.pandas_udf("string")
    def without(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, drop in parts:
            out = []
            for t, p in zip(text, drop):
                if t is None or p is None:
                    out.append(None)
                else:
                    gone = set(p)
                    out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
            yield pd.Series(out, dtype=object)

    text = F.col(f"row.`{text_col}`")
    hit = F.col("drop_pos").isNotNull()
    cleaned = F.when(hit, without(F.when(hit, text), F.col("drop_pos"))).otherwise(text)
    return j.select(
        *[(cleaned.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c)) for c in names],
        F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop_pos"), F.lit(0)).cast("long").alias("n_removed_lines"))
