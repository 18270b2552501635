"""E1 whole-page notes: scan -> N1..N3 -> T2..T9 -> F1..F12 -> F14 -> R1..R6 -> L7, R7 -> T10, T13 -> S4/S5.

One Exchange moves the page rows by ``page_id``; titles, clean-up and rendering reuse that partitioning. The node table
(read by titles and clean-up) and the cleaned rows (read by rendering, code languages and the A4 count) are
materialised with a reliable checkpoint that keeps the partitioning (see ``plans.materialize``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdown.functions import text as T
from loomdown.operators.chrome import clean_page
from loomdown.operators.markdown import RENDER_COLS, prepare_rows, render_prepared, with_piece
from loomdown.operators.nodes import build_nodes, page_partitions, without_closes
from loomdown.operators.titles import page_titles
from loomdown.plans.materialize import materialize


def url_stem(url: Column, key: Column) -> Column:
    """File-stem analogue for pages read from a table: last URL path segment without extension, else 'page <id>'."""
    seg = F.regexp_extract(url, r"^(?:[a-z]+://[^/]*)?[^?#]*?/?([^/?#]*?)(?:\.[^./?#]*)?(?:[?#].*)?$", 1)
    stem = F.when(seg != "", seg).otherwise(F.concat(F.lit("page_"), key.cast("string")))
    return F.translate(stem, "_-", "  ")


def postprocess_full_page(md: Column) -> Column:
    """R3-R6."""
    return T.lstrip_newlines(T.squeeze_blank(T.strip_conversation_with(T.strip_brand_headings(md))))


def page_notes(pages: DataFrame, opts, key: str = "page_id", html: str = "html", stem: Column | None = None,
               nodes: DataFrame | None = None) -> DataFrame:
    """One row per input page: (page_id, title, file_name, markdown, word_count, tags, n_code, removed_code, status,
    message). ``stem`` is the fallback raw title (file stem with '_'/'-' as spaces)."""
    if nodes is None:
        nodes = materialize(without_closes(build_nodes(pages, opts, key=key, html=html)).drop("any_text"), opts.materialize)
    titles = materialize(page_titles(nodes), opts.materialize, readers=1)
    cleaned = clean_page(nodes, opts).where(F.col("in_region") | F.col("user_code")).select(*RENDER_COLS, "in_region", "user_code")
    cleaned = materialize(prepare_rows(with_piece(cleaned), F.col("in_region")), opts.materialize)
    removed = cleaned.where(F.col("user_code")).groupBy("page_id").agg(F.count("*").alias("removed_code"))
    region = cleaned.where(F.col("in_region"))
    md = materialize(render_prepared(region, opts), opts.materialize, readers=1).withColumn("markdown", postprocess_full_page(F.col("markdown")))
    base = pages.select(F.col(key).alias("page_id"), (stem if stem is not None else F.lit(None).cast("string")).alias("stem"))
    # tags and titles are read off whole notes: dealt over all cores, however few bytes the keys have
    base = base.repartition(page_partitions(pages.sparkSession), "page_id")
    j = base.join(md, "page_id", "left").join(titles, "page_id", "left").join(removed, "page_id", "left")
    markdown = F.coalesce(F.col("markdown"), F.lit(""))
    raw_title = F.coalesce(F.col("title"), F.col("stem"), F.concat(F.lit("page "), F.col("page_id").cast("string")))
    title = T.smart_title(raw_title, opts)
    ok = markdown != ""
    return j.select(
        "page_id",
        F.col("title").alias("page_title"),
        title.alias("title"),
        T.file_name(title, opts.max_filename_length).alias("file_name"),
        markdown.alias("markdown"),
        T.word_count(markdown).alias("word_count"),
        T.auto_tags(markdown).alias("tags"),
        F.coalesce(F.col("n_code"), F.lit(0)).cast("long").alias("n_code"),
        F.coalesce(F.col("removed_code"), F.lit(0)).cast("long").alias("removed_code"),
        F.when(ok, "ok").otherwise("empty").alias("status"),
        F.when(ok, "Full-page export successful.").otherwise("Nothing to export: empty Markdown.").alias("message"),
    )
