"""S4-S6 note outputs, R8/R9 note text, A1-A4 summaries.

* S4 (separate notes): the same file name overwrites, so the last request in (page_id, phrase_id) order wins ->
  ``max_by`` per file name: a partial (map-side) aggregate, so a file name shared by a third of all notes is combined
  before the shuffle instead of landing whole in one task.
* S5 (one merged note): kept one row per note with its ordering key and its piece (header + body, or separator +
  body); the file is the concatenation of pieces in key order, assembled at export. The per-target first key is a
  partial aggregate of one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdown.functions import text as T



def note_files(notes: DataFrame, opts, order_key=("page_id", "phrase_id")) -> DataFrame:
    """(file_name, page_id, phrase_id, title, content) for the winning note of each file name."""
    ok = notes.where((F.col("status") == "ok") & (F.length("markdown") > 0))
    key = F.struct(*[F.col(c) for c in order_key])
    win = ok.groupBy("file_name").agg(F.max_by(F.struct(*order_key, "title", "markdown", "tags"), key).alias("w"))
    return win.select(
        "file_name", *[F.col(f"w.{c}").alias(c) for c in order_key], F.col("w.title").alias("title"),
        T.note_text(F.col("w.title"), F.col("w.markdown"), F.col("w.tags"), opts).alias("content"))


def merged_notes(notes: DataFrame, target: str, opts, order_key=("page_id", "phrase_id"), started: bool = False) -> DataFrame:
    """One row per exported note: (merge_target, page_id, phrase_id, piece); concatenating ``piece`` in
    (page_id, phrase_id) order gives the merged file. Front matter title/tags come from the first note; a target that was
    ``started`` earlier has its front matter already."""
    ok = notes.where((F.col("status") == "ok") & (F.length("markdown") > 0)).withColumn("merge_target", T.merge_target_name(F.lit(target)))
    key = F.struct(*[F.col(c) for c in order_key])
    firsts = ok.groupBy("merge_target").agg(F.min(key).alias("first_key"))
    # one target, hence one row: the broadcast is bounded by construction
    j = ok.join(F.broadcast(firsts), "merge_target")
    is_first = F.lit(False) if started else key == F.col("first_key")
    head = T.note_text(F.col("title"), F.col("markdown"), F.col("tags"), opts)
    sep = F.concat(F.lit("\n\n---\n\n# "), F.col("title"), F.lit("\n\n"), F.col("markdown"))
    return j.select("merge_target", *order_key, F.when(is_first, head).otherwise(sep).alias("piece"))


def export_summary(notes: DataFrame) -> DataFrame:
    """A1: exported / total."""
    ok = (F.col("status") == "ok") & (F.length(F.coalesce(F.col("markdown"), F.lit(""))) > 0)
    return notes.agg(F.sum(ok.cast("long")).alias("exported"), F.count("*").alias("total"))


def reject_summary(notes: DataFrame) -> DataFrame:
    """A3 (+ F15): failures by kind."""
    return notes.where(F.col("status") != "ok").groupBy("status", "message").agg(F.count("*").alias("n"))


def phrase_summary(answers: DataFrame) -> DataFrame:
    """A2: successful extractions per page."""
    return answers.groupBy("page_id").agg(F.sum((F.col("status") == "ok").cast("long")).alias("extracted"),
                                          F.count("*").alias("asked"))
