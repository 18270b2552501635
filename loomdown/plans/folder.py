"""E1 over a folder: every ``*.htm*`` file directly in it -> notes, file outputs and the batch summary (A1).

Files that fail to decode become failure rows (``bad_encoding``); a file name shared by several notes is won by the
last path in path order (S4), or every note goes into one merged target (S5) whose pieces are ordered by path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdown.operators.notes import export_summary, merged_notes, note_files
from loomdown.plans.answers import MESSAGES
from loomdown.plans.full_page import page_notes
from loomdown.sources.files import file_stem, scan_dir


def folder_notes(spark: SparkSession, directory: str, opts, merge_target: str | None = None,
                 pattern: str = "*.htm*") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, outputs, summary): one note row per file, the file outputs (S4 rows or S5 pieces), exported/total."""
    pages = scan_dir(spark, directory, pattern)
    ok = pages.where(F.col("status") == "ok")
    notes = page_notes(ok, opts, stem=file_stem(F.col("path"))).join(ok.select("page_id", "path"), "page_id")
    failed = pages.where(F.col("status") != "ok").select(
        "page_id", "path", "status", F.lit(MESSAGES["bad_encoding"]).alias("message"))
    cols = ["page_id", "path", "title", "file_name", "markdown", "word_count", "tags", "status", "message"]
    all_notes = notes.select(*cols).unionByName(failed, allowMissingColumns=True)
    if merge_target:
        outputs = merged_notes(all_notes, merge_target, opts, order_key=("path",))
    else:
        outputs = note_files(all_notes, opts, order_key=("path",))
    return all_notes, outputs, export_summary(all_notes)
