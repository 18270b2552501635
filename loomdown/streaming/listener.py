"""S3: the folder listener as a Structured Streaming file source.

New ``.html``/``.htm`` files (suffix compared case-insensitively) directly in the watched folder are picked up by
the ``binaryFile`` stream source; files already present when the listener starts are ignored by their modification
time. Each micro-batch runs the same batch plan (whole-page notes by default, or phrase requests joined to the
batch's pages) inside ``foreachBatch`` - the node-table windows are not allowed on a stream, and a page is complete
within its batch, so no state crosses batches. Exactly-once file tracking comes from the checkpoint location.
Writers should move finished files into the folder atomically (this replaces a fixed wait for the writer).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdown.plans.materialize import releasing
from loomdown.sources.files import BINARY_SCHEMA, decode_files, file_stem
from loomdown.sources.markdown_files import append_markdown, write_markdown_files


def html_stream(spark: SparkSession, folder: str, start_ts=None) -> DataFrame:
    """Streaming page rows (page_id, path, mtime, html, status) for new HTML files in ``folder`` (not recursive)."""
    raw = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).load(folder.rstrip("/"))
    raw = raw.where(F.lower(F.col("path")).rlike(r"\.html?$"))
    if start_ts is not None:
        raw = raw.where(F.col("modificationTime") >= F.lit(start_ts).cast("timestamp"))
    return decode_files(raw)


def notes_batch(batch: DataFrame, opts, requests: DataFrame | None = None) -> DataFrame:
    """The per-micro-batch plan: whole-page notes, or answers for phrase requests keyed by path. Files that are not valid
    UTF-8 are failure rows (one per file, or per request on it)."""
    from loomdown.plans.full_page import page_notes

    pages = batch.where(F.col("status") == "ok")
    bad = batch.where(F.col("status") != "ok").select("page_id", "path", "status")
    if requests is None:
        notes = page_notes(pages, opts, stem=file_stem(F.col("path")))
        return notes.join(batch.select("page_id", "path"), "page_id").unionByName(bad, allowMissingColumns=True)
    from loomdown.operators.nodes import build_nodes
    from loomdown.plans.answers import page_answers

    asked = requests.where(F.btrim("phrase") != "")  # a blank phrase asks nothing
    req = asked.join(pages.select("path", "page_id"), "path")
    answers = page_answers(build_nodes(pages, opts), req.select("phrase_id", "page_id", "phrase"), opts)
    answers = answers.join(pages.select("page_id", "path"), "page_id")
    return answers.unionByName(asked.join(bad, "path").select("page_id", "phrase_id", "path", "status"), allowMissingColumns=True)


def start_listener(spark: SparkSession, folder: str, out_dir: str, checkpoint_dir: str, opts, start_ts="now",
                   requests: DataFrame | None = None, trigger: dict | None = None, markdown_dir: str | None = None,
                   merge_target: str | None = None):
    """Run the listener. ``start_ts`` is the modification time from which files count: the listener's start by default,
    None for a backfill of what lies in the folder. Each batch overwrites its own ``batch_id=N`` folder below
    ``out_dir``, so a batch that is replayed after a failure leaves no second copy; ``latest_notes`` reads the result.

    With ``markdown_dir`` each batch also becomes Markdown files there: one per file name, or, with ``merge_target``, the end of
    one merged note in (path, phrase) order. The target's state tells whether it is started and which batch came last, so
    a replayed batch is appended exactly once. What a batch caches is released when it is written."""
    if merge_target and not markdown_dir:
        raise ValueError("a merge target needs markdown_dir")
    if start_ts == "now":
        start_ts = spark.sql("select current_timestamp()").first()[0]
    stream = html_stream(spark, folder, start_ts)

    def run(batch: DataFrame, batch_id: int) -> None:
        folder = f"{out_dir.rstrip('/')}/batch_id={batch_id}"
        with releasing():
            out = notes_batch(batch, opts, requests)
            if "tags" in out.columns:
                out = out.withColumn("tags", F.array_join("tags", ", "))
            out.write.mode("overwrite").parquet(folder)
        if markdown_dir:  # from the written rows: the notes are computed once
            rows = spark.read.schema(out.schema).parquet(folder)
            rows = rows.withColumn("tags", F.filter(F.split("tags", ", "), lambda t: t != ""))
            order = ("path",) if requests is None else ("path", "phrase_id")
            if merge_target:
                append_markdown(rows, merge_target, markdown_dir, batch_id, opts, order, writer=checkpoint_dir)
            else:
                write_markdown_files(rows, markdown_dir, opts, order)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def latest_notes(spark: SparkSession, out_dir: str) -> DataFrame:
    """The listener's notes with the last batch winning a shared file name (failures have none and all stay)."""
    rows = spark.read.parquet(out_dir)
    names = [c for c in rows.columns if c != "file_name"]
    won = rows.where(F.col("file_name").isNotNull()).groupBy("file_name").agg(
        F.max_by(F.struct(*names), F.struct("batch_id", "page_id")).alias("w"))
    return won.select(*[F.col(f"w.{c}").alias(c) if c != "file_name" else F.col(c) for c in rows.columns]).unionByName(
        rows.where(F.col("file_name").isNull()))
