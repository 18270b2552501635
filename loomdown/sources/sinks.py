"""S4/S5 sinks: note files and merged notes kept over several runs.

Each run overwrites its own ``run=N`` folder, so a run that is repeated after a failure leaves no second copy. Readers
resolve the runs: a file name belongs to its last run (overwrite), a merged target holds all runs in order (append).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomdown.functions import text as T
from loomdown.operators.notes import merged_notes, note_files
from loomdown.plans.answers import MESSAGES


def _runs(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(folder.rstrip("/"))
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_note_files(notes: DataFrame, folder: str, run: int, opts, order_key=("page_id", "phrase_id")) -> None:
    """The run's winning note of each file name."""
    note_files(notes, opts, order_key).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/run={int(run)}")


def export_notes(notes: DataFrame, folder: str, run: int, opts, order_key=("page_id", "phrase_id")) -> dict[str, int]:
    """S4 with A1 and A3 from the same run: writes the note files and returns ``total``, ``exported`` and the number of rows of each failure
    status, as metrics observed on the rows on their way to the files. The notes are computed once."""
    kinds = [k for k in MESSAGES if k != "ok"]
    exported = (F.col("status") == "ok") & (F.length(F.coalesce("markdown", F.lit(""))) > 0)
    seen = Observation()
    watched = notes.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(exported).alias("exported"),
                            *[F.count_if(F.col("status") == k).alias(k) for k in kinds])
    write_note_files(watched, folder, run, opts, order_key)
    return dict(seen.get)


def read_note_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files as the runs left them: the last run that wrote a name wins (a partial aggregate)."""
    rows = spark.read.parquet(folder.rstrip("/"))
    rest = [c for c in rows.columns if c != "file_name"]
    won = rows.groupBy("file_name").agg(F.max_by(F.struct(*rest), "run").alias("w"))
    return won.select("file_name", *[F.col(f"w.{c}").alias(c) for c in rest])


def append_merged(notes: DataFrame, target: str, folder: str, run: int, opts, order_key=("page_id", "phrase_id")) -> None:
    """The run's pieces of a merged target. If an earlier run has written the target, no piece carries the front matter."""
    spark = notes.sparkSession
    runs = _runs(spark, folder)
    started = runs is not None and not runs.where(
        (F.col("run") < int(run)) & (F.col("merge_target") == T.merge_target_name(F.lit(target)))).isEmpty()
    pieces = merged_notes(notes, target, opts, order_key, started)
    pieces.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/run={int(run)}")


def read_merged(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces; concatenated by (run, order key) they are the merged file of their target."""
    return spark.read.parquet(folder.rstrip("/"))
