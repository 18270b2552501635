"""S4/S5 as Markdown files: one object per file name.

Tasks write through a data source (``loomdown_markdown``) into a staging folder of their own; a failed task deletes it, and the
driver's commit keeps only the folders of the tasks that succeeded, so a lost or repeated attempt leaves nothing a reader
would take. A second job then publishes:

* S4, separate notes: each staged file moves to its final name and replaces what was there.
* S5, one merged note: a run's pieces are range-partitioned by the order key, so any number of tasks render and stage
  them; the object is then put together by one task that copies bytes block by block (an object has one writer).

A merged target carries a small state: the run that appended last, its writer, and the object's length before it. A run that
is repeated cuts the object back to that length first, so it is appended exactly once; the state is written before
the object changes. An object that exists already, whoever wrote it, is continued with a separator, not a second front matter.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from loomdown.functions import text as T
from loomdown.operators.notes import merged_notes, note_files
from loomdown.sources.objects import Folder

PART_BYTES = 32 << 20


@dataclass
class StagedTask(WriterCommitMessage):
    folder: str
    files: int


class MarkdownParts(DataSource):
    """Write-only source of (file_name, piece) rows; equal names must be neighbours within a partition."""

    @classmethod
    def name(cls) -> str:
        return "loomdown_markdown"

    def schema(self) -> str:
        return "file_name string, piece string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PartsWriter(self.options["folder"], self.options["staging"])


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, staging: str):
        self.folder, self.staging = folder, staging

    def write(self, iterator) -> StagedTask:
        folder, out, now, files = Folder(self.folder), None, None, 0
        mine = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}"
        try:
            for batch in iterator:
                for name, piece in zip(batch.column(0), batch.column(1)):
                    if name.as_py() != now:
                        if out is not None:
                            out.close()
                        now, files = plain_name(name.as_py()), files + 1
                        out = folder.writer(f"{self.staging}/{mine}/{now}")
                    out.write((piece.as_py() or "").encode("utf-8"))
            if out is not None:
                out.close()
        except BaseException:
            folder.drop(f"{self.staging}/{mine}")
            raise
        return StagedTask(mine, files)

    def commit(self, messages) -> None:
        """Folders of attempts that did not commit go; the list of the others makes the staged files valid."""
        folder = Folder(self.folder)
        kept = {m.folder: m.files for m in messages if m is not None and m.files}
        for name in set(folder.names(self.staging)) - kept.keys():
            folder.drop(f"{self.staging}/{name}")
        folder.replace(f"{self.staging}/_tasks", [json.dumps(kept, sort_keys=True).encode()])

    def abort(self, messages) -> None:
        Folder(self.folder).drop(self.staging)


def plain_name(name: str | None) -> str:
    if not name or "/" in name or "\0" in name or name in (".", "..") or name.startswith("_"):
        raise ValueError(f"not a file name for a note: {name!r}")
    return name


def _stage(rows: DataFrame, folder: str) -> tuple[str, dict[str, int]]:
    """(staging folder, the committed task folders in partition order with their numbers of files)"""
    rows.sparkSession.dataSource.register(MarkdownParts)
    staging = f"_staging/{uuid.uuid4().hex}"
    rows.write.format(MarkdownParts.name()).mode("append").options(folder=folder, staging=staging).save()
    return staging, json.loads(b"".join(Folder(folder).whole(f"{staging}/_tasks")))


def write_markdown_files(notes: DataFrame, folder: str, opts, order_key=("page_id", "phrase_id")) -> int:
    """Every file name's winning note becomes ``folder/file_name``; the number of files. Doing a run again leaves the same files.

    Names written by earlier runs and not by this one stay. No exported notes write no file.
    """
    files = note_files(notes, opts, order_key).select("file_name", F.col("content").alias("piece"))
    staging, tasks = _stage(files, folder)
    spark = notes.sparkSession

    def publish(batches):
        there = Folder(folder)
        for b in batches:
            for task in b.column(0).to_pylist():
                for name in there.names(f"{staging}/{task}"):  # an attempt after a lost one moves what is left
                    there.move(f"{staging}/{task}/{name}", name)
            yield b

    if tasks:
        dealt = spark.createDataFrame([(t,) for t in tasks], "task string").repartition(len(tasks))
        dealt.mapInArrow(publish, "task string").write.format("noop").mode("overwrite").save()
    Folder(folder).drop(staging)
    return sum(tasks.values())


def merged_start(folder: Folder, name: str, run: int, writer: str) -> int:
    """The object's length before ``run`` of ``writer`` appends to it; written down before anything changes."""
    state, size = f"_state/{name}.json", folder.size(name) or 0
    last = json.loads(b"".join(folder.whole(state))) if folder.size(state) is not None else None
    if last is not None and last["writer"] == writer:
        if run < last["run"]:
            raise ValueError(f"run {run} of {name} comes after run {last['run']}")
        if run == last["run"]:
            return last["start"]
    folder.replace(state, [json.dumps({"writer": writer, "run": run, "start": size}).encode()])
    return size


def append_markdown(notes: DataFrame, target: str, folder: str, run: int, opts, order_key=("page_id", "phrase_id"), writer: str = "") -> int:
    """The run's notes in key order at the end of ``folder/target.md``; the object's new length in bytes.

    ``run`` numbers grow for each ``writer``; doing the last run again appends nothing twice. A run without exported notes changes nothing.
    """
    spark = notes.sparkSession
    name = plain_name(spark.range(1).select(T.merge_target_name(F.lit(target)).alias("n")).first().n)
    there = Folder(folder)
    start = merged_start(there, name, int(run), writer)
    kept = f"_staging/{uuid.uuid4().hex}"
    address = there.address if "://" in there.address else "file://" + there.address.removeprefix("file:")
    # rendered once: the range partitioning below reads its input twice
    merged_notes(notes, target, opts, order_key, started=start > 0).write.parquet(f"{address}/{kept}")
    pieces = spark.read.parquet(f"{address}/{kept}")
    size = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    n = max(1, -(-size // PART_BYTES))
    ordered = pieces.repartitionByRange(n, *order_key).sortWithinPartitions(*order_key)
    staging, tasks = _stage(ordered.select(F.col("merge_target").alias("file_name"), "piece"), folder)

    def join(batches):
        for b in batches:
            for _ in range(b.num_rows):
                f = Folder(folder)

                def chunks():
                    if start:
                        yield from f.head(name, start)
                    for task in tasks:
                        yield from f.whole(f"{staging}/{task}/{name}")

                yield pa.RecordBatch.from_pydict({"bytes": pa.array([f.replace(name, chunks())], pa.int64())})

    total = there.size(name) or 0
    if tasks or total > start:
        total = spark.range(1, numPartitions=1).mapInArrow(join, "bytes long").first()[0]
    for x in (staging, kept):
        there.drop(x)
    return total


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, content) of the folder's Markdown files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.decode("content", "UTF-8").alias("content"))
