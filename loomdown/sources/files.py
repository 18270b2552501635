"""HTML files as page rows.

* S2 ``scan_dir``: every ``*.htm*`` file directly inside a folder (the glob is part of the path, so nested folders are
  never read), with its path kept as the ordering key.
* S1 decoding: the bytes are read by the ``binaryFile`` source and kept only if they are valid UTF-8
  (``is_valid_utf8``), otherwise the row is a failure with ``status = 'bad_encoding'``.
* Requested paths that do not exist become ``status = 'missing'`` rows (left-anti join against what was read).

Output: ``(page_id, path, mtime, html, status)``; ``page_id`` is the path itself, so no two files share a key.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
PAGE_SCHEMA = "page_id string, path string, mtime timestamp, html string, status string"


def decode_files(raw: DataFrame) -> DataFrame:
    """S1 on binaryFile rows: strict UTF-8 with line ends as LF, or a bad_encoding failure row."""
    s = F.col("content").cast("string")
    ok = F.is_valid_utf8(s)
    path = _norm(F.col("path"))
    return raw.select(
        path.alias("page_id"), path.alias("path"), F.col("modificationTime").alias("mtime"),
        F.when(ok, F.regexp_replace(s, "\r\n?", "\n")).alias("html"), F.when(ok, "ok").otherwise("bad_encoding").alias("status"))


def scan_dir(spark: SparkSession, directory: str, pattern: str = "*.htm*") -> DataFrame:
    """Files matching ``pattern`` directly in ``directory``; an empty folder gives an empty DataFrame."""
    path = directory.rstrip("/") + "/" + pattern
    if not _lists(spark, path):
        return spark.createDataFrame([], PAGE_SCHEMA)
    return decode_files(spark.read.format("binaryFile").load(path))


def _norm(path_col):
    return F.regexp_replace(path_col, r"^file:", "")


def read_requested(spark: SparkSession, requested: DataFrame, folders: list[str]) -> DataFrame:
    """S1 for a table of paths (column ``path``) below ``folders``, the caller's own list (its configuration, not data):
    found files are decoded, the others become 'missing' rows. One load lists all folders and is semi-joined with the
    request; neither paths nor contents pass through the driver."""
    files = requested.select(_norm(F.col("path")).alias("path")).distinct()
    there = [p for p in (f.rstrip("/") + "/*" for f in folders) if _lists(spark, p)]
    if not there:
        found = spark.createDataFrame([], PAGE_SCHEMA)
    else:
        raw = spark.read.format("binaryFile").load(there)
        found = decode_files(raw.withColumn("path", _norm(F.col("path"))).join(files, "path", "left_semi"))
    missing = files.join(found.select("path"), "path", "left_anti").select(
        F.col("path").alias("page_id"), "path", F.lit(None).cast("timestamp").alias("mtime"),
        F.lit(None).cast("string").alias("html"), F.lit("missing").alias("status"))
    return found.unionByName(missing)


def _lists(spark: SparkSession, pattern: str) -> bool:
    """Whether the pattern names any file."""
    try:
        spark.read.format("binaryFile").load(pattern)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def file_stem(path_col) -> F.Column:
    """T9 fallback for files: the file stem with '_' and '-' turned into spaces."""
    stem = F.regexp_extract(path_col, r"([^/]*?)(\.[^./]*)?$", 1)
    return F.translate(stem, "_-", "  ")
