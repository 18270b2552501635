"""Small helpers shared by the operators: table access, the shared folder, written tables, folds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, a local master (tests) gets a temporary folder; on a cluster that is an error,
    because other machines could not read it.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="loomdown-shared-")
    return f"{base.rstrip('/')}/loomdown-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: lineage ends there, lost executors re-read files."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_folder = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that no later step reads (what was made from them must be written itself), and asks the JVM for a
    collection, after which Spark drops the shuffle files of finished steps."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._written_folder)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def held_out(doc_id: str = "doc_id") -> Column:
    """The evaluation fold: crc32 of the id as text leaves remainder 1 modulo 3 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def bounded_sample(df: DataFrame, id_col: str, max_rows: int) -> DataFrame:
    """About ``max_rows`` rows chosen by a hash of the id (all rows when there are fewer): for fitting models only."""
    n = df.count()
    if n <= max_rows:
        return df
    cut = int((1 << 20) * max_rows / n)
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 20)) < cut)


def null_safe(left: DataFrame, right: DataFrame, *names: str) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond
