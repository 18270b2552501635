"""Materialisation points of the long page plans.

A page plan runs tokenise -> nest -> ~12 window stages -> render. Two intermediate tables (the node table and the
cleaned region rows) are each read by several consumers. They are cut with a *reliable* checkpoint into the cluster's
shared ``spark.checkpoint.dir`` (never a local or lineage-less checkpoint): a lost executor re-reads the files instead
of recomputing the pages, and downstream plans start from a small leaf. The checkpoint action runs without adaptive
execution so that the written table keeps its ``hashpartitioning(page_id)``: consumers' windows, aggregates and
joins keyed by page_id then run without another Exchange.

``mode``: "checkpoint" (default; the checkpointed table is also cached in memory for its several readers),
"persist" (MEMORY_AND_DISK, lineage kept) or "none".
"""

from __future__ import annotations

import threading
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from loomdown.session import ensure_checkpoint_dir

# while a table is materialised: no adaptive merging of its partitions, tables dealt by page_id meet on keys that hold page_id
# and more (a place, a piece's number) where they are, instead of both moving, and rows that lie in the order of a group's keys are
# aggregated as they come, instead of by a hash table that spills into a sort
WHILE = {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.replaceHashWithSortAgg": "true"}

_LOCK = threading.Lock()
_OPEN = threading.local()


@contextmanager
def releasing():
    """Tables this thread materialises inside the block leave the cache at its end (a listener's batch is written by then)."""
    before, _OPEN.tables = getattr(_OPEN, "tables", None), []
    try:
        yield
    finally:
        for t in _OPEN.tables:
            t.unpersist()
        _OPEN.tables = before


def _held(df: DataFrame) -> DataFrame:
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if getattr(_OPEN, "tables", None) is not None:
        _OPEN.tables.append(df)
    return df


def materialize(df: DataFrame, mode: str = "checkpoint", readers: int = 2) -> DataFrame:
    """``df`` cut from its plan; a table with one reader is not cached beside its checkpoint."""
    if mode == "none":
        return df
    if mode == "persist":
        return _held(df) if readers > 1 else df
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    with _LOCK:
        prev = {k: spark.conf.get(k) for k in WHILE}
        for k, v in WHILE.items():
            spark.conf.set(k, v)
        try:
            ck = df.checkpoint(eager=True)
        finally:
            for k, v in prev.items():
                spark.conf.set(k, v)
    # the checkpoint files are the reliable copy; consumers read an in-memory columnar cache of them (a lost
    # executor's cached blocks are re-read from the checkpoint files, not recomputed)
    return _held(ck) if readers > 1 else ck
