"""Operator 10, exact dedup: group by a 128-bit content hash, compare bytes inside the group, keep one stable id.

DataFrame functions only. The text is part of the grouping key *after* its hash: the hash-aggregate finds the group
by hash and then compares the key's bytes, so two texts with one hash never merge. Copies collapse map-side, hence a
group holding a third of all rows sends one row per task through the shuffle. The rows then look up their group by
hashes alone (no text moves a second time), in a join whose large groups AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as the empty text. Ties: rows repeating one id and text are one row for the decision, each of
    them is reported (kept if its id is the kept one), and all count in group_size. A null id is kept only if its group
    has no other id. An empty table gives no rows; other input columns are ignored, whatever their names.
    """
    best = {"max": F.max, "min": F.min}[keep]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.select("id", "t", F.md5(F.encode("t", "UTF-8")).alias("h128"))
    # (h128, t): byte comparison inside a hash group
    groups = rows.groupBy("h128", "t").agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
    sha = F.sha2(F.encode("t", "UTF-8"), 256).alias("text_sha256")
    groups = groups.select("h128", sha, "keep_id", "group_size")
    light = rows.select("id", "h128", sha)
    out = light.join(groups, ["h128", "text_sha256"])
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
