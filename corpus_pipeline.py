"""The training-data pipeline: toxicity filter, boilerplate lines, near duplicates, benchmark leaks, token ids.

``run`` applies STAGES to the documents table. Each stage gets what its predecessor kept, written as Parquet in the shared folder
and read again, so no stage recomputes an earlier one and a lost executor costs only the running tasks. All stages but the
last return the columns of documents; rows with null or empty texts pass through (as empty documents they have one fingerprint and
one of them stays). Rows repeating an id and text are copies like any others, null ids included; an empty table passes all stages
as an empty one. Other columns, whatever their names, pass through unchanged; only text and n_chars change, by line dedup.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdown.llm import bpe, decontam, line_dedup, simhash, toxicity
from loomdown.llm.common import held_out, read_table, written


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9, learned from the labelled documents outside the held-out fold; rejected documents go."""
    labels = read_table(spark, sf_dir, "labels")
    return toxicity.drop_toxic(docs, toxicity.fit(docs.where(~held_out()), labels.where(~held_out())))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines on many sources leave the texts; n_chars follows the text, documents stay."""
    # the operator adds two counts; columns of the documents with these names keep their values
    aside = {c: f"kept_{uuid.uuid4().hex}" for c in docs.columns if c.lower() in ("n_lines", "n_removed_lines")}
    out = line_dedup.line_dedup(docs.withColumnsRenamed(aside))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: three-word shingles, at most two differing bits; the smallest id of each group stays."""
    return simhash.keep_one(docs)


def stage_decontam(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents holding a test item go."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: token counts and digests of the ids and of the decoded bytes."""
    import public_tokenizers

    return bpe.roundtrip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", stage_toxicity),
    ("line_dedup", stage_line_dedup),
    ("simhash", stage_simhash),
    ("decontam", stage_decontam),
    ("bpe", stage_bpe),
]

#: fingerprints and learned scores are beyond SQL; tests/llm compares each stage with a plain version; decontam by planted items
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
