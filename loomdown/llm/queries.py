"""The registered queries of the training-data operators and their DuckDB SQL (where SQL can express them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdown.llm.common import held_out, read_table


def op1_lang_id(spark, sf_dir):
    from loomdown.llm.lang_id import fit, predict

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = predict(docs, fit(docs.where(~held_out() & F.col("doc_id").isNotNull())))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_packing(spark, sf_dir):
    import public_tokenizers

    from loomdown.llm.packing import pack, unpack_documents

    pieces, folder = pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    back = unpack_documents(pieces, folder)
    back = back.select("shard", "row", "row_offset", "sha256", "segment_ok")
    return pieces.join(back, ["shard", "row", "row_offset"], "left").select(
        "doc_id", "n_tokens", "piece", "shard", "row", "row_offset", "length", "sha256", "segment_ok")


def op3_suffix_dedup(spark, sf_dir):
    from loomdown.llm.suffix_dedup import remove_repeats

    r = remove_repeats(read_table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash(spark, sf_dir):
    from loomdown.llm.simhash import simhash_components

    c = simhash_components(read_table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark, sf_dir):
    from loomdown.llm.line_dedup import line_dedup

    d = line_dedup(read_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", F.col("n_removed_lines").alias("n_removed"),
                    F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op6_warc(spark, sf_dir):
    from loomdown.llm.warc import archive_roundtrip

    return archive_roundtrip(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_bpe(spark, sf_dir):
    import public_tokenizers

    from loomdown.llm.bpe import roundtrip

    return roundtrip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_decontam(spark, sf_dir):
    from loomdown.llm.decontam import contamination

    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark, sf_dir):
    from loomdown.llm.toxicity import fit, score

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels")
    got = score(docs, fit(docs.where(~held_out()), labels.where(~held_out())))
    return got.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_exact_dedup(spark, sf_dir):
    from loomdown.llm.exact_dedup import exact_dedup

    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op11_recompression(spark, sf_dir):
    from loomdown.llm.recompression import remove_repeats

    r = remove_repeats(read_table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op12_whitening(spark, sf_dir):
    from loomdown.llm.whitening import whitened_embeddings

    return whitened_embeddings(read_table(spark, sf_dir, "embeddings"))


def turn_repair_rows(conversations):
    """The contract's rows of a conversations table: damage, repair, digests."""
    from loomdown.llm.turn_repair import conversation_hashes, damaged, repair

    summary, turns = repair(damaged(conversations))
    sha = conversation_hashes(turns).withColumnRenamed("conv", "hashed")
    j = summary.join(sha, summary["conv"].eqNullSafe(sha["hashed"]))
    return j.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_turn_repair(spark, sf_dir):
    return turn_repair_rows(read_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_lang_id": op1_lang_id,
    "op2_packing": op2_packing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_simhash": op4_simhash,
    "op5_line_dedup": op5_line_dedup,
    "op6_warc": op6_warc,
    "op7_bpe": op7_bpe,
    "op8_decontam": op8_decontam,
    "op9_toxicity": op9_toxicity,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_recompression": op11_recompression,
    "op12_whitening": op12_whitening,
    "op13_turn_repair": op13_turn_repair,
}

_TRIM = "trim(l, ' ' || chr(9) || chr(13))"

ORACLE_SQL = {
    "op5_line_dedup": f"""
with occ as (select source, {_TRIM} as k from (select source, unnest(string_split(text, chr(10))) as l from documents)),
boiler as (select k from occ where k <> '' group by k having count(distinct source) >= 10),
b as (select coalesce(list(k), []) as ks from boiler),
d as (select doc_id, text, coalesce(string_split(text, chr(10)), []) as ls from documents),
f as (select doc_id, text, ls, list_filter(ls, lambda l: not list_contains(ks, {_TRIM})) as kept from d, b)
select doc_id, len(ls)::bigint as n_lines, (len(ls) - len(kept))::bigint as n_removed,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) as kept_sha256
from f""",
    "op6_warc": f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as d from pages)
select page_id, octet_length(encode(html)) as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(d, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31) + 1)::bigint, 1)), '') as payload_digest,
       case when page_id = max(page_id) over w then 'response' else 'revisit' end as record_type,
       case when page_id <> max(page_id) over w then max(page_id) over w end as refers_to
from p window w as (partition by html)""",
    "op10_exact_dedup": """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))""",
}
