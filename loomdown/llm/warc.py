"""Operator 6, WARC: a deterministic sharded writer and its reader.

Writing: page ids are cut into shards of about equal payload bytes by the exact running byte sum over the ids (no sampling, so the
shards are the same in every run); the number of shards follows the bytes, each shard is a task, and an id heavier than a shard,
the null id too, spreads over several. Only records equal in id and payload stay in one shard. Each shard's records are sorted by page id and streamed, one gzip member a record, into
files that roll when their compressed size reaches ``roll_bytes``. Headers and digests are made anew from the payload.
Files are written under temporary names; a task reports them in a manifest, and only files named by the manifest get
their final names, so attempts lost with an executor leave nothing behind that a reader would take.

Equal payloads are stored once: the record of the largest page id is the response, the others are revisits that refer
to it. Payloads are equal when length, SHA-1 and SHA-256 agree. Who refers to whom comes from a partial-aggregated maximum per payload; the pages themselves are shuffled once.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdown.llm.common import shared_dir, written
from loomdown.llm.files import TemporaryFile, commit, open_fs

SHARD_BYTES = 64 << 20
ROLL_BYTES = 32 << 20
SLICE_IDS = 1 << 20
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of a SHA-1 given in hex: five hex digits are four symbols."""
    out = []
    for i in range(8):
        v = F.conv(F.substring(sha1_hex, 1 + 5 * i, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_B32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


class Shards:
    """Where ids go: shard i holds the ids up to ``ends[i]``; an id (the null id included) heavier than a shard takes more shards,
    ``more[id]`` = (first extra shard, number of extras), over which its records are spread by their hash.

    It has one number per shard, that is per ``shard_bytes`` of payload, so its size is known from the input's."""

    def __init__(self, ends: np.ndarray, heavy: list[tuple[int | None, int]]):
        self.ends, self.count, self.more = ends, len(ends) + 1, {}
        for i, extra in sorted(heavy, key=lambda x: (x[0] is not None, x[0] or 0)):
            self.more[i] = (self.count, extra)
            self.count += extra

    def of(self, ids: pa.Array, spread: np.ndarray) -> np.ndarray:
        null = np.asarray(ids.is_null())
        values = np.asarray(ids.fill_null(0))
        out = np.searchsorted(self.ends, values, side="left").astype(np.int32)
        out[null] = 0
        for i, (first, extra) in self.more.items():
            at = np.flatnonzero(null if i is None else ~null & (values == i))
            lot = spread[at].astype(np.uint64) % np.uint64(extra + 1)
            out[at] = np.where(lot == 0, out[at], first + lot.astype(np.int64) - 1)
        return out


def shard_plan(sizes: DataFrame, target: int, slice_ids: int = SLICE_IDS) -> Shards:
    """The shards of (id, b) rows: ids in order, a new shard whenever ``target`` bytes are full.

    The running byte sum is taken in id slices (a range partitioning, written once) plus each slice's offset, so its length
    is not bounded by a task, and the number of jobs does not follow the data. Offsets, and so shards, do not depend on where the slices were cut.
    """
    ids = written(sizes.groupBy("id").agg(F.sum("b").alias("b")))
    total, number = ids.agg(F.sum("b"), F.count("id")).first()
    if total is None or total <= target:
        return Shards(np.zeros(0, dtype=np.int64), [])
    heavy = [(r.id, -(-r.b // target) - 1) for r in ids.where(F.col("b") > target).collect()]
    # a heavy id counts in its first shard with the share that stays there
    share = F.least(F.col("b"), F.lit(target))
    known = ids.where(F.col("id").isNotNull()).select("id", share.alias("b"))
    sliced = written(known.repartitionByRange(max(1, -(-number // slice_ids)), "id").withColumn("slice", F.spark_partition_id()))
    totals = sliced.groupBy("slice").agg(F.sum("b").alias("t"))
    offsets = totals.select("slice", (F.sum("t").over(Window.orderBy("slice")) - F.col("t")).alias("off"))  # a row per slice of ids
    run = F.sum("b").over(Window.partitionBy("slice").orderBy("id")) - F.col("b")
    placed = sliced.withColumn("run", run).join(offsets, "slice").select("id", F.floor((F.col("run") + F.col("off")) / target).alias("shard"))
    last = placed.groupBy("shard").agg(F.max("id").alias("last")).select("last").toArrow().column(0).to_numpy()
    return Shards(np.sort(last)[:-1], heavy)


def _record(page_id, copy: int | str, url: str, html: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit has headers only and names the response's record."""
    name = f"{'null' if page_id is None else page_id}:{copy}"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = head if refers_to is not None else head + html
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{_digest(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}:0>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8") + block + b"\r\n\r\n"


def _digest(data: bytes) -> str:
    import base64

    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url",
               min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES,
               slice_ids: int = SLICE_IDS) -> DataFrame:
    """Writes the archives below ``folder`` and returns the manifest (name, records, bytes, first_id, last_id).

    A null payload is empty; a null url is written as an empty target. Rows repeating an id are written once each; of equal
    payloads under the largest id the first in sort order is the response, its repeats are revisits of it. Rows with a
    null id come first, each as a response. White space and control characters in a url are percent-encoded. An empty table writes no archive, only the manifest.
    Other columns, whatever their names, are not read.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    url = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\x00-\x20\x7f]", "%20")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), payload.alias("html"))
    size = F.octet_length("html").cast("long")
    # payloads are equal when length, SHA-1 and SHA-256 agree
    key = F.concat(F.unhex(F.lpad(F.hex(size), 16, "0")), F.unhex(F.sha1("html")), F.unhex(F.sha2("html", 256)))
    light = written(rows.select("id", size.alias("b"), key.alias("k")))
    shards = shard_plan(light.select("id", "b"), shard_bytes, slice_ids)
    sent = spark.sparkContext.broadcast(shards)

    equal = light.where((F.col("b") >= min_bytes) & F.col("id").isNotNull())
    groups = equal.groupBy("k").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where(F.col("n") > 1)
    meta = equal.select("id", "k").distinct().join(groups.select("k", "refers_to"), "k").select(
        "id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "k", F.lit(0).alias("kind"), "refers_to")
    full = rows.select("id", "url", "html", key.alias("k"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"))

    @F.arrow_udf("int")
    def place(ids: pa.Array, spread: pa.Array) -> pa.Array:
        return pa.array(sent.value.of(ids, np.asarray(spread)), pa.int32())

    # equal payloads of one id stay together (the first is the response); records of the null id refer to none
    spread = F.xxhash64("k", F.when(F.col("id").isNull(), F.col("url")))
    # each page's meta row sorts right before the page itself; shard i is partition i
    ordered = full.unionByName(meta).withColumn("shard", place("id", F.shiftright(spread, 1).bitwiseAND(F.lit((1 << 62) - 1))))
    ordered = ordered.repartitionById(shards.count, "shard").sortWithinPartitions("shard", "id", "k", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: TemporaryFile | None = None
        now, seq, note, last, number, done = -1, 0, (None, None, None), object(), 0, None

        def finish():
            out.close()
            done = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
                (out.name, out.temp, stats["records"], stats["bytes"], stats["first"], stats["last"]),
                (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                names=["name", "temp", "records", "bytes", "first_id", "last_id"])
            return done

        stats = {}
        for b in batches:
            for i in range(b.num_rows):
                page, url, html, k, kind, ref, sh = (b.column(j)[i].as_py() for j in range(7))
                if kind == 0:
                    note = (page, k, ref)
                    continue
                if out is not None and (sh != now or stats["bytes"] >= roll_bytes):
                    yield finish()
                    out = None
                    seq = seq + 1 if sh == now else 0
                if sh != now:
                    now, seq = sh, 0
                if page != last:
                    last, number, done = page, 0, None
                noted = page is not None and note[:2] == (page, k)
                refers = note[2] if noted else None
                if refers == page and k != done:  # the first of its payload under the largest id
                    refers = None
                done = k
                # the response of a payload is copy 0 of its page, so that revisits can name it
                first = refers is None and noted
                number += 1
                copy = 0 if first else f"{now}-{number}"
                if out is None:
                    out = TemporaryFile(folder, f"part-{now:06d}-{seq:05d}.warc.gz")
                    stats = {"records": 0, "bytes": 0, "first": page, "last": page}
                data = _member(_record(page, copy, url, html, _digest(html), refers))
                out.write(data)
                stats["records"] += 1
                stats["bytes"] += len(data)
                stats["last"] = page
        if out is not None:
            yield finish()

    cols = ["id", "url", "html", "k", "kind", "refers_to", "shard"]
    parts = written(ordered.select(*cols).mapInArrow(run, "name string, temp string, records long, bytes long, first_id long, last_id long"))

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for temp, name in zip(b.column(1).to_pylist(), b.column(0).to_pylist()):
                commit(folder, temp, name)
            yield b.select(["name", "records", "bytes", "first_id", "last_id"])

    done = parts.mapInArrow(publish, "name string, records long, bytes long, first_id long, last_id long")
    done.write.mode("overwrite").parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.parquet(f"{folder}/_manifest")


class _Members:
    """Reads concatenated gzip members from a stream piece by piece; yields each member's bytes."""

    def __init__(self, stream, piece: int = 1 << 20):
        self.stream, self.piece = stream, piece

    def __iter__(self):
        rest = b""
        while True:
            z, out = zlib.decompressobj(31), io.BytesIO()
            while not z.eof:
                if not rest:
                    rest = self.stream.read(self.piece)
                    if not rest:
                        if out.tell():
                            raise ValueError("truncated archive")
                        return
                out.write(z.decompress(rest))
                rest = z.unused_data if z.eof else b""
            yield out.getvalue()


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return headers, block[: int(headers["content-length"])]


def read_warc(folder: str, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) of every record of the archives.

    The digest and size of a response come from its payload and must equal its headers; a revisit states those of the
    payload it refers to. A damaged record raises an error.
    """
    n = max(1, manifest.count())
    names = manifest.select("name").repartition(n)  # dealt one by one, a file a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                f, root = open_fs(folder)
                rows, held = [], 0
                with f.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in _Members(stream):
                        h, block = _parse(data)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest, kind = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
                        if kind == "response" and (_digest(payload) != digest or len(payload) != size):
                            raise ValueError(f"damaged record {h['warc-record-id']} in {name}")
                        ident = h["warc-record-id"].split(":")[2]
                        ref = h.get("warc-refers-to")
                        rows.append((None if ident == "null" else int(ident), h["warc-target-uri"], kind, size, digest,
                                     int(ref.split(":")[2]) if ref else None, payload if with_payload else None))
                        held += len(payload) if with_payload else 200
                        if held > 8 << 20:
                            yield _batch(rows, with_payload)
                            rows, held = [], 0
                yield _batch(rows, with_payload)

    return names.mapInArrow(run, _schema(with_payload))


_TYPES = [("page_id", "long", pa.int64()), ("url", "string", pa.string()), ("record_type", "string", pa.string()), ("payload_bytes", "long", pa.int64()),
          ("payload_digest", "string", pa.string()), ("refers_to", "long", pa.int64()), ("payload", "binary", pa.binary())]


def _schema(with_payload: bool) -> str:
    return ", ".join(f"{n} {t}" for n, t, _ in _TYPES[: 7 if with_payload else 6])


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    types = _TYPES[: 7 if with_payload else 6]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, _, t) in enumerate(types)], names=[n for n, _, _ in types])


def archive_roundtrip(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages into new archives in the shared folder and reads them back, a row per page."""
    folder = shared_dir(pages.sparkSession)
    return read_warc(folder, write_warc(pages, folder, **options))
