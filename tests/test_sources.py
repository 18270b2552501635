"""File scan, strict decoding, missing paths, and the streaming listener equal to the batch run."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from loomdown.sources.files import read_requested, scan_dir
from loomdown.streaming.listener import notes_batch, start_listener

PAGE = "<html><head><title>{t}</title></head><body><main><h1>{t}</h1><p>Body of {t}.</p></main></body></html>"


def _folder():
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name, t in [("a.html", "Alpha Note"), ("b.htm", "Beta Note"), ("c.HTML", "Gamma Note"), ("d.htmx", "Delta Note")]:
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write(PAGE.format(t=t))
    with open(os.path.join(d, "bad.html"), "wb") as f:
        f.write(b"<p>\xff\xfe broken</p>")
    os.mkdir(os.path.join(d, "nested"))
    with open(os.path.join(d, "nested", "e.html"), "w") as f:
        f.write(PAGE.format(t="Nested"))
    return d


def test_scan_dir(spark):
    d = _folder()
    rows = {os.path.basename(r.path): r for r in scan_dir(spark, d).collect()}
    assert set(rows) == {"a.html", "b.htm", "d.htmx", "bad.html"}       # glob *.htm*, case-sensitive, not recursive
    assert rows["bad.html"].status == "bad_encoding" and rows["bad.html"].html is None
    assert rows["a.html"].status == "ok"
    empty = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    assert scan_dir(spark, empty).count() == 0


def test_read_requested_missing(spark):
    d = _folder()
    req = spark.createDataFrame([(f"{d}/a.html",), (f"{d}/zzz.html",), ("/nonexistent-folder/x.html",)], "path string")
    got = {os.path.basename(r.path): r.status for r in read_requested(spark, req, [d, "/nonexistent-folder"]).collect()}
    assert got == {"a.html": "ok", "zzz.html": "missing", "x.html": "missing"}


def test_stream_equals_batch(spark, opts):
    d = _folder()
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    ck = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    q = start_listener(spark, d, out + "/notes", ck, opts, start_ts=None)
    q.awaitTermination(300)
    streamed = spark.read.parquet(out + "/notes")
    assert [(os.path.basename(r.path), r.status) for r in streamed.where("status != 'ok'").collect()] == [("bad.html", "bad_encoding")]
    streamed = streamed.where("status = 'ok'")
    got = {os.path.basename(r.path): (r.title, r.markdown) for r in streamed.collect()}
    # suffix test is case-insensitive for the listener (.HTML included, .htmx excluded), nested folder ignored
    assert set(got) == {"a.html", "b.htm", "c.HTML"}
    batch = scan_dir(spark, d, "*.[hH][tT][mM]*").where(F.lower("path").rlike(r"\.html?$"))
    want = {os.path.basename(r.path): (r.title, r.markdown) for r in notes_batch(batch, opts).where("status = 'ok'").collect()}
    assert got == want
    assert got["a.html"] == ("Alpha Note", "# Alpha Note\n\nBody of Alpha Note.")


def test_folder_notes(spark, opts):
    from loomdown.plans.folder import folder_notes

    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    same = "<html><head><title>Same Title</title></head><body><main><p>{b}</p></main></body></html>"
    for name, body in [("a.html", "first"), ("b.html", "second")]:
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write(same.format(b=body))
    with open(os.path.join(d, "c.htm"), "w", encoding="utf-8") as f:
        f.write(PAGE.format(t="Other"))
    with open(os.path.join(d, "bad.html"), "wb") as f:
        f.write(b"\xff\xfe")
    notes, files, summary = folder_notes(spark, d, opts)
    s = summary.first()
    assert (s.exported, s.total) == (3, 4)
    by_name = {r.file_name: r for r in files.collect()}
    assert set(by_name) == {"Same_Title.md", "Other.md"}
    assert by_name["Same_Title.md"].path.endswith("b.html") and by_name["Same_Title.md"].content.endswith("second")
    _, merged, _ = folder_notes(spark, d, opts, merge_target="All")
    pieces = sorted(merged.collect(), key=lambda r: r.path)
    assert [os.path.basename(r.path) for r in pieces] == ["a.html", "b.html", "c.htm"]
    assert pieces[0].piece.startswith("---\n") and pieces[1].piece.startswith("\n\n---\n\n# Same Title")


def test_listener_phrase_requests(spark, opts):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    chat = ('<html><body><main><div data-message-author-role="user"><p>How do I sort a list in Python?</p></div>'
            '<div data-message-author-role="assistant"><p>Use sorted(items) or items.sort() for in place.</p></div>'
            '</main></body></html>')
    with open(os.path.join(d, "chat.html"), "w", encoding="utf-8") as f:
        f.write(chat)
    req = spark.createDataFrame([(1, f"{d}/chat.html", "sort a list"), (2, f"{d}/chat.html", "no such words")],
                                "phrase_id long, path string, phrase string")
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    ck = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    q = start_listener(spark, d, out + "/answers", ck, opts, start_ts=None, requests=req)
    q.awaitTermination(300)
    got = {r.phrase_id: r for r in spark.read.parquet(out + "/answers").collect()}
    assert got[1].status == "ok" and got[1].markdown == "Use sorted(items) or items.sort() for in place."
    assert got[1].title == "Sort a List" and got[2].status == "phrase_not_found"
