"""Markdown objects: overwrite and append over runs, replays, failed tasks, many tasks, and the listener with a merge target."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from loomdown.operators.notes import merged_notes, note_files
from loomdown.sources import markdown_files as M
from loomdown.sources.objects import Folder
from loomdown.streaming.listener import start_listener

SCHEMA = "page_id long, phrase_id long, file_name string, title string, markdown string, tags array<string>, status string"


def _notes(spark, *rows):
    return spark.createDataFrame([(i, 0, name, name.title(), text, ["ai"], "ok") for i, name, text in rows], SCHEMA)


def _folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def _text(folder, name):
    with open(f"{folder}/{name}", encoding="utf-8", newline="") as f:
        return f.read()


def _visible(folder):
    return sorted(x for x in os.listdir(folder) if not x.startswith("_"))


def _leftovers(folder):
    return [x for d in ("_staging", "_temporary") if os.path.isdir(f"{folder}/{d}") for x in os.listdir(f"{folder}/{d}")]


def test_files_overwrite(spark, opts):
    d = _folder()
    one = _notes(spark, (1, "a b.md", "alpha"), (2, "b+%.md", "é beta"), (3, "b+%.md", "later\r\nbeta"))
    assert M.write_markdown_files(one.repartition(3), d, opts) == 2
    want = {r.file_name: r.content for r in note_files(one, opts).collect()}
    assert {n: _text(d, n) for n in _visible(d)} == want and want["b+%.md"].endswith("later\r\nbeta")
    two = _notes(spark, (1, "a b.md", "short"), (9, "c.md", "gamma"))
    for _ in range(2):
        assert M.write_markdown_files(two, d, opts) == 2
    want.update({r.file_name: r.content for r in note_files(two, opts).collect()})
    assert {r.file_name: r.content for r in M.read_markdown(spark, d).collect()} == want
    assert M.write_markdown_files(two.limit(0), d, opts) == 0 and len(_visible(d)) == 3 and not _leftovers(d)


def test_failed_task_leaves_nothing(spark, opts):
    d = _folder()
    bad = _notes(spark, *[(i, f"n{i}.md", "x") for i in range(40)], (99, "no/file.md", "x"))
    with pytest.raises(Exception, match="not a file name"):
        M.write_markdown_files(bad, d, opts)
    assert not _visible(d) and not _leftovers(d)
    with pytest.raises(ValueError):
        M.append_markdown(bad, "../up", d, 1, opts)


def test_append_runs(spark, opts, monkeypatch):
    """Many parts in key order; a replay in any state of the object appends once; later runs continue with a separator."""
    monkeypatch.setattr(M, "PART_BYTES", 300)
    d = _folder()
    one = _notes(spark, *[(i, f"n{i}.md", f"note {i} é" * 5) for i in range(60)]).repartition(7)
    two = _notes(spark, *[(i, f"m{i}.md", f"more {i}") for i in range(5)])
    piece = lambda df, started: "".join(r.piece for r in merged_notes(df, "all", opts, started=started).orderBy("page_id").collect())
    first, second = piece(one, False), piece(two, True)
    n = M.append_markdown(one, "all", d, 1, opts)
    assert _text(d, "all.md") == first and n == len(first.encode())
    M.append_markdown(one, "all.md", d, 1, opts)
    assert _text(d, "all.md") == first and first.count("---\n") and first.startswith("---\n")
    state = _text(d, "_state/all.md.json")
    M.append_markdown(two, "all", d, 2, opts)
    for _ in range(2):  # the second time as after a failure between the state and the object
        M.append_markdown(two, "all", d, 2, opts)
        assert _text(d, "all.md") == first + second
        with open(f"{d}/all.md", "w", encoding="utf-8", newline="") as f:
            f.write(first)
    M.append_markdown(two, "all", d, 2, opts)
    assert _text(d, "all.md") == first + second and state != _text(d, "_state/all.md.json")
    with pytest.raises(ValueError, match="comes after"):
        M.append_markdown(one, "all", d, 1, opts)
    M.append_markdown(two.limit(0), "all", d, 3, opts)
    M.append_markdown(two, "all", d, 0, opts, writer="another")
    assert _text(d, "all.md") == first + second + second and not _leftovers(d) and _visible(d) == ["all.md"]


def test_existing_object_is_continued(spark, opts):
    d = _folder()
    Folder(d).replace("mine.md", [b"# By hand\n"])
    for _ in range(2):
        M.append_markdown(_notes(spark, (1, "a.md", "alpha")), "mine", d, 4, opts)
    assert _text(d, "mine.md") == "# By hand\n\n\n---\n\n# A.Md\n\nalpha"
    assert json.loads(_text(d, "_state/mine.md.json")) == {"run": 4, "start": 10, "writer": ""}
    M.append_markdown(_notes(spark).limit(0), "none", d, 1, opts)
    assert _visible(d) == ["mine.md"]


def test_listener_merges(spark, opts):
    """Two batches and a replay of the second give one merged note; no batch leaves a cached table."""
    d, out, ck, md = _folder(), _folder(), _folder(), _folder()
    page = "<html><head><title>{t}</title></head><body><main><h1>{t}</h1><p>Body of {t}.</p></main></body></html>"
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()

    def batch(*names):
        for n in names:
            with open(f"{d}/{n}.html", "w", encoding="utf-8") as f:
                f.write(page.format(t=n.title()))
        q = start_listener(spark, d, out + "/notes", ck, opts, start_ts=None, markdown_dir=md, merge_target="All")
        q.awaitTermination(300)

    batch("beta", "alpha")
    one = _text(md, "All.md")
    assert one.startswith("---\n") and one.index("Body of Alpha") < one.index("Body of Beta")
    batch("gamma")
    two = _text(md, "All.md")
    assert two.startswith(one + "\n\n---\n\n# Gamma\n\n") and two.endswith("Body of Gamma.")
    os.remove(f"{ck}/commits/1")  # the batch ran, its commit was lost
    if os.path.exists(f"{ck}/commits/.1.crc"):
        os.remove(f"{ck}/commits/.1.crc")
    batch()
    assert _text(md, "All.md") == two and _visible(md) == ["All.md"]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached
    with pytest.raises(ValueError, match="markdown_dir"):
        start_listener(spark, d, out, ck, opts, merge_target="All")
