"""S4/S5 over two runs: overwrite of note files, append to a merged target, a repeated run."""

from loomdown.sources.sinks import append_merged, read_merged, read_note_files, write_note_files

SCHEMA = "page_id long, phrase_id long, file_name string, title string, markdown string, tags array<string>, status string"


def _notes(spark, *rows):
    return spark.createDataFrame([(i, 0, name, name.title(), text, ["ai"], "ok") for i, name, text in rows], SCHEMA)


def test_two_runs(spark, opts, tmp_path):
    files, merged = f"file://{tmp_path}/files", f"file://{tmp_path}/merged"
    one = _notes(spark, (1, "a", "alpha"), (2, "b", "beta"))
    two = _notes(spark, (3, "b", "later beta"), (4, "c", "gamma"))
    for run, notes in ((1, one), (2, two), (2, two)):
        write_note_files(notes, files, run, opts)
        append_merged(notes, "all", merged, run, opts)
    got = {r.file_name: r.content for r in read_note_files(spark, files).collect()}
    assert set(got) == {"a", "b", "c"} and "later beta" in got["b"] and "alpha" in got["a"]
    pieces = [r.piece for r in read_merged(spark, merged).orderBy("run", "page_id", "phrase_id").collect()]
    assert len(pieces) == 4
    text = "".join(pieces)
    assert text.startswith("---\n") and all(p.startswith("\n\n---\n\n# ") for p in pieces[1:])
    assert [text.index(x) for x in ("alpha", "beta", "later beta", "gamma")] == sorted(text.index(x) for x in ("alpha", "beta", "later beta", "gamma"))


def test_repeated_first_run(spark, opts, tmp_path):
    merged = f"file://{tmp_path}/merged"
    for _ in range(2):
        append_merged(_notes(spark, (1, "a", "alpha")), "all", merged, 1, opts)
    assert [r.piece[:4] for r in read_merged(spark, merged).collect()] == ["---\n"]


def test_export_counts_come_with_the_files(spark, opts, tmp_path):
    """One run of the notes yields the files, A1's counts and A3's failures of all kinds; an empty body counts as not exported."""
    from pyspark.sql import functions as F

    from loomdown.operators.notes import export_summary, reject_summary
    from loomdown.plans.answers import MESSAGES
    from loomdown.sources.sinks import export_notes

    failed = [k for k in MESSAGES if k != "ok"]
    rows = [(i, 0, None, None, None, None, failed[i % len(failed)]) for i in range(9)] + [
        (20, 0, "a", "A", "one", ["ai"], "ok"), (21, 0, "a", "A", "two", ["ai"], "ok"), (22, 0, "b", "B", "", ["ai"], "ok")]
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, SCHEMA)
    got = export_notes(df.mapInArrow(count, df.schema), f"file://{tmp_path}/n", 1, opts)
    assert ran.value == len(rows)
    want = export_summary(df).first()
    assert (got["exported"], got["total"]) == (want.exported, want.total) == (2, 12)
    kinds = {r.status: r.n for r in reject_summary(df.withColumn("message", F.lit(""))).collect()}
    assert {k: got[k] for k in failed} == kinds
    assert [r.content.endswith("two") for r in read_note_files(spark, f"file://{tmp_path}/n").collect()] == [True]
