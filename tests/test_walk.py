"""Listing by levels and reading by name, over real folders."""

import os

import pytest
from pyspark.sql import functions as F

from docstrata.plans import indexing
from docstrata.sources import documents, listing, walk
from test_sources import NOW, recorded, registry_frame, stores


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for name, text in {
        "a.txt": "one", "b.TXT": "two", "sub/c.md": "three", "sub/deep/er/d.txt": "four", "node_modules/x/e.txt": "no", "tmp/f.txt": "no",
        "sub/node_modules/g.txt": "no", "App.app/Contents/h.txt": "no", "sub/tmpfile.txt": "five", "empty/.keep": "", "sub/my dir ü/i.txt": "six",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


EXCLUDE = ["**/node_modules/**", "/tmp/f", "/root/tmp/"]
BUNDLES = ["**/*.app/**"]


def test_cut_folders_are_not_opened(spark, tree):
    found = walk.walk(spark, [str(tree)], EXCLUDE, BUNDLES)
    rel = lambda df: sorted(os.path.relpath(r["path"], tree) for r in df.collect())
    assert rel(found.directories) == [".", "empty", "sub", "sub/deep", "sub/deep/er", "sub/my dir ü"]
    assert {(os.path.relpath(r["path"], tree), r["reason"]) for r in found.skipped.collect()} == {
        ("node_modules", "excluded"), ("sub/node_modules", "excluded"), ("tmp", "excluded"), ("App.app", "bundle")}
    assert found.failed.isEmpty()
    want = listing.list_corpus(spark, [str(tree)], EXCLUDE, BUNDLES)  # this one never sees hidden files
    assert sorted(map(tuple, found.files.where("path not like '%.keep'").collect())) == sorted(map(tuple, want.collect()))
    some = walk.walk_corpus(spark, [str(tree), str(tree / "sub")], EXCLUDE, BUNDLES, [".txt"])
    assert rel(some) == ["a.txt", "b.TXT", "sub/deep/er/d.txt", "sub/my dir ü/i.txt", "sub/tmpfile.txt"]


def test_globs_cut_only_what_holds_nothing_else(spark):
    rows = spark.createDataFrame([("/r/a",), ("/r/a/b",), ("/r/ab",)], "path string")
    got = lambda *p: [r[0] for r in rows.where(walk.below(F.col("path"), p)).orderBy("path").collect()]
    assert got("**/a/**") == ["/r/a", "/r/a/b"] and got("*.txt") == [] and got("/r/a/") == ["/r/a", "/r/a/b"]
    assert got("**/b/**") == ["/r/a/b"] and got("/r/a") == ["/r/a", "/r/a/b", "/r/ab"] and got() == []


def test_missing_roots_and_empty_lists(spark, tree):
    found = walk.walk(spark, [str(tree / "none"), str(tree / "empty")])
    assert [os.path.basename(r["path"]) for r in found.failed.collect()] == ["none"]
    assert [os.path.basename(r["path"]) for r in found.files.collect()] == [".keep"]
    assert walk.walk(spark, []).files.isEmpty()


def test_files_are_read_by_name(spark, tree, monkeypatch):
    monkeypatch.setattr(walk, "BATCH_BYTES", 1)
    files = walk.walk_corpus(spark, [str(tree)], EXCLUDE, BUNDLES).where("path not like '%.keep'")
    held = files.collect()
    (tree / "a.txt").unlink()
    opened = spark.sparkContext.accumulator(0)
    frame = spark.createDataFrame([tuple(r) for r in held], files.schema)
    rows = {os.path.relpath(r["path"], tree): (r["text"], r["error_kind"]) for r in documents.ingest_named(frame, opened).collect()}
    assert rows["a.txt"] == (None, "read") and rows["sub/c.md"] == ("three", None) and rows["b.TXT"] == ("two", None) and len(rows) == 6
    assert opened.value == 6


def test_incremental_index_opens_the_planned_files_only(spark, tree, tmp_path):
    chunks, status, dead = stores(spark, tmp_path / "s")

    def run():
        opened = spark.sparkContext.accumulator(0)
        plan = indexing.index_tree(spark, [str(tree)], registry_frame(spark), chunks, status, NOW, dead_letters=dead,
                                   exclude=EXCLUDE, bundles=BUNDLES, opened=opened)
        return {os.path.relpath(r["path"], tree): r["action"] for r in plan.collect()}, opened.value

    first, n = run()
    assert set(first.values()) == {"index"} and len(first) == 6
    assert n % 6 == 0  # each file once for every time the documents are read
    times = n // 6
    assert run() == ({}, 0)
    (tree / "a.txt").write_text("one, changed")
    os.utime(tree / "a.txt", (2_000_000_000, 2_000_000_000))
    (tree / "sub" / "new.txt").write_text("seven")
    (tree / "b.TXT").unlink()
    plan, n = run()
    assert plan == {"a.txt": "index", "sub/new.txt": "index", "b.TXT": "remove"} and n == 2 * times
    got = {os.path.relpath(k, tree): v[0] for k, v in recorded(status).items()}
    assert got["a.txt"] == got["sub/new.txt"] == "indexed" and got["b.TXT"] == "deleted"
    assert {r["text"] for r in chunks.read().collect()} == {"one, changed", "three", "four", "five", "six", "seven"}
