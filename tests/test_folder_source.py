"""The change stream of a folder over several triggers."""

import os

import pytest

from docstrata.streaming import folder_source as fs


def test_merge_of_listings():
    old, new = [("a", 1, 1), ("b", 1, 1), ("d", 1, 1)], [("b", 2, 1), ("c", 1, 1), ("d", 1, 1), ("e", 1, 1)]
    assert list(fs.changes(old, new)) == [("unlink", old[0]), ("change", new[0]), ("add", new[1]), ("add", new[3])]
    assert list(fs.changes([], new[:1])) == [("add", new[0])] and list(fs.changes(old[:1], [])) == [("unlink", old[0])] and list(fs.changes(old, old)) == []


@pytest.mark.parametrize("depth", [0, 2])
def test_changes_over_triggers(spark, tmp_path, depth):
    root, seen = tmp_path / "root", []
    (root / "a" / "deep" / "er").mkdir(parents=True)
    (root / "b").mkdir()
    for name in ("top.txt", "a/one.txt", "a/deep/two.txt", "a/deep/er/three.txt", "b/four.txt"):
        (root / name).write_text(name)
    spark.dataSource.register(fs.FolderChanges)

    def trigger():
        stream = spark.readStream.format("folder_changes").option("path", str(root)).option("state", str(tmp_path / "state")).option("depth", depth).load()
        rows = []
        query = stream.writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        seen.extend(rows)
        return sorted((os.path.relpath(r["path"], root), r["op"]) for r in rows)

    first = ["a/deep/er/three.txt", "a/deep/two.txt", "a/one.txt", "b/four.txt", "top.txt"]
    assert trigger() == [(p, "add") for p in first]
    (root / "a" / "one.txt").write_text("another size")
    (root / "b" / "four.txt").unlink()
    (root / "b").rmdir()
    (root / "c").mkdir()
    (root / "c" / "five.txt").write_text("5")
    assert trigger() == [("a/one.txt", "change"), ("b/four.txt", "unlink"), ("c/five.txt", "add")]
    assert trigger() == []
    (root / "top.txt").unlink()
    assert trigger() == [("top.txt", "unlink")]
    assert len({r["event_id"] for r in seen}) == len(seen) and len([n for n in os.listdir(tmp_path / "state") if n.isdigit()]) <= 3


def test_a_repeated_task_gives_the_same_rows(tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "x").write_text("1")
    reader = fs.FolderReader({"path": str(tmp_path / "root"), "state": str(tmp_path / "state")})
    start, end = reader.initialOffset(), reader.latestOffset()
    (part,) = reader.partitions(start, end)
    first = list(reader.read(part))
    (tmp_path / "root" / "y").write_text("2")
    assert list(reader.read(part)) == first and reader.partitions(start, end) == [part] and len(first) == 1
