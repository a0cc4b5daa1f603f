from docstrata.frames import salted_join, values_frame
from docstrata.operators import lookups, maintenance
from docstrata.plans import reindex
from docstrata.registry import registry_frame

NOW = 1_735_689_600_000
HOUR = 3_600_000
STATUS = "path string, status string, parser_version int, chunk_count int, error_message string, last_modified timestamp, indexed_at timestamp, file_hash string, last_retry timestamp"


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "id string, path string, page int, chunk_index int, text string")


def ids(frame):
    return sorted(r["id"] for r in frame.collect())


def statuses(spark, rows):
    base = spark.createDataFrame(
        rows, "path string, status string, parser_version int, file_hash string, modified long, retry long"
    )
    return base.selectExpr(
        "path", "status", "parser_version", "1 as chunk_count", "'' as error_message",
        "timestamp_millis(modified) as last_modified", "timestamp_millis(modified) as indexed_at", "file_hash",
        "timestamp_millis(retry) as last_retry",
    )


def test_upsert_replaces_and_inserts(spark):
    base = chunk_rows(spark, [("1", "/a", 0, 0, "old"), ("2", "/a", 0, 1, "keep")])
    new = chunk_rows(spark, [("1", "/a", 0, 0, "first"), ("1", "/a", 0, 1, "last"), ("3", "/b", 0, 0, "new")])
    got = {r["id"]: r["text"] for r in maintenance.upsert(base, new).collect()}
    assert got == {"1": "last", "2": "keep", "3": "new"}
    again = maintenance.upsert(maintenance.upsert(base, new), new)
    assert {r["id"]: r["text"] for r in again.collect()} == got
    assert ids(maintenance.upsert(base, new.where("false"))) == ["1", "2"]


def test_delete_by_predicate(spark):
    base = chunk_rows(
        spark, [("1", "/delete.txt", 1, 0, ""), ("2", "/delete.txt", 2, 0, ""), ("3", "/keep.txt", 1, 0, ""), ("4", "/delete.txt", None, 0, "")]
    )
    assert ids(maintenance.delete_where(base, "path = '/delete.txt' and page = 1")) == ["2", "3", "4"]


def test_replace_leaves_no_stale_chunk(spark):
    base = chunk_rows(spark, [("1", "/a", 0, 0, ""), ("2", "/a", 0, 1, ""), ("9", "/b", 0, 0, "")])
    new = chunk_rows(spark, [("3", "/a", 0, 0, ""), ("4", "/a", 0, 1, ""), ("5", "/a", 0, 2, "")])
    assert ids(maintenance.replace_paths(base, new)) == ["3", "4", "5", "9"]


def folders_frame(spark, names):
    return values_frame(spark, list(zip(names, range(len(names)))), "folder string, position int")


def test_folder_boundaries(spark):
    rows = spark.createDataFrame(
        [("/documents/file1.txt",), ("/documents-backup/file2.txt",), ("/docs/file3.txt",), ("/documents/sub/x.md",), ("/top.txt",)],
        "path string",
    )
    for _ in (1,):
        one = folders_frame(spark, ["/documents/"])
        assert sorted(r["path"] for r in lookups.in_folders(rows, one).collect()) == [
            "/documents/file1.txt", "/documents/sub/x.md",
        ]
        assert lookups.outside_folders(rows, one).count() == 3
        nested = folders_frame(spark, ["/documents/sub", "/documents", "/docs"])
        got = {r["path"]: r["folder"] for r in lookups.assign_folder(rows, nested).collect()}
        assert got == {
            "/documents/file1.txt": "/documents", "/documents-backup/file2.txt": None, "/docs/file3.txt": "/docs",
            "/documents/sub/x.md": "/documents/sub", "/top.txt": None,
        }
        flipped = folders_frame(spark, ["/documents", "/documents/sub"])
        got = {r["path"]: r["folder"] for r in lookups.assign_folder(rows, flipped).collect()}
        assert got["/documents/sub/x.md"] == "/documents"
        assert lookups.in_folders(rows, folders_frame(spark, [])).count() == 0
        root = folders_frame(spark, ["/docs", "/"])
        assert lookups.in_folders(rows, root).count() == rows.count()
        got = {r["path"]: r["folder"] for r in lookups.assign_folder(rows, root).collect()}
        assert got["/docs/file3.txt"] == "/docs" and got["/top.txt"] == "/" and got["/documents/sub/x.md"] == "/"


def test_salted_join_equals_plain_join_on_a_hot_key(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(str, left.join(right, "k", how).select("k", "i").collect()))
        assert sorted(map(str, salted_join(left, right, "k", how, ["i"]).select("k", "i").collect())) == plain


def test_upgrade_of_one_document(spark):
    status = statuses(spark, [("/a.doc", "indexed", 1, "h", 1, None), ("/b.doc", "failed", 1, "h", 1, 2), ("/c.txt", "indexed", 4, "h", 1, None)])
    changed, summary = maintenance.parser_upgrades(status, registry_frame(spark))
    assert {r["ext"]: r["files"] for r in summary.collect()} == {"doc": 1, "doc_retries": 1}
    assert maintenance.unknown_statuses(changed).isEmpty()
    assert maintenance.unknown_statuses(changed.selectExpr("'lost' as status")).count() == 3
    got = {r["path"]: (r["status"], r["error_message"]) for r in changed.collect()}
    assert got["/a.doc"] == ("outdated", "Parser upgraded to v2")
    assert got["/b.doc"][0] == "queued" and got["/c.txt"] == ("indexed", "")


def decisions(spark, rows, force=False):
    listing = spark.createDataFrame([(r[0], 10, 1000) for r in rows], "path string, size_bytes long, mtime_ms long")
    known = statuses(spark, [r for r in rows if r[1] is not None]) if any(r[1] for r in rows) else statuses(spark, [("/none", "indexed", 1, "", 1, None)])
    out = reindex.index_decision(listing, known, registry_frame(spark), NOW, force)
    return {r["path"]: r["reason"] for r in out.collect()}


def test_first_reason_wins(spark):
    import hashlib

    def same(path):
        return hashlib.md5(f"{path}:10:1000".encode()).hexdigest()

    rows = [
        ("/new.txt", None, None, None, None, None),
        ("/out.txt", "outdated", 1, "x", 1, None),
        ("/ver.txt", "indexed", 3, "x", 1, None),
        ("/nul.txt", "indexed", None, same("/nul.txt"), 1, None),
        ("/mod.txt", "indexed", 4, "old-hash", 1, None),
        ("/tim.txt", "indexed", 4, "", 1000, None),
        ("/old.txt", "indexed", 4, "", 999, None),
        ("/unk.txt", "indexed", 4, "", None, None),
        ("/ok.txt", "indexed", 4, same("/ok.txt"), 1, None),
        ("/due.txt", "failed", 4, same("/due.txt"), 1, NOW - 25 * HOUR),
        ("/day.txt", "error", 4, same("/day.txt"), 1, NOW - 24 * HOUR),
        ("/nev.txt", "error", 4, same("/nev.txt"), 1, None),
        ("/x.unknown", "indexed", 0, same("/x.unknown"), 1, None),
    ]
    assert decisions(spark, rows) == {
        "/new.txt": "new-file", "/out.txt": "outdated", "/ver.txt": "parser-upgraded", "/nul.txt": "parser-upgraded",
        "/mod.txt": "modified", "/tim.txt": None, "/old.txt": "modified", "/unk.txt": "modified", "/ok.txt": None,
        "/due.txt": "retry-failed", "/day.txt": None, "/nev.txt": "retry-failed", "/x.unknown": None,
    }
    assert set(decisions(spark, rows, force=True).values()) == {"force-reindex"}


def test_checks_can_be_switched_off(spark):
    status = spark.createDataFrame(
        [("/m.txt", "indexed", 9, 1, "", "x"), ("/v.txt", "indexed", 1, 1, "", None), ("/f.txt", "failed", 9, 0, "", None)],
        "path string, status string, parser_version int, chunk_count int, error_message string, file_hash string",
    ).selectExpr("*", "timestamp_millis(5000) as last_modified", "timestamp_millis(5000) as indexed_at", "cast(null as timestamp) as last_retry")
    listing = spark.createDataFrame([(p, 1, 1000) for p in ("/m.txt", "/v.txt", "/f.txt", "/n.txt")], "path string, size_bytes long, mtime_ms long")
    registry = spark.createDataFrame([("txt", 2, True)], "ext string, version int, enabled boolean")

    def reasons(**checks):
        return {r["path"]: r["reason"] for r in reindex.index_decision(listing, status, registry, 10_000, **checks).collect()}

    assert reasons() == {"/m.txt": "modified", "/v.txt": "parser-upgraded", "/f.txt": "retry-failed", "/n.txt": "new-file"}
    off = reasons(check_modified=False, check_parser_version=False, retry_failed=False)
    assert off == {"/m.txt": None, "/v.txt": None, "/f.txt": None, "/n.txt": "new-file"}
    plan = reindex.plan_reindex(listing, status, folders_frame(spark, ["/"]), registry, 10_000, retry_failed=False)
    assert {r["path"]: r["action"] for r in plan.collect()} == {"/m.txt": "index", "/v.txt": "index", "/f.txt": "skip", "/n.txt": "index"}


def test_plan_partitions_its_input(spark, sf):
    from docstrata.workload import tables as t

    listing, status = t.listing(spark, sf), t.status(spark, sf)
    plan = reindex.plan_reindex(listing, status, t.folders(spark), t.registry(spark), t.NOW_MS)
    counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    assert counts["index"] + counts["skip"] == listing.count()
    stats = reindex.plan_stats(plan).first().asDict()
    assert sum(v for k, v in stats.items() if k != "total_files") == stats["total_files"]
    assert reindex.validate_plan(plan, reindex.plan_stats(plan)).first()["valid"]
