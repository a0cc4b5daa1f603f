import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docstrata.frames import key_filter
from docstrata.plans import indexing
from docstrata.registry import registry_frame
from docstrata.sources import documents, listing, reports, store
from docstrata.streaming import feed, maintain

NOW = 1_735_689_600_000


def ingest(spark, content, fn=documents.ingest_text):
    return fn(spark.createDataFrame([("/f", bytearray(content))], "path string, content binary")).first()["text"]


@pytest.mark.parametrize(
    "content",
    [
        "héllo  wörld\n".encode(),
        b"\xff\xfe" + "héllo wörld".encode("utf-16-le"),
        b"\xfe\xff" + "héllo wörld".encode("utf-16-be"),
        "héllo wörld".encode("latin-1"),
        b"\xef\xbb\xbf" + "héllo wörld".encode(),
    ],
)
def test_encodings(spark, content):
    assert ingest(spark, content) == "héllo wörld"


def test_utf16_without_mark(spark):
    text = "plain words in a row, enough of them to tell"
    assert ingest(spark, text.encode("utf-16-le")) == text
    assert ingest(spark, text.encode("utf-16-le") + b"a") == text


def test_quoted_csv(spark):
    content = b'Product A,"Contains, comma",10.50\nProduct B,"Has ""quotes""",20.00\n\n  \n'
    got = ingest(spark, content, lambda f: documents.ingest_delimited(f, ","))
    assert got == 'Product A Contains, comma 10.50\nProduct B Has "quotes" 20.00'


def test_tsv_with_empty_fields(spark):
    got = ingest(spark, b"1\t\t3\n\t2\t\n", lambda f: documents.ingest_delimited(f, "\t"))
    assert got.split("\n")[0] == "1  3"
    assert got.split("\n")[1].rstrip() == " 2"


def test_rtf(spark):
    source = rb"{\rtf1\ansi}{\fonttbl\f0 Arial;}\pard Hello \b bold\b0  world.\par"
    assert ingest(spark, source, documents.ingest_rtf) == "Hello bold world."


def test_pages(spark):
    docs = spark.createDataFrame([("/a", "x" * 120_000), ("/b", "  ")], "path string, text string")
    rows = documents.paginate(docs).orderBy("page").collect()
    assert [(r["page"], len(r["text"])) for r in rows] == [(1, 50_000), (2, 50_000), (3, 20_000)]


@pytest.fixture()
def tree(tmp_path):
    for name in ("a.txt", "sub/b.md", "sub/skip/c.txt", "Tool.app/d.txt", "e.exe", "f.tmp.TXT", "g.rtf"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"Text of {name}. More words.")
    return tmp_path


def test_list_corpus(spark, tree):
    rows = listing.list_corpus(spark, [str(tree)], ["/skip/", "*.tmp.*"], ["**/*.app/**"], ["txt", ".MD"])
    assert sorted(r["path"].removeprefix(str(tree)) for r in rows.collect()) == ["/a.txt", "/sub/b.md"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1].splitlines()[0]
    bundles = listing.skipped_bundles(listing.list_files(spark, [str(tree)]), ["**/*.app/**"]).collect()
    assert [r["bundle"] for r in bundles] == [str(tree / "Tool.app")]


def test_ingest_dispatch(spark, tree):
    rows = documents.ingest_corpus(spark, [str(tree)]).collect()
    assert {r["path"].removeprefix(str(tree)) for r in rows} == {
        "/a.txt", "/sub/b.md", "/sub/skip/c.txt", "/Tool.app/d.txt", "/f.tmp.TXT", "/g.rtf",
    }


def test_file_stream(spark, tree, tmp_path):
    stream = feed.file_stream(spark, str(tree)).select("path", "size_bytes")
    seen = []
    query = (
        stream.writeStream.foreachBatch(lambda df, i: seen.extend(df.collect()))
        .option("checkpointLocation", str(tmp_path.parent / (tmp_path.name + "-progress")))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert len(seen) == 7


def test_reports(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1.5)], "name string, value double")
    for fmt in ("json", "csv"):
        reports.write_report(frame, str(tmp_path / fmt), fmt)
    assert spark.read.schema(frame.schema).json(str(tmp_path / "json")).collect() == frame.collect()
    back = spark.read.schema(frame.schema).option("header", True).csv(str(tmp_path / "csv"))
    assert back.collect() == frame.collect()
    with pytest.raises(ValueError):
        reports.write_report(frame, str(tmp_path / "x"), "xml")


CHUNK_DDL = "id string, path string, mtime_ms long, page int, offset long, text string, vector array<float>, type string, title string, chunk_index int"


def chunk(i, path, text="t", index=0):
    return (i, path, 0, 0, 0, text, None, "txt", path, index)


def chunk_frame(spark, rows):
    return spark.createDataFrame(rows, CHUNK_DDL)


@pytest.fixture()
def table(spark, tmp_path):
    table = store.chunk_store(spark, str(tmp_path / "chunks"), buckets=4)
    table.create()
    return table


def state(table):
    return sorted((r["id"], r["path"], r["text"]) for r in table.read().collect())


def test_store_life(spark, table):
    assert state(table) == []
    table.upsert(chunk_frame(spark, [chunk("1", "/a"), chunk("2", "/a"), chunk("3", "/b")]))
    table.upsert(chunk_frame(spark, [chunk("3", "/b", "new"), chunk("3", "/b", "newest", 1)]))
    assert state(table) == [("1", "/a", "t"), ("2", "/a", "t"), ("3", "/b", "newest")]
    assert table.upsert(chunk_frame(spark, [])) is None
    keys = spark.createDataFrame([("/a",)], "path string")
    new = chunk_frame(spark, [chunk("7", "/a"), chunk("8", "/a"), chunk("9", "/a")])
    assert table.replace(keys, new, batch_id=4) is not None
    assert [s[0] for s in state(table)] == ["3", "7", "8", "9"]
    assert table.replace(keys, chunk_frame(spark, []), batch_id=4) is None  # replayed batch
    assert [r["id"] for r in table.where_key("/b").collect()] == ["3"]
    table.delete_where("id = '8' or text = 'newest'")
    assert [s[0] for s in state(table)] == ["7", "9"]
    assert table.vacuum() > 0
    assert [s[0] for s in state(table)] == ["7", "9"]
    table.clear()
    assert state(table) == []


def test_unlogged_version_is_invisible(spark, table, tmp_path):
    table.overwrite(chunk_frame(spark, [chunk("1", "/a")]))
    chunk_frame(spark, [chunk("x", "/a")]).selectExpr("*", "0 as bucket").write.partitionBy("bucket").parquet(
        str(tmp_path / "chunks" / "data" / "version=2")
    )
    assert state(table) == [("1", "/a", "t")]
    table.overwrite(chunk_frame(spark, [chunk("2", "/b")]))
    assert state(table) == [("2", "/b", "t")]


def test_index_and_search(spark, tmp_path):
    chunks = store.chunk_store(spark, str(tmp_path / "c"), buckets=2)
    status = store.status_store(spark, str(tmp_path / "s"), buckets=2)
    for table in (chunks, status):
        table.create()
    docs = spark.createDataFrame(
        [("/a.txt", "alpha beta.", 1, None, None), ("/b.txt", " ", 2, None, None), ("/c.pdf", None, 3, "parse", "bad")],
        "path string, text string, mtime_ms long, error_kind string, error_message string",
    )
    listing_rows = docs.selectExpr("path", "10L as size_bytes", "mtime_ms")
    indexing.index_files(docs, listing_rows, registry_frame(spark), chunks, status, NOW)
    got = {r["path"]: (r["status"], r["chunk_count"], r["error_message"]) for r in status.read().collect()}
    assert got == {
        "/a.txt": ("indexed", 1, ""),
        "/b.txt": ("failed", 0, "No text content extracted"),
        "/c.pdf": ("failed", 0, "bad"),
    }
    hits = indexing.search_text(
        chunks.read(), spark.createDataFrame([(1, "alpha beta.")], "query_id int, text string"), 5
    ).collect()
    assert [(h["path"], round(h["score"], 5), h["rank"]) for h in hits] == [("/a.txt", 1.0, 1)]


def test_maintenance_over_several_batches(spark, tmp_path):
    chunks = store.chunk_store(spark, str(tmp_path / "c"), buckets=2)
    status = store.status_store(spark, str(tmp_path / "s"), buckets=2)
    for table in (chunks, status):
        table.create()
    files = spark.createDataFrame(
        [("/a.txt", 5, 1, "one."), ("/b.txt", 5, 2, "two."), ("/c.bin", 5, 3, "three.")],
        "path string, size_bytes long, mtime_ms long, text string",
    )
    load = lambda wanted: files.join(wanted, "path", "left_semi")
    batches = [
        [("/a.txt", "add", 1, 1), ("/b.txt", "add", 1, 2), ("/c.bin", "add", 1, 3)],
        [("/a.txt", "change", 2, 4), ("/b.txt", "unlink", 3, 5)],
    ]
    from docstrata.operators.embedding import HashEmbedder

    for number, rows in [(0, batches[0]), (1, batches[1]), (1, batches[1])]:
        events = spark.createDataFrame(rows, "path string, op string, ts long, event_id long")
        maintain.apply_changes(
            events, number, load, chunks, status, registry_frame(spark), HashEmbedder, NOW
        )
    assert [r["path"] for r in chunks.read().collect()] == ["/a.txt"]
    assert {r["path"]: r["status"] for r in status.read().collect()} == {"/a.txt": "indexed", "/b.txt": "deleted"}


def failing_model():
    from docstrata.operators.embedding import HashEmbedder

    class Failing:
        """Fails on texts with a certain word."""

        def embed(self, texts):
            if any("poison" in t for t in texts):
                raise ValueError("no such word")
            return HashEmbedder().embed(texts)

    return Failing


def stores(spark, tmp_path):
    made = [
        store.chunk_store(spark, str(tmp_path / "c"), buckets=2), store.status_store(spark, str(tmp_path / "s"), buckets=2),
        store.dead_letter_store(spark, str(tmp_path / "d"), buckets=2),
    ]
    for table in made:
        table.create()
    return made


def recorded(status):
    rows = status.read().collect()
    assert len({r["path"] for r in rows}) == len(rows)
    return {r["path"]: (r["status"], r["chunk_count"], r["error_message"]) for r in rows}


def test_failed_chunks_and_pages_are_recorded(spark, tmp_path):
    chunks, status, dead = stores(spark, tmp_path)
    long = " ".join(["A sentence of some words that fills the first chunk."] * 60)
    docs = spark.createDataFrame(
        [("/a.txt", long + " poison.", 1, None, None, 1), ("/b.pdf", "one.", 2, None, None, 1), ("/b.pdf", "two.", 2, None, None, 2),
         ("/c.pdf", "x.", 3, None, None, 1), ("/c.pdf", None, 3, "parse", "page 2 is broken", 2), ("/d.txt", "poison.", 3, None, None, 1)],
        "path string, text string, mtime_ms long, error_kind string, error_message string, page int",
    )
    files = docs.selectExpr("path", "10L as size_bytes", "mtime_ms").distinct()
    # A model call fails as a whole, so the texts it fails on come in a run of their own.
    for part in (docs.where("path like '%.pdf'"), docs.where("path like '%.txt'")):
        indexing.index_files(part, files, registry_frame(spark), chunks, status, NOW, failing_model(), dead_letters=dead)
    got = recorded(status)
    lost = {r["path"]: r["error"] for r in dead.read().collect()}
    assert set(lost) == {"/a.txt", "/d.txt"} and "no such word" in lost["/a.txt"]
    kept = chunks.read().where("path = '/a.txt'").count()
    assert got["/a.txt"][:2] == ("error", kept) and got["/a.txt"][2].endswith("chunks failed: ValueError: no such word")
    assert got["/b.pdf"] == ("indexed", 2, "") and got["/c.pdf"] == ("failed", 0, "page 2 is broken")
    assert got["/d.txt"] == ("error", 0, "1 of 1 chunks failed: ValueError: no such word")


def test_a_model_that_cannot_be_built_fails_the_job(spark):
    from docstrata.operators import embedding

    def broken():
        raise RuntimeError("no weights")

    with pytest.raises(Exception, match="no weights"):
        embedding.embed(spark.createDataFrame([("a",)], "text string"), "text", broken).collect()


def test_index_a_tree(spark, tmp_path):
    """List, plan, read, chunk, embed, store, record; then changes, a vanished file and a file that cannot be parsed."""
    import os

    chunks, status, dead = stores(spark, tmp_path)
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("First text.")
    (root / "sub" / "b.md").write_text("# Head\n\nSecond *text*.")
    (root / "c.pdf").write_bytes(b"%PDF")
    (root / "skip.bin").write_bytes(b"x")
    registry = registry_frame(spark)

    def run():
        plan = indexing.index_tree(spark, [str(root)], registry, chunks, status, NOW, dead_letters=dead)
        return {os.path.basename(r["path"]): (r["action"], r["reason"]) for r in plan.collect()}

    assert run() == {"a.txt": ("index", "new-file"), "b.md": ("index", "new-file"), "c.pdf": ("index", "new-file")}
    got = {os.path.basename(k): v for k, v in recorded(status).items()}
    assert got == {"a.txt": ("indexed", 1, ""), "b.md": ("indexed", 1, ""), "c.pdf": ("failed", 0, "No extractor for this file type")}
    row = chunks.read().where("path like '%a.txt'").first()
    assert row["mtime_ms"] == int(os.stat(root / "a.txt").st_mtime_ns // 1_000_000) and row["text"] == "First text."
    assert run() == {}
    (root / "a.txt").write_text("First text, changed.")
    os.utime(root / "a.txt", (2_000_000_000, 2_000_000_000))
    (root / "sub" / "b.md").unlink()
    assert run() == {"a.txt": ("index", "modified"), "b.md": ("remove", None)}
    got = {os.path.basename(k): v[0] for k, v in recorded(status).items()}
    assert got == {"a.txt": "indexed", "b.md": "deleted", "c.pdf": "failed"}
    assert [r["text"] for r in chunks.read().collect()] == ["First text, changed."]


def test_vanished_file_becomes_deleted(spark, tmp_path):
    from docstrata.operators.embedding import HashEmbedder

    chunks, status, dead = stores(spark, tmp_path)
    files = spark.createDataFrame([("/a.txt", 5, 1, "one.")], "path string, size_bytes long, mtime_ms long, text string")
    for number, source in enumerate([files, files.limit(0)]):
        events = spark.createDataFrame([("/a.txt", ["add", "change"][number], number, number)], "path string, op string, ts long, event_id long")
        maintain.apply_changes(
            events, number, lambda wanted: source.join(wanted, "path", "left_semi"), chunks, status, registry_frame(spark), HashEmbedder, NOW, dead  # noqa: B023
        )
    assert recorded(status) == {"/a.txt": ("deleted", 0, "")} and chunks.read().count() == 0


def test_delete_rewrites_matching_buckets_only(spark, table):
    table.overwrite(chunk_frame(spark, [chunk(str(i), f"/{i}") for i in range(40)]))
    before = table._newest()
    table.delete_where("id = '7'")
    after = table._newest()
    assert sum(map(len, after.values())) == 4 and len(after[max(after)]) == 1 and max(after) > max(before)
    assert table.delete_where("id = 'none'") is None and table.read().count() == 39


def test_listing_changes_and_suppression(spark):
    from docstrata.streaming import feed

    ddl = "path string, size_bytes long, mtime_ms long"
    before = spark.createDataFrame([("/a", 1, 1), ("/b", 1, 1), ("/c", 1, None)], ddl)
    after = spark.createDataFrame([("/a", 2, 1), ("/c", 1, None), ("/d", 1, 1)], ddl)
    events = feed.listing_changes(before, after, NOW)
    assert {r["path"]: r["op"] for r in events.collect()} == {"/a": "change", "/b": "unlink", "/d": "add"}
    rows = [("/x", "add", "f", 0, 1), ("/x", "add", "f", 10, 2), ("/x", "unlink", "f", 20, 3), ("/x", "add", "f", 30, 4), ("/x", "add", "f", 30 + 3601, 5), ("/y", "add", "f", 5, 6)]
    frame = spark.createDataFrame(rows, "path string, op string, fingerprint string, at long, event_id long").selectExpr("*", "timestamp_seconds(at) as ts")
    assert sorted(r["event_id"] for r in feed.suppress_in_flight(frame).collect()) == [1, 3, 4, 5, 6]


def test_a_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from docstrata import session

    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=context))


def test_times_without_zone_are_utc(spark):
    from docstrata.frames import instant

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as ts").transform(instant, "ts").selectExpr("unix_seconds(ts) s").first()
        assert row["s"] == 1_704_067_200
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_delimited_texts_are_held_a_few_at_a_time():
    texts = [f"a, {i}\nb,c" for i in range(1_000)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_001)), pa.array(texts)], names=["id", "text"])
    parts = list(documents._delimited(iter([batch]), 1, ","))
    assert max(p.num_rows for p in parts) <= documents.FILES_AT_A_TIME
    assert pa.Table.from_batches(parts).to_pylist() == [{"id": i, "text": t and f"a {i}\nb c"} for i, t in enumerate(texts)]


def shuffled_bytes(spark):
    """Bytes that all stages of the session have shuffled so far."""
    context = spark.sparkContext
    listed = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(listed.apply(i).shuffleWriteBytes() for i in range(listed.size()))


def test_replace_moves_only_what_changes(spark, table):
    """Rows of other files stay where they are, whatever share of the buckets changes."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.sha1(F.concat_ws(":", "id", k))), "")
    many = spark.range(4_000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("/"), (F.col("id") % 200).cast("string")).alias("path"))
    rows = many.withColumn("text", text).selectExpr(
        "id", "path", "0L as mtime_ms", "0 as page", "0L as offset", "text", "cast(null as array<float>) as vector", "'txt' as type", "path as title", "0 as chunk_index"
    )
    table.overwrite(rows)
    keys = spark.createDataFrame([(f"/{k}",) for k in range(20)], "path string")
    before = shuffled_bytes(spark)
    table.replace(keys, chunk_frame(spark, [chunk("new", "/3")]), batch_id=1)
    table.delete_where("path = '/30'")
    moved = shuffled_bytes(spark) - before
    left = {str(i) for i in range(4_000) if i % 200 >= 20 and i % 200 != 30} | {"new"}
    assert {r["id"] for r in table.read().select("id").collect()} == left
    assert moved < 0.3 * 4_000 * 1_600


def test_replace_against_a_plain_table(spark, table, monkeypatch):
    """Keys that a small bitmap cannot tell apart, repeated rows, null keys, and buckets that are packed anew."""
    monkeypatch.setattr(store, "key_filter", lambda keys, column: key_filter(keys, column, 1 << 15))
    monkeypatch.setattr(store, "MOST_FILES", 0.5)
    rows = [chunk(str(i), f"/{i % 3_000}", "old") for i in range(6_000)] + [chunk("none", None)]
    table.overwrite(chunk_frame(spark, rows))
    held = {(r[0], r[1], r[5]) for r in rows}
    for batch, (low, high) in enumerate([(0, 1_500), (1_000, 1_010), (10_000, 13_000), (2_000, 2_900)]):
        new = [chunk(f"n{i}", f"/{i}", f"{batch}:{k}", k) for i in range(low, min(high, low + 30)) for k in (1, 0, 2)]
        keys = spark.createDataFrame([(f"/{i}",) for i in [*range(low, high), low]] + [(None,)], "path string")
        assert table.replace(keys, chunk_frame(spark, new), batch) is not None
        gone = {f"/{i}" for i in range(low, high)}
        held = {r for r in held if r[1] not in gone} | {(f"n{i}", f"/{i}", f"{batch}:2") for i in range(low, min(high, low + 30))}
        found = [(r["id"], r["path"], r["text"]) for r in table.read().collect()]
        assert len(found) == len(held) and set(found) == held


def test_files_of_a_bucket_stay_few(spark, table):
    table.overwrite(chunk_frame(spark, [chunk(str(i), f"/{i}") for i in range(100)]))
    most = 0
    for i in range(6):
        table.replace(spark.createDataFrame([(f"/{k}",) for k in range(i, 100, 7)], "path string"), chunk_frame(spark, [chunk(f"n{i}{k}", f"/{k}") for k in range(i, 100, 7)]))
        live = {(f"version={v}", f"bucket={b}") for v, held in table._newest().items() for b in held}
        most = max(most, sum(tuple(name.split("/")[-3:-1]) in live for name in table.read().inputFiles()))
    assert most <= 4 * (store.MOST_FILES + 2) * table.salts and table.read().count() == 100


def test_maintenance_moves_only_changed_files(spark, tmp_path):
    """A batch with a few files shuffles neither the other files' texts nor their chunks."""
    from docstrata.operators.embedding import HashEmbedder

    chunks, status, _ = stores(spark, tmp_path)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.sha1(F.concat_ws(":", "id", k))), "")
    named = spark.range(3_000).select("id", F.format_string("/%d.txt", "id").alias("path")).withColumn("text", text)
    path = str(tmp_path / "files")
    named.selectExpr("path", "1000L as size_bytes", "id as mtime_ms", "text").write.parquet(path)
    files = spark.read.parquet(path)
    chunks.overwrite(named.selectExpr(
        "cast(id as string) as id", "path", "0L as mtime_ms", "0 as page", "0L as offset", "text", "cast(null as array<float>) as vector", "'txt' as type", "path as title", "0 as chunk_index"
    ))
    events = spark.createDataFrame(
        [(f"/{k}.txt", "change", 1, k) for k in range(40)] + [("/50.txt", "unlink", 1, 50), ("/gone.txt", "change", 1, 51)],
        "path string, op string, ts long, event_id long",
    )
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as it is with many paths
    before = shuffled_bytes(spark)
    try:
        maintain.apply_changes(events, 0, maintain.loader(files), chunks, status, registry_frame(spark), HashEmbedder, NOW)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    moved = shuffled_bytes(spark) - before
    got = {r["path"]: r["mtime_ms"] for r in chunks.read().collect()}
    assert set(got) == {f"/{k}.txt" for k in range(3_000) if k != 50} and all(got[f"/{k}.txt"] == k for k in range(40))
    assert recorded(status)["/50.txt"][0] == recorded(status)["/gone.txt"][0] == "deleted"
    assert moved < 0.5 * 3_000 * 1_600
