"""The two-level tree of cells against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstrata.operators import cell_tree, search


@pytest.fixture(scope="module")
def data(spark):
    """Clusters, one with a third of the rows as copies; a zero vector and a missing one."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[0] if i % 3 == 0 else centres[i % 12] + rng.normal(size=8) * 0.1).tolist(), i % 5) for i in range(600)]
    rows += [(600, [0.0] * 8, 1), (601, None, 1)]
    queries = [(i, (centres[i % 12] + rng.normal(size=8) * 0.1).tolist()) for i in range(24)] + [(24, [0.0] * 8)]
    return (
        spark.createDataFrame(rows, "id long, vector array<double>, label int"),
        spark.createDataFrame(queries, "query_id int, vector array<double>"),
    )


@pytest.fixture(scope="module", params=["cosine", "l2"])
def tree(request, data, spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tree") / request.param)
    return at, cell_tree.build_tree(data[0], n_tops=4, branch=4, metric=request.param, at=at)


def found(hits):
    return sorted((r["query_id"], r["id"], r["distance"], r["rank"]) for r in hits.collect())


def test_nearest_in_small_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    points, centroids = rng.normal(size=(50, 3)), np.repeat(rng.normal(size=(20, 3)), 2, axis=0)
    monkeypatch.setattr(search, "MATRIX_ELEMENTS", 30)
    place, away = cell_tree._nearest(points, centroids)
    d = np.sqrt(((points[:, None] - centroids[None]) ** 2).sum(axis=2))
    assert (place == d.argmin(axis=1)).all() and np.allclose(away, d.min(axis=1))


def test_radii_hold(data, tree):
    _, built = tree
    rows = built.cells.join(built.leaves.select("leaf", F.col("vector").alias("c"), "radius"), "leaf").collect()
    assert len(rows) == 601
    for r in rows:
        v = np.array(r["vector"])
        v = v / (np.linalg.norm(v) or 1) if built.metric == "cosine" else v
        assert np.linalg.norm(v - np.array(r["c"])) <= r["radius"] + 1e-9


@pytest.mark.parametrize("where", [None, "label = 2", "id < 3", "id < 0"])
def test_exact_search_and_filters(data, tree, where):
    """Also filters that leave fewer than k rows, or none, over the whole table."""
    _, built = tree
    got = cell_tree.exact_topk(built, data[1], 5, where=where, n_tops=1, n_leaves=1)
    assert found(got) == found(search.batch_topk(data[0], data[1], 5, built.metric, where=where))


def test_far_cells_are_skipped(data, tree):
    """Cells that the radii exclude are named for no query; none that holds a hit is excluded."""
    _, built = tree
    exact = search.batch_topk(data[0], data[1], 3, built.metric)
    limits = exact.where("rank = 3").select("query_id", F.col("distance").alias("limit"))
    named = {(r["query_id"], r["leaf"]) for r in cell_tree.open_leaves(built, data[1].join(limits, "query_id")).collect()}
    hits = {(r["query_id"], r["leaf"]) for r in exact.join(built.cells, "id").collect()}
    assert hits <= named
    clustered = {x for x in named if x[0] < 24}
    assert len(clustered) < 0.6 * 24 * built.leaves.count()


def test_every_leaf_when_the_queries_are_dealt_to_a_grid(data, tree, monkeypatch):
    _, built = tree
    limits = data[1].withColumn("limit", F.lit(0.1))
    whole = sorted(map(tuple, cell_tree.open_leaves(built, limits).collect()))
    monkeypatch.setattr(search, "LEAST_SIDE", 1)
    monkeypatch.setattr(search, "GRID_BYTES", 8 * 8 * 5)
    assert sorted(map(tuple, cell_tree.open_leaves(built, limits).collect())) == whole


def test_rows_stored_since(data, spark, tree, tmp_path):
    _, built = tree
    rows, queries = data
    at = str(tmp_path / "t")
    cell_tree.build_tree(rows.where("id % 2 = 0"), n_tops=3, branch=3, metric=built.metric, at=at)
    assert cell_tree.open_tree(spark, at).delta is None
    cell_tree.store_rows(at, rows.where("id % 2 = 1"))
    cell_tree.store_rows(at, rows.where("id < 40").select("id", F.lit(None).cast("array<double>").alias("vector")))
    cell_tree.store_rows(at, rows.where("id < 20").select("id", F.reverse("vector").alias("vector"), "label"))
    now = rows.where("id >= 40").union(rows.where("id < 20").select("id", F.reverse("vector").alias("vector"), "label"))
    again = cell_tree.open_tree(spark, at)
    assert found(cell_tree.probe_tree(again, queries, 5, 3, 9)) == found(search.batch_topk(now, queries, 5, built.metric))
    assert found(cell_tree.exact_topk(again, queries, 5, "label < 3")) == found(search.batch_topk(now, queries, 5, built.metric, "label < 3"))


def test_probes_reach_the_recall(data, tree):
    _, built = tree
    n_tops, n_leaves = cell_tree.probes_for(built, data[1], 5, 0.9)
    got = set(found(cell_tree.probe_tree(built, data[1], 5, n_tops, n_leaves)))
    want = found(search.batch_topk(data[0], data[1], 5, built.metric))
    assert len(got & set(want)) >= 0.9 * len(want)


def test_scan_reads_named_tops_only(data, tree):
    _, built = tree
    plan = cell_tree.probe_tree(built, data[1].where("query_id = 1"), 3, 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(top" in plan or "PartitionFilters: [(top" in plan


def test_grid_repeats_rows_with_the_root(spark):
    """27 groups of queries by the old rule repeated the chunk table 27 times."""
    rows, queries, tasks = 1_000_000, 27 * 5_000, 64
    side = search._side(rows, queries, 64, tasks)
    moved = rows * -(-queries // side) + queries * -(-rows // side)
    assert side * 8 * 64 <= search.GRID_BYTES and moved < 0.25 * (27 * rows + queries * (rows // 50_000))
    assert search._side(4 * rows, 4 * queries, 64, tasks) <= search.GRID_BYTES // 512
    assert search._side(10, 10, 10**9, 1) == 1


def test_groups_of_the_grid_by_size(data, monkeypatch):
    """Small groups on both sides give the same rows."""
    rows, queries = data[0].where("vector is not null"), data[1]
    want = found(search.batch_topk(rows, queries, 4))
    monkeypatch.setattr(search, "LEAST_SIDE", 8)
    monkeypatch.setattr(search, "GRID_BYTES", 8 * 8 * 10)
    assert found(search.batch_topk(rows, queries, 4, broadcast_bytes=0)) == want


def test_hits_fetch_texts_without_moving_the_chunks(spark, tmp_path):
    """Over a table bucketed by id only the hits are shuffled."""
    from docstrata.plans import indexing

    rows = spark.range(400).selectExpr(
        "cast(id as string) as id", "concat('/', id) as path", "1 as page", "0L as offset", "concat('text ', id) as text", "'' as title",
        "array(cast(id as double), 1.0D) as vector",
    )
    chunks = indexing.save_chunks(rows, f"chunks_{tmp_path.name}", str(tmp_path / "chunks"), 4)
    assert len([f for f in (tmp_path / "chunks").iterdir() if f.name.startswith("part-")]) == 4
    hits = spark.createDataFrame([(1, "7", 0.1, 1), (1, "8", 0.2, 2), (2, "7", 0.3, 1)], "query_id int, id string, distance double, rank int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search.project_hits(hits, chunks)
        assert sorted((r["query_id"], r["id"], r["text"]) for r in found.collect()) == [(1, "7", "text 7"), (1, "8", "text 8"), (2, "7", "text 7")]
        semi = chunks.select("id", "text").join(hits.select("id").distinct(), "id", "left_semi")._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in semi and semi.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_asked_leaves_are_written_once(spark):
    """A search reads its queries several times; the joins that name their leaves must not run for each."""
    rows = spark.range(200).selectExpr("id", "array(cos(id), sin(id), cos(3 * id)) as vector")
    tree = cell_tree.build_tree(rows, n_tops=2, branch=2)
    asked = cell_tree.nearest_leaves(tree, rows.selectExpr("id as query_id", "vector"), 1, 2)
    assert "Join" not in asked._jdf.queryExecution().executedPlan().toString() and asked.count() == 200
