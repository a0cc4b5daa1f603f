import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docstrata.functions import vectors as vx
from docstrata.operators import ann, search

DDL = "id string, vector array<float>"


def exact(rows, queries, k, metric):
    out = []
    for qid, q in queries:
        scored = []
        for cid, v in rows:
            a, b = np.asarray(q, dtype=np.float32).astype(float), np.asarray(v, dtype=np.float32).astype(float)
            if metric == "l2":
                d = float(np.sqrt(((a - b) ** 2).sum()))
            else:
                scale = np.linalg.norm(a) * np.linalg.norm(b)
                d = 1.0 if scale == 0 else 1.0 - float(a @ b) / scale
            scored.append((round(d, 6) + 0.0, cid))
        out += [(qid, cid, d, n + 1) for n, (d, cid) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def data(spark):
    """A third of the vectors are copies of one vector, one is zero, one is missing."""
    rng = np.random.default_rng(3)
    hot = rng.normal(size=8).tolist()
    rows = [(f"r{i:03d}", hot if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(300)]
    rows.append(("zero", [0.0] * 8))
    queries = [(i, rng.normal(size=8).tolist()) for i in range(20)] + [(20, hot), (21, [0.0] * 8)]
    frame = spark.createDataFrame([*rows, ("none", None)], DDL).repartition(5)
    return rows, queries, frame, spark.createDataFrame(queries, "query_id int, vector array<float>")


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("limit,ties", [(search.BROADCAST_BYTES, 8), (search.BROADCAST_BYTES, 1), (0, 1)])
def test_topk_equals_brute_force(data, metric, limit, ties, monkeypatch):
    monkeypatch.setattr(search, "TIES", ties)
    monkeypatch.setattr(search, "LEAST_SIDE", 40)
    monkeypatch.setattr(search, "GRID_BYTES", 8 * 8 * 20)
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    monkeypatch.setattr(search, "MATRIX_ELEMENTS", 1000)
    rows, queries, chunks, asked = data
    got = search.batch_topk(chunks, asked, 7, metric, broadcast_bytes=limit)
    found = sorted((r["query_id"], r["id"], r["distance"], r["rank"]) for r in got.collect())
    assert found == exact(rows, queries, 7, metric)


def test_k_beyond_the_table(data):
    rows, _, chunks, asked = data
    assert search.batch_topk(chunks, asked, 1000).count() == len(rows) * 22


def test_single_query(data):
    rows, queries, chunks, _ = data
    got = [(r["id"], r["distance"]) for r in search.topk(chunks, queries[0][1], 5).collect()]
    assert got == [(c, d) for _, c, d, _ in sorted(exact(rows, queries[:1], 5, "cosine"), key=lambda x: x[3])]


def test_empty_tables(spark, data):
    _, _, chunks, asked = data
    assert search.batch_topk(chunks.where("false"), asked, 5).isEmpty()
    assert search.batch_topk(chunks, asked.where("false"), 5).isEmpty()


def test_filter_before_ranking(data):
    rows, queries, chunks, asked = data
    got = search.batch_topk(chunks, asked, 3, where="id < 'r100'")
    found = sorted((r["query_id"], r["id"], r["distance"], r["rank"]) for r in got.collect())
    assert found == exact([r for r in rows if r[0] < "r100"], queries, 3, "cosine")


@pytest.mark.parametrize("limit", [search.BROADCAST_BYTES, 0])
def test_all_cells_are_exact(data, limit, monkeypatch):
    monkeypatch.setattr(search, "LEAST_SIDE", 40)
    monkeypatch.setattr(search, "GRID_BYTES", 8 * 8 * 20)
    rows, queries, chunks, asked = data
    index = ann.build_ivf(chunks.where("vector is not null"), n_cells=4)
    near = ann.nearest_cells(asked, index.centroids, 4)
    got = search.nearest_in_cells(index.cells.select("id", "vector", "cell"), near, 5, "cosine", limit)
    found = sorted((r["query_id"], r["id"], r["distance"], r["rank"]) for r in got.collect())
    assert found == exact(rows, queries, 5, "cosine")
    some = ann.probe_ivf(index, asked, 5, nprobe=1)
    assert 0.3 < ann.recall_at(some, got).first()["recall"] <= 1.0


def test_index_only_for_large_tables(data):
    assert ann.maybe_build_ivf(data[2], 50_000) is None


def test_distance_expression_agrees(data):
    rows, queries, chunks, _ = data
    q = F.array(*[F.lit(float(np.float32(x))) for x in queries[0][1]])
    for metric in ("cosine", "l2"):
        got = chunks.where("vector is not null").select("id", F.round(vx.distance("vector", q, metric), 6).alias("d"))
        mine = sorted((r["d"] + 0.0, r["id"]) for r in got.collect())[:5]
        assert mine == sorted((d, c) for _, c, d, _ in exact(rows, queries[:1], 5, metric))


def test_hits_are_projected_and_grouped(spark):
    chunks = spark.createDataFrame(
        [("1", "/a", None, None, None, None), ("2", "/a", 2, 5, "t", "A"), ("3", "/b", 1, 0, "u", "B")],
        "id string, path string, page int, offset long, text string, title string",
    )
    ranked = spark.createDataFrame(
        [(1, "2", 0.1, 1), (1, "3", 0.2, 2), (1, "1", 1.4, 3)], "query_id int, id string, distance double, rank int"
    )
    hits = search.project_hits(ranked, chunks)
    last = hits.where("id = '1'").first()
    assert (last["page"], last["offset"], last["text"], last["title"], last["score"]) == (0, 0, "", "", 0.0)
    groups = {r["path"]: (r["hits"], r["best_score"], r["position"]) for r in search.group_hits(hits).collect()}
    assert groups == {"/a": (2, 0.9, 1), "/b": (1, 0.8, 2)}
    assert [r["id"] for r in search.file_hits(hits, "/a").collect()] == ["2", "1"]


def test_ragged_vectors_raise(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0, 3.0, 4.0]), ("c", [1.0, 2.0, 3.0])], "id string, vector array<float>")
    with pytest.raises(Exception, match="different lengths"):
        search.topk(rows.coalesce(1), [1.0, 0.0, 0.0], 2).collect()


def test_probing_skips_cells(spark, sf, tmp_path):
    """One query over a stored index reads the partitions of its cells only."""
    import numpy as np

    from docstrata.workload import tables as t

    rows = t.vectors(spark, sf).select("id", "vector")
    centres = np.array([r["vector"] for r in rows.orderBy("id").limit(8).collect()])
    ann.write_ivf(ann.assign_cells(rows, centres), str(tmp_path / "ivf"))
    index = ann.IvfIndex(centres, spark.read.parquet(str(tmp_path / "ivf")), "cosine")
    asked = rows.orderBy("id").limit(1).selectExpr("id as query_id", "vector")
    plan = ann.probe_ivf(index, asked, 5, nprobe=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell") and "PartitionFilters: []" not in plan


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_most_pairs_are_left_out_by_single_precision(metric, monkeypatch):
    """Only rows near a query's limit are computed in full; the result is that of all pairs in full."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6_000, 16)) * rng.choice([1.0, 3.0], size=(6_000, 1))
    v[5_000:] = v[rng.integers(0, 30, 1_000)]
    full, distances = [], search._distances
    monkeypatch.setattr(search, "_distances", lambda q, v, m: full.append(len(q) * len(v)) or distances(q, v, m))
    top = search._TopK(v[:300], 10, metric)
    top.add(pa.array(np.arange(6_000)), v[:6_000])
    assert sum(full) < 0.5 * 300 * 6_000
    unit = search._unit_rows(v) if metric == "cosine" else v
    d = np.round(distances(unit[:300], unit, metric), 6) + 0.0
    for q in range(300):
        order = np.lexsort((np.arange(6_000), d[q]))[:10]
        assert top.ids[q].tolist() == order.tolist()
        assert top.d[q] == pytest.approx(d[q][order], abs=2e-6)
