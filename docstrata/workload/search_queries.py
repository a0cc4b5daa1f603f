"""Checked queries: vector search, approximate search, hits, retrieval quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docstrata.operators import ann, cell_tree, chunking, embedding, evaluation, lookups, search
from docstrata.plans import indexing
from docstrata.session import fresh_dir
from docstrata.workload import tables as t
from docstrata.workload.registry import query
from docstrata.workload.tables import oracle
from docstrata.workload.text_queries import _raw

_PAIRS = """
select q.vec_id as query_id, d.vec_id as id,
       round(1.0 - list_cosine_similarity(q.embedding::double[], d.embedding::double[]), 6) as distance
from embeddings q join embeddings d on true
"""


def _top(pairs: str, k: int) -> str:
    return f"""
select query_id, id, distance, cast(rank as int) as rank from (
  select *, row_number() over (partition by query_id order by distance, id) as rank from ({pairs}) p) r where rank <= {k}
"""


def _asked(spark, sf):
    return t.vectors(spark, sf).select(F.col("id").alias("query_id"), "vector")


@query(
    "q1_topk",
    """
select id, distance from (
  select d.vec_id as id,
         round(1.0 - list_cosine_similarity(d.embedding::double[],
                     (select list_transform(range(64), lambda i: cos(i)::double))), 6) as distance from embeddings d) x
order by distance, id limit 100
""",
)
def topk(spark, sf):
    """One free query vector against the whole table, 100 hits as the result list asks for."""
    import math

    return search.topk(t.vectors(spark, sf), [math.cos(i) for i in range(64)], 100)


@query("q2_batch_topk", _top(_PAIRS, 10))
def batch_topk(spark, sf):
    return search.batch_topk(t.vectors(spark, sf), _asked(spark, sf), 10)


@query("q2_batch_topk_shuffled", _top(_PAIRS, 10))
def batch_topk_shuffled(spark, sf):
    """The path for query sets too large to travel whole."""
    return search.batch_topk(t.vectors(spark, sf), _asked(spark, sf), 10, broadcast_bytes=0)


@query("q3_filtered_topk", _top(_PAIRS.replace("on true", "on d.label >= 5"), 10))
def filtered_topk(spark, sf):
    return search.batch_topk(t.vectors(spark, sf), _asked(spark, sf), 10, where="label >= 5")


@query("q4_l2_topk", _top(_PAIRS.replace("1.0 - list_cosine_similarity", "list_distance"), 10))
def l2_topk(spark, sf):
    return search.batch_topk(t.vectors(spark, sf), _asked(spark, sf), 10, metric="l2")


def _text_chunks(spark, sf):
    """The chunk table of the corpus, written once: searching must not chunk and embed again."""
    cut = chunking.chunk_fixed(t.corpus(spark, sf).select("path", "mtime_ms", "text"))
    rows, _ = embedding.split_failures(embedding.embed(cut, prefix="passage: "))
    path = fresh_dir(spark, "index")
    chunking.chunk_rows(rows).write.parquet(path)
    return spark.read.parquet(path)


def _text_hits(spark, sf, k=10):
    questions = t.given(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return indexing.search_text(_text_chunks(spark, sf), questions, k, prefix="query: ")


def _with_hits(body: str) -> str:
    vectors = f"""
, cv as (select *, list_transform(r, lambda x: cast(x / sqrt(list_sum(list_transform(r, lambda y: y * y))) as float)::double) as v
         from (select *, {_raw("'passage: ' || text")} as r from chunks) a),
qv as (select item_id, text as q, list_transform(r, lambda x: cast(x / sqrt(list_sum(list_transform(r, lambda y: y * y))) as float)::double) as v
       from (select *, {_raw("'query: ' || text")} as r from benchmark) a),
hits as (select query_id, id, path, page, "offset", text, round(greatest(0, 1 - distance), 6) as score, title, rank, q from (
  select *, row_number() over (partition by query_id order by distance, id) as rank from (
    select qv.item_id as query_id, qv.q, cv.id, cv.path, cv.page, cv."offset", cv.text, cv.title,
           round(1 - list_cosine_similarity(qv.v, cv.v), 6) as distance from qv join cv on true) p) r where rank <= 10)
"""
    return oracle("@@", "chunks").replace(" @@", vectors) + body


@query(
    "q5_search_text",
    _with_hits('select query_id, id, path, page, "offset", text, score, title, cast(rank as int) as rank from hits'),
)
def search_text(spark, sf):
    """Text to hits: chunk and embed the corpus, embed the questions, rank, project."""
    return _text_hits(spark, sf).withColumn("score", F.round("score", 6))


@query("q6_probe_ivf_all_cells", _top(_PAIRS, 10))
def probe_all_cells(spark, sf):
    """With every cell probed the approximate search is exact."""
    index = ann.build_ivf(t.vectors(spark, sf), n_cells=16)
    return ann.probe_ivf(index, _asked(spark, sf), 10, nprobe=16)


_FIXED_CELLS = """
with centres as (select label, arg_min(embedding, vec_id)::double[] as c from embeddings group by label),
ranked as (
  select e.vec_id, centres.label, row_number() over (
    partition by e.vec_id order by list_cosine_similarity(e.embedding::double[], centres.c) desc, centres.label) as place
  from embeddings e join centres on true),
probed as (
  select q.vec_id as query_id, d.vec_id as id,
         round(1.0 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as distance
  from ranked q join ranked d on d.place = 1 and q.place <= 3 and d.label = q.label
  join embeddings a on a.vec_id = q.vec_id join embeddings b on b.vec_id = d.vec_id)
"""


def _fixed_cells(spark, sf):
    """An index around the first vector of every label; there are ten labels. Stored by cell, as a real one."""
    import numpy as np

    rows = t.vectors(spark, sf)
    first = rows.groupBy("label").agg(F.min_by("vector", "id").alias("vector")).orderBy("label").collect()
    index = ann.assign_cells(rows.select("id", "vector"), np.array([r["vector"] for r in first], dtype=np.float64))
    path = fresh_dir(spark, "ivf")
    ann.write_ivf(index, path)
    return ann.IvfIndex(index.centroids, spark.read.parquet(path), index.metric)


@query("q6_probe_fixed_cells", _FIXED_CELLS + _top("select * from probed", 10))
def probe_fixed_cells(spark, sf):
    """Three cells of fixed centroids for every query."""
    return ann.probe_ivf(_fixed_cells(spark, sf), _asked(spark, sf), 10, nprobe=3)


@query(
    "q6_ivf_recall",
    _FIXED_CELLS
    + f"""
select round(avg(case when p.id is null then 0.0 else 1.0 end), 6)::double as recall from ({_top(_PAIRS, 10)}) e
left join ({_top("select * from probed", 10)}) p on p.query_id = e.query_id and p.id = e.id
""",
)
def ivf_recall(spark, sf):
    """Recall at 10 with three of the fixed cells probed."""
    found = ann.probe_ivf(_fixed_cells(spark, sf), _asked(spark, sf), 10, nprobe=3)
    exact = search.batch_topk(t.vectors(spark, sf), _asked(spark, sf), 10)
    return ann.recall_at(found, exact).select(F.round("recall", 6).alias("recall"))


@query(
    "q5_search_bucketed",
    _with_hits('select query_id, id, path, page, "offset", text, score, title, cast(rank as int) as rank from hits'),
)
def search_bucketed(spark, sf):
    """The same over a chunk table bucketed by id."""
    path = fresh_dir(spark, "bucketed")
    chunks = indexing.save_chunks(_text_chunks(spark, sf), "chunks_" + path.rsplit("-", 1)[-1], path, 8)
    questions = t.given(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return indexing.search_text(chunks, questions, 10, prefix="query: ").withColumn("score", F.round("score", 6))


_UNIT = "list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[])))"

_FIXED_TREE = f"""
with e as (select vec_id, embedding::double[] as v, {_UNIT} as u, label from embeddings),
seeds as (select label, v as c, row_number() over (partition by label order by vec_id) - 1 as j from e where label < 5),
tops as (select label as top, c from seeds where j = 0),
leaves as (select label as top, label * 4 + j as leaf, c from seeds where j < 4),
placed as (
  select vec_id, v, top, row_number() over (partition by vec_id order by list_distance(u, c), top) as a,
    row_number() over (partition by vec_id order by round(list_distance(u, c), 6), top) as b from e join tops on true),
leafed as (
  select p.vec_id, e.v, p.a, l.leaf, row_number() over (partition by p.vec_id, p.a order by list_distance(e.u, l.c), l.leaf) as k
  from placed p join e using (vec_id) join leaves l on l.top = p.top where p.a = 1),
asked as (
  select p.vec_id, e.v, l.leaf, row_number() over (partition by p.vec_id order by round(list_distance(e.u, l.c), 6), l.leaf) as k
  from placed p join e using (vec_id) join leaves l on l.top = p.top where p.b <= 2),
probed as (
  select q.vec_id as query_id, d.vec_id as id, round(1.0 - list_cosine_similarity(q.v, d.v), 6) as distance
  from asked q join leafed d on q.leaf = d.leaf and q.k <= 3 and d.k = 1)
"""


def _fixed_tree(spark, sf):
    """A stored tree around the first vectors of five labels, four leaves each."""
    first = Window.partitionBy("label").orderBy("id")
    seeds = t.vectors(spark, sf).where("label < 5").withColumn("j", F.row_number().over(first) - 1)
    tops = seeds.where("j = 0").select(F.col("label").alias("top"), "vector")
    leaves = seeds.where("j < 4").select((F.col("label") * 4 + F.col("j")).cast("long").alias("leaf"), F.col("label").alias("top"), "vector")
    return cell_tree.assign_tree(t.vectors(spark, sf), tops, leaves, at=fresh_dir(spark, "tree"))


@query("q6_probe_tree", _FIXED_TREE + _top("select * from probed", 10))
def probe_tree(spark, sf):
    """Three leaves of two tops of a fixed tree for every query."""
    return cell_tree.probe_tree(_fixed_tree(spark, sf), _asked(spark, sf), 10, n_tops=2, n_leaves=3)


@query("q6_tree_with_delta", _top(_PAIRS, 10))
def tree_with_delta(spark, sf):
    """A tree of two thirds of the vectors, written, and the others stored since, some first with a wrong vector and some
    rows of the tree taken away and stored again: with every leaf probed the result is the exact one."""
    rows, path = t.vectors(spark, sf), fresh_dir(spark, "tree")
    cell_tree.build_tree(rows.where("id % 3 <> 0"), n_tops=4, branch=4, at=path)
    wrong = F.transform("vector", lambda x: -x).alias("vector")
    cell_tree.store_rows(path, rows.where("id % 6 = 0").select("id", wrong, "label"))
    cell_tree.store_rows(path, rows.where("id % 5 = 1").select("id", F.lit(None).cast("array<float>").alias("vector"), "label"))
    cell_tree.store_rows(path, rows.where("id % 3 = 0 or id % 5 = 1"))
    return cell_tree.probe_tree(cell_tree.open_tree(spark, path), _asked(spark, sf), 10, n_tops=4, n_leaves=16)


def _built_tree(spark, sf):
    return cell_tree.build_tree(t.vectors(spark, sf), n_tops=4, branch=6, at=fresh_dir(spark, "tree"))


@query("q3_filtered_tree", _top(_PAIRS.replace("on true", "on d.label >= 8"), 10))
def filtered_tree(spark, sf):
    """Exact filtered search over a trained tree, by widening probes and the radii of cells."""
    return cell_tree.exact_topk(_built_tree(spark, sf), _asked(spark, sf), 10, where="label >= 8", n_tops=1, n_leaves=1)


@query("q2_topk_by_bounds", _top(_PAIRS, 10))
def topk_by_bounds(spark, sf):
    """Exact search that skips the cells too far away."""
    return cell_tree.exact_topk(_built_tree(spark, sf), _asked(spark, sf), 10)


@query("q6_tree_recall")
def tree_recall(spark, sf):
    """Probes measured to reach a recall of 0.9 on a tenth of the vectors, and what they reach on all of them."""
    tree = _built_tree(spark, sf)
    sample = _asked(spark, sf).where("query_id % 10 = 0")
    n_tops, n_leaves = cell_tree.probes_for(tree, sample, 10, 0.9)
    found = cell_tree.probe_tree(tree, _asked(spark, sf), 10, n_tops, n_leaves)
    exact = search.batch_topk(t.vectors(spark, sf), _asked(spark, sf), 10)
    return ann.recall_at(found, exact).select(F.round("recall", 6).alias("recall"), F.lit(n_tops).alias("tops"), F.lit(n_leaves).alias("leaves"))


def _by_label(spark, sf):
    """Vector hits with the label as their file."""
    hits = search.batch_topk(t.vectors(spark, sf), _asked(spark, sf), 10)
    labels = t.vectors(spark, sf).select("id", F.concat(F.lit("/label/"), "label").alias("path"))
    return hits.join(labels, "id").select(
        "query_id", "id", "path", F.round(1.0 - F.col("distance"), 6).alias("score"), "rank"
    )


_LABELLED = (
    "select h.*, '/label/' || e.label as path, round(1.0 - h.distance, 6) as score from ("
    + _top(_PAIRS, 10)
    + ") h join embeddings e on e.vec_id = h.id"
)


@query(
    "q7_group_hits",
    f"""
select query_id, path, best_score, hits, first_rank,
       cast(row_number() over (partition by query_id order by first_rank, path) as int) as position
from (select query_id, path, max(score) as best_score, count(*) as hits, min(rank) as first_rank
      from ({_LABELLED}) x group by query_id, path) g
""",
)
def group_hits(spark, sf):
    return search.group_hits(_by_label(spark, sf))


@query(
    "q8_file_hits",
    f"select query_id, id, path, score, rank from ({_LABELLED}) x where path = '/label/7'",
)
def file_hits(spark, sf):
    return search.file_hits(_by_label(spark, sf), "/label/7")


@query(
    "q9_search_files",
    oracle(
        """
select s.path, case when g.path is not null then 'queued' else s.status end as status, coalesce(s.chunk_count, 0) as chunks,
       s.error_message as error, s.last_modified_ms as modified_ms
from (select * from status where contains(lower(path), '/en/') order by path limit 30) s
left join (select distinct f.path from corpus f join labels b on f.doc_id = b.doc_id where b.quality = 0) g on g.path = s.path
""",
        "status",
        "corpus",
    ),
)
def search_files(spark, sf):
    busy = t.corpus(spark, sf).join(t.given(spark, sf, "labels").where("quality = 0"), "doc_id").select("path")
    found = search.search_files(t.status(spark, sf), "/EN/", busy)
    return found.withColumn("modified_ms", F.unix_millis("modified")).drop("modified")


def _judged(spark, sf):
    return lookups.with_class_relevance(t.runs(spark, sf), t.classes(spark, sf))


def _queries(spark, sf):
    return lookups.class_relevant_counts(t.classes(spark, sf))


def _round(df, *columns):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


@query(
    "j7_with_relevance",
    oracle(
        """
select r.query_id, r.doc_id, r.score, cast(r.rank as int) as rank, q.doc_id is not null as relevant
from runs r left join (select vec_id as query_id, min(vec_id) over (partition by label) as doc_id from embeddings) q
  on q.query_id = r.query_id and q.doc_id = r.doc_id
""",
        "runs",
    ),
)
def with_relevance(spark, sf):
    """Explicit judgements: the first member of a vector's class is its relevant document."""
    table = t.classes(spark, sf)
    first = table.groupBy("label").agg(F.min("doc_id").alias("doc_id"))
    qrels = table.select(F.col("doc_id").alias("query_id"), "label").join(first, "label")
    return lookups.with_relevance(t.runs(spark, sf), qrels).select("query_id", "doc_id", "score", "rank", "relevant")


@query(
    "j7_with_class_relevance",
    oracle("select query_id, doc_id, score, cast(rank as int) as rank, relevant from judged", "judged"),
)
def with_class_relevance(spark, sf):
    return _judged(spark, sf).select("query_id", "doc_id", "score", "rank", "relevant")


@query("r1_precision_at_3", oracle("select query_id, round(p3, 6) as precision from report", "report"))
def precision_at_3(spark, sf):
    return _round(evaluation.precision_at(_judged(spark, sf), _queries(spark, sf), 3), "precision")


@query("r2_recall_at_10", oracle("select query_id, round(r10, 6) as recall from report", "report"))
def recall_at_10(spark, sf):
    return _round(evaluation.recall_at(_judged(spark, sf), _queries(spark, sf), 10), "recall")


@query(
    "r2_recall_at_10_distinct",
    f"""
select h.query_id, max(case when h.path = '/label/' || q.label then 1.0 else 0.0 end)::double as recall
from ({_LABELLED}) h join embeddings q on q.vec_id = h.query_id group by h.query_id
""",
)
def recall_at_10_distinct(spark, sf):
    """A label is one document with many hits, of which one counts."""
    labels = t.vectors(spark, sf).select(F.col("id").alias("query_id"), F.concat(F.lit("/label/"), "label").alias("own"))
    judged = _by_label(spark, sf).join(labels, "query_id").select(
        "query_id", F.col("path").alias("doc_id"), "rank", (F.col("path") == F.col("own")).alias("relevant")
    )
    queries = labels.select("query_id", F.lit(1).cast("long").alias("n_relevant"))
    return _round(evaluation.recall_at(judged, queries, 10, distinct_docs=True), "recall")


@query("r3_reciprocal_rank", oracle("select query_id, round(rr::double, 6) as rr from report", "report"))
def reciprocal_rank(spark, sf):
    return _round(evaluation.reciprocal_rank(_judged(spark, sf), _queries(spark, sf)), "rr")


@query("r4_mrr", oracle("select round(avg(rr::double), 6) as mrr from report", "report"))
def mrr(spark, sf):
    return _round(evaluation.mrr(_judged(spark, sf), _queries(spark, sf)), "mrr")


@query(
    "r5_query_report",
    oracle(
        """
select query_id, n_relevant, round(p1::double, 6) as p1, round(p3::double, 6) as p3, round(p5::double, 6) as p5,
       round(p10::double, 6) as p10, round(r10::double, 6) as r10, round(rr::double, 6) as rr,
       round(avg_score::double, 8) as avg_score, found, cast(top_relevant as int) as top_relevant from report
""",
        "report",
    ),
)
def query_report(spark, sf):
    report = evaluation.query_report(_judged(spark, sf), _queries(spark, sf))
    return _round(report, "p1", "p3", "p5", "p10", "r10", "rr").withColumn("avg_score", F.round("avg_score", 8))


_OVERALL = """
select count(*) as queries, round(avg(p1), 6) as p1, round(avg(p3), 6) as p3, round(avg(p5), 6) as p5,
       round(avg(p10), 6) as p10, round(avg(r10), 6) as r10, round(avg(rr::double), 6) as mrr,
       (select round(avg(score), 6) from judged) as avg_score, (select min(score) from judged) as min_score,
       (select max(score) from judged) as max_score from report
"""


def _overall(spark, sf):
    return evaluation.overall_report(_judged(spark, sf), _queries(spark, sf))


@query("r6_overall_report", oracle(_OVERALL, "report"))
def overall_report(spark, sf):
    return _round(
        _overall(spark, sf), "p1", "p3", "p5", "p10", "r10", "mrr", "avg_score", "min_score", "max_score"
    )


@query(
    "r7_score_histogram",
    oracle(
        """
select b.bin, count(j.score) as hits
from (values ('0.0-0.2', 0.0, 0.2), ('0.2-0.4', 0.2, 0.4), ('0.4-0.6', 0.4, 0.6), ('0.6-0.8', 0.6, 0.8), ('0.8-1.0', 0.8, 1.1))
     as b(bin, low, high)
left join judged j on j.score >= b.low::double and j.score < b.high::double and j.score <= 1.0 group by b.bin
""",
        "judged",
    ),
)
def score_histogram(spark, sf):
    return evaluation.score_histogram(_judged(spark, sf))


def _categories(spark, sf):
    name = F.when(F.col("label") < 3, "low").when(F.col("label") < 7, "middle").otherwise("high")
    return t.classes(spark, sf).select(F.col("doc_id").alias("query_id"), name.alias("category"))


@query(
    "r8_category_report",
    oracle(
        """
select category, count(*) as queries, round(avg(top_relevant), 6) as success_rate, round(avg(p1), 6) as p1,
       round(avg(p3), 6) as p3, round(avg(rr::double), 6) as mrr
from report r join (select vec_id, case when label < 3 then 'low' when label < 7 then 'middle' else 'high' end as category
                    from embeddings) c on c.vec_id = r.query_id group by category
""",
        "report",
    ),
)
def category_report(spark, sf):
    report = evaluation.query_report(_judged(spark, sf), _queries(spark, sf))
    return _round(
        evaluation.category_report(report, _categories(spark, sf)), "success_rate", "p1", "p3", "mrr"
    )


@query(
    "r9_grade",
    oracle(
        """
select case when p1 >= 0.8 and p3 >= 0.9 and rr >= 0.85 then 'EXCELLENT' when p1 >= 0.7 and p3 >= 0.85 and rr >= 0.75 then 'VERY GOOD'
            when p1 >= 0.6 and p3 >= 0.75 and rr >= 0.65 then 'GOOD' when p1 >= 0.5 and p3 >= 0.65 then 'FAIR' else 'POOR' end as grade,
       p1 >= 0.7 and p3 >= 0.85 as gate_passed, category
from (select category, avg(p1) as p1, avg(p3) as p3, avg(rr::double) as rr
      from report r join (select vec_id, case when label < 3 then 'low' when label < 7 then 'middle' else 'high' end as category
                          from embeddings) c on c.vec_id = r.query_id group by category) x
""",
        "report",
    ),
)
def grade(spark, sf):
    """Every category's grade."""
    report = evaluation.query_report(_judged(spark, sf), _queries(spark, sf))
    graded = evaluation.grade(evaluation.category_report(report, _categories(spark, sf)))
    return graded.select("category", "grade", "gate_passed")


@query(
    "r10_check_bounds",
    oracle(
        """
select x.query_id, x.doc_id, r.score, coalesce(r.score >= 0.3 and (x.label >= 5 or r.score <= 0.9), false) as passed,
       case when r.score is null then 'File not found in results' end as reason
from (select vec_id as query_id, label, min(vec_id) over (partition by label) as doc_id from embeddings) x
left join runs r on r.query_id = x.query_id and r.doc_id = x.doc_id
""",
        "runs",
    ),
)
def check_bounds(spark, sf):
    table = t.classes(spark, sf)
    first = table.groupBy("label").agg(F.min("doc_id").alias("expected"))
    expectations = table.join(first, "label").select(
        F.col("doc_id").alias("query_id"),
        F.col("expected").alias("doc_id"),
        F.lit(0.3).alias("min_score"),
        F.when(F.col("label") < 5, 0.9).alias("max_score"),
    )
    return evaluation.check_bounds(t.runs(spark, sf), expectations)
