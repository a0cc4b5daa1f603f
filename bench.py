"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from docstrata.operators import ann, cell_tree, chunking, embedding, search, stats  # noqa: E402
from docstrata.plans import indexing, reindex  # noqa: E402
from docstrata.sources import store  # noqa: E402
from docstrata.session import build_session, fresh_dir  # noqa: E402
from docstrata.streaming import feed  # noqa: E402
from docstrata.workload import search_queries, stream_queries, tables as t  # noqa: E402


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    vectors = t.vectors(spark, sf)
    asked = vectors.select(F.col("id").alias("query_id"), "vector")
    hundred = asked.orderBy("query_id").limit(100)
    sink = lambda df: df.write.format("noop").mode("overwrite").save()

    def build_index():
        build_index.path = fresh_dir(spark, "ivf")
        index = ann.build_ivf(vectors, n_cells=32)
        ann.write_ivf(index, build_index.path)
        build_index.index = ann.IvfIndex(index.centroids, spark.read.parquet(build_index.path), index.metric)

    def build_tree():
        build_tree.tree = cell_tree.build_tree(vectors, n_tops=4, branch=6, at=fresh_dir(spark, "tree"))

    def recall():
        found = ann.probe_ivf(build_index.index, asked, 10, nprobe=20)
        recall.value = ann.recall_at(found, search.batch_topk(vectors, asked, 10)).first()[0]

    def plan():
        made = reindex.plan_reindex(
            t.listing(spark, sf), t.status(spark, sf), t.folders(spark), t.registry(spark), t.NOW_MS
        )
        sink(made)

    def completion():
        events = stream_queries.event_stream(spark, sf).select(
            "path", F.lit("1").alias("run"), F.date_trunc("day", "ts").alias("started"),
            F.lit(66).alias("total"), F.lit(1).alias("processed"), F.lit(0).alias("errors"),
        ).withWatermark("started", "30 days")
        stream_queries.drain(feed.track_completion(events), "update")

    def index():
        """Plan-independent part of the whole job: chunk, embed, store and record all documents."""
        tables = store.chunk_store(spark, fresh_dir(spark, "c")), store.status_store(spark, fresh_dir(spark, "s"))
        for table in tables:
            table.create()
        docs = t.corpus(spark, sf).selectExpr("path", "text", "mtime_ms", "cast(null as string) error_kind", "'' error_message")
        indexing.index_files(docs, t.listing(spark, sf), t.registry(spark), *tables, t.NOW_MS)

    events = t.events(spark, sf)
    documents = t.documents(spark, sf)
    profile = events.select(F.col("event_type").alias("op"), F.col("value").alias("ms"), F.lit(True).alias("ok"))
    runs = {
        "warmup": lambda: (sink(events), sink(chunking.chunk_sentences(documents.limit(8), "doc_id"))),
        "c1_chunk_sentences": lambda: sink(chunking.chunk_sentences(documents, "doc_id")),
        "c3_chunk_fixed": lambda: sink(chunking.chunk_fixed(documents)),
        "e1_embed_chunks": lambda: sink(embedding.embed(chunking.chunk_sentences(documents, "doc_id"))),
        "q1_topk": lambda: search.topk(vectors, [1.0] * 64, 100).collect(),
        "q2_batch_topk_100": lambda: sink(search.batch_topk(vectors, hundred, 10)),
        "q2_batch_topk_2000": lambda: sink(search.batch_topk(vectors, asked, 10)),
        "q6_build_ivf": build_index,
        "q6_probe_ivf": lambda: sink(ann.probe_ivf(build_index.index, asked, 10, nprobe=20)),
        "q6_recall": recall,
        "q6_build_tree": build_tree,
        "q6_probe_tree": lambda: sink(cell_tree.probe_tree(build_tree.tree, asked, 10, n_tops=4, n_leaves=15)),
        "q2_topk_by_bounds": lambda: sink(cell_tree.exact_topk(build_tree.tree, hundred, 10)),
        "p7_plan_reindex": plan,
        "index_files": index,
        "q5_search_text": lambda: sink(search_queries.search_text(spark, sf)),
        "a2_operation_breakdown": lambda: sink(stats.operation_breakdown(profile)),
        "a6_latency_stats": lambda: sink(stats.latency_stats(events, "event_type", "value")),
        "w6_track_completion": completion,
    }
    took = {}
    for name, run in runs.items():
        begin = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - begin, 3)
    took.pop("warmup")
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "recall_at_10": round(recall.value, 4),
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
