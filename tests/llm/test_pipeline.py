"""The pipeline against the brute-force versions of its stages."""

import hashlib

import pyarrow.parquet as pq
from test_bpe import library
from test_decontaminate import brute as leaks
from test_line_dedup import brute as lines
from test_minhash import brute as near
from test_quality import brute as measures

import corpus_pipeline


def good(rows):
    """Ids of (doc_id, text, source) that pass the rules."""
    fails = {}
    for doc_id, text, _ in rows:
        n_words, _, _, _, repeated = measures(text)
        fails[doc_id] = n_words < 10 or 100 * repeated > 20 * n_words
    hosts = {}
    for doc_id, _, host in rows:
        hosts.setdefault(host, []).append(fails[doc_id])
    rates = [sum(v) / len(v) for h, v in hosts.items() if h is not None]
    mean = sum(rates) / len(rates)
    var = sum((r - mean) ** 2 for r in rates) / len(rates)
    s = min(max(mean * (1 - mean) / var - 1, 1.0), 1e6) if var else 1e6
    bad = {h for h, v in hosts.items() if h is not None and (sum(v) + mean * s) / (len(v) + s) > 0.5}
    return [r for r in rows if not fails[r[0]] and r[2] not in bad]


def brute(rows, items):
    kept = good(rows)
    cleaned = [(d, text) for d, _, _, text in lines([(d, t) for d, t, _ in kept])]
    cleaned = [(0 if d == -1 else d, t) for d, t in cleaned]  # lines() writes -1 for the id 0
    groups = near(cleaned)
    left = [(d, t) for d, t in cleaned if groups[d][1] == d]
    found = {d for d, _ in leaks(left, items)}
    left = [(d, t) for d, t in left if d not in found]
    ids, decoded = library([t for _, t in left])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return sorted((d, len(i), i, sha(",".join(map(str, i))), sha(x)) for (d, _), i, x in zip(left, ids, decoded, strict=True))


def test_run(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    items = pq.read_table(f"{sf}/benchmark.parquet").to_pylist()
    want = brute([(r["doc_id"], r["text"], r["source"]) for r in docs], [(r["item_id"], r["text"]) for r in items])
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == want and 0 < len(want) < len(docs)


def test_stages_take_odd_rows(spark, sf):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text + " x", None, None, None), (None, text, "en", "s", None), (3, None, "de", "s", 0),
            (4, "", None, "s", 0), (5, " ".join(f"a{i}" for i in range(60_000)), "en", "t", 1), (6, "one line that repeats\n" + text[::-1], "en", "s", 1),
            (7, "one line that repeats\nq " + " ".join(f"z{i}" for i in range(30)), "en", "s", 2)]
    extra = "component_id, kept, host, key, ids, label, deduped, window, n, a, b, row, m, clean, alone, again, base_failed"
    extra += ", __dropped, __alone, __again, __host, __rules, __leak, __doc, __keys, __cleaned, __deduped, __salt"
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame = frame.selectExpr("*", *[f"cast(doc_id as string) as `{c}`" for c in extra.split(", ")])
    for start in (frame, frame.where("false")):
        docs = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            docs = stage(spark, docs, sf)
            if k < 4:
                assert docs.columns == columns
        got = sorted((r.doc_id or 0, r.n_tokens > 0) for r in docs.collect())
        assert got == ([(0, True), (1, True), (5, True), (6, True), (7, True)] if start is frame else [])
