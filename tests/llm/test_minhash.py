"""Near-duplicates against all pairs of exact sets."""

import re

import pyarrow.parquet as pq
import pytest

from docstrata.llm import minhash


def brute(rows, shingle=5, percent=75):
    """rows: (doc_id, text) -> {doc_id: (n, component)}."""
    sets = {}
    for doc_id, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        if len(words) < shingle:
            sets[doc_id] = {tuple(words)} if words else set()
        else:
            sets[doc_id] = {tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    shared = {}
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def run(frame, **options):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame, **options).collect()}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_documents(spark, size):
    path = f"/root/testdata/{size}/documents.parquet"
    rows = pq.read_table(path, columns=["doc_id", "text"]).to_pylist()
    want = brute([(r["doc_id"], r["text"]) for r in rows])
    got = run(spark.read.parquet(path))
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}
    assert any(c != d for d, (n, c) in want.items())


def test_chains_and_copies(spark):
    """A chain of texts, each near the next only, groups of equal and of near copies, and unrelated ones that share
    most of a passage."""
    base = [f"w{i}" for i in range(60)]
    rows = [(100 + k, " ".join(base[k * 3 :] + [f"t{i}" for i in range(k * 3)])) for k in range(12)]
    rows += [(300 + k, "Same  text HERE for all of\tus " + "x y z " * 5) for k in range(30)]
    rows += [(400 + k, " ".join([f"v{i}" for i in range(80)][:-1] + [f"k{k}"])) for k in range(40)]
    rows += [(500 + k, " ".join([f"p{i}" for i in range(40)] + [f"o{k}_{i}" for i in range(25)])) for k in range(90)]
    want = brute(rows)
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}
    assert {got[100 + k][1] for k in range(12)} == {100} and {got[400 + k][1] for k in range(40)} == {400}


def test_large_buckets_in_blocks(spark, monkeypatch):
    """Buckets compared in blocks give the same links."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "BLOCK", 8_000)
    rows = [(k, " ".join([f"p{i}" for i in range(40)] + [f"o{k // 2}_{i}" for i in range(20)] + [f"e{k}"])) for k in range(40)]
    want = brute(rows)
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {d: c for d, (_, c, _) in got.items()} == {d: c for d, (_, c) in want.items()}
    assert got[1][1] == 0 and got[2][1] == 2


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60_000)) + " " + "y" * 300_000
    rows = [(1, None, 9), (2, "", 9), (3, " \n\t", 9), (4, "a b", 9), (5, "A\tB", 9), (6, "a b c d", 9), (None, "a b", 9), (7, long, 9), (8, long + " z", 9), (8, long + " z", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame).collect())
    assert got == [(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False),
                   (6, 1, 6, True), (7, 59_997, 7, True), (8, 59_998, 7, False), (8, 59_998, 7, False)]
    assert minhash.near_duplicates(frame.where("false")).count() == 0
