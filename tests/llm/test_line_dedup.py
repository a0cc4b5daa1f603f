import random

import numpy as np

from docstrata.llm import line_dedup


def brute(rows):
    first, holders = {}, {}
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(doc_id)
    first = {k: min(v) for k, v in holders.items() if len(v) > 1}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if doc_id is None or first.get(key(x), doc_id) == doc_id]
        out.append((doc_id or -1, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out)


def run(frame):
    return sorted((r.doc_id or -1, *[r.deduped[k] for k in ("n_lines", "n_dropped", "text")]) for r in line_dedup.dedup_lines(frame).collect())


def test_edges(spark):
    rows = [
        (5, "A line to repeat\nown line of five\nshort\n"), (3, "  a LINE to repeat \t\nshort\n\na line to repeat"), (9, None), (8, ""),
        (7, "é" * 9 + "\n" + "é" * 10 + "\nonly here, long"), (6, "é" * 9 + "\n" + "é" * 10), (None, "a line to repeat\nx"),
        (5, "A line to repeat\nown line of five\nshort\n"), (10, "own line of five"), (11, "y" * 300_000 + "\n" + "z\n" * 20_000), (12, "y" * 300_000),
    ]
    frame = spark.createDataFrame([(a, b, "c", 1) for a, b in rows], "doc_id long, text string, deduped string, key int")
    assert run(frame) == brute(rows)
    assert line_dedup.dedup_lines(frame.where("false")).count() == 0


def test_random_and_hot_lines(spark, monkeypatch):
    """A filter of the least size, far too small for these lines, changes nothing in the result."""
    rng = random.Random(3)
    pool = [f"passage number {i} of the pool" for i in range(300)]
    rows = []
    for i in range(3_000):
        lines = [rng.choice(pool) if rng.random() < 0.3 else f"line {rng.random()}" for _ in range(rng.randint(0, 12))]
        if i % 3 == 0:
            lines.insert(0, "a line that a third of the documents hold")
        rows.append((i, "\n".join(lines)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute(rows)
    assert run(frame) == want
    monkeypatch.setattr(line_dedup, "filter_bits", lambda n, most: line_dedup.SEGMENT_BYTES * 8)
    assert run(frame) == want


def test_filter_has_no_false_negatives():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64)
    bloom = line_dedup.Bloom(line_dedup.filter_bits(50_000))
    bloom.add(hashes)
    assert bloom.holds(hashes).all()
    assert bloom.holds(hashes + np.uint64(1)).mean() < 0.05


def test_later_bits_are_read_only_where_the_first_are_set(monkeypatch):
    bloom, asked, places = line_dedup.Bloom(1 << 16), [], line_dedup.Bloom.places
    held = np.arange(1, 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bloom.add(held)
    monkeypatch.setattr(line_dedup.Bloom, "places", lambda self, h, probe: (asked.append(len(h)), places(self, h, probe))[1])
    others = np.arange(1000, 2000, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    assert bloom.holds(np.concatenate([held, others]))[:100].all() and asked[0] == 1100 and asked[1] < 300
    assert not len(bloom.holds(held[:0]))
