"""Repeated passages against a plain version over all windows."""

import random
import re

import numpy as np
import pytest

from docstrata.llm import substrings


def brute(rows, least=50):
    """rows: (doc_id, text) -> sorted (doc_id, n_words, n_removed, kept text)."""
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, words in split:
        if d is not None:
            for i in range(len(words) - least + 1):
                win = " ".join(words[i : i + least])
                first[win] = min(first.get(win, d), d)
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - least + 1):
            if d is not None and first[" ".join(words[i : i + least])] < d:
                gone.update(range(i, i + least))
        out.append((d, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=repr)


def run(frame, **options):
    found = substrings.dedup_substrings(frame, **options)
    return sorted(((r.doc_id, r.deduped.n_words, r.deduped.n_removed, r.deduped.text) for r in found.collect()), key=repr)


def texts(seed, n, least):
    """Texts cut from few sources in ever other pieces, so that matches end anywhere; copies; repeats within a text."""
    rng = random.Random(seed)
    sources = [[f"s{k}_{rng.randrange(40)}" for _ in range(6 * least)] for k in range(3)]
    hot = [f"h{i}" for i in range(least + 7)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(rng.randrange(1, 4)):
            source = rng.choice(sources)
            at, size = rng.randrange(len(source)), rng.randrange(1, 3 * least)
            words += source[at : at + size] + [f"o{d}_{i}" for i in range(rng.randrange(0, 4))]
            if rng.random() < 0.4:
                words += hot
            if rng.random() < 0.2:
                words += words[-least - 3 :]
        rows.append((d, " ".join(words)))
        if rng.random() < 0.3:
            rows.append((1000 + d, "\n".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("least,seed,n", [(50, 12, 60), (10, 3, 120), (6, 6, 60)])
def test_pieces_of_sources(spark, least, seed, n):
    rows = texts(n, n, least)
    got = run(spark.createDataFrame(rows, "doc_id long, text string"), least=least, seed=seed)
    assert got == brute(rows, least)
    assert any(r[2] for r in got) and any(0 < r[2] < r[1] for r in got)


def test_edges(spark):
    passage = [f"p{i}" for i in range(49)]
    long = " ".join(f"w{i}" for i in range(60_000)) + " " + "y" * 300_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, " ".join(passage)), (5, " ".join(passage)), (6, " ".join([*passage, "q"])),
            (7, "\t".join(["z", *passage, "q", "z"])), (8, " ".join([*passage, "Q"])), (None, " ".join([*passage, "q"])),
            (9, long), (10, long + " z"), (10, long + " z"), (10, "a b"), (10, " ".join([*passage, "q", "r"])), (11, "é " * 120), (12, "é " * 121)]
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, tx int, cuts string, row string")
    assert run(frame) == brute(rows)
    assert substrings.dedup_substrings(frame).columns == ["doc_id", "text", "tx", "cuts", "row", "deduped"]
    assert run(frame.where("false")) == []


def test_every_window_has_one_anchor_and_equal_windows_the_same():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 5, 4000).astype(np.uint64)
    bounds = np.array([0, 0, 1500, 1520, 1520, 4000])
    row, anchor, content, at, low, high = substrings.anchors(words, bounds, 20, 4)
    starts = [(r, s) for r, a, b in zip(row, low, high) for s in range(a, b + 1)]
    assert starts == [(r, s) for r in range(5) for s in range(bounds[r + 1] - bounds[r] - 19)]
    seen, same = {}, {}
    for r, h, c, p, a, b in zip(row, anchor, content, at, low, high):
        for s in range(a, b + 1):
            win = tuple(words[bounds[r] + s : bounds[r] + s + 20])
            assert seen.setdefault(win, (h, p - s)) == (h, p - s) and s <= p <= s + 16
        whole = (tuple(words[bounds[r] + a : bounds[r] + b + 20]), p - a)
        assert same.setdefault((h, c), whole) == whole
