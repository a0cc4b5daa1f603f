"""Importance resampling against a plain version by text."""

import hashlib
import math
import re
import zlib

import pytest

from docstrata.llm import resample


def features(text, orders=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    runs = [" ".join(words[i : i + k]) for k in range(1, orders + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute(rows, target, percent=5):
    """rows: (doc_id, text) -> sorted (doc_id, n_features, weight, score, rank)."""
    found = [(d, *features(t)) for d, t in rows]
    s, t = [0] * 10_000, [0] * 10_000
    for _, _, held in found:
        for b in held:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((y + 1.0) * (S + 10_000.0) / ((x + 1.0) * (T + 10_000.0)))) for x, y in zip(s, t)]
    out, able = [], []
    for d, n, held in found:
        weight = sum(gain[b] for b in held)
        if d is None:
            out.append([None, len(held), weight, None, None])
            continue
        h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(held), weight, score, None])
        if n >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0]))
    for k, row in enumerate(able[: math.floor(percent * len(able) / 100)]):
        row[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def run(docs, target, **options):
    return sorted((tuple(r) for r in resample.resample(docs, target, **options).collect()), key=repr)


def odd_rows():
    menu = "Home | About | Contact\nTerms and Conditions\n"
    rows = [(k, menu + f"item {k % 7} of the list\n\n  \nan answer about seas, rivers and lakes {k}\n" * (1 + k % 5)) for k in range(60)]
    rows += [(100 + k, menu * 4) for k in range(120)]
    rows += [(300, None), (301, ""), (302, "\n \n;;\n"), (303, "one"), (304, "one\ntwo"), (305, "a\nb\nc\nd\ne"), (None, menu * 9)]
    rows += [(306, "Ünïcode Ärger — naïve line \x7f\x00 x\ty"), (307, "w " * 90_000 + "\n" + "z" * 200_000)]
    rows += [(308, menu * 5), (308, menu * 5), (308, "another text\nof that id " * 8)]
    return rows


TARGET = ["an answer about seas", "rivers and lakes\nin the list", None, ""]


@pytest.mark.parametrize("frequent", [4096, 4, 1])
def test_odd_rows(spark, frequent):
    """Lines common enough to be broadcast, and none such, give the same; so do other columns with clashing names."""
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, lines string")
    target = spark.createDataFrame([(t, 2) for t in TARGET], "text string, times int")
    assert run(docs, target, frequent=frequent, percent=30) == brute(rows, TARGET, 30)


def test_empty_tables(spark):
    docs, target = spark.createDataFrame(odd_rows()[:40], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert run(docs, target) == brute(odd_rows()[:40], [])
    assert run(docs.where("false"), target) == []


@pytest.mark.parametrize("orders", [1, 2, 3, 4])
def test_lines_and_crossings_are_all_runs(orders):
    for lines in (["a b c d", "e", "f g", "h i j k"], ["a", "b", "c", "d"], ["x"], ["y" * 70 + " " + "z" * 63 + " b " + "c" * 64 + " d"], []):
        own = [x.encode() for x in lines]
        held, sizes = resample.line_buckets(own, orders=orders)
        assert [int(n) for n in sizes] == [len(features(x, orders)[1]) for x in lines]
        assert sorted(held.tolist() + resample.crossing_buckets(own, orders=orders)) == sorted(features("\n".join(lines), orders)[1])
