import math
import re
import resource
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from docstrata.llm import lm
from docstrata.llm.elias_fano import EliasFano


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 1 << 62), (5, 10), (1000, 1000), (1000, 1 << 62), (300, 5), (5000, 5200)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n))
    seq = EliasFano.build(values)
    assert (seq.access(np.arange(n)) == values).all()
    asked = np.concatenate([values, rng.integers(0, top, 500), [top, top + 5, 0, -1]])
    place = np.searchsorted(values, asked)
    there = [p < n and values[p] == q for p, q in zip(place, asked)]
    assert (seq.find(asked) == np.where(there, place, -1)).all()


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


class Plain:
    """The same model in dictionaries."""

    def __init__(self, texts):
        streams = [tokens(t) for t in texts]
        self.one = Counter(w for s in streams for w in s)
        two = Counter(p for s in streams for p in zip(s, s[1:]))
        three = Counter(p for s in streams for p in zip(s, s[1:], s[2:]))
        self.two = {k: c for k, c in two.items() if c >= lm.LEAST_COUNT}
        self.three = {k: c for k, c in three.items() if c >= lm.LEAST_COUNT}
        self.n = sum(c for w, c in self.one.items() if w != "<s>")
        self.v = len([w for w in self.one if w != "<s>"])
        self.mass2, self.mass3 = Counter(), Counter()
        for (a, _), c in self.two.items():
            self.mass2[a] += c - lm.DISCOUNT
        for (a, b, _), c in self.three.items():
            self.mass3[a, b] += c - lm.DISCOUNT

    def p1(self, w):
        return (self.one[w] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def p2(self, a, w):
        if a not in self.one:
            return self.p1(w)
        back = 1 - self.mass2[a] / self.one[a]
        return back * self.p1(w) + max(self.two.get((a, w), 0) - lm.DISCOUNT, 0) / self.one[a]

    def p3(self, a, b, w):
        if (a, b) not in self.two:
            return self.p2(b, w)
        back = 1 - self.mass3[a, b] / self.two[a, b]
        return back * self.p2(b, w) + max(self.three.get((a, b, w), 0) - lm.DISCOUNT, 0) / self.two[a, b]

    def score(self, text):
        s = tokens(text)
        base = sum(math.log10(self.p1(w)) for w in s[1:])
        full = sum(math.log10(self.p2(s[0], w) if i == 1 else self.p3(s[i - 2], s[i - 1], w)) for i, w in enumerate(s) if i)
        return len(s) - 1, sum(self.one[w] > 0 for w in s[1:]), base, full


def check(spark, rows):
    frame = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double")
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 5 == 1
    plain = Plain([t for d, t in rows if not held(d)])
    got = lm.score_documents(frame).collect()
    assert len(got) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t)
    for r in got:
        n, known, base, full = plain.score(texts[r.doc_id].pop() if len(set(texts[r.doc_id])) > 1 else texts[r.doc_id][0])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), n, known, plain.n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert full - 3.1 * n / lm.STEPS <= r.score <= full + 1e-6, (r, full)  # up to three codes a token, rounded down
    return got, plain


@pytest.mark.parametrize("shard_words", [lm.SHARD_WORDS, 2_000])
def test_documents(spark, sf, monkeypatch, shard_words):
    monkeypatch.setattr(lm, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(lm, "GATHER", 5_000)
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    got, _ = check(spark, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one():
    plain = Plain(["a b c a b d", "a b c", "a b", "b a b c"])
    words = [w for w in plain.one if w != "<s>"]
    for a, b in [("a", "b"), ("b", "c"), ("<s>", "a"), ("zz", "a"), ("c", "zz")]:
        total = sum(plain.p3(a, b, w) for w in words) + plain.p3(a, b, "never seen")
        assert total == pytest.approx(1)


def test_edges(spark):
    long = "the same words again and again " * 20_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b a B"), (4, "A b a B"), (5, "a b"), (None, "a b c"), (6, long), (8, "y" * 200_000), (9, "a b c d e"), (10, "a b")]
    check(spark, rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert lm.score_documents(frame.where("false")).count() == 0
    only = lm.score_documents(frame.where("doc_id is null")).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) for r in only] == [(True, 0, 0, 0.0, 0.0)]


def test_sums_of_rows():
    rng = np.random.default_rng(4)
    columns = [rng.integers(0, 4, 500), rng.integers(0, 9, 500), rng.integers(0, 5, 500)]
    want = sorted(Counter(zip(*[c.tolist() for c in columns])).items())
    for limits in ([4, 9, 5], [1 << 30, 1 << 30, 1 << 30]):
        found, counts = lm._sums(lm._packed(columns, limits), limits)
        assert list(zip(zip(*[c.tolist() for c in found]), counts.tolist())) == want
        found, counts = lm._sums(lm._packed([c[:0] for c in columns], limits), limits)
        assert len(counts) == 0 and all(len(c) == 0 for c in found)


@pytest.mark.parametrize("cell_tokens", [lm.CELL_TOKENS, 40])
def test_every_pair_and_triple_counts(spark, monkeypatch, cell_tokens):
    """N-grams seen once are in the levels too; a frequent word's followers lie in many cells, with the same scores."""
    monkeypatch.setattr(lm, "LEAST_COUNT", 1)  # what `Plain` counts
    monkeypatch.setattr(lm, "CELL_TOKENS", cell_tokens)
    texts = [f"the w{i} of the w{i * 7 % 50} and the w{i % 9} ends" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    _, plain = check(spark, rows)
    assert min(plain.two.values()) == min(plain.three.values()) == 1
    facts = lm.train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert (facts.cells[-1] > 8) == (cell_tokens == 40)


def test_seen_once_is_known(spark):
    frame = spark.createDataFrame([(0, "a b c"), (2, "d e f"), (3, "a b c"), (5, "x b y")], "doc_id long, text string")
    facts = lm.train(frame.where("doc_id in (0, 2, 5)"))
    seen, unseen = (lm.Model(facts).score(lm.pa.array([t], lm.pa.large_string()))[3][0] for t in ("d e f", "d f e"))
    assert seen > unseen + 1


def test_bodies():
    rng = np.random.default_rng(5)
    for limits in ([3, 40, 50], [3, 1 << 40, 1 << 40]):
        columns = [np.sort(rng.integers(0, limits[1], 300)), rng.integers(0, limits[2], 300)]
        packed, counts = lm._packed(columns, limits[1:]), rng.integers(1, 9, 300)
        body = lm._body(packed, counts)
        assert all((a == b).all() for a, b in zip(lm._columns(body, len(packed)), [*packed, counts]))
        *found, sums = lm._cell_sums(lm.pa.table({"body": [body, None, body]}), limits)
        want = Counter()
        for a, b, c in zip(*[x.tolist() for x in (*columns, counts)]):
            want[a, b] += 2 * c
        assert dict(zip(zip(*[x.tolist() for x in found]), sums.tolist())) == want and len(sums) == len(want)


def test_many_shards_with_few_file_handles(spark, monkeypatch):
    """200 shards are looked up in a process that may open 256 files, and few of them stay mapped."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 20)
    rows = spark.createDataFrame([(" ".join(f"w{(i * 7 + k) % 900}" for i in range(60)),) for k in range(60)], "text string")
    facts = lm.train(rows)
    assert len(facts.bases) > 128
    texts = pa.array([r.text for r in rows.collect()], pa.large_string())
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (256, hard))
    try:
        whole = lm.Model(facts)
        first = whole.score(texts)
        assert len(whole._words.held) > 100
        monkeypatch.setattr(lm, "OPEN_FILES", 16)
        small = lm.Model(facts)
        assert all((a == b).all() for a, b in zip(first, small.score(texts))) and len(small._words.held) == 16
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))


@pytest.mark.parametrize("n,top", [(1, 1), (5, 10), (1000, 1000), (1000, 1 << 62), (5000, 5200)])
def test_values_around_places(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n))
    seq = EliasFano.build(values)
    index = np.sort(rng.integers(0, n, 200))
    before, at = seq.around(index)
    assert (at == values[index]).all() and (before == np.where(index > 0, values[np.maximum(index - 1, 0)], 0)).all()
    assert (seq.values() == values).all()


def test_whole_sequences_and_lone_followers_are_not_searched(monkeypatch):
    """All values are read in one pass, and a context with one follower is looked up without a search."""
    level = lm.Level(EliasFano.build(np.arange(1, 1001)), EliasFano.build(lm.summed_up(np.arange(1, 1001), np.arange(1000) % 7)), *[np.zeros(0, np.uint16)] * 2)
    searched = []
    find, select = EliasFano.find, EliasFano._select
    monkeypatch.setattr(EliasFano, "find", lambda self, values: searched.extend(values) or find(self, values))
    contexts = np.array([0, 3, 500, 999])
    place, rank = level.find(contexts, np.array([0, 0, 1, 2, 3, 3]), np.array([0, 1, 3, 500 % 7, 999 % 7, -1]))
    assert place.tolist() == [0, -1, 3, 500, 999, -1] and rank.tolist() == [0, -1, 0, 0, 0, -1] and not searched
    monkeypatch.setattr(EliasFano, "_select", lambda self, rank, zeros: searched.extend(rank) or select(self, rank, zeros))
    assert (level.follower(np.arange(1000)) == np.arange(1000) % 7).all() and not searched


def test_look_ups_go_through_each_cell_once_for_megabytes(spark, monkeypatch):
    """3 MB of texts take one look-up a cell and level, with the scores that each text has alone; more cells, larger blocks."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 200)
    rows = [" ".join(f"w{(i * 7 + k) % 900}" for i in range(60)) for k in range(60)]
    facts = lm.train(spark.createDataFrame([(t,) for t in rows], "text string"))
    texts = pa.array([t for t in rows for _ in range(180)], pa.large_string())
    assert 3 << 20 < texts.nbytes < 4 << 20
    alone = [lm.Model(facts).score(pa.array([t], pa.large_string()))[3][0] for t in rows]
    asked = []
    find = lm.Level.find
    monkeypatch.setattr(lm.Level, "find", lambda self, *of: asked.append(self) or find(self, *of))
    got = [lm.Model(facts).score(p)[3] for p in lm.blocks(texts, facts.cells[-1])]
    assert np.concatenate(got) == pytest.approx(np.repeat(alone, 180))
    assert len(asked) <= 2 * facts.cells[-1]
    assert len(lm.blocks(texts, 8)) == 1 and len(lm.blocks(pa.concat_arrays([texts] * 3), 8)) > len(lm.blocks(pa.concat_arrays([texts] * 3), 4096)) == 1
