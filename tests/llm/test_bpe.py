import random

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from docstrata.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "", " ", "\n\n  x\t\t y", "It's they'll I'D 'S don''t", "héllo wörld ñ ß 你好 مرحبا 🙂🙂‍♀️", "a b c \u0085\x1c\x1d\x1e\x1f", "<|endoftext|>",
    "a<|endoftext|><|endoftext|> b<|endoftext|", "x" * 3_000, "ab" * 20_000, "1234567890 ٣٤ ½", "�﻿\x00\x7f", "  leading", "é ​",
]


def library(texts):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    found = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return found, [tokenizer.decode(i, skip_special_tokens=False) for i in found]


def test_same_as_the_library():
    rng = random.Random(5)
    texts = HARD + ["".join(chr(rng.choice([32, 10, 39, rng.randrange(33, 127), rng.randrange(0xA0, 0x2FF), rng.randrange(0x4E00, 0x4F00)])) for _ in range(60)) for _ in range(800)]
    ids, decoded = library(texts)
    mine = bpe.Codec(PATH)
    for text, want, back in zip(texts, ids, decoded, strict=True):
        assert mine.encode(text) == want, repr(text)
        assert mine.decode(want) == back == text, repr(text)
    assert mine.decode([ids[4][0], 178, 50_256, 999_999]) == Tokenizer.from_file(PATH).decode([ids[4][0], 178, 50_256], skip_special_tokens=False)


def test_documents(spark, sf):
    import hashlib

    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    ids, decoded = library([r["text"] or "" for r in rows])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((r["doc_id"], len(i), sha(",".join(map(str, i))), sha(d)) for r, i, d in zip(rows, ids, decoded, strict=True))
    got = queries.op9_bpe_roundtrip(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == want


def test_edges(spark):
    frame = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a b", 5), (2, "", 5)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids, r.decoded) for r in bpe.tokenized(frame, PATH).collect())
    assert got == [(0, 2, [64, 275], "a b"), (1, 0, [], ""), (2, 0, [], ""), (2, 0, [], "")]
    assert bpe.tokenized(frame.where("false"), PATH).count() == 0


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 20)
    monkeypatch.setattr(bpe, "FOREST_ROWS", 3)
    mine, rng = bpe.Codec(PATH), random.Random(1)
    for _ in range(40):
        texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) + rng.choice("xyz") for _ in range(rng.randrange(9))) for _ in range(3)]
        assert mine.encode_all(texts) == library(texts)[0]
        assert len(mine.young) <= 60 and len(mine.old) <= 60


def test_forest_is_the_same_as_a_tree_each():
    mine, rng = bpe.Codec(PATH), random.Random(9)
    pieces = [bytes(rng.choice(b"aaab thein\xc3\xa9") for _ in range(rng.randrange(1, bpe.SHORT_BYTES + 1))) for _ in range(600)]
    assert bpe.merge_forest(pieces, mine.starts, mine.table) == [bpe.merge([mine.start[b] for b in p], mine.pairs) for p in pieces]


def test_tree_takes_the_leftmost_of_the_least():
    tree = bpe.RankTree([5, 2, 9, 2, 7])
    assert tree.top() == (2, 1)
    tree.set(1, 8)
    assert tree.top() == (2, 3)


def test_lists_of_ids_and_texts_are_arrow_arrays():
    mine, texts = bpe.Codec(PATH), HARD + ["", "a b a b"] * 3
    ids, want = mine.token_ids(texts), library(texts)
    assert ids.to_pylist() == want[0] and mine.decode_all(ids).to_pylist() == texts
    assert mine.decode_all(ids[:0]).to_pylist() == [] and mine.token_ids([]).to_pylist() == []
    half = pa.array([mine.encode("é")[:1], mine.start[0xC3:0xC4]], pa.list_(pa.int32()))
    assert mine.decode_all(half).to_pylist() == [mine.decode(i) for i in half.to_pylist()]


def test_met_pieces_are_not_merged_again(monkeypatch):
    mine = bpe.Codec(PATH)
    texts = ["some words<|endoftext|> and more", "y" * 100 + " words"]
    first = mine.token_ids(texts)
    merged = []
    monkeypatch.setattr(bpe, "CACHE_PIECES", 1)  # the next call begins a generation
    monkeypatch.setattr(bpe, "merge_forest", lambda rows, *_: merged.extend(rows))
    assert mine.token_ids(texts) == first and not merged and len(mine.old) == 4
