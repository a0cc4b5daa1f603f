import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docstrata.functions import paths, text as tx
from docstrata.operators import chunking


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def chunks_of(spark, text, target=500, overlap=60):
    docs = spark.createDataFrame([(1, text)], "doc int, text string")
    rows = chunking.chunk_sentences(docs, "doc", "text", target, overlap).orderBy("chunk_index").collect()
    return [(r["offset"], r["text"]) for r in rows]


@pytest.mark.parametrize("text", ["", "   ", "\n\t", "﻿ "])
def test_blank_text_has_no_chunks(spark, text):
    assert chunks_of(spark, text) == []


def test_one_sentence_is_one_chunk(spark):
    assert chunks_of(spark, "This is a short sentence.") == [(0, "This is a short sentence.")]


def test_chunks_stay_near_the_target(spark):
    found = chunks_of(spark, "First sentence. " * 100, 100, 20)
    assert len(found) > 1
    assert all(-(-len(t) // 4) <= 150 for _, t in found)


def test_long_sentence_after_short_buffer_repeats_the_offset(spark):
    found = chunks_of(spark, "Hi there. " + "x" * 3000 + ".")
    assert [(o, len(t)) for o, t in found] == [(0, 9), (0, 3011)]


def greedy(sentences, target, overlap):
    """Chunks by definition: whole joined texts are measured every time."""
    def size(parts):
        return -(-len(" ".join(parts)) // 4)

    out, held, tokens, offset = [], [], 0, 0
    for sentence in sentences:
        if held and tokens + size([sentence]) > target:
            out.append((offset, " ".join(held)))
            while held and size(held) > overlap:
                offset += len(held.pop(0)) + 1
            tokens = size(held)
        held.append(sentence)
        tokens += size([sentence])
    out.append((offset, " ".join(held)))
    return out


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.text("ab ", max_size=40), min_size=1, max_size=40),
    st.integers(1, 30),
    st.integers(0, 30),
)
def test_sentence_runs_equal_the_definition(sentences, target, overlap):
    runs = chunking.sentence_chunks(sentences, target, overlap)
    assert [(o, " ".join(sentences[a:b])) for a, b, o in runs] == greedy(sentences, target, overlap)


def test_offsets_point_into_the_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("text", tx.collapse_whitespace("text"))
    rows = chunking.chunk_sentences(docs, ["doc_id"], "text", 100, 20).join(
        docs.select("doc_id", F.col("text").alias("whole")), "doc_id"
    )
    wrong = rows.where(F.expr("substring(whole, offset + 1, length(text)) <> text"))
    assert wrong.isEmpty()


def test_fixed_windows(spark):
    docs = spark.createDataFrame([(1, "a" * 1701), (2, "b" * 800), (3, " \n "), (4, "c")], "doc int, text string")
    rows = chunking.chunk_fixed(docs, "text", 800, 100).collect()
    sizes = {}
    for r in sorted(rows, key=lambda r: (r["doc"], r["chunk_index"])):
        sizes.setdefault(r["doc"], []).append((r["offset"], len(r["text"])))
    assert sizes == {1: [(0, 800), (700, 800), (1400, 301)], 2: [(0, 800)], 4: [(0, 1)]}
    assert chunking.chunk_fixed(docs, "text", 800, 100, max_chunks=2).count() == 4


def test_fixed_windows_with_overlap_beyond_size(spark):
    docs = spark.createDataFrame([(1, "abcdef")], "doc int, text string")
    found = [r["text"] for r in chunking.chunk_fixed(docs, "text", 4, 9).orderBy("chunk_index").collect()]
    assert found == ["abcd", "bcde", "cdef"]


def test_chunk_rows_keep_their_own_file(spark):
    chunks = spark.createDataFrame(
        [("/a.txt", 0, 0, "x"), ("/a.txt", 1, 5, "y"), ("/b.md", 0, 0, "z"), ("/b.md", 1, 5, "w")],
        "path string, chunk_index int, offset long, text string",
    )
    listing = spark.createDataFrame([("/a.txt", 1, 11), ("/b.md", 2, 22)], "path string, size_bytes long, mtime_ms long")
    rows = chunking.assemble_chunks(chunks, None, listing).collect()
    assert {(r["path"], r["mtime_ms"], r["type"], r["title"]) for r in rows} == {
        ("/a.txt", 11, "txt", "a.txt"),
        ("/b.md", 22, "md", "b.md"),
    }
    assert len({r["id"] for r in rows}) == 4


PATHS = [
    ("/a/b.txt", "b.txt", "txt", "/a", "txt"),
    ("/a.d/b", "b", "", "/a.d", ""),
    ("/b.", "b.", "", "/", ""),
    ("b.MD", "b.MD", "MD", "/", "md"),
    ("/x/.gitignore", ".gitignore", "gitignore", "/x", "gitignore"),
    ("/x/a.tar.gz", "a.tar.gz", "gz", "/x", "tar.gz"),
    ("/x/a.gz", "a.gz", "gz", "/x", "gz"),
]


@pytest.mark.parametrize("path,base,ext,parent,extended", PATHS)
def test_path_parts(spark, path, base, ext, parent, extended):
    got = [
        one(spark, f("p"), p=path)
        for f in (paths.basename, paths.extension, paths.parent_dir, paths.extended_extension)
    ]
    assert got == [base, ext, parent, extended]


def test_markdown_rules(spark):
    source = "# Title\n\n- item *one*\n1. [label](http://x)\n> quoted `code` text"
    assert one(spark, tx.strip_markdown("t"), t=source) == "Title item one label quoted text"


def test_snippet_window(spark):
    text = "a" * 300 + " needle " + "b" * 300
    got = one(spark, tx.snippet("t", "q"), t=text, q="NEEDLE hay")
    assert got == "..." + text[251:451] + "..."
    assert one(spark, tx.snippet("t", "q"), t=text, q="absent") == "a" * 200 + "..."
    assert one(spark, tx.snippet("t", "q"), t="short", q="x") == "short"


def test_highlight(spark):
    row = one(spark, tx.highlight("t", "q"), t="A (b) a+b", q="(b) a")
    # The second word is also looked for inside the marks of the first.
    assert row["html"] == "<mark>A</mark> <m<mark>a</mark>rk>(b)</m<mark>a</mark>rk> <mark>a</mark>+b"
    assert row["match_type"] == "keyword"
    assert one(spark, tx.highlight("t", "q"), t="text", q="  ")["match_type"] == "semantic"
    assert one(spark, tx.highlight("t", "q"), t="Price $5", q="$5")["html"] == "Price <mark>$5</mark>"


def test_context_window_takes_the_middle(spark):
    parts = [f"Sentence number {i} is here." for i in range(40)]
    got = one(spark, tx.context_window("t"), t=" ".join(parts))
    assert got == "... " + " ".join(parts[19:22]) + " ..."
    assert one(spark, tx.context_window("t"), t="y" * 500) == "y" * 400 + "..."


def test_whitespace_matches_definition(spark):
    rng = random.Random(5)
    alphabet = "ab" + tx.WHITESPACE
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["x"] for r in frame.select("i", tx.collapse_whitespace("t").alias("x")).collect()}
    for i, text in enumerate(texts):
        for ch in tx.WHITESPACE:
            text = text.replace(ch, " ")
        assert got[i] == " ".join(part for part in text.split(" ") if part)
