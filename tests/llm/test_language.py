import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from docstrata.llm import language, queries


def test_gram_counts_against_a_plain_count(monkeypatch):
    for text in ["", "a", "Ab  c!", "  É_é9ß", "x" * 10 + "𝒳 yz", "one two " * 9]:
        plain = " " + "".join(chr(language._LETTERS[ord(c)]) if ord(c) < 1 << 16 else c for c in text)
        while "  " in plain:
            plain = plain.replace("  ", " ")
        want = Counter()
        for n in language.GRAMS:
            for i in range(len(plain) - n + 1):
                gram = plain[i : i + n]
                if gram != " ":
                    key = n
                    for c in gram:
                        key = ((key << 21) ^ ord(c)) & (2**64 - 1)
                    want[int(language.mix64(np.array([key], dtype=np.uint64))[0]) % language.DIMENSIONS] += 1
        dims, counts = language.gram_counts(text)
        assert dict(zip(dims.tolist(), counts.tolist())) == dict(want), text


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got = queries.op3_language_id(spark, sf).collect()
    assert {r.doc_id for r in got} == set(truth) and len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    right = np.mean([r.lang_pred == truth[r.doc_id]["lang"] for r in held])
    print("held-out accuracy", right, len(held))
    assert right > 0.97
    assert sum(r.rejected for r in got) < 0.1 * len(got)


def test_edges(spark):
    base = {"en": "the cat and the dog went to the house", "de": "der hund und die katze gehen nach hause", "xx": "zzq qqz"}
    rows = [(i, f"{base[k]} {base[k]}", k) for i, k in enumerate(["en", "de", "xx"] * 30)]
    rows += [(500, None, "en"), (501, "", "de"), (502, "123 !!", "en"), (503, "the dog", None), (None, "die katze", "de"), (504, "katze " * 100_000, None), (503, "the dog", None)]
    frame = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {}
    for r in language.identify(frame).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[503]) == 2 and got[503][0].lang_pred == "en" and got[504][0].lang_pred == "de"
    assert [got[i][0].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[500][0].score == 0
    assert got[None][0].held_out and got[None][0].lang_pred == "de"
    assert language.identify(frame.where("false")).count() == 0
    blind = language.identify(frame.withColumn("lang", frame.lang.substr(9, 1)).selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in blind.collect()} == {"und"}
