import re

from pyspark.sql import functions as F

from docstrata.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, at = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            at |= {i + k for i in places for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(at))


TEXTS = [
    None, "", " \n \t", "a b", "a b c d e a b c d e", "x " * 40, "é#*$%&|<> " * 3, "one two\none two\n\n \none two ",
    "a b c d e f a b c d e f g h i j k l m n", " ".join(f"w{i}" for i in range(50_000)), "z" * 400_000, "a b c\x0bd\x0ce\rf",
]


def test_measures_and_edges(spark):
    rows = [(i, t, "h", "host") for i, t in enumerate(TEXTS)] + [(3, "a b", None, "x"), (None, "a b", "h", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, host string")
    got = quality.judged(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "a b" if r.doc_id is None else TEXTS[r.doc_id]
        want = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text and text[:50]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert quality.judged(frame.where("false")).count() == 0


def test_hosts(spark):
    good = " ".join(f"g{i}" for i in range(30))
    rows = [(i, "too short" if i % 10 else f"{good} {i}", "bad") for i in range(200)]
    rows += [(1000 + i, "too short" if i % 10 == 0 else f"{good} {i}", f"h{i % 7}") for i in range(700)]
    rows += [(5000, good + " one", "new"), (5001, "short", "lone"), (5002, good, None), (5003, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.judged(frame).collect()}
    assert not any(got[i].kept for i in range(200))  # the host drags its good documents down
    assert all(got[1000 + i].kept == bool(i % 10) for i in range(700))
    assert got[5000].kept and not got[5001].kept and got[5001].host_rate < 1
    assert got[5002].kept and got[5002].host_rate is None and not got[5003].kept
    kept = {r.doc_id for r in quality.keep_good(frame).collect()}
    assert kept == {d for d, r in got.items() if r.kept}


def test_keep_good_measures_only_what_the_base_rule_asks_for(spark):
    plan = quality.rules(F.col("text")), quality.base_rules(F.col("text"))
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    shown = [frame.select(m.alias("m"))._jdf.queryExecution().optimizedPlan().toString() for m in plan]
    assert "translate" in shown[0] and "translate" not in shown[1]
    for r in frame.select("text", plan[1].alias("m")).collect():
        want = brute(r.text)
        assert (r.m.n_words, r.m.n_repeat_words) == (want[0], want[4])


def test_only_windows_whose_hash_repeats_are_compared(spark):
    frame = spark.createDataFrame([("a b c d e f a b c d e g",)], "text string")
    plan = frame.select(quality.base_rules(F.col("text")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "sort_array" in plan
