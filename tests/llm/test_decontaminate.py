import itertools
import re
from collections import Counter

import pyarrow.parquet as pq

from docstrata.llm import decontaminate as d


def canon(text):
    """[(kind, value)] of a text, token by token."""
    out, end = [], None
    for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or ""):
        tok, between = m[0], (text[end : m.start()] if end is not None else None)
        opens = between is None or re.search(r"[\n.!?]", between)
        capital = "A" <= tok[0] <= "Z" or "À" <= tok[0] <= "Þ"
        low = re.sub("[A-Z]", lambda x: x[0].lower(), tok)
        last = out[-1] if out else None
        if "0" <= tok[0] <= "9":
            kind = "n"
        elif last and last[0] == "n" and low in d.UNITS:
            kind = "u"
        elif capital and not opens:
            kind = "x"
        else:
            kind = "w"
        joined = last and kind == last[0] and ((kind == "n" and between in [".", ",", ":"]) or (kind == "x" and between == " "))
        if joined:
            out[-1] = (kind, last[1] + (low,))
        else:
            out.append((kind, (low,)))
        end = m.end()
    return out


def occurrences(spots, windows, key):
    """{place: slots} of every shift."""
    shifts = {}
    for j, seen in windows.items():
        for i, window in spots.items():
            if key(window) == key(seen):
                shifts.setdefault(j - i, {})[i] = [(a, b) for a, b in zip(window, seen) if a[0] != "w"]
    return shifts.values()


def agreeing(rows):
    values = {}
    for slots in rows.values():
        for a, b in slots:
            values.setdefault(a, Counter())[b] += 1
    # Of values that are equally common either may stand; the tests have none.
    stands = {a: c.most_common(1)[0][0] for a, c in values.items()}
    return {i: slots for i, slots in rows.items() if all(stands[a] == b for a, b in slots)}


def longest(places):
    return max((sum(1 for _ in g) for _, g in itertools.groupby(enumerate(sorted(places)), lambda x: x[1] - x[0])), default=0)


def brute(docs, items):
    leaks = {}
    folded = lambda text: [("w", t) for t in re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())]
    for (item_id, body), (doc_id, text) in itertools.product(items, docs):
        for plain in (False, True):
            c, t = (folded(body), folded(text)) if plain else (canon(body), canon(text))
            if not c or (not plain and len(c) < d.LEAST_TOKENS) or (plain and len(c) < d.LEAST_PLAIN and len(t) != len(c)):
                continue
            w = min(len(c), d.WINDOW)
            key = lambda seq: tuple(v if k == "w" else k for k, v in seq)
            cut = lambda x: {i: x[i : i + w] for i in range(len(x) - w + 1) if plain or 2 * sum(k == "w" for k, _ in x[i : i + w]) >= w}
            spots = cut(c)
            good = [agreeing(rows) for rows in occurrences(spots, cut(t), key)]
            n = len(set().union(*good)) if good else 0
            if spots and (n >= d.SHARE_LEAST * len(spots) or (plain and max(map(longest, good), default=0) >= d.RUN_LEAST)):
                same = n == len(spots) if plain else all(a == b for rows in good for slots in rows.values() for a, b in slots)
                leaks[doc_id, item_id] = (len(spots), n, same)
                break
    return leaks


def run(spark, docs, items):
    a = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id): (r.n_windows, r.n_found, r.verbatim) for r in d.find_leaks(a, b).collect()}


ITEMS = [
    (1, "A farmer named John Smith has 12 apples and sells 5 apples to Mary for 3.50 dollars each. How many apples does John Smith have left, if 12 is right?"),
    (2, "What is the boiling point of water in degrees?"), (3, "too short"), (4, None), (None, "A null item that has many words but no id at all"),
    (5, "six words make this item whole"),
]
SAME = "Intro.\n" + ITEMS[0][1] + " Outro text."
OTHER = "A farmer named Peter has 40 apples and sells 7 apples to Anna Bell for 2 dollars each. How many apples does Peter have left, if 40 is right?"
BROKEN = OTHER.replace("if 40", "if 41")


def test_reparameterised_and_inconsistent(spark):
    docs = [
        (10, SAME), (11, OTHER), (12, BROKEN), (13, "x " * 50 + OTHER + "\n" + SAME), (14, "A farmer has apples and sells them."), (15, None), (16, ""),
        (17, "He asked what is the boiling point of water in degrees today"), (18, "Here six words make this item whole, yes"), (18, "Here six words make this item whole, yes"),
        (None, SAME), (19, "W " * 30_000 + SAME), (20, "THE WORDS ARE ALL IN CAPITALS " * 30),
    ]
    got = run(spark, docs, ITEMS)
    assert got == brute([r for r in docs if r[0] is not None], [r for r in ITEMS if r[0] is not None])
    assert got[10, 1][2] and not got[11, 1][2] and (13, 1) in got and (17, 2) in got and (18, 5) in got and (19, 1) in got
    assert 0 < got[12, 1][1] < got[11, 1][1] and not any(k[0] in (14, 20) for k in got)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    assert d.find_leaks(docs, items).count() == 1
    assert d.find_leaks(docs.where("false"), items).count() == 0
    assert d.find_leaks(docs, items.where("false")).count() == 0
    assert d.drop_leaks(docs, items).count() == 0 and d.drop_leaks(docs, items.where("false")).columns == docs.columns


def test_documents(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    plain = lambda s: " ".join(s.lower().split())
    got = run(spark, docs, items)
    exact = {(i, j) for i, t in docs for j, b in items if plain(b) in plain(t)}
    assert exact <= set(got) and len(set(got) - exact) <= 2, set(got) ^ exact


def test_exact_copies_of_every_kind(spark):
    items = [
        (1, "12 + 30 = 42, 7 + 8 = 15, 9 + 1 = 10, 2 + 2 = 4"), (2, "WHO WROTE THE BOOK ABOUT THE GREAT WHITE WHALE OF NANTUCKET"),
        (3, "Did Anna Bell meet Carl Dorn in Oslo or did Erik Falk see Gina Holm in Rome"), (4, "name the river here please"),
    ]
    docs = [(i, f"Some text: {body} and more.") for i, body in items]
    docs += [(10 + i, f"Some text: {body.lower()} and more.") for i, body in items]
    docs += [(20 + i, f"Some text: {body.upper()} and more.") for i, body in items]
    docs += [(31, "Name the lake here please"), (32, "pi is squared"), (33, "12 + 31 = 43")]
    got = run(spark, docs, items)
    assert set(got) == {(k + i, i) for i, _ in items for k in (0, 10, 20)}


def test_short_items_runs_and_equal_values(spark):
    long = " ".join(f"word{i}" for i in range(59))
    items = [(1, "Yes"), (2, "pi squared"), (3, long), (4, ITEMS[0][1])]
    part = " ".join(long.split()[7:32])
    same_value = ITEMS[0][1].replace("12", "7").replace("5 apples", "7 apples")
    docs = [(1, "I said yes to a plan, pi squared"), (2, "Yes!"), (3, "PI SQUARED"), (4, f"Before. {part} after it."),
            (5, " ".join(long.split()[7:25])), (6, same_value), (7, "pi squared " * 3)]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert set(got) == {(2, 1), (3, 2), (4, 3), (6, 4)} and got[4, 3] == (52, 18, False) and not got[6, 4][2] and got[2, 1][2]


def test_other_columns_pass_whatever_their_names(spark):
    docs = spark.createDataFrame([(1, ITEMS[0][1], 5, 6), (2, "clean", 7, 8)], "doc_id long, text string, __leak int, row int")
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    assert [tuple(r) for r in d.drop_leaks(docs, items).collect()] == [(2, "clean", 7, 8)]
