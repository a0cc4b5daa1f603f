import html as H
import random
import re

import pyarrow.parquet as pq
import pytest

from docstrata.llm import page_text, queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="ad">
<header><h1>Site</h1></header><nav><ul><li><a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<!-- <p>hidden</p> --><article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>&nbsp; &lt;tag&gt;
two<br>three<p>four<div class="ad box">Buy</div><ul><li>a<li>b</ul><table><tr><td>x<td>y</table><aside>side</aside>
<form><input><label>name</label></form><div id="comments"><p>reader says</p></div><p hidden>h</p>1 < 2 &#233;</article>
<div class="sidebar">s</div><footer>&copy; f</footer></body></html>"""


def test_markup():
    main, every = page_text.blocks(PAGE)
    assert main == ["Head & line", "One bold <tag> two", "three", "four", "a", "b", "x", "y", "1 < 2 é"] == every


@pytest.mark.parametrize("html", ["", "plain text", "<", "a < b > c", "<p", "<p class='x", "<!-- open", "<script>never", "</p></div>", "<p/><br/>x", "&amp;&bogus;&#0;&#xD800;"])
def test_broken_markup(html):
    main, every = page_text.blocks(html)
    assert main == [] and all(x == " ".join(x.split()) and x for x in every)


def test_unclosed_and_nested():
    assert page_text.blocks("<main><p class=ad>no<p>yes<nav>no<div>no</div></nav>more</main>tail")[0] == ["yes", "more"]
    assert page_text.blocks("<div role=main>in<div class='share'>x</div></div>out") == (["in"], ["in", "out"])
    assert page_text.blocks("<div>" * 5_000 + "deep" + "</div>" * 5_000)[1] == ["deep"]


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "with-ads box", "search-page", "sidebar", "form"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_marked_wrapper_keeps_the_main_part(name, tag):
    html = f"<p>Site</p><div class='{name}'><i>menu</i><{tag}><p>The text of the page</p></{tag}><p>more</p></div><p>End</p>"
    assert page_text.blocks(html)[0] == ["The text of the page"]
    assert page_text.blocks(f"<p>Site</p><{tag} class='{name}'>The text</{tag}>")[0] == ["The text"]
    assert page_text.blocks(f"<form id=aspnetForm><{tag}>The text</{tag}></form>")[0] == ["The text"]


def test_marked_words_in_the_main_part():
    kept = """<section id="related-work">A</section><section id="search">B</section><div class="alert alert-info">C</div>
    <h2 id="share">D</h2><h3 id="form-of-government">E</h3><div class="social-history">F</div><p><math><mi>x</mi><mo>=</mo><mn>1</mn></math></p>
    <svg><text>G</text><text>H</text></svg>"""
    gone = "<div class='share box'>x</div><div id=comments>x</div><div class=related>x</div><nav>x</nav><div class=ad><article>x</article></div>"
    assert page_text.blocks(f"<article>{kept}{gone}</article>")[0] == ["A", "B", "C", "D", "E", "F", "x=1", "G", "H"]


def test_articles_in_boilerplate_are_no_main_part():
    assert page_text.blocks("<main>text</main><div class=related><article>other</article></div>")[0] == ["text"]
    assert page_text.blocks("<p>a long text of a page</p><div class=related><article>other</article></div>") == ([], ["a long text of a page"])


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in range(2))
        found = sorted(page_text.shared_lines(a, b))
        assert len(found) == lcs(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in found)  # a subsequence of b


def page(i, lines):
    return (i, f"http://h.example.com/a/{i:05}", "<body>" + "".join(f"<p>{H.escape(x)}</p>" for x in lines) + "</body>")


def test_differencing(spark):
    """Pages without a named main part lose what the nearest pages share, over many slices of one host."""
    rows = [page(i, ["Site name", "Menu", f"Text {i} has words of its own, which no other page has", f"More of {i}", "Imprint"]) for i in range(400)]
    rows += [(1000, "http://other.example.com/a/00000", "<p>Site name</p><p>alone</p>"), (1001, None, "<p>x</p>"), (1002, "http://z.example.com/", None), (1003, "", ""), (1003, "", "")]
    rows += [page(2000 + k, ["Copy one", "of a page", "that is there twice"]) for k in range(2)]
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        frame = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string").repartition(5)
        got = {}
        for r in page_text.extract_text(frame).collect():
            got.setdefault(r.page_id, []).append(r.text)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert all(got[i] == [f"Text {i} has words of its own, which no other page has More of {i}"] for i in range(400))
    assert got[1000] == ["Site name alone"] and got[1001] == ["x"] and got[1002] == [""] and got[1003] == ["", ""]
    assert got[2000] == got[2001] == ["Copy one of a page that is there twice"]
    assert page_text.extract_text(frame.where("false")).count() == 0


def test_pages(spark, sf):
    truth = {}
    for r in pq.read_table(f"{sf}/pages.parquet").to_pylist():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        truth[r["page_id"]] = " ".join(H.unescape(re.sub(r"</?(?:p|br|b|h1)>", " ", body)).split())
    rows = queries.op8_page_text(spark, sf).collect()
    assert {r.page_id: r.text for r in rows} == truth and all(r.n_chars == len(r.text) for r in rows)


def plain(rows, copy_share=0.8):
    """page_id -> (text, n_lines, n_shared): the pages of a host in order of path, each against the nearest that differ."""
    hosts, found = {}, {}
    for i, url, html in rows:
        host, path = re.match(r"https?://([^/?#]*)([^?#]*)", url).groups()
        lines = page_text.marked_lines(html)
        hosts.setdefault(host.lower(), []).append((path, i, lines, [text for text, _ in lines]))
    for pages in hosts.values():
        pages.sort(key=lambda p: p[:2])
        for k, (_, i, lines, texts) in enumerate(pages):
            near = [next((p[3] for p in side if p[3] != texts), None) for side in (pages[:k][::-1], pages[k + 1 :])]
            whole = sum(len(t) for t, at in lines if at != page_text.MARKUP)
            gone, seen = set(), []
            for theirs in filter(None, near):
                shared = page_text.shared_lines(texts, theirs)
                size = sum(len(texts[j]) for j in shared if lines[j][1] != page_text.MARKUP)
                if not size or size < whole:
                    seen.append(shared)
                    gone |= shared if size <= copy_share * whole else set()
            gone |= seen[0] & seen[1] if len(seen) == 2 else set()
            main = any(at == page_text.MAIN for _, at in lines)
            kept = [t for j, (t, at) in enumerate(lines) if at == page_text.MAIN or (not main and not at and j not in gone)]
            found[i] = (" ".join(kept), len(lines), len(gone))
    return found


def both(spark, rows, partitions=7):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
        got = page_text.extract_text(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(got) == len(rows)
    return {r.page_id: r for r in got}


def test_every_page_is_differenced(spark):
    """Shared lines are deleted on pages with an article too; the markup restores the article's and removes single ones."""
    rows = [
        (i, f"http://h.example.com/{i}", f"<nav>Menu</nav><p>Site</p><p>Box {i}</p><article><p>Text {i}</p><p>Same words</p></article><footer>Own {i}</footer>")
        for i in range(8)
    ]
    for i, r in both(spark, rows).items():
        assert r.text == f"Text {i} Same words"
        assert (r.n_lines, r.n_shared, r.n_restored, r.n_removed) == (6, 3, 1, 2)


def test_much_boilerplate_and_copies(spark):
    menu = [f"Menu entry {k} of the site" for k in range(20)]
    rows = [page(i, [*menu, f"Words of {i}"]) for i in range(6)]
    # A text with many copies between its neighbours, over several slices.
    copied = [*menu, "The same text", "twice"]
    rows += [page(10 + i, copied) for i in range(300)] + [page(900, [*menu, "Last"])]
    # Nearly the same text twice, and two pages of which one holds the other.
    rows += [(2000 + k, f"http://n.example.com/{k}", f"<p>A long text of a page</p><p>with more</p><p>{k}</p>") for k in range(2)]
    rows += [(3000 + k, f"http://p.example.com/{k}", "<p>A part</p>" + "<p>and all the rest of it</p>" * k) for k in range(2)]
    got = both(spark, rows)
    assert all(got[i].text == f"Words of {i}" for i in range(1, 6))
    assert all(got[10 + i].text == "The same text twice" for i in range(300))
    assert [got[2000 + k].text for k in range(2)] == [f"A long text of a page with more {k}" for k in range(2)]
    assert [got[3000 + k].text for k in range(2)] == ["A part", "and all the rest of it"]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_version(spark, seed):
    rng = random.Random(seed)
    words = [f"<p>line {k} {'x' * k}</p>" for k in range(7)] + ["<nav>menu</nav>", "<article>a<p>b</article>", "<footer>f</footer>"]
    pool = ["".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(40)]
    rows = [(i, f"http://h{rng.randrange(3)}.example.com/{rng.randrange(60)}", rng.choice(pool[: rng.choice([2, 40])])) for i in range(400)]
    got = both(spark, rows, 9)
    assert {i: (r.text, r.n_lines, r.n_shared) for i, r in got.items()} == plain(rows)


def test_given_pages_against_a_plain_version(spark, sf):
    rows = [(r["page_id"], r["url"], r["html"]) for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()]
    got = queries.op8_page_text(spark, sf).collect()
    assert {r.page_id: (r.text, r.n_lines, r.n_shared) for r in got} == plain(rows)
    assert any(r.n_shared for r in got)


def test_longest_common_subsequence_of_long_pages():
    rng = random.Random(3)
    a, b = ([rng.randrange(3) for _ in range(4_000)] for _ in range(2))
    found = sorted(page_text.shared_lines(a, b))
    rest = iter(b)
    assert len(found) > 2_500 and all(a[i] in rest for i in found)
