"""Main text of web pages: block parsing and differencing against pages with the nearest URLs.

Every page is cut into lines, its blocks of text, menus and other boilerplate included; scripts, styles and titles are none.
Pages are paired by URL path within their host: the lines of every page are aligned with those of the nearest pages
before and after it in path order that differ from it, by longest common subsequence, and shared lines are deleted.
A neighbour that holds the whole page is no evidence; one that shares nearly the whole page may be a copy of it, and
only lines that the other neighbour shares too are deleted on its word.

Then the markup checks every line. A deleted line of the main part (article, main) is restored. A line that is left is
removed if it stands in a menu, header, footer, sidebar, form, notice, advert or comment, or outside the main part of a
page that names one. The main part is never dropped with an element around it; inside it only exact words of class,
role and id mark boilerplate, elsewhere also the parts of hyphenated ones.

Line hashes and lengths travel through the order, which is dealt by range, so a host, or a group of copies, may hold any
share of the pages; the lines that the markup lets through travel once, to meet what is decided of them.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.ordering import sliced, with_others
from docstrata.llm.shared import discard, settle

COPY_SHARE = 0.8

#: Elements whose content is no text of the page, ...
SKIPPED = frozenset(
    "script style noscript template head title nav aside form button select option textarea input iframe object "
    "embed dialog menu canvas audio video map datalist footer".split()
)
#: ... those that are boilerplate outside the main part only, ...
OUTER = frozenset(["header", "svg"])
#: ... elements that begin and end a block, ...
BLOCKS = frozenset(
    "address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main ol p pre section summary svg table tbody td text tfoot th thead tr ul".split()
)
#: ... elements without content, ...
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: ... words of class, id and role that mark boilerplate.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disqus footer form gdpr login menu modal nav navbar navigation newsletter notice notices "
    "pagination popup promo promoted related search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription tracking widget alert".split()
)
#: Of these, words that also name boxes of the text itself, ...
BOXES = frozenset("alert form notice notices search tracking".split())
#: ... and elements whose id is a place in the text.
PLACES = frozenset("h1 h2 h3 h4 h5 h6 section".split())
OUTER_MARKED = frozenset(["header", "masthead", "topbar"])
MAIN_TAGS = frozenset(["article", "main"])

_RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Za-z0-9]+")
#: An opening tag of the first kind ends the open element of that kind, unless one of the others is between.
_ENDS = {
    "p": (), "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
}


def _words(value: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(value)}


#: How an element is dropped: by part of a hyphenated word, by a word or tag that may stand around the main part, wholly.
WEAK, STRONG, WHOLLY = 1, 2, 3
#: Where a block stands: in the main part, in an article in an element dropped as STRONG, or in boilerplate by its markup.
MAIN, SET_ASIDE, MARKUP = 1, 2, 3


def _boilerplate(tag: str, attrs: str, in_main: bool) -> tuple[int, bool, bool]:
    """(how it is boilerplate or 0, opens a main part, is the page's only main part)."""
    if tag in SKIPPED or (tag in OUTER and not in_main):
        return STRONG if tag in ("form", "header") and not in_main else WHOLLY, False, False
    main, only, dropped = tag in MAIN_TAGS, tag == "main", 0
    if attrs and not attrs.isspace():
        for name, *values in _ATTRIBUTE.findall(attrs):
            name, value = name.lower(), next(filter(None, values), "")
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                return WHOLLY, False, False
            if name in ("class", "id", "role") and tag not in ("html", "body"):
                exact = set(value.lower().split())
                if in_main:
                    if exact & (MARKED - BOXES) and not (name == "id" and tag in PLACES):
                        return WHOLLY, False, False
                else:
                    marked = MARKED | OUTER_MARKED
                    dropped = max(dropped, STRONG if exact & marked else WEAK if _words(value) & marked else 0)
                main |= name == "role" and exact in ({"main"}, {"article"})
                only |= name == "role" and exact == {"main"}
            main |= name == "itemprop" and value.lower() == "articlebody"
    return dropped, main, only


def marked_lines(html: str) -> list[tuple[str, int]]:
    """(text, where it stands: MAIN, MARKUP or 0) of all blocks of a page, in page order."""
    lines: list[tuple[str, int]] = []
    part: list[str] = []
    stack: list[tuple[str, int, int]] = []  # tag, how it is dropped, where it stands
    dropped = where = 0

    def close() -> None:
        if part:
            text = " ".join("".join(part).split())
            part.clear()
            if text:
                lines.append((text, MARKUP if dropped else where))

    def pop(depth: int) -> None:
        nonlocal dropped, where
        outer = stack[depth - 1][1:] if depth else (0, 0)
        if outer != (dropped, where):
            close()
        del stack[depth:]
        dropped, where = outer

    at, n = 0, len(html)
    while at < n:
        found = _MARKUP.search(html, at)
        # A `<` that opens no markup is text.
        part.append(unescape(html[at : found.start() if found else n]))
        if not found:
            break
        at = found.end()
        if found["cdata"] is not None:
            part.append(found["cdata"])
        if not found["tag"]:
            continue
        tag = found["tag"].lower()
        if found["end"]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is not None:
                if tag in BLOCKS or tag in SKIPPED or dropped:
                    close()
                pop(depth)
            continue
        if tag in BLOCKS or tag in SKIPPED:
            close()
        if tag in BLOCKS or tag in SKIPPED:
            for ended, between in _ENDS.items():
                if ended == "p" and tag not in ("br", "hr") or ended == tag or {ended, tag} == {"dt", "dd"} or {ended, tag} == {"td", "th"}:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in between or (ended == "p" and stack[k][0] in ("article", "main", "section", "div", "td", "li", "blockquote")):
                            break
                        if stack[k][0] == ended:
                            pop(k)
                            break
        if tag in VOID or found["attrs"].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in _RAW and tag != "noscript":
            close_tag = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = close_tag.end() if close_tag else n
            continue
        if dropped == WHOLLY or (dropped and where):
            stack.append((tag, dropped, where))
            continue
        how, opens, only = _boilerplate(tag, found["attrs"], bool(where))
        if how or opens:
            close()
        if dropped:
            if how == WHOLLY:
                dropped = WHOLLY
            elif only or (opens and max(dropped, how) == WEAK):
                dropped, where = 0, MAIN
            elif opens:
                dropped, where = 0, SET_ASIDE
            else:
                dropped = max(dropped, how)
        elif only and how < WHOLLY:
            where = where or MAIN
        elif opens and how == WEAK:
            where = MAIN
        elif opens and how == STRONG and not where:
            where = SET_ASIDE
        else:
            dropped = how
            where = where or (MAIN if opens and not how else 0)
        stack.append((tag, dropped, where))
    close()
    # An article in an element dropped as STRONG is the main part of a page that has none and little else.
    held = {k: sum(len(text) for text, at in lines if at == k) for k in (0, MAIN, SET_ASIDE)}
    aside = MAIN if not held[MAIN] and held[SET_ASIDE] > held[0] else MARKUP
    return [(text, aside if at == SET_ASIDE else at) for text, at in lines]


def blocks(html: str) -> tuple[list[str], list[str]]:
    """(blocks of the main part, all blocks) of a page, boilerplate by markup left out, in page order."""
    lines = marked_lines(html)
    return [text for text, at in lines if at == MAIN], [text for text, at in lines if at != MARKUP]


def shared_lines(mine: list[int], theirs: list[int]) -> set[int]:
    """Places of `mine` in a longest common subsequence with `theirs`."""
    head = 0
    while head < min(len(mine), len(theirs)) and mine[head] == theirs[head]:
        head += 1
    tail = 0
    while tail < min(len(mine), len(theirs)) - head and mine[-1 - tail] == theirs[-1 - tail]:
        tail += 1
    middle = range(head, len(mine) - tail)
    held = {mine[i] for i in middle}
    places: dict[int, int] = {}
    width = 0
    for line in theirs[head : len(theirs) - tail]:
        if line in held:
            places[line] = places.get(line, 0) | 1 << width
            width += 1
    kept = [i for i in middle if mine[i] in places]
    # Bit j of a row is 0 where line j of theirs makes the subsequence with the lines of mine so far longer by one.
    rows = [(1 << width) - 1]
    for i in kept:
        met = rows[-1] & places[mine[i]]
        rows.append(((rows[-1] + met) | (rows[-1] - met)) & rows[0])
    found = {*range(head), *range(len(mine) - tail, len(mine))}
    i, j = len(kept), width
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.add(kept[i])
    return found


def deleted_lines(sizes: list[int], hashes: list[int], neighbours: list[list[int] | None], copy_share: float) -> set[int]:
    """Places of the lines that neighbours share. `sizes` are their lengths, 0 for what the markup has as boilerplate."""
    gone: set[int] = set()
    likely: list[set[int]] = []
    for theirs in neighbours:
        if theirs:
            shared = shared_lines(hashes, theirs)
            of_text = sum(sizes[i] for i in shared)
            if of_text == sum(sizes) > 0:
                continue  # nothing of the page would be left
            likely.append(shared)
            if of_text <= copy_share * sum(sizes):
                gone |= shared
    return gone | set.intersection(*likely) if len(likely) == 2 else gone


def decided(places: list[int], gone: set[int]) -> tuple[list[int], int, int, int, int]:
    """Of a page of which the differencing deletes the lines `gone`, after the check by markup: which of its candidates
    stay deleted, and the numbers of its lines, of those deleted, and of these restored and of others removed."""
    held = [i for i, at in enumerate(places) if at == _candidate(places)]
    lost = [] if MAIN in places else [k for k, i in enumerate(held) if i in gone]
    restored = sum(i in gone for i in held) - len(lost)
    return lost, len(places), len(gone), restored, len(places) - len(held) - (len(gone) - len(lost) - restored)


def _candidate(places: list[int]) -> int:
    """Where the lines stand that the markup lets through: in the main part if the page has one."""
    return MAIN if MAIN in places else 0


def _hashes(pages: list[list[tuple[str, int]]]) -> pa.Array:
    return pa.array([[xxhash.xxh3_64_intdigest(text) - (1 << 63) for text, _ in page] for page in pages], pa.list_(pa.int64()))


def page_lines(html: pa.Array) -> pa.Array:
    """Hashes of a page's lines, where they stand, and their lengths, 0 for what the markup has as boilerplate."""
    pages = [marked_lines(h.as_py() or "") for h in html]
    places = pa.array([[at for _, at in page] for page in pages], pa.list_(pa.int8()))
    sizes = pa.array([[0 if at == MARKUP else len(text) for text, at in page] for page in pages], pa.list_(pa.int32()))
    return pa.StructArray.from_arrays([_hashes(pages), places, sizes], names=["hashes", "places", "sizes"])


def page_candidates(html: pa.Array) -> pa.Array:
    """Hashes of a page's lines, and the texts of those that the markup lets through."""
    pages = [marked_lines(h.as_py() or "") for h in html]
    wanted = [_candidate([at for _, at in page]) for page in pages]
    lines = [[text for text, at in page if at == k] for page, k in zip(pages, wanted, strict=True)]
    return pa.StructArray.from_arrays([_hashes(pages), pa.array(lines, pa.list_(pa.string()))], names=["hashes", "lines"])


def _differenced(copy_share: float):
    @F.arrow_udf("struct<lost: array<int>, n_lines: bigint, n_shared: bigint, n_restored: bigint, n_removed: bigint>")
    def differenced(hashes: pa.Array, places: pa.Array, sizes: pa.Array, before: pa.Array, after: pa.Array) -> pa.Array:
        pages = [
            decided(at, deleted_lines(lengths, own, near, copy_share))
            for own, at, lengths, *near in zip(*[c.to_pylist() for c in (hashes, places, sizes, before, after)], strict=True)
        ]
        lost, *counts = zip(*pages, strict=True) if pages else [()] * 5
        arrays = [pa.array(lost, pa.list_(pa.int32())), *[pa.array(n, pa.int64()) for n in counts]]
        return pa.StructArray.from_arrays(arrays, names=["lost", "n_lines", "n_shared", "n_restored", "n_removed"])

    return differenced


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", copy_share: float = COPY_SHARE
) -> DataFrame:
    """page_id, url, text of every row of `pages`, and how it came about: n_lines of the page, n_shared that the
    differencing deleted, n_restored of these and n_removed of the others by the markup.

    Character references are decoded, white space in a block is one space, blocks are joined by one. A null or empty
    page has an empty text. A page without a URL belongs to a host of its own kind and is compared there. Equal paths
    are ordered by id, then by content, so repeated rows are each other's copies; copies have the same neighbours, the
    nearest pages that differ. A page with one neighbour keeps what that one shares if it is over `copy_share` of its
    text. Broken markup is read as far as it goes. Other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    place = [host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")]
    read_as = F.arrow_udf(page_lines, "struct<hashes: array<bigint>, places: array<tinyint>, sizes: array<int>>")
    read = rows.select("page_id", *place, read_as("html").alias("read"))
    light = settle(read.select("page_id", "host", "path", "read.*", F.xxhash64("read.hashes").alias("digest")), "page-lines")
    order = ["host", "path", "page_id", "digest"]
    slices = sliced(light, order, "page-order")
    discard(light)
    near = with_others(slices, order, F.struct("host", "digest"), F.struct("host", "hashes"))
    beside = [F.when(F.col(f"{c}.host") == F.col("host"), F.col(f"{c}.hashes")) for c in ("__before", "__after")]
    judged = near.select(*order, _differenced(copy_share)("hashes", "places", "sizes", *beside).alias("of"))
    # Repeated rows are judged alike.
    judged = judged.groupBy(*order).agg(F.first("of").alias("of")).withColumnRenamed("page_id", "__id")
    texts_as = F.arrow_udf(page_candidates, "struct<hashes: array<bigint>, lines: array<string>>")
    texts = rows.select("page_id", "url", *place, texts_as("html").alias("read"))
    texts = texts.select("page_id", "url", "host", "path", "read.lines", F.xxhash64("read.hashes").alias("digest"))
    same = [F.col(f"t.{c}") == F.col(f"j.{c}") for c in ("host", "path", "digest")]
    both = texts.alias("t").join(judged.alias("j"), [*same, F.col("page_id").eqNullSafe(F.col("__id"))], "left")
    left = F.filter("lines", lambda _, k: ~F.array_contains("of.lost", k))
    return both.select("page_id", "url", F.array_join(left, " ").alias("text"), "of.n_lines", "of.n_shared", "of.n_restored", "of.n_removed")
