"""Text expressions: whitespace, markup removal, snippets, highlights, context windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space (tab to carriage return, space, no-break space,
# ogham space, en quad to hair space, line and paragraph separator, narrow no-break space, medium
# mathematical space, ideographic space, byte-order mark).
WHITESPACE = (
    "\t\n\u000b\u000c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS = "[" + WHITESPACE + "]"

# The code points that separate words in fixed-window chunking (as above without the byte-order
# mark, with the four information separators and next line).
WORD_SEPARATORS = WHITESPACE.replace("\ufeff", "") + "\u001c\u001d\u001e\u001f\u0085"

# Markdown removal rules, applied in this order.
MARKDOWN_RULES = [
    (rf"(?m)^#{{1,6}}{WS}+", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"[*_]{1,2}([^*_]+)[*_]{1,2}", "$1"),
    (r"`{1,3}[^`]*`{1,3}", ""),
    (rf"(?m)^[-*+]{WS}+", ""),
    (rf"(?m)^[0-9]+\.{WS}+", ""),
    (rf"(?m)^>{WS}+", ""),
]

# Rich-text removal rules, applied in this order.
RTF_RULES = [
    (r"\A\{\\rtf[^}]*\}", ""),
    (r"\{\\[*]?[A-Za-z0-9_]+[^}]*\}", ""),
    (rf"\\[A-Za-z]+[-]?[0-9]*{WS}?", ""),
    (r"\\'", ""),
    (r"[{}]", ""),
]

SENTENCE_BREAK = rf"(?<=[.!?]){WS}+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_whitespace(c: Column | str, whitespace: str = WHITESPACE) -> Column:
    """Every run of white space becomes one space; none at either end.

    Runs that are one plain space already, nearly all of them in prose, are not matched at all; the look-ahead
    turns printable ASCII away before the large class is consulted.
    """
    other = whitespace.replace(" ", "")
    run = f"(?! ?[!-~])(?: [{whitespace}]+|[{other}][{whitespace}]*)"
    return F.trim(F.regexp_replace(_col(c), run, " "))


def trim_whitespace(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), rf"\A{WS}+|{WS}+\z", "")


def is_blank(c: Column | str) -> Column:
    return ~F.coalesce(_col(c), F.lit("")).rlike("[^" + WHITESPACE + "]")


def _apply(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    out = _col(c)
    for pattern, replacement in rules:
        out = F.regexp_replace(out, pattern, replacement)
    return collapse_whitespace(out)


def strip_markdown(c: Column | str) -> Column:
    return _apply(c, MARKDOWN_RULES)


def strip_rtf(c: Column | str) -> Column:
    return _apply(c, RTF_RULES)


def snippet(text: Column | str, query: Column | str, max_len: int = 200) -> Column:
    """Short preview: the whole text when it fits, else a window opening 50 characters before the first
    query word, else the head."""
    t, q = _col(text), _col(query)
    word = F.element_at(F.split(F.lower(q), WS + "+"), 1)
    found = F.position(word, F.lower(t))
    start = F.greatest(found - 51, F.lit(0))
    end = F.least(F.length(t), start + max_len)
    window = F.concat(
        F.when(start > 0, "...").otherwise(""),
        F.substring(t, start + 1, end - start),
        F.when(end < F.length(t), "...").otherwise(""),
    )
    return (
        F.when(F.length(t) <= max_len, t)
        .when(found == 0, F.concat(F.substring(t, 1, max_len), F.lit("...")))
        .otherwise(window)
    )


def highlight(text: Column | str, query: Column | str) -> Column:
    """Struct `(html, match_type)`: query words wrapped in `<mark>` one after the other, ignoring case;
    `keyword` when anything was wrapped, else `semantic`."""
    t = _col(text)
    words = F.filter(F.split(F.lower(_col(query)), WS + "+"), lambda w: w != "")
    html = F.aggregate(
        words,
        t,
        lambda acc, w: F.regexp_replace(
            acc,
            F.concat(F.lit("(?iu)("), F.regexp_replace(w, r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(")")),
            F.lit("<mark>$1</mark>"),
        ),
    )
    return F.struct(
        html.alias("html"),
        F.when(html != t, "keyword").otherwise("semantic").alias("match_type"),
    )


def context_window(text: Column | str, max_chars: int = 400) -> Column:
    """Up to three whole sentences around the middle of a long text; its head when they do not fit."""
    t = _col(text)
    head = F.concat(F.substring(t, 1, max_chars), F.lit("..."))

    def window(sentences: Column) -> Column:
        n = F.size(sentences)
        take = F.least(F.lit(3), n)
        start = F.greatest(F.lit(0), F.floor(n / 2).cast("int") - F.floor(take / 2).cast("int"))
        end = F.least(n, start + take)
        body = F.array_join(F.slice(sentences, start + 1, take), " ")
        framed = F.concat(
            F.when(start > 0, "... ").otherwise(""), body, F.when(end < n, " ...").otherwise("")
        )
        return F.when(F.length(body) > max_chars, head).otherwise(framed)

    # The one-element array binds the split text to a variable, so that it is split once per row.
    split = F.array(F.split(trim_whitespace(t), SENTENCE_BREAK))
    return (
        F.when(F.length(t) <= max_chars, t)
        .when(is_blank(t), head)
        .otherwise(F.element_at(F.transform(split, window), 1))
    )
