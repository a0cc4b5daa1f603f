"""Host-level quality rules.

Every document is measured by a few rules on its own text. The failures of the base rule are counted by host (here the
`source` of a document), the rates are shrunk with a beta prior whose two parameters are estimated from the hosts
themselves (method of moments), and the verdict on the host is joined back to its documents.

Only DataFrame functions; one shuffle of a row per host and task, besides the join of the hosts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.shared import packed, settle, unpacked

WORDS_LEAST = 10
REPEAT_PERCENT_MOST = 20
#: A host is refused when the shrunk share of its documents that fail is above this.
HOST_RATE_MOST = 0.5
WINDOW = 5

_SPLIT = "[\\x20\\x09-\\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPLIT, -1), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once however often `body` names it, inner functions included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _twice(found: Column) -> Column:
    """Places `i`, ascending, of the entries (w, i) of a sorted array whose `w` stands there at least twice."""
    same = lambda j, k: F.get(found, j)["w"] == F.get(found, k)["w"]
    twice = F.filter(
        F.sequence(F.lit(0), F.size(found) - 1),
        lambda k: F.coalesce((k > 0) & same(k - 1, k), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)),
    )
    return F.sort_array(F.transform(twice, lambda k: F.get(found, k)["i"]))


def repeat_words(words: Column) -> Column:
    """Number of words that lie in a 5-word window found at least twice in the array, all its places included.
    `words` is a variable of `let`."""
    n = F.size(words)
    places = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))

    def windows(hashes: Column) -> Column:
        return F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + (j - 1)) for j in range(WINDOW)]))

    # Equal windows have equal hashes: only those whose hash is there twice are compared word by word. Words hold no
    # space, so joining by one is free of collisions. Equal windows stand next to each other once sorted.
    def by_hash(quick: Column) -> Column:
        return F.sort_array(F.transform(quick, lambda h, k: F.struct(h.alias("w"), (k + 1).alias("i"))))

    def by_words(at: Column) -> Column:
        return F.sort_array(
            F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i, WINDOW)).alias("w"), i.alias("i")))
        )

    def covered(starts: Column) -> Column:
        # Each start covers WINDOW words, less what the start before it covers already.
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda s, i: F.struct((s["n"] + F.least(i - s["last"], F.lit(WINDOW))).alias("n"), i.alias("last")),
            lambda s: s["n"],
        )

    def compared(found: Column) -> Column:
        return let(_twice(found), lambda at: let(by_words(at), lambda same: covered(_twice(same))))

    def counted(quick: Column) -> Column:
        # Where all hashes differ there is nothing to look for.
        return F.when(F.size(F.array_distinct(quick)) == F.size(quick), F.lit(0)).otherwise(let(by_hash(quick), compared))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: let(windows(hashes), counted))


def _word_measures(words: Column) -> tuple[Column, Column]:
    """What the base rule asks for."""
    return F.size(words).cast("long").alias("n_words"), repeat_words(words).cast("long").alias("n_repeat_words")


def rules(text: Column) -> Column:
    """Struct of the measures of one text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda s: F.translate(s, _SPACES, "") != "")
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def measures(words: Column) -> Column:
        n_words, n_repeat_words = _word_measures(words)
        return F.struct(
            n_words,
            F.length(F.translate(whole, _SPACES, "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
            dup_lines.cast("long").alias("n_dup_lines"),
            n_repeat_words,
        )

    return let(words_of(text), measures)


def base_rules(text: Column) -> Column:
    """Struct of those measures of one text that the base rule asks for."""
    return let(words_of(text), lambda words: F.struct(*_word_measures(words)))


def fails(measures: str) -> Column:
    """The base rule, of a struct made by `rules` or `base_rules`."""
    n, repeated = F.col(f"{measures}.n_words"), F.col(f"{measures}.n_repeat_words")
    return (n < WORDS_LEAST) | (100 * repeated > REPEAT_PERCENT_MOST * n)


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, host, the measures and base_failed of every row."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), rules(F.col(text_col)).alias("m")
    )
    return rows.select("doc_id", "host", "m.*", fails("m").alias("base_failed"))


def host_verdicts(scored: DataFrame, rate_most: float = HOST_RATE_MOST) -> DataFrame:
    """host, host_docs, host_failed, host_rate (shrunk) and host_kept of the rows (host, base_failed).

    With the hosts' rates p of mean m and variance v, the prior is beta(m s, (1 - m) s) with s = m (1 - m) / v - 1, held
    between 1 and 10^6 (v = 0: 10^6); the shrunk rate is (failed + m s) / (docs + s). Rows without a host are no host.
    """
    hosts = scored.where("host is not null").groupBy("host").agg(
        F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")
    )
    moments = hosts.select(F.avg(F.expr("host_failed / host_docs")).alias("m"), F.var_pop(F.expr("host_failed / host_docs")).alias("v"))
    raw = F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(1e6))
    prior = moments.select(F.struct(F.col("m"), F.least(F.greatest(raw, F.lit(1.0)), F.lit(1e6)).alias("s"))).scalar()
    shrunk = (F.col("host_failed") + F.col("p.m") * F.col("p.s")) / (F.col("host_docs") + F.col("p.s"))
    return (
        hosts.withColumn("p", prior).withColumn("host_rate", shrunk)
        .select("host", "host_docs", "host_failed", "host_rate", (F.col("host_rate") <= rate_most).alias("host_kept"))
    )


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    rate_most: float = HOST_RATE_MOST,
) -> DataFrame:
    """One row for every row of `docs`: its id, the measures, base_failed, kept, and the host with its figures.

    kept: neither the document nor its host fails. A null text has no words and so fails; a document without a host is
    judged alone. Rows that repeat an id are measured each. An empty table gives an empty result. Other columns are
    ignored.
    """
    scored = settle(measured(docs, id_col, text_col, host_col), "quality")
    # A written table has a known size: a short list of hosts is planned as a broadcast, a long one as a join that Spark
    # can split at a hot host.
    verdicts = settle(host_verdicts(scored.select("host", "base_failed"), rate_most), "hosts")
    return scored.join(verdicts, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"),
        "host", "host_docs", "host_failed", F.round("host_rate", 6).alias("host_rate"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", rate_most: float = HOST_RATE_MOST) -> DataFrame:
    """The rows of `docs`, all columns, whatever their names, that are kept. The base rule is applied once, where the rows are
    read; what it says is written with the rows."""
    measured_ = packed(docs).withColumn("m", base_rules(F.col(f"row.`{text_col}`")))
    rows = settle(measured_.select("row", F.col(f"row.`{host_col}`").cast("string").alias("host"), fails("m").alias("base_failed")), "judged")
    bad = settle(host_verdicts(rows.select("host", "base_failed"), rate_most).where("not host_kept").select("host"), "bad-hosts")
    good = rows.where(~F.col("base_failed")).join(bad, "host", "left_anti")
    return good.select(unpacked(good, docs.columns))


#: DuckDB SQL of `judged` over documents.
SQL = r"""
with w as (
  select doc_id, source as host, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) as lines
  from documents),
g as (
  select *, list_transform(range(1, len(words) - 3), lambda i: list_aggregate(words[i:i+4], 'string_agg', ' ')) as grams from w),
m as (
  select doc_id, host, len(words) as n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, row_number() over () as rid, grams from g),
u as (select rid, unnest(grams) as gram, generate_subscripts(grams, 1) as i from m),
d as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) as n from u) where n > 1),
c as (select rid, count(distinct i + k) as n from d, range(5) as r(k) group by rid),
b as (
  select m.*, coalesce(c.n, 0) as n_repeat_words,
    n_words < 10 or 100 * coalesce(c.n, 0) > 20 * n_words as base_failed from m left join c using (rid)),
h as (select host, count(*) as host_docs, count(*) filter (where base_failed) as host_failed from b where host is not null group by host),
p as (select avg(host_failed / host_docs) as m, var_pop(host_failed / host_docs) as v from h),
q as (select m, least(greatest(case when v > 0 then m * (1 - m) / v - 1 else 1e6 end, 1.0), 1e6) as s from p),
r as (select host, host_docs, host_failed, (host_failed + m * s) / (host_docs + s) as rate from h, q)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and coalesce(rate <= 0.5, true) as kept, b.host as host, host_docs, host_failed::bigint as host_failed,
  round(rate, 6) as host_rate
from b left join r on b.host = r.host
"""
