"""Checked queries: ingest, scalars, chunking, embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from docstrata.functions import paths, text as tx, vectors as vx
from docstrata.operators import chunking, embedding, lookups, stats
from docstrata.sources import documents, listing as ls
from docstrata.workload import tables as t
from docstrata.workload.registry import query
from docstrata.workload.tables import SQL_WS, oracle

EXCLUDE = ["/src7/", "*.tsv"]
BUNDLES = ["**/*.app/**"]
EXTS = ["pdf", ".docx", "TXT", "md", "tsv", "csv"]
DIM = 64


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SQL_WS}+', ' ', 'g'))"


def _rules(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        own = pattern.replace(tx.WS, SQL_WS).replace("'", "''")
        x = f"regexp_replace({x}, '{own}', '{replacement.replace('$', chr(92))}', 'g')"
    return _collapse(x)


@query(
    "s1_list_corpus",
    oracle(
        """
select path, size_bytes, mtime_ms from listing
where lower(regexp_extract(path, '\\.([^./]+)$', 1)) in ('pdf', 'docx', 'txt', 'md', 'tsv', 'csv')
  and not contains(path, '/src7/') and not regexp_matches(path, '(^|/)[^/]*\\.tsv$')
  and not regexp_matches(path, '\\.app(/|$)')
""",
        "listing",
    ),
)
def list_corpus(spark, sf):
    kept = ls.filter_supported(t.listing(spark, sf), EXTS, BUNDLES, EXCLUDE)
    return kept.select("path", "size_bytes", "mtime_ms")


@query(
    "s1_skipped_bundles",
    oracle(
        "select distinct regexp_extract(path, '^(.*?\\.app)/', 1) as bundle from listing where contains(path, '.app/')",
        "listing",
    ),
)
def skipped_bundles(spark, sf):
    return ls.skipped_bundles(t.listing(spark, sf), BUNDLES)


@query("s2_ingest_text", f"select doc_id, {_collapse('text')} as text from documents")
def ingest_text(spark, sf):
    """Documents as files: some languages in UTF-16 with a byte-order mark, the rest in UTF-8."""
    content = (
        F.when(F.col("lang") == "fr", F.concat(F.lit(b"\xff\xfe"), F.encode("text", "UTF-16LE")))
        .when(F.col("lang") == "es", F.concat(F.lit(b"\xfe\xff"), F.encode("text", "UTF-16BE")))
        .otherwise(F.encode("text", "UTF-8"))
    )
    files = t.documents(spark, sf).select("doc_id", content.alias("content"))
    return documents.ingest_text(files)


@query("s3_clean_markdown", f"select doc_id, {_rules('text', tx.MARKDOWN_RULES)} as text from documents")
def clean_markdown(spark, sf):
    return documents.clean_markdown(t.documents(spark, sf).select("doc_id", "text"))


_RTF_SQL = "'{\\rtf1\\ansi}{\\fonttbl\\f0 Arial;}\\pard ' || replace(text, chr(10), '\\par ' || chr(10)) || '\\''e9}'"


@query("s4_clean_rtf", f"select doc_id, {_rules(_RTF_SQL, tx.RTF_RULES)} as text from documents")
def clean_rtf(spark, sf):
    """Documents dressed as rich text: header, font table, paragraph marks and a character escape."""
    wrapped = F.concat(
        F.lit("{\\rtf1\\ansi}{\\fonttbl\\f0 Arial;}\\pard "),
        F.replace(F.col("text"), F.lit("\n"), F.lit("\\par \n")),
        F.lit("\\'e9}"),
    )
    return documents.clean_rtf(t.documents(spark, sf).select("doc_id", wrapped.alias("text")))


@query(
    "s5_ingest_delimited",
    f"""
select doc_id, regexp_replace(array_to_string(list_transform(
         list_filter(string_split(replace(replace(text, chr(13), ' '), '"', ''), chr(10)),
                     lambda l: regexp_matches(l, '[^ \\t\\x0b\\x0c]')),
         lambda l: array_to_string(list_transform(string_split(l, ','),
             lambda f: regexp_replace(f, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')), ' ')), chr(10)),
         '^{SQL_WS}+|{SQL_WS}+$', '', 'g') as text from documents
""",
)
def ingest_delimited(spark, sf):
    """Documents read as comma-separated files; quotes are tested on fixtures."""
    plain = F.replace(F.replace(F.col("text"), F.lit("\r"), F.lit(" ")), F.lit('"'), F.lit(""))
    files = t.documents(spark, sf).select("doc_id", F.encode(plain, "UTF-8").alias("content"))
    return documents.ingest_delimited(files, ",")


@query(
    "s6_paginate",
    f"""
select doc_id, cast(p + 1 as int) as page, substr(x, p * 2000 + 1, 2000) as text
from (select doc_id, x, unnest(range(0, cast(floor((length(x) - 1) / 2000) + 1 as bigint))) as p
      from (select doc_id, {_collapse('text')} as x from documents) f where length(x) > 0) e
""",
)
def paginate(spark, sf):
    """Pages of 2 000 characters, so that most documents have several."""
    return documents.paginate(t.documents(spark, sf).select("doc_id", "text"), "text", 2000)


@query(
    "p1_filter_supported",
    oracle(
        "select path from listing where lower(regexp_extract(path, '\\.([^./]+)$', 1)) in ('rtf', 'doc', 'xlsx')",
        "listing",
    ),
)
def filter_supported(spark, sf):
    return ls.filter_supported(t.listing(spark, sf), [".rtf", "DOC", "xlsx"]).select("path")


@query(
    "p2_valid_paths",
    oracle(
        """
select distinct l.path from listing l join folders f on starts_with(l.path, f.folder || '/')
where starts_with(l.path, '/') and not contains(l.path, '../') and not contains(l.path, '/./')
  and not contains(l.path, '//')
""",
        "listing",
        "folders",
    ),
)
def valid_paths(spark, sf):
    return lookups.valid_paths(t.listing(spark, sf), t.folders(spark)).select("path")


@query(
    "t1_path_parts",
    oracle(
        """
select path, string_split(path, '/')[-1] as base, regexp_extract(path, '\\.([^./]+)$', 1) as ext,
       regexp_replace(path, '/[^/]*$', '') as dir from listing
""",
        "listing",
    ),
)
def path_parts(spark, sf):
    return t.listing(spark, sf).select(
        "path",
        paths.basename("path").alias("base"),
        paths.extension("path").alias("ext"),
        paths.parent_dir("path").alias("dir"),
    )


@query(
    "t2_extended_extension",
    oracle(
        """
select path, case when packed then lower(ext) || '.gz' when hidden then lower(ext) else lower(ext) end as ext
from (select path, regexp_extract(path, '\\.([^./]+)$', 1) as ext, h < '5' as packed, h > 'b' as hidden from listing) x
""",
        "listing",
    ),
)
def extended_extension(spark, sf):
    """Some files packed (`a.md.gz`), some made dotfiles (`.md`)."""
    name = (
        F.when(F.col("h") < "5", F.concat("path", F.lit(".gz")))
        .when(F.col("h") > "b", F.concat(paths.parent_dir("path"), F.lit("/."), paths.extension("path")))
        .otherwise(F.col("path"))
    )
    return t.listing(spark, sf).select("path", paths.extended_extension(name).alias("ext"))


@query(
    "t3_fingerprint",
    oracle("select path, md5(concat(path, ':', size_bytes, ':', mtime_ms)) as file_hash from listing", "listing"),
)
def fingerprint(spark, sf):
    return t.listing(spark, sf).select(
        "path", paths.fingerprint("path", "size_bytes", "mtime_ms").alias("file_hash")
    )


@query(
    "t4_chunk_id",
    oracle('select path, "offset", sha1(concat(path, \':0:\', "offset")) as id from chunks', "chunks"),
)
def chunk_ids(spark, sf):
    rows = t.chunks(spark, sf)
    return rows.select("path", "offset", paths.chunk_id("path", F.lit(None).cast("int"), "offset").alias("id"))


@query(
    "t5_est_tokens",
    """
select doc_id, cast(ceil(length(text) / 4.0) as bigint) as chunk_tokens,
       cast(ceil(length(text) / 2.5) as bigint) as batch_tokens from documents
""",
)
def est_tokens(spark, sf):
    return t.documents(spark, sf).select(
        "doc_id",
        paths.est_tokens("text", 4).alias("chunk_tokens"),
        paths.est_tokens("text", 2.5).alias("batch_tokens"),
    )


@query(
    "t6_text_profile",
    """
select lang, count(*) as texts, cast(sum(n) as bigint) as total_chars, round(avg(n), 6) as avg_chars,
       cast(min(n) as int) as min_chars, cast(max(n) as int) as max_chars,
       cast(sum(ceil(n / 2.5)) as bigint) as est_tokens, cast(sum(o) as bigint) as non_ascii,
       round(sum(o) / sum(n)::double * 100, 6) as non_ascii_percent
from (select lang, length(text) as n, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) as o from documents) d
group by lang
""",
)
def text_profile(spark, sf):
    report = stats.text_profile(t.documents(spark, sf), "text", "lang")
    return report.withColumns(
        {c: F.round(c, 6) for c in ("avg_chars", "non_ascii_percent")}
    )


_LAST_WORDS = f"array_to_string(string_split({_collapse('text')}, ' ')[-2:], '  ')"


def _with_query(spark, sf):
    """Each document with its own last two words as the query, so that every row has another pattern."""
    words = F.split(tx.collapse_whitespace("text"), " ")
    asked = F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), "  ")
    return t.documents(spark, sf).select("doc_id", "text", asked.alias("q"))


@query(
    "t7_snippet",
    f"""
select doc_id, case when n <= 200 then text when pos = 0 then substr(text, 1, 200) || '...'
  else case when b > 0 then '...' else '' end || substr(text, b + 1, e - b) || case when e < n then '...' else '' end
  end as snippet
from (select *, least(n, b + 200) as e from (
  select doc_id, text, length(text) as n, pos, greatest(0, pos - 51) as b from (
    select doc_id, text, strpos(lower(text), string_split(lower({_LAST_WORDS}), '  ')[1]) as pos from documents) x) y) z
""",
)
def snippet(spark, sf):
    return _with_query(spark, sf).select("doc_id", tx.snippet("text", "q").alias("snippet"))


@query(
    "t8_highlight",
    f"""
select doc_id, html, case when html <> text then 'keyword' else 'semantic' end as match_type
from (select doc_id, text, list_reduce(list_filter(string_split(lower({_LAST_WORDS}), '  '), lambda w: w <> ''),
        lambda acc, w: regexp_replace(acc, '(' || regexp_replace(w, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g') || ')',
                              '<mark>\\1</mark>', 'gi'), text) as html from documents) x
""",
)
def highlight(spark, sf):
    marked = tx.highlight("text", "q")
    return (
        _with_query(spark, sf)
        .select("doc_id", marked.alias("m"))
        .select("doc_id", "m.html", "m.match_type")
    )


@query(
    "t9_context_window",
    f"""
select doc_id, case when length(text) <= 400 then text when n = 0 or length(body) > 400 then substr(text, 1, 400) || '...'
  else case when b > 0 then '... ' else '' end || body || case when b + take < n then ' ...' else '' end end as context
from (select *, array_to_string(s[b + 1 : b + take], ' ') as body from (
  select *, greatest(0, n // 2 - take // 2) as b from (
    select doc_id, text, s, len(s) as n, least(3, len(s)) as take from (
      select doc_id, text, list_filter(list_transform(
          string_split(regexp_replace(text, '([.!?])({SQL_WS}|\\z)', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
          lambda p: regexp_replace(p, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')), lambda p: p <> '') as s
      from documents) a) c) d) e
""",
)
def context_window(spark, sf):
    return t.documents(spark, sf).select("doc_id", tx.context_window("text").alias("context"))


def sentence_chunk_sql(source: str, keys: str, target: int, overlap: int) -> str:
    """Sentence chunks as a walk over the sentences of each text."""
    return f"""
with recursive src as (select {keys}, row_number() over () as k, text from {source} where regexp_matches(text, '[^' || '{SQL_WS[1:-1]}' || ']')),
cut as (select k, string_split(regexp_replace(text, '([.!?]){SQL_WS}+', '\\1' || chr(1), 'g'), chr(1)) as s from src),
sums as (select k, s, len(s) as n,
   list_prepend(0::bigint, list_transform(range(1, len(s) + 1), lambda i: cast(list_sum(list_transform(s[1:i], lambda x: length(x) + 1)) as bigint))) as p from cut),
walk(k, i, first, tokens, cut_from, cut_to) as (
  select k, 0::bigint, 0::bigint, 0::bigint, null::bigint, null::bigint from sums
  union all
  select k, i + 1, case when full_ then nf else first end,
         case when full_ then case when nf < i then cast(ceil((pi - p[nf + 1] - 1) / 4.0) as bigint) else 0 end else tokens end + size_,
         case when full_ then first end, case when full_ then i end
  from (select *, list_filter(range(first, i + 1), lambda x: x = i or ceil((pi - p[x + 1] - 1) / 4.0) <= {overlap})[1] as nf
        from (select w.k, w.i, w.first, w.tokens, u.p, u.p[w.i + 1] as pi, cast(ceil(length(u.s[w.i + 1]) / 4.0) as bigint) as size_,
                     w.tokens + ceil(length(u.s[w.i + 1]) / 4.0) > {target} and w.i > w.first as full_
              from walk w join sums u on u.k = w.k where w.i < u.n) a) b),
spans as (select k, cut_from, cut_to from walk where cut_from is not null
          union all select w.k, w.first, w.i from walk w join sums u on u.k = w.k and w.i = u.n)
select {keys}, cast(row_number() over (partition by x.k order by cut_to) - 1 as int) as chunk_index,
       u.p[cut_from + 1] as "offset", array_to_string(u.s[cut_from + 1 : cut_to], ' ') as text
from spans x join sums u on u.k = x.k join src on src.k = x.k
"""


@query("c1_chunk_sentences", sentence_chunk_sql("documents", "doc_id", 500, 60))
def chunk_sentences(spark, sf):
    return chunking.chunk_sentences(t.documents(spark, sf), "doc_id")


@query("c1_chunk_sentences_small", sentence_chunk_sql("documents", "doc_id", 100, 20))
def chunk_sentences_small(spark, sf):
    return chunking.chunk_sentences(t.documents(spark, sf), "doc_id", "text", 100, 20)


_PAGES = f"""(select doc_id, cast(p + 1 as int) as page, substr(x, p * 2000 + 1, 2000) as text
from (select doc_id, x, unnest(range(0, cast(floor((length(x) - 1) / 2000) + 1 as bigint))) as p
      from (select doc_id, {_collapse('text')} as x from documents) f where length(x) > 0) e)"""


@query("c2_chunk_pages", sentence_chunk_sql(_PAGES, "doc_id, page", 100, 20))
def chunk_pages(spark, sf):
    return chunking.chunk_pages(paginate(spark, sf), "doc_id", 100, 20)


@query("c3_chunk_fixed", oracle('select path, chunk_index::int as chunk_index, "offset", text from chunks', "chunks"))
def chunk_fixed(spark, sf):
    cut = chunking.chunk_fixed(t.corpus(spark, sf).select("path", "text"))
    return cut.select("path", "chunk_index", "offset", "text")


@query(
    "c4_assemble_chunks",
    oracle(
        'select id, path, mtime_ms, page, "offset", text, type, title from chunks',
        "chunks",
    ),
)
def assemble_chunks(spark, sf):
    cut = chunking.chunk_fixed(t.corpus(spark, sf).select("path", "text"))
    rows = chunking.assemble_chunks(cut, None, t.listing(spark, sf))
    return rows.select("id", "path", "mtime_ms", "page", "offset", "text", "type", "title")


def _raw(x: str, dim: int = DIM) -> str:
    return (
        f"list_transform(range({dim}), lambda i: "
        f"(cast('0x' || substr(sha1({x}), 2 * (i % 20) + 1, 2) as int) - 128) / 128.0::double)"
    )


@query(
    "e1_embed",
    f"""
select doc_id, cast(i as int) as i, round(v[i]::double, 5) as v from (
  select doc_id, v, unnest(range(1, {DIM + 1})) as i from (
    select doc_id, list_transform(r, lambda x: cast(x / sqrt(list_sum(list_transform(r, lambda y: y * y))) as float)) as v
    from (select doc_id, {_raw("'passage: ' || text")} as r from documents) a) b) c
""",
)
def embed(spark, sf):
    rows = embedding.embed(t.documents(spark, sf).select("doc_id", "text"), prefix="passage: ")
    spread = rows.select("doc_id", F.posexplode("vector").alias("i", "v"))
    return spread.select(
        "doc_id", (F.col("i") + 1).alias("i"), F.round(F.col("v").cast("double"), 5).alias("v")
    )


@query(
    "e2_l2_normalize",
    """
select vec_id, i, round(v, 6) as v from (
  select vec_id, cast(unnest(range(1, 65)) as int) as i,
         unnest(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))) as v
  from (select vec_id, list_transform(embedding, lambda x: x::double * 3) as e from embeddings) a) b
""",
)
def l2_normalize(spark, sf):
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)
    unit = t.given(spark, sf, "embeddings").select("vec_id", scaled.alias("e")).select(
        "vec_id", F.posexplode(vx.l2_normalize("e")).alias("i", "v")
    )
    return unit.select("vec_id", (F.col("i") + 1).alias("i"), F.round("v", 6).alias("v"))


@query(
    "e3_hash_embed",
    f"""
select doc_id, i, v, round(v / n, 6) as unit from (
  select doc_id, cast(unnest(range(1, {DIM + 1})) as int) as i, unnest(r) as v,
         sqrt(list_sum(list_transform(r, lambda y: y * y))) as n
  from (select doc_id, {_raw('text')} as r from documents) a) b
""",
)
def hash_embed(spark, sf):
    rows = t.documents(spark, sf).select("doc_id", vx.hash_values("text", DIM).alias("r"))
    both = rows.select("doc_id", F.posexplode(F.arrays_zip("r", vx.l2_normalize("r").alias("u"))).alias("i", "x"))
    return both.select(
        "doc_id", (F.col("i") + 1).alias("i"), F.col("x.r").alias("v"), F.round("x.u", 6).alias("unit")
    )


@query(
    "e4_pack_batches",
    oracle(
        """
, sized as (select path, chunk_index, cast(ceil(length(text) / 2.5) as bigint) as tokens from chunks),
walk(path, chunk_index, tokens, batch_id, rows_, sum_) as (
  select path, chunk_index, tokens, 0::bigint, 1::bigint, tokens from sized where chunk_index = 0
  union all
  select s.path, s.chunk_index, s.tokens, case when w.rows_ = 32 or w.sum_ + s.tokens > 7000 then w.batch_id + 1 else w.batch_id end,
         case when w.rows_ = 32 or w.sum_ + s.tokens > 7000 then 1 else w.rows_ + 1 end,
         case when w.rows_ = 32 or w.sum_ + s.tokens > 7000 then s.tokens else w.sum_ + s.tokens end
  from walk w join sized s on s.path = w.path and s.chunk_index = w.chunk_index + 1)
select path, cast(chunk_index as bigint) as chunk_index, tokens, batch_id from walk
""",
        "chunks",
    ),
)
def pack_batches(spark, sf):
    packed = embedding.pack_batches(t.chunks(spark, sf), "path", "chunk_index", "text", block_rows=32)
    return packed.select("path", "chunk_index", "tokens", "batch_id")


class _FailingEmbedder(embedding.HashEmbedder):
    """Refuses batches holding a text without a full stop."""

    def embed(self, texts):
        if any("." not in text for text in texts):
            raise RuntimeError("refused")
        return super().embed(texts)


@query(
    "e5_split_failures",
    oracle(
        """
select path, count(*) filter (not contains(text, '.')) as failed_chunks, count(*) filter (contains(text, '.')) as ok_chunks
from chunks group by path
""",
        "chunks",
    ),
)
def split_failures(spark, sf):
    """A model that refuses some texts, called with one text at a time."""
    rows = embedding.embed(t.chunks(spark, sf).select("path", "text"), embedder=_FailingEmbedder, max_rows=1)
    ok, dead = embedding.split_failures(rows)
    good = ok.groupBy("path").agg(F.count("*").alias("ok_chunks"))
    both = good.join(embedding.failure_counts(dead), "path", "full")
    return both.select("path", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("failed_chunks", "ok_chunks")])
