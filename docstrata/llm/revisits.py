"""Web captures: not-modified revisits resolved against earlier full responses.

An as-of join by canonical URL: a revisit (record type `revisit` or status 304) refers to the latest full response
(type `response`, status 200) of its URL that comes before it. Its validators have to agree with that response's, then
the headers it may update are merged over the stored ones. All captures lie in one order (URL, time, id) that is dealt
by range, so a URL with any share of the captures is no single task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.ordering import sliced, with_last
from docstrata.llm.shared import settle

#: Header fields of a not-modified answer that never update a stored response: those that describe its
#: own (absent) body and those of one connection.
NOT_PERMITTED = (
    "connection content-encoding content-length content-range content-type keep-alive proxy-authenticate "
    "proxy-authentication-info proxy-authorization proxy-connection te trailer transfer-encoding upgrade"
).split()
#: Fixed value: query parameters that name no resource.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|msclkid|ref|sessionid)="


def canonical_url(url: Column) -> Column:
    """The URL without scheme, user, `www.`, default port, fragment, tracking parameters and a slash at the end of its
    path; host in lower case, parameters sorted. Null stays null."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def http_status(block: Column) -> Column:
    """Status code of an HTTP header block, null where it has no status line."""
    return F.regexp_extract(F.coalesce(block, F.lit("")), r"^HTTP/[0-9.]+ +([0-9]{3})", 1).try_cast("int")


def http_headers(block: Column) -> Column:
    """map of lower-case field names to values; values of a repeated field are joined by a comma."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda s: s.rlike(r"^[^\s:]+:"))
    fields = F.transform(
        lines,
        lambda s: F.struct(
            F.lower(F.regexp_extract(s, r"^([^:]+):", 1)).alias("name"), F.trim(F.regexp_extract(s, r"^[^:]+:(.*)$", 1)).alias("value")
        ),
    )
    names = F.array_distinct(F.transform(fields, lambda f: f["name"]))
    joined = F.transform(
        names, lambda n: F.array_join(F.transform(F.filter(fields, lambda f: f["name"] == n), lambda f: f["value"]), ", ")
    )
    return F.map_from_arrays(names, joined)


def _etag(headers: str) -> Column:
    """The entity tag for a weak comparison."""
    return F.regexp_replace(F.col(f"{headers}.etag"), r"^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for every revisit among `records` (record_id, url, captured, record_type, http, digest): record_id,
    url_key, captured, outcome, refers_to, digest and headers.

    captured orders as text or timestamp; equal times are ordered by record_id, so of two captures at one time the
    smaller id is earlier. outcome is `resolved`, or

    * `no_response`: there is no earlier full response of the canonical URL;
    * `mismatch`: the entity tags differ (weak comparison), or where one has none, the Last-Modified values, or where
      one has none of these either, the payload digests;
    * `unverified`: there is nothing that both carry to compare.

    refers_to is the response's id, null with `no_response`. headers and digest are those of the response, headers with
    the permitted fields of the revisit merged over it, where the revisit is resolved; else its own. A record with a
    null id, url or time is left out; identical repeated records count once; a null or malformed header block has no
    status and no fields. Other columns are ignored; an empty table gives an empty result.
    """
    kept = ("record_id", "url", "captured", "record_type", "http", "digest")
    rows = records.select(*kept).where("record_id is not null and url is not null and captured is not null")
    parsed = rows.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "captured", "record_type",
        http_status(F.col("http")).alias("status"), http_headers(F.col("http")).alias("headers"), "digest",
    )
    is_revisit = F.coalesce((F.col("record_type") == "revisit") | (F.col("status") == 304), F.lit(False))
    is_full = F.coalesce((F.col("record_type") == "response") & (F.col("status") == 200), F.lit(False))
    order = ("url_key", "captured", "record_id")
    needed = parsed.where(is_revisit | is_full)
    # Dealing by range reads its input twice, once to find the ranges; so what is parsed is written first.
    slices = sliced(settle(needed, "parsed-captures"), order, "captures")
    full = F.when(is_full & ~is_revisit, F.struct("url_key", "record_id", "headers", "digest"))
    found = with_last(slices, order, full).where(is_revisit).dropDuplicates(["record_id", "url_key", "captured"])
    last = F.when(F.col("__last.url_key") == F.col("url_key"), F.col("__last"))
    found = found.withColumn("r", last).drop("__last")
    same = F.coalesce(
        _etag("headers") == _etag("r.headers"),
        F.col("headers.`last-modified`") == F.col("r.headers.`last-modified`"),
        F.col("digest") == F.col("r.digest"),
    )
    outcome = (
        F.when(F.col("r").isNull(), "no_response").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    )
    named = F.transform(F.split(F.lower(F.coalesce("headers.connection", F.lit(""))), ","), lambda c: F.trim(c))
    banned = F.concat(F.array(*map(F.lit, NOT_PERMITTED)), named)
    update = F.map_filter("headers", lambda k, _: ~F.array_contains(banned, k))
    merged = F.map_concat(F.map_filter("r.headers", lambda k, _: ~F.map_contains_key(update, k)), update)
    done = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id", "url_key", "captured", "outcome", F.col("r.record_id").alias("refers_to"),
        F.when(done, F.col("r.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(done, merged).otherwise(F.col("headers")).alias("headers"),
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Captures of every row of `pages` (page_id, url, html): a full response and three later revisits of other spellings
    of its URL. Of the revisits some are recorded before the response, some carry another entity tag, some only a
    Last-Modified, and some nothing; decided by the page id."""
    base = pages.where("page_id is not null").select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    made = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    plain = F.regexp_replace("url", r"[?#].*$", "")
    early = (F.col("page_id") % 11 == 5) & (F.col("k") == 1)
    day = F.when(early, -1).otherwise(F.col("k") * 3)
    stamp = lambda d: F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.col("page_id") % 100_000 * 60 + d * 86_400), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    spelled = F.when(F.col("k") == 1, F.concat(plain, F.lit("?utm_source=feed"))).when(F.col("k") == 2, F.concat(plain, F.lit("#top"))).otherwise(F.col("url"))
    other = (F.col("page_id") % 7 == 3) & (F.col("k") == 2)
    bare, dated = (F.col("page_id") % 13 == 4) & (F.col("k") == 3), (F.col("page_id") % 5 == 2) & (F.col("k") > 0)
    tag = F.concat(F.lit('ETag: "'), F.when(other, F.lit("new")).otherwise(F.col("digest")), F.lit('"'))
    modified = F.concat(F.lit("Last-Modified: "), stamp(F.lit(-30)))
    first = F.concat_ws("\r\n", F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html"), F.lit("Content-Length: 9"), F.lit("Cache-Control: max-age=60"), tag, modified)
    later = F.concat_ws(
        "\r\n", F.lit("HTTP/1.1 304 Not Modified"), F.lit("Connection: close, X-Hop"), F.lit("X-Hop: 1"), F.lit("Content-Length: 0"),
        F.concat(F.lit("Cache-Control: max-age="), F.col("k").cast("string")), F.when(~bare & ~dated, F.concat(F.lit("etag: W/"), F.substring(tag, 7, 99))), F.when(dated & ~bare, modified),
    )
    return made.select(
        (F.col("page_id") * 4 + F.col("k")).cast("long").alias("record_id"), spelled.alias("url"), stamp(day).alias("captured"),
        F.when(F.col("k") == 0, "response").otherwise("revisit").alias("record_type"), F.when(F.col("k") == 0, first).otherwise(later).alias("http"),
        F.when(F.col("k") == 0, F.col("digest")).alias("digest"),
    )
