import random
import re

import pytest

from docstrata.llm import revisits
from docstrata.llm.queries import table

COLUMNS = "record_id long, url string, captured string, record_type string, http string, digest string"


def key(url):
    bare = re.sub(r"^[A-Za-z][\w+.-]*://", "", re.sub(r"#.*$", "", url.strip(), flags=re.S))
    host, path, query = re.match(r"([^/?]*)([^?]*)\??(.*)", bare, re.S).groups()
    host = re.sub(r":(80|443)$", "", re.sub(r"^www\.", "", re.sub(r"^[^@]*@", "", host.lower())))
    kept = sorted(p for p in query.split("&") if p and not re.match(revisits.TRACKING, p.lower()))
    return host + re.sub("/+$", "", path) + ("?" + "&".join(kept) if kept else "")


def parse(block):
    lines = re.split(r"\r?\n", block or "")
    status = re.match(r"HTTP/[0-9.]+ +([0-9]{3})", lines[0])
    headers = {}
    for line in lines:
        if m := re.match(r"([^\s:]+):(.*)$", line):
            headers.setdefault(m[1].lower(), []).append(m[2].strip(" "))
    return int(status[1]) if status else None, {k: ", ".join(v) for k, v in headers.items()}


def brute(rows):
    out, held = {}, {}
    for rid, url, when, kind, http, digest in sorted({r for r in rows if None not in r[:3]}, key=lambda r: (key(r[1]), r[2], r[0])):
        status, headers = parse(http)
        if kind == "revisit" or status == 304:
            r = held.get(key(url))
            pairs = []
            if r:
                strip = lambda h: h["etag"].removeprefix("W/") if "etag" in h else None
                pairs = [(strip(headers), strip(r[1])), (headers.get("last-modified"), r[1].get("last-modified")), (digest, r[2])]
                pairs = [p for p in pairs if None not in p]
            outcome = "no_response" if not r else "unverified" if not pairs else "resolved" if pairs[0][0] == pairs[0][1] else "mismatch"
            if outcome == "resolved":
                banned = {*revisits.NOT_PERMITTED, *[c.strip() for c in headers.get("connection", "").lower().split(",")]}
                headers, digest = r[1] | {k: v for k, v in headers.items() if k not in banned}, r[2]
            out[rid] = (key(url), when, outcome, r[0] if r else None, digest, headers)
        elif kind == "response" and status == 200:
            held[key(url)] = (rid, headers, digest)
    return out


def run(frame):
    rows = revisits.resolve_revisits(frame).collect()
    got = {r.record_id: (r.url_key, r.captured, r.outcome, r.refers_to, r.digest, r.headers) for r in rows}
    assert len(got) == len(rows)
    return got


def test_pages(spark, sf):
    frame = revisits.captures_of_pages(table(spark, sf, "pages"))
    got = run(frame)
    assert got == brute([tuple(r) for r in frame.collect()])
    assert {v[2] for v in got.values()} == {"resolved", "no_response", "mismatch", "unverified"}


@pytest.mark.parametrize("parts", [1, 13])
def test_hot_url_over_many_slices(spark, parts):
    rng = random.Random(parts)
    rows = []
    for i in range(1_500):
        url = "http://hot.example.com/a" if i % 3 else f"https://www.h{i % 7}.example.com:443/p{i % 50}/?b=2&a=1&utm_medium=x#f"
        full = rng.random() < 0.05
        tag = rng.choice(['ETag: "1"', 'ETag: W/"1"', 'etag: "2"', "Last-Modified: x", "Last-Modified: y", ""])
        lines = ["HTTP/1.1 200 OK" if full else "HTTP/1.1 304 Not Modified", tag, "Content-Length: 5", "Vary: a", f"Vary: b{i % 3}", "Connection: X-Own", "X-Own: 1"]
        rows.append((i, url, f"2024-01-01T00:{rng.randrange(60):02}:00Z", "response" if full else rng.choice(["revisit", "response"]), "\r\n".join(x for x in lines if x), rng.choice([None, "d1"])))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = run(spark.createDataFrame(rows, COLUMNS).repartition(5))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == brute(rows) and len({v[2] for v in got.values()}) == 4


def test_edges(spark):
    ok, no = "HTTP/1.1 200 OK\r\nETag: \"a\"", "HTTP/1.1 304 Not Modified\nETag: \"a\"\nX: " + "y" * 100_000
    rows = [
        (1, "http://a.com/", "2024", "response", ok, "d"), (2, "HTTP://A.com", "2024", "revisit", no, None), (2, "HTTP://A.com", "2024", "revisit", no, None),
        (3, "http://a.com", None, "revisit", no, None), (4, None, "2025", "revisit", no, None), (None, "http://a.com", "2025", "revisit", no, None),
        (5, "http://a.com", "2025", "revisit", None, None), (6, "http://a.com", "2026", None, "junk", None), (7, "", "2026", "revisit", "", None), (0, "http://a.com", "2024", "revisit", no, None),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS + ", headers string, status int")
    got = run(frame)
    assert got == brute(rows) and got[2][3] == 1 and got[0][2] == "no_response" and got[5][2] == "unverified"
    assert revisits.resolve_revisits(frame.where("false")).count() == 0
