"""Turning file bytes or extracted text into normalised document text."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions import paths
from docstrata.functions import text as tx
from docstrata.functions.text import WHITESPACE
from docstrata.sources.walk import read_named

# The UTF-16 heuristic looks at 100 bytes of files of at least 20 bytes, wants more than 20
# zero bytes, and more than twice as many at odd as at even positions.
PROBE_BYTES = 100
PROBE_MIN_LENGTH = 20
PROBE_MIN_ZEROS = 20

# Files whose records are held at a time.
FILES_AT_A_TIME = 64

# Fixed value: characters per page of extracted text.
PAGE_CHARS = 50_000


def decode_content(content: Column | str) -> Column:
    """Text of a file's bytes: UTF-16 by byte-order mark, UTF-16LE by its zero-byte pattern, UTF-8 where
    valid, else Latin-1. Byte-order marks are removed."""
    raw = F.col(content) if isinstance(content, str) else content
    head = F.hex(F.substring(raw, 1, PROBE_BYTES))
    pairs = r"(?:..)"
    # Zero bytes at even and odd positions, counted on the hexadecimal dump two bytes at a time.
    even = F.regexp_count(F.regexp_replace(head, rf"(..){pairs}?", "$1,"), F.lit("00,"))
    odd = F.regexp_count(F.regexp_replace(head, r"..(..)?", "$1,"), F.lit("00,"))
    looks_utf16 = (
        (F.octet_length(raw) >= PROBE_MIN_LENGTH) & (even + odd > PROBE_MIN_ZEROS) & (odd > even * 2)
    )
    bom = F.hex(F.substring(raw, 1, 2))
    even_bytes = F.substring(raw, F.lit(1), F.octet_length(raw) - F.octet_length(raw) % 2)
    decoded = (
        F.when(bom == "FFFE", F.decode(even_bytes, "UTF-16LE"))
        .when(bom == "FEFF", F.decode(even_bytes, "UTF-16BE"))
        .when(looks_utf16, F.decode(even_bytes, "UTF-16LE"))
        .when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
        .otherwise(F.decode(raw, "ISO-8859-1"))
    )
    return F.regexp_replace(decoded, "\\A\ufeff", "")


def read_corpus(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A Parquet corpus. Text work is bound by the processor, so an input with fewer splits than task slots is
    spread over them; one with enough splits, as any large corpus has, is read as it lies, without a shuffle."""
    rows = spark.read.parquet(path)
    slots = spark.sparkContext.defaultParallelism
    return rows.repartition(slots, key) if rows.rdd.getNumPartitions() * 2 <= slots else rows


def read_files(spark: SparkSession, roots: list[str], ext: str | None = None) -> DataFrame:
    """`(path, size_bytes, mtime_ms, content)` of the files below the roots, of one extension (whatever its case) if
    given."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if ext is not None:
        letters = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)
        reader = reader.option("pathGlobFilter", f"*.{letters}")
    files = reader.load(roots)
    return files.select(
        F.regexp_replace("path", r"^file:/*", "/").alias("path"),
        F.col("length").alias("size_bytes"),
        F.unix_millis("modificationTime").alias("mtime_ms"),
        "content",
    )


def _with_text(files: DataFrame, text: Column) -> DataFrame:
    return files.withColumn("text", text).drop("content")


def ingest_text(files: DataFrame) -> DataFrame:
    """`content` -> `text`: decoded, white space collapsed and trimmed."""
    return _with_text(files, tx.collapse_whitespace(decode_content("content")))


def ingest_markdown(files: DataFrame) -> DataFrame:
    return _with_text(files, tx.strip_markdown(decode_content("content")))


def ingest_rtf(files: DataFrame) -> DataFrame:
    return _with_text(files, tx.strip_rtf(F.make_valid_utf8(F.col("content").cast("string"))))


def clean_markdown(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, tx.strip_markdown(col))


def clean_rtf(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, tx.strip_rtf(col))


def delimited_text(content: str, sep: str) -> str:
    """One line per record, its trimmed fields joined by a space. Records the reader rejects and lines
    without any text are left out; empty fields stay."""
    csv.field_size_limit(2**31 - 1)
    lines = []
    reader = csv.reader(io.StringIO(content, newline=""), delimiter=sep, skipinitialspace=True)
    while True:
        try:
            record = next(reader)
        except StopIteration:
            break
        except csv.Error:
            continue
        if not record or (len(record) == 1 and not record[0].strip(WHITESPACE)):
            continue
        lines.append(" ".join(field.strip(WHITESPACE) for field in record))
    return "\n".join(lines).strip(WHITESPACE)


def _delimited(batches: Iterator[pa.RecordBatch], at: int, sep: str) -> Iterator[pa.RecordBatch]:
    """A few files at a time: their texts are held as Python strings, and once more as records."""
    for batch in batches:
        for k in range(0, batch.num_rows, FILES_AT_A_TIME):
            part = batch.slice(k, FILES_AT_A_TIME)
            texts = [None if t is None else delimited_text(t, sep) for t in part.column(at).to_pylist()]
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))


def ingest_delimited(files: DataFrame, sep: str = ",") -> DataFrame:
    """CSV or TSV `content` -> `text`, keeping the record order of each file."""
    decoded = files.withColumn("text", decode_content("content")).drop("content")
    at = decoded.columns.index("text")

    return decoded.mapInArrow(lambda batches: _delimited(batches, at, sep), decoded.schema)


def paginate(df: DataFrame, text: str = "text", size: int = PAGE_CHARS) -> DataFrame:
    """Collapsed text cut into pages of `size` characters, numbered from 1; blank text has no page."""
    flat = df.withColumn(text, tx.collapse_whitespace(text))
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    kept = [F.col(c) for c in df.columns if c != text]
    out = flat.select(*kept, F.posexplode(cut).alias("page", text))
    return out.withColumn("page", F.col("page") + 1)


# Extractors by extension: each maps `(path, content, ...)` to `(path, text, ...)`; content is null where a named file could not be read.
_EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "txt": ingest_text,
    "md": ingest_markdown,
    "rtf": ingest_rtf,
    "csv": lambda files: ingest_delimited(files, ","),
    "tsv": lambda files: ingest_delimited(files, "\t"),
}


def register_extractor(ext: str, extractor: Callable[[DataFrame], DataFrame]) -> None:
    """Adds or replaces the extractor of an extension; formats such as PDF are supplied by the caller."""
    _EXTRACTORS[ext.lower()] = extractor


def ingest_corpus(spark: SparkSession, roots: list[str]) -> DataFrame:
    """`(path, size_bytes, mtime_ms, text, error_kind, error_message)` of all files below the roots whose extension has
    an extractor.

    Each extractor reads the files of its extension only, so every file is read once. An extractor reports a file it
    cannot parse by a non-null `error_message`; that file has the kind `parse` and no text.
    """
    return _extracted({ext: read_files(spark, roots, ext) for ext in _EXTRACTORS})


def ingest_named(files: DataFrame, opened: Accumulator | None = None) -> DataFrame:
    """The same of `files(path, size_bytes, mtime_ms)` whose extension has an extractor, and of no others: each is opened
    by its name. A file that cannot be read has the kind `read` and no text; its extractor sees a null content."""
    ext = F.lower(paths.extension("path"))
    return _extracted({e: read_named(files.where(ext == e), opened) for e in _EXTRACTORS})


def has_extractor(path: Column | str) -> Column:
    return F.lower(paths.extension(path)).isin(list(_EXTRACTORS))


def _extracted(files: dict[str, DataFrame]) -> DataFrame:
    columns = ["path", "size_bytes", "mtime_ms", "text", "error_kind", "error_message"]
    out = None
    for ext, extractor in _EXTRACTORS.items():
        part = extractor(files[ext])
        for name, kind in (("error_message", "string"), ("size_bytes", "long"), ("mtime_ms", "long"), ("read_error", "string")):
            if name not in part.columns:
                part = part.withColumn(name, F.lit(None).cast(kind))
        unread = F.col("read_error").isNotNull()
        part = part.withColumn("error_message", F.coalesce("read_error", "error_message"))
        failed = F.col("error_message").isNotNull()
        kind = F.when(unread, "read").when(failed, "parse")
        part = part.withColumn("error_kind", kind).withColumn("text", F.when(~failed, F.col("text")))
        out = part.select(columns) if out is None else out.unionByName(part.select(columns))
    return out
