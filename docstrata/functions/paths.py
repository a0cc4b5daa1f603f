"""Path expressions: pure Catalyst columns, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Compression suffixes that form a dual extension such as `tar.gz`.
DUAL_EXTENSIONS = ("gz", "bz2", "xz")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(c: Column | str) -> Column:
    """Last path component."""
    return F.substring_index(_col(c), "/", -1)


def extension(c: Column | str) -> Column:
    """Text after the last dot of the last component; empty when that dot is missing or trailing."""
    return F.regexp_extract(_col(c), r"(?s)\.([^./]+)\z", 1)


def file_type(c: Column | str) -> Column:
    """Lower-case extension with the dotfile rule: a leading dot does not start an extension."""
    return F.lower(F.regexp_extract(basename(c), r"(?s).\.([^.]+)\z", 1))


def parent_dir(c: Column | str) -> Column:
    """Directory of a path, `/` for entries at the root and for names without a slash."""
    path = _col(c)
    head = F.regexp_extract(path, r"(?s)\A(.+)/[^/]*\z", 1)
    return F.when(head == "", F.lit("/")).otherwise(head)


def extended_extension(c: Column | str) -> Column:
    """Lower-case extension, with `.gitignore` -> `gitignore` and `a.tar.gz` -> `tar.gz`."""
    base = F.lower(basename(c))
    dotfile = F.regexp_extract(base, r"(?s)\A\.([^.]*)\z", 1)
    plain = F.regexp_extract(base, r"(?s).\.([^.]+)\z", 1)
    inner = F.regexp_extract(base, r"(?s).\.([^.]+)\.[^.]+\z", 1)
    dual = F.concat_ws(".", inner, plain)
    return (
        F.when(base.startswith(".") & ~F.substring(base, 2, 2**31 - 1).contains("."), dotfile)
        .when(plain.isin(*DUAL_EXTENSIONS) & (inner != ""), dual)
        .otherwise(plain)
    )


def fingerprint(path: Column | str, size: Column | str, mtime_ms: Column | str) -> Column:
    """`md5(path:size:mtime)`: the change-detection hash of a file."""
    return F.md5(
        F.concat_ws(":", _col(path), _col(size).cast("string"), _col(mtime_ms).cast("string")).cast("binary")
    )


def chunk_id(path: Column | str, page: Column | str, offset: Column | str) -> Column:
    """`sha1(path:page:offset)`; a missing page counts as 0."""
    page_text = F.coalesce(_col(page), F.lit(0)).cast("string")
    return F.sha1(F.concat_ws(":", _col(path), page_text, _col(offset).cast("string")).cast("binary"))


def est_tokens(c: Column | str, chars_per_token: float = 4) -> Column:
    """Token estimate of a text: length over characters per token, rounded up."""
    return F.ceil(F.length(_col(c)) / F.lit(chars_per_token)).cast("long")


def ancestors(directory: Column | str) -> Column:
    """Every directory on the way to `directory`, root (as an empty name) and itself included:
    `/a/b` -> [``, `/a`, `/a/b`]. A relative directory has none."""
    parts = F.split(F.rtrim(_col(directory), F.lit("/")), "/")
    return F.when(
        F.startswith(_col(directory), F.lit("/")),
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i))),
    ).otherwise(F.array().cast("array<string>"))


def safe_path(c: Column | str) -> Column:
    """Absolute path without parent, self or empty components."""
    path = _col(c)
    return path.startswith("/") & ~path.contains("../") & ~path.contains("/./") & ~path.contains("//")


def glob_to_regex(pattern: str) -> str:
    """Java regular expression of a `*`/`?` glob, matching a whole path or its last components."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            ch = pattern[i]
            out += "[^/]*" if ch == "*" else "[^/]" if ch == "?" else ("\\" + ch if not ch.isalnum() else ch)
            i += 1
    return r"(?s)(?:\A|/)" + out + r"\z"
