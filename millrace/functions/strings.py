"""Column functions on lines, URLs and patterns. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LINE_BYTES = 4096


def trim_line(c: Column) -> Column:
    """Without carriage returns and line feeds at the end."""
    return F.regexp_replace(c, r"[\r\n]+$", "")


def within_bound(c: Column, limit: int = MAX_LINE_BYTES) -> Column:
    return F.octet_length(c) <= limit


def strip_schemes(c: Column) -> Column:
    """Without URL schemes anywhere, in any case; longer names first, so no scheme is cut inside another."""
    return F.regexp_replace(c, r"(?i)(https|http|ftps|sftp|ftp|wss|ws)://", "")


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_query(c: Column) -> Column:
    return F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)


def url_without_query(c: Column) -> Column:
    return F.regexp_replace(c, r"[?#].*$", "")


def collapse_controls(c: Column) -> Column:
    """Each carriage return, line feed and tab as one space."""
    return F.translate(c, "\r\n\t", "   ")


def cap_bytes(c: Column, limit: int = MAX_LINE_BYTES) -> Column:
    """The longest prefix of at most limit bytes that ends between two characters."""
    data = c.cast("binary")
    cuts = [F.try_validate_utf8(F.substring(data, 1, limit - k).cast("string")) for k in range(min(4, limit + 1))]
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.coalesce(*cuts))


def glob_to_regex(pattern: str) -> str:
    """A shell glob (* ? [..]) as an anchored regular expression of the subset that Java and RE2 share."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif ch == "[":
            end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] in ("!", "^") else i + 1)
            if end < 0:
                raise ValueError(f"bad pattern: {pattern!r} has no closing bracket")
            inside = pattern[i + 1 : end]
            if not inside.strip("!^"):
                raise ValueError(f"bad pattern: {pattern!r} has an empty class")
            out += "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += "\\" + ch if ch in r"\.+(){}|^$" else ch
        i += 1
    return f"^{out}$"


def like_filter(c: Column, part: str | None) -> Column:
    """Contains part in any ASCII case; blank or * is everything. % and _ stand for themselves."""
    if not part or not part.strip() or part.strip() == "*":
        return F.lit(True)
    return F.lower(c).contains(part.strip().lower())


def content_digest(c: Column) -> Column:
    return F.sha2(c, 256)


def row_key(*cols: str) -> Column:
    """A 64-bit key of the columns, for partitioning; equality is always checked on the columns themselves."""
    return F.xxhash64(*cols)
