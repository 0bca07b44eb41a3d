"""Lines, bytes and previews, as columns.  Offsets are bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW = 200
# Preview texts by request.
PREVIEWS = {
    "structure": "%d files", "symbols": "%d symbols", "search": "%d matches for '%s'", "implementation": "%s::%s (%d bytes)", "tests": "%d tests for %s",
    "callers": "%d callers of %s", "variables": "%d variables in %s", "peek": "%s:%d-%d", "grep": "%d matches for '%s'", "chunks": "%d chunks for %s",
}


def line_array(content: Column) -> Column:
    """Split at \\n or \\r\\n, no empty last line, a lone \\r stays, '' has no line."""
    plain = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    # The text is split once, not in a lambda, which would split it again for every line.
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(plain, r"\n\z", ""), "\n", -1))


def numbered(line_no: Column, text: Column) -> Column:
    return F.format_string("%6d │ %s", line_no, text)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def first_line(text: Column) -> Column:
    return F.regexp_extract(text, r"\A([^\n]*?)\r?(?:\n|\z)", 1)


def byte_slice(content: Column, start: Column, end: Column) -> Column:
    """The bytes [start, end) of content as text."""
    return F.substring(F.encode(content, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int")).cast("string")


def preview(text: Column) -> Column:
    """Beyond 200 bytes: as many whole characters as fit, and dots."""
    data = F.encode(text, "UTF-8")
    back = F.lit(PREVIEW)
    for k in (3, 2, 1):  # up to three bytes of a character may hang over the edge
        tail = F.substring(data, PREVIEW + 2 - k, k)
        inside = F.lit(True)
        for i in range(1, k + 1):
            inside = inside & F.hex(F.substring(tail, i, 1)).between("80", "BF")
        back = F.when(inside, F.lit(PREVIEW - k)).otherwise(back) if k == 3 else F.when((back == PREVIEW) & inside, F.lit(PREVIEW - k)).otherwise(back)
    return F.when(F.octet_length(text) > PREVIEW, F.concat(F.substring(data, F.lit(1), back).cast("string"), F.lit("..."))).otherwise(text)


def preview_of(request: str, *values: Column) -> Column:
    return F.format_string(PREVIEWS[request], *values)


def rfc3339(ts: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
