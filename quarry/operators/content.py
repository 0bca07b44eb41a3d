"""Lines, peeks, regular-expression search and chunks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import line_array, numbered
from quarry.operators.search_index import first_matches, first_of


def checked(pattern: str) -> str:
    """The pattern with Unicode classes; a broken one is an error at once."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"bad pattern: {e}") from None
    return "(?U)" + pattern


def lines(files: DataFrame) -> DataFrame:
    """project, path, language, line_no (from 1), text, start_byte; no exchange, and time in proportion to the bytes of a file."""
    # The bytes are bound by a lambda, so that they are encoded once for each file.
    at = F.sequence(F.lit(1), F.octet_length("content"))
    ends = F.get(F.transform(F.array(F.encode("content", "UTF-8")), lambda data: F.filter(at, lambda i: F.substring(data, i, F.lit(1)) == F.lit(b"\n"))), F.lit(0))
    starts = F.concat(F.array(F.lit(0)), ends)
    # A last line that is ended by \n leaves one start too many.
    each = F.filter(F.zip_with(line_array(F.col("content")), starts, lambda x, s: F.struct(x.alias("text"), s.alias("start"))), lambda z: z["text"].isNotNull())
    own = files.where("content != ''").select("project", "path", "language", F.posexplode(each).alias("k", "line"))
    return own.select("project", "path", "language", (F.col("k") + 1).alias("line_no"), F.col("line.text").alias("text"), F.col("line.start").cast("long").alias("start_byte"))


def peek(files: DataFrame, start: int = 0, end: int = 100) -> DataFrame:
    """The lines [start, end) of each file, numbered; both are clamped, an empty range gives ''."""
    return peek_many(files, None, F.lit(start), F.lit(end))


def peek_many(files: DataFrame, ranges: DataFrame | None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """The same for a table of (project, path, start, end)."""
    own = files.where("content is not null").select("project", "path", line_array(F.col("content")).alias("l"))
    if ranges is not None:
        own = own.join(ranges.select("project", "path", "start", "end"), ["project", "path"])
        start, end = F.col("start"), F.col("end")
    total = F.size("l")
    own = own.withColumns({"total_lines": total, "s": F.least(F.greatest(start, F.lit(0)), total), "e": F.least(F.greatest(end, F.lit(0)), total)})
    own = own.withColumn("e", F.greatest("s", "e"))
    text = F.array_join(F.transform(F.slice("l", F.col("s") + 1, F.col("e") - F.col("s")), lambda x, i: numbered(F.col("s") + i + 1, x)), "\n")
    return own.select("project", "path", (F.col("s") + 1).alias("start_line"), F.col("e").alias("end_line"), "total_lines", text.alias("content"))


def matches(files: DataFrame, pattern: str, context_lines: int = 2, keys: tuple = ("project", "path")) -> DataFrame:
    """Every matching line with its context; the context is cut out where the line is found, so no row carries its file on."""
    c = context_lines
    own = files.where("content is not null").select(*keys, line_array(F.col("content")).alias("l"))
    own = own.select(*keys, "l", F.posexplode("l").alias("i", "text")).where(F.col("text").rlike(checked(pattern)))
    before = F.slice("l", F.greatest(F.col("i") - c, F.lit(0)) + 1, F.least(F.col("i"), F.lit(c)))
    return own.select(*keys, (F.col("i") + 1).alias("line"), "text", before.alias("context_before"), F.slice("l", F.col("i") + 2, F.lit(c)).alias("context_after"))


def grep(files: DataFrame, pattern: str, max_matches: int = 50, context_lines: int = 2, scope: str = "all") -> DataFrame:
    """The first matches by path and line.  scope="code" drops a line whose first match starts in a comment or string."""
    if scope not in ("all", "code"):
        raise ValueError(f"unknown scope: {scope}")
    found = matches(files, pattern, context_lines) if scope == "all" else code_matches(files, pattern, context_lines)
    return found.orderBy("project", "path", "line").limit(max_matches)


def code_matches(files: DataFrame, pattern: str, context_lines: int = 2) -> DataFrame:
    """Matching lines whose first match is code.  Files without a grammar keep all; offsets are true bytes, with \\r\\n too."""
    from quarry.operators.symbols import with_facts

    spans = with_facts(files, "spans", "lines").select("project", "path", F.col("facts.spans").alias("spans"), F.col("facts.lines").alias("starts"), "content")
    c, p = context_lines, checked(pattern)
    own = spans.select("project", "path", "spans", "starts", line_array(F.col("content")).alias("l"))
    own = own.select("project", "path", "spans", "starts", "l", F.posexplode("l").alias("i", "text")).where(F.col("text").rlike(p))
    at = F.get("starts", F.col("i")) + F.octet_length(F.left("text", F.regexp_instr("text", F.lit(p)) - 1))
    own = own.withColumn("at", at).where(F.expr("spans is null or not exists(spans, s -> at >= s.start and at < s.end)"))
    before = F.slice("l", F.greatest(F.col("i") - c, F.lit(0)) + 1, F.least(F.col("i"), F.lit(c)))
    return own.select("project", "path", (F.col("i") + 1).alias("line"), "text", before.alias("context_before"), F.slice("l", F.col("i") + 2, F.lit(c)).alias("context_after"))


def _count(pattern: str) -> Column:
    return F.size(F.filter(line_array(F.col("content")), lambda x: x.rlike(checked(pattern)))).cast("long")


def grep_summary(files: DataFrame, pattern: str, max_matches: int = 50) -> DataFrame:
    total = F.coalesce(F.sum(_count(pattern)), F.lit(0))
    return files.where("content is not null").agg(total.alias("total_matches")).withColumn("truncated", F.col("total_matches") > max_matches)


def grep_count_by(files: DataFrame, pattern: str, keys: list[str]) -> DataFrame:
    return files.where("content is not null").groupBy(*keys).agg(F.sum(_count(pattern)).alias("matches")).where("matches > 0")


#: Patterns that one pass over the lines takes.
PATTERN_BLOCK = 500


def grep_many(files: DataFrame, patterns: DataFrame, max_matches: int = 50, literal: bool = False) -> DataFrame:
    """Per pattern (pattern_id, pattern): its first lines and its total.  Literal patterns are automata that read each line once.  Regular
    expressions go to the tasks in blocks of PATTERN_BLOCK, and a line is tried pattern by pattern only where the block's alternation finds something."""
    if literal:
        return first_matches(files, patterns, max_matches)
    rows = patterns.select("pattern_id", "pattern").orderBy("pattern_id").toLocalIterator()
    blocks: list[list] = [[]]
    for r in rows:
        if len(blocks[-1]) == PATTERN_BLOCK:
            blocks.append([])
        blocks[-1].append(r)
    text = files.where("content is not null").select("project", "path", F.posexplode(line_array(F.col("content"))).alias("i", "text"))
    found = None
    for own in blocks:
        if not own:
            return text.where("false").selectExpr("cast(null as bigint) as pattern_id", "project", "path", "i + 1 as line", "text", "0L as total")
        any_of = "|".join(f"(?:{checked(r['pattern'])[4:]})" for r in own)
        ids = F.array_compact(F.array(*[F.when(F.col("text").rlike(checked(r["pattern"])), F.lit(r["pattern_id"])) for r in own]))
        part = text.where(F.col("text").rlike(any_of)).select(F.explode(ids).alias("pattern_id"), "project", "path", (F.col("i") + 1).alias("line"), "text")
        found = part if found is None else found.unionByName(part)
    return first_of(found, max_matches)


def chunk_indices(files: DataFrame, size: int = 5000, overlap: int = 200) -> DataFrame:
    """Byte ranges of `size` with `overlap`, by closed form; an empty file has none."""
    if size <= 0 or overlap >= size or overlap < 0:
        raise ValueError("size must be over 0 and overlap under size")
    step, total = size - overlap, F.octet_length("content").cast("long")
    n = (1 + F.ceil(F.greatest(total - size, F.lit(0)) / step)).cast("int")
    own = files.where("octet_length(content) > 0").select("project", "path", total.alias("total_bytes"), F.explode(F.sequence(F.lit(0), n - 1)).alias("index"))
    start = F.col("index").cast("long") * step
    return own.select("project", "path", "index", start.alias("start"), F.least(start + size, F.col("total_bytes")).alias("end"), "total_bytes")


def chunk_text(files: DataFrame, size: int = 5000, overlap: int = 200) -> DataFrame:
    """The chunks' text, the edges moved on to the next character start."""
    step, total = size - overlap, F.octet_length("content").cast("long")
    n = (1 + F.ceil(F.greatest(total - size, F.lit(0)) / step)).cast("int")

    def moved(data: Column, at: Column) -> Column:
        # A character has at most three bytes after its first.
        inside = [F.hex(F.substring(data, (at + 1 + k).cast("int"), F.lit(1))).between("80", "BF") for k in range(3)]
        return at + F.when(~inside[0], 0).when(~inside[1], 1).when(~inside[2], 2).otherwise(3)

    if size <= 0 or overlap >= size or overlap < 0:
        raise ValueError("size must be over 0 and overlap under size")
    own = files.where("octet_length(content) > 0")
    ranges = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("index"), (k.cast("long") * step).alias("start"), F.least(k.cast("long") * step + size, total).alias("end")))

    def texts(data: Column) -> Column:
        cut = F.transform(ranges, lambda r: F.struct(r["index"].alias("index"), moved(data, r["start"]).alias("start"), moved(data, r["end"]).alias("end")))
        return F.transform(cut, lambda r: F.struct(r["index"].alias("index"), r["start"].alias("start"), r["end"].alias("end"), F.substring(data, (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")).cast("string").alias("text")))

    # The bytes are bound by a lambda, so that they are encoded once for each file.
    return own.select("project", "path", F.inline(F.get(F.transform(F.array(F.encode("content", "UTF-8")), texts), F.lit(0))))
