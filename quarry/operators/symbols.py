"""The symbol layer: one lexer pass per file, then plain DataFrame operations on its facts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.names import PARSED, is_definition_line, is_text_definition_line, kind_named
from quarry.functions.shapes import facts_of_batch
from quarry.functions.text import byte_slice, line_array, trimmed

FACTS = {
    "symbols": "array<struct<name string, kind string, start_byte long, end_byte long, start_line int, end_line int, signature string, parent string>>",
    "calls": "array<struct<callee string, line int, text string, start_byte long, caller string>>",
    "variables": "array<struct<name string, pos long, within array<struct<function string, start long>>>>",
    "spans": "array<struct<start long, end long>>", "lines": "array<long>",
}
#: Calls in brief: without text, place and caller, or a file's calls by name.
BRIEF = {"sites": "array<struct<callee string, line int>>", "callees": "array<struct<callee string, n_calls long, first_line int>>"}
#: Shapes that a Python worker has read.
_SHAPES: dict = {}


def with_facts(files: DataFrame, *wanted: str) -> DataFrame:
    """files with the column facts (all of FACTS, or the wanted ones, which may be of BRIEF); narrow, so store its result when several operators need it.  Marked as nondeterministic, so that
    Spark infers no filter on what is exploded from it, which would run the lexer a second time."""
    wanted = wanted or tuple(FACTS)

    def facts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from quarry.operators import symbols  # the worker's own module keeps the shapes between tasks

        for content, language in batches:
            yield facts_of_batch(content, language, wanted, symbols._SHAPES)

    out = F.arrow_udf(facts, f"struct<{', '.join(f'{x}: {(FACTS | BRIEF)[x]}' for x in wanted)}>").asNondeterministic()
    return files.where("content is not null").withColumn("facts", out("content", "language"))


def facts_of(files: DataFrame, *what: str) -> DataFrame:
    """files that have no facts yet get the ones asked for; only parsed languages are read."""
    return files if "facts" in files.columns else with_facts(files.where(F.col("language").isin(PARSED)), *what)


def extract_symbols(files: DataFrame, source: bool = False) -> DataFrame:
    """The symbols of files; with source their texts, cut where the file is read, so that no file is joined again."""
    own = facts_of(files, "symbols")
    if not source:
        return own.select("project", "path", "language", F.inline("facts.symbols"))
    own = own.select("project", "path", "language", F.encode("content", "UTF-8").alias("data"), F.inline("facts.symbols"))
    return own.withColumn("source", F.substring("data", (F.col("start_byte") + 1).cast("int"), (F.least("end_byte", F.octet_length("data")) - F.col("start_byte")).cast("int")).cast("string")).drop("data")


def extract_calls(files: DataFrame) -> DataFrame:
    return facts_of(files, "calls").select("project", "path", "language", F.inline("facts.calls"))


def call_sites(files: DataFrame) -> DataFrame:
    """extract_calls without text, place and caller."""
    return facts_of(files, "sites").select("project", "path", "language", F.inline("facts.sites"))


def count_calls(files: DataFrame) -> DataFrame:
    """The calls of each file by name, counted where the file is read: project, path, language, callee, n_calls, first_line."""
    return facts_of(files, "callees").select("project", "path", "language", F.inline("facts.callees"))


def code_spans(files: DataFrame) -> DataFrame:
    return facts_of(files, "spans").select("project", "path", F.inline("facts.spans"))


def all_variables(files: DataFrame) -> DataFrame:
    """Distinct names bound in each function, with the first place; self and _ are left out.  The sweep over a file's functions is the lexer's,
    so a row goes to the functions around it and not to all of the file."""
    own = facts_of(files, "variables").select("project", "path", F.explode("facts.variables").alias("v")).where("v.name not in ('self', '_')")
    own = own.select("project", "path", "v.name", "v.pos", F.explode("v.within").alias("f"))
    return own.groupBy("project", "path", F.col("f.function").alias("function"), F.col("f.start").alias("fn_start_byte"), "name").agg(F.min("pos").alias("pos"))


def list_variables(files: DataFrame, function: str, path: str) -> DataFrame:
    return all_variables(files.where(F.col("path") == path)).where(F.col("function") == function).orderBy("project", "fn_start_byte", "pos")


def dedup_symbols(symbols: DataFrame) -> DataFrame:
    """One row per (project, path, name): the last."""
    rest = [c for c in symbols.columns if c not in ("project", "path", "name")]
    return symbols.groupBy("project", "path", "name").agg(F.max(F.struct("start_byte", *[c for c in rest if c != "start_byte"])).alias("s")).select("project", "path", "name", *[F.col(f"s.{c}") for c in rest])


def list_symbols(symbols: DataFrame, kind: str | None = None, path: str | None = None, limit: int = 100) -> DataFrame:
    if kind := kind_named(kind):
        symbols = symbols.where(F.col("kind") == kind)
    if path is not None:
        symbols = symbols.where(F.col("path") == path)
    return symbols.orderBy("project", "path", "start_line", "start_byte").limit(limit)


def search_symbols(symbols: DataFrame, q: str, limit: int = 20) -> DataFrame:
    return symbols.where(F.contains(F.lower("name"), F.lit(q.lower()))).orderBy("project", "path", "start_line", "start_byte").limit(limit)


def search_many(symbols: DataFrame, queries: list[str], limit: int = 20) -> DataFrame:
    """The first symbols of each query."""
    hit = F.array_compact(F.array(*[F.when(F.contains(F.lower("name"), F.lit(q.lower())), F.lit(q)) for q in queries]))
    by = Window.partitionBy("query").orderBy("project", "path", "start_line", "start_byte")
    return symbols.withColumn("query", F.explode(hit)).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def implementation(symbols: DataFrame, files: DataFrame | None, wanted: DataFrame) -> DataFrame:
    """The text of the wanted (project, path, name); what is not found is missing (see not_found).  Without files the symbols hold their source."""
    own = symbols.join(wanted.select("project", "path", "name").distinct(), ["project", "path", "name"])
    if files is None:
        return own.select("project", "path", "name", "start_byte", "source")
    own = own.join(files.select("project", "path", "content"), ["project", "path"])
    return own.select("project", "path", "name", "start_byte", byte_slice(F.col("content"), F.col("start_byte"), F.least("end_byte", F.octet_length("content"))).alias("source"))


def not_found(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(symbols, ["project", "path", "name"], "left_anti")


def facts_of_name(files: DataFrame, name: str) -> DataFrame:
    """files with the symbols and calls of that name alone (facts), for find_callers.  Both are words of the text, but for the # of a private
    method, so a file without the name is not read."""
    own = with_facts(files.where(F.col("language").isin(PARSED) & F.contains("content", F.lit(name.lstrip("#")))), "symbols", "calls")
    kept = F.struct(F.filter("facts.symbols", lambda x: x["name"] == name).alias("symbols"), F.filter("facts.calls", lambda x: x["callee"] == name).alias("calls"))
    return own.select("project", "path", "language", kept.alias("facts")).where("size(facts.symbols) + size(facts.calls) > 0")


def find_callers(calls: DataFrame, symbols: DataFrame, name: str, path: str, limit: int = 50) -> DataFrame:
    """Calls of that name anywhere, if the symbol exists, without definition lines in its own file."""
    known = symbols.where((F.col("name") == name) & (F.col("path") == path)).select("project").distinct()
    own = calls.where(F.col("callee") == name).join(known, "project", "left_semi")
    own = own.where(~((F.col("path") == path) & is_definition_line(F.col("text"), F.lit(name), F.col("language"))))
    return own.select("project", "path", "line", "text", "start_byte").orderBy("project", "path", "line", "start_byte").limit(limit)


def find_callers_text(files: DataFrame, name: str, path: str, limit: int | None = 50) -> DataFrame:
    """Lines that hold the name, in files without a grammar; limit None: all, unordered."""
    own = files.where(~F.col("language").isin(PARSED) & F.col("content").isNotNull() & F.contains("content", F.lit(name)))
    own = own.select("project", "path", F.posexplode(line_array(F.col("content"))).alias("i", "t")).where(F.contains("t", F.lit(name)))
    own = own.where(~((F.col("path") == path) & is_text_definition_line(F.col("t"), F.lit(name))))
    own = own.select("project", "path", (F.col("i") + 1).alias("line"), trimmed(F.col("t")).alias("text"))
    return own if limit is None else own.orderBy("project", "path", "line").limit(limit)


def remove_files(rows: DataFrame, paths: DataFrame) -> DataFrame:
    return rows.join(paths.select("project", "path"), ["project", "path"], "left_anti")
