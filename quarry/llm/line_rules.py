"""Quality rules by cross-document line frequency, in built-in functions only.

Lines are normalised (lower case, white space runs to one space, trimmed) and hashed.  Per host (`source`; null and the
empty string are one host without a name) the number of distinct documents that hold a line is counted; rows with the same text count as one document, so
that exact copies do not make each other's lines look like boilerplate.  A line is removed from the documents of a host when
it stands in more than `max_docs` documents and in more than `max_share` of the host's documents.  A document is depleted
when what remains has fewer than `min_words` words or less than `min_left` of its words.

Base rules per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; base_failed when
n_words < 10 or 100 * n_repeat_words > 20 * n_words.  kept is false for base_failed or depleted documents.

cleaned(), the pipeline's stage, goes further: near copies count once, too (`_common_beside_copies`).  line_rules() counts distinct
texts, as the SQL of its query does.

Null and empty texts: all counts 0, base_failed.  Repeated rows and a null doc_id: each row gets its own result.
Windows and lines are compared by 64-bit hashes within one text or one host; a text is known by two 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored, table

WS = r"[ \\t-\\r]"
TRIM = r"' \t\n\x0B\f\r'"


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is worked out once for each row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _base_sql() -> str:
    trimmed = "trim(BOTH ' \\t\\n\\u000B\\f\\r' FROM t)"
    covered = _let(
        "sort_array(transform(g, (h, i) -> struct(h, i)))",
        "s",
        _let(
            "sort_array(transform(filter(s, (x, j) -> (j > 0 and get(s, j - 1).h = x.h) or coalesce(get(s, j + 1).h = x.h, false)), x -> x.i))",
            "p",
            "aggregate(transform(p, (x, j) -> least(5, coalesce(get(p, j + 1) - x, 5))), 0, (a, v) -> a + v)",
        ),
    )
    repeats = f"if(size(w) < 5, 0, {_let('transform(sequence(0, size(w) - 5), i -> xxhash64(slice(w, i + 1, 5)))', 'g', f'if(size(array_distinct(g)) = size(g), 0, {covered})')})"
    words = _let(
        f"if({trimmed} = '', cast(array() as array<string>), split({trimmed}, '{WS}+'))",
        "w",
        f"struct(size(w) as n_words, length(array_join(w, '')) as word_chars, {repeats} as n_repeat_words)",
    )
    lines = _let(f"filter(split(t, '\\n', -1), l -> l rlike '[^ \\\\t-\\\\r]')", "l", "size(l) - size(array_distinct(l))")
    return _let(
        "coalesce({text}, '')",
        "t",
        f"struct({words} as w, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '')) as n_symbols, {lines} as n_dup_lines)",
    )


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, host, the text's two hashes k1 and k2, the base counts and base_failed; the text itself is left behind."""
    held = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), *_keys(text), F.expr(_base_sql().replace("{text}", f"`{text}`")).alias("b"))
    out = held.selectExpr("doc_id", "host", "k1", "k2", *[f"cast({x} as bigint) as {x.rpartition('.')[2]}" for x in ("b.w.n_words", "b.w.word_chars", "b.n_symbols", "b.n_dup_lines", "b.w.n_repeat_words")])
    return out.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def _keys(text: str) -> list:
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2")]


def _normal(text: str) -> str:
    """The normalised lines of a text; lines without a word come out empty."""
    return f"transform(split(regexp_replace(lower(coalesce(`{text}`, '')), '[ \\\\t\\\\x0B\\\\f\\\\r]+', ' '), '\\n', -1), l -> trim(l))"


def common_lines(docs: DataFrame, copies: DataFrame, max_docs: int, max_share: float, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lines, common): each distinct text's distinct lines with their words, and the lines above both limits per host.  copies: host, k1, k2, rows."""
    each = docs.select(F.coalesce("source", F.lit("")).alias("host"), *_keys(text), F.explode(F.expr(f"filter({_normal(text)}, l -> l != '')")).alias("l"))
    each = each.select("host", "k1", "k2", F.xxhash64("l").alias("h"), F.size(F.split("l", " ")).alias("w"))
    # Several rows of one text repeat its lines as often: n is divided out by the number of rows below.
    lines = each.groupBy("host", "h", "k1", "k2").agg(F.sum("w").alias("w"))
    lines = stored(lines, "lines")
    of_host = copies.groupBy("host").agg(F.count("*").alias("n_docs"))
    found = lines.groupBy("host", "h").agg(F.count("*").alias("c")).where(F.col("c") > max_docs)
    common = found.join(of_host, "host").where(F.col("c") > max_share * F.col("n_docs")).select("host", "h")
    return lines, common


def _judged(docs: DataFrame, max_docs: int, max_share: float, text: str = "text") -> DataFrame:
    """One row for each distinct text of a host that lost lines: host, k1, k2 and the words lost by one row."""
    copies = stored(docs.groupBy(F.coalesce("source", F.lit("")).alias("host"), *_keys(text)).agg(F.count("*").alias("rows")), "copies")
    lines, common = common_lines(docs, copies, max_docs, max_share, text)
    # Both sides are keyed by an expression, so both are exchanged and the rows of a very common line can be split.
    common = common.select(F.xxhash64("host", "h").alias("line"), F.col("host").alias("of"), F.col("h").alias("same"))
    hit = lines.withColumn("line", F.xxhash64("host", "h")).join(common, "line").where("host = of and h = same")
    gone = stored(hit.groupBy("host", "k1", "k2").agg(F.sum("w").alias("gone_words")).join(copies, ["host", "k1", "k2"]).selectExpr("host as g_host", "k1 as g1", "k2 as g2", "gone_words div rows as gone_words"), "gone")
    for x in (lines, copies):
        discard(x)
    return gone


def _common_beside_copies(docs: DataFrame, max_docs: int, max_share: float, text: str = "text") -> DataFrame:
    """g_key, g_host and common: the hashes of each host's lines above the limits, where texts that share most of their lines count as one.

    A line above both limits stands in a twentieth of a host's texts (max_share), so a host has at most 20 times as many such lines as a text has on average, however many texts there are.

    A text whose words stand mostly in lines above the limits is either one of a group of near copies, whose lines stand mostly
    in such texts, or made of lines that other texts hold beside their own.  Only the former are grouped, by the one of their
    shared lines that most of such texts hold, so a group with lines edited here and there falls into a few parts, however
    many texts it has.  Lines and texts of the host are then counted anew, each part as one text.
    """
    each = docs.select(F.coalesce("source", F.lit("")).alias("host"), *_keys(text), F.explode(F.expr(f"filter({_normal(text)}, l -> l != '')")).alias("l"))
    each = each.select("host", "k1", "k2", F.xxhash64("l").alias("h"), F.size(F.split("l", " ")).alias("w"))
    lines = stored(each.groupBy("host", "h", "k1", "k2").agg(F.sum("w").alias("w")), "lines")
    trimmed = f"trim(BOTH ' \\t\\n\\u000B\\f\\r' FROM coalesce(`{text}`, ''))"
    copies = docs.select(F.coalesce("source", F.lit("")).alias("host"), *_keys(text), F.expr(f"if({trimmed} = '', 0, size(split({trimmed}, '{WS}+')))").alias("words"))
    copies = stored(copies.groupBy("host", "k1", "k2").agg(F.count("*").alias("rows"), F.first("words").alias("words")), "copies")
    of_host = copies.groupBy("host").agg(F.count("*").alias("n_docs"))
    often = lines.groupBy("host", "h").agg(F.count("*").alias("c")).where(F.col("c") > max_docs)
    often = often.join(of_host, "host").selectExpr("xxhash64(host, h) as line", "host as of", "h as same", "c", f"c > {max_share} * n_docs as above")
    # As in _judged(), a very common line can be split.
    held = lines.withColumn("line", F.xxhash64("host", "h")).join(often, "line").where("host = of and h = same").drop("of", "same")
    held = stored(held.select("host", "k1", "k2", "h", "line", "w", "c", "above"), "held-lines")

    texts = ["host", "k1", "k2"]
    mostly = held.where("above").groupBy(*texts).agg(F.sum("w").alias("gone_words")).join(copies, texts).where("2 * gone_words > rows * words").select(*texts)
    near = stored(held.join(mostly, texts), "near-copies")
    shared = near.where("above").groupBy("line", "c").agg(F.count("*").alias("a")).where("2 * a > c").selectExpr("line as of", "a")
    part = near.where("above").join(shared, F.col("line") == F.col("of")).groupBy(*texts).agg(F.max(F.struct("a", "line")).alias("m")).selectExpr(*texts, "m.line as part")
    part = stored(part, "parts")
    # Of n texts in parts, all but one a part are taken off the counts.
    fewer = near.join(part, texts).groupBy("host", "h", "part").agg(F.count("*").alias("n")).groupBy("host", "h").agg(F.sum(F.expr("n - 1")).alias("less"))
    parts = part.groupBy("host", "part").agg(F.count("*").alias("n")).groupBy("host").agg(F.sum(F.expr("n - 1")).alias("less_docs"))
    counted = held.select("host", "h", "c").distinct().join(fewer, ["host", "h"], "left").join(of_host.join(parts, "host", "left"), "host")
    common = counted.selectExpr("host", "h", "c - coalesce(less, 0) as c", "n_docs - coalesce(less_docs, 0) as n").where(f"c > {max_docs} and c > {max_share} * n")
    out = stored(common.groupBy("host").agg(F.collect_set("h").alias("common")).selectExpr("xxhash64(host) as g_key", "host as g_host", "common"), "common-lines")
    for x in (lines, copies, held, near, part):
        discard(x)
    return out


def line_rules(docs: DataFrame, max_docs: int = 20, max_share: float = 0.05, min_words: int = 10, min_left: float = 0.3) -> DataFrame:
    """Per row of docs (doc_id, text, source): the base counts, base_failed, n_removed_words, depleted and kept."""
    gone = _judged(docs, max_docs, max_share).select(F.xxhash64("g_host", "g1", "g2").alias("t"), "g_host", "g1", "g2", "gone_words")
    base = with_base(docs).withColumn("t", F.xxhash64("host", "k1", "k2"))
    out = base.join(gone, (base.t == gone.t) & (base.host == gone.g_host) & (base.k1 == gone.g1) & (base.k2 == gone.g2), "left")
    left = "n_words - coalesce(gone_words, 0)"
    out = out.withColumn("depleted", F.expr(f"gone_words is not null and ({left} < {min_words} or {left} < {min_left} * n_words)"))
    return out.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "coalesce(gone_words, 0) as n_removed_words", "depleted", "not base_failed and not depleted as kept")


def cleaned(docs: DataFrame, max_docs: int = 20, max_share: float = 0.05, min_words: int = 10, min_left: float = 0.3) -> DataFrame:
    """The kept rows with docs' own columns, without the removed lines, near copies counted once; n_chars follows the text where there is such a column."""
    common = _common_beside_copies(docs, max_docs, max_share)
    held = docs.select(F.struct(*docs.columns).alias("d"), F.coalesce("source", F.lit("")).alias("g_h"))
    # Exploded, so that no filter is pushed below the counts, which would work them out again.
    held = held.select("d", "g_h", F.xxhash64("g_h").alias("g_of"), F.explode_outer(F.array(F.expr(_base_sql().replace("{text}", "d.text")))).alias("b"))
    held = held.where("b.w.n_words >= 10 and 100 * b.w.n_repeat_words <= 20 * b.w.n_words")
    # One array for each host and not a row for each text, so texts need no exchange; where there are very many hosts, both sides are exchanged and a large host can be split.
    held = held.join(common, (F.col("g_of") == F.col("g_key")) & (F.col("g_h") == F.col("g_host")), "left")
    own = f"filter(transform({_normal('d.text').replace('`', '')}, l -> if(l = '', null, struct(xxhash64(l) as h, size(split(l, ' ')) as w))), x -> x is not null)"
    lost = _let(own, "own", _let("array_intersect(own.h, common)", "gone", "if(size(gone) > 0, struct(gone, aggregate(filter(own, x -> array_contains(gone, x.h)), 0L, (n, x) -> n + x.w) as gone_words), null)"))
    out = held.select("d", "b", F.explode_outer(F.array(F.expr(f"if(common is null, null, {lost})"))).alias("lost")).select("d", "b", "lost.gone", "lost.gone_words")
    left = "b.w.n_words - gone_words"
    out = out.where(f"gone is null or not ({left} < {min_words} or {left} < {min_left} * b.w.n_words)")
    normal = "trim(regexp_replace(lower(l), '[ \\\\t\\\\x0B\\\\f\\\\r]+', ' '))"
    text = F.expr(f"if(gone is null, d.text, array_join(filter(split(d.text, '\\n', -1), l -> not array_contains(gone, xxhash64({normal}))), '\\n'))")
    out = out.withColumn("new_text", text).select("d.*", "new_text")
    changed = {"text": F.col("new_text")} | ({"n_chars": F.length("new_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.withColumns(changed).select(*docs.columns)


def op4_line_rules(spark, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with t as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as text, row_number() over () as rid from documents),
w as (select *, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') as ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) as ls,
             list_transform(string_split(regexp_replace(lower(text), '[ \t\x0B\f\r]+', ' ', 'g'), chr(10)), lambda x: trim(x)) as ns from t),
g as (select rid, i, list_aggregate(list_slice(ws, i, i + 4), 'string_agg', ' ') as gram from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from w)),
d as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) as c from g) where c > 1),
r as (select rid, sum(least(5, coalesce(nxt - i, 5))) as n from (select rid, i, lead(i) over (partition by rid order by i) as nxt from d) group by rid),
l as (select rid, host, text, l, len(string_split(l, ' ')) as k from (select rid, host, text, unnest(ns) as l from w) where l <> ''),
h as (select host, count(distinct text) as n from t group by host),
c as (select host, l from (select host, l, count(distinct text) as c from l group by host, l) join h using (host) where c > 20 and c > 0.05 * n),
x as (select rid, sum(k) as gone from l join c using (host, l) group by rid),
b as (select doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
             cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words,
             cast(coalesce(gone, 0) as bigint) as n_removed_words, gone is not null as lost
      from w left join r using (rid) left join x using (rid)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
             lost and (n_words - n_removed_words < 10 or n_words - n_removed_words < 0.3 * n_words) as depleted from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, depleted, not base_failed and not depleted as kept from f
"""
