"""Tables that the registered queries derive from the given ones: files, code, logs and changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ["py", "rs", "ts", "js", "go", "java", "scala", "sql", "md", "min.js", "lock", "RS", "toml", "txt"]
CODE = ["python", "rust", "typescript", "javascript", "go", "java", "scala"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], k: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast({k} as int) + 1)"


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: project, path, size, language, content."""
    from quarry.functions.names import language_of

    d = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "source as project",
        f"concat(case when doc_id % 11 = 0 then 'node_modules/' when doc_id % 13 = 0 then '.cache/' else 'src/' end, lang, '/d', doc_id, '.', {_pick(EXTENSIONS, 'doc_id % 14')}) as path",
        "cast(octet_length(text) as bigint) as size", "text as content",
    )
    return d.withColumn("language", language_of(F.col("path")))


DOC_FILES_SQL = """doc_files as (select *, coalesce(case lower(ext) when 'rs' then 'rust' when 'py' then 'python' when 'ts' then 'typescript' when 'js' then 'javascript' when 'go' then 'go'
  when 'java' then 'java' when 'scala' then 'scala' when 'sql' then 'sql' when 'md' then 'markdown' when 'toml' then 'toml' end, 'other') as language
  from (select doc_id, project, path, size, content, case when ext = 'min.js' then 'js' else ext end as ext from
  (select doc_id, source as project, strlen(text) as size, text as content, (list_value('py','rs','ts','js','go','java','scala','sql','md','min.js','lock','RS','toml','txt'))[doc_id % 14 + 1] as ext,
   case when doc_id % 11 = 0 then 'node_modules/' when doc_id % 13 = 0 then '.cache/' else 'src/' end || lang || '/d' || doc_id || '.' || (list_value('py','rs','ts','js','go','java','scala','sql','md','min.js','lock','RS','toml','txt'))[doc_id % 14 + 1] as path from documents)))"""


def url_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' distinct URL paths as files; paths that are directories of others are left out."""
    p = table(spark, sf_dir, "pages").selectExpr("regexp_extract(url, '^https?://([^/]+)', 1) as project", "ltrim('/', regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)) as path", "cast(octet_length(html) as bigint) as size")
    own = p.where("path != ''").groupBy("project", "path").agg(F.sum("size").alias("size"))
    dirs = own.selectExpr("project", "explode(transform(filter(sequence(1, size(split(path, '/'))), k -> k < size(split(path, '/'))), k -> array_join(slice(split(path, '/'), 1, k), '/'))) as path").distinct()
    return own.join(dirs, ["project", "path"], "left_anti")


URL_FILES_SQL = """raw as (select regexp_extract(url, '^https?://([^/]+)', 1) as project, ltrim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/') as path, strlen(html) as size from pages),
sized as (select project, path, sum(size) as size from raw where path <> '' group by all),
ups as (select distinct project, array_to_string(string_split(path, '/')[1:k], '/') as path from (select project, path, unnest(range(1, len(string_split(path, '/')))) as k from sized)),
url_files as (select * from sized anti join ups using (project, path))"""

COMMENT = {"python": "# supply_0(x)"} | {k: "// supply_0(x)" for k in CODE[1:]}
HEAD = {"python": "def %s(x):", "rust": "fn %s(x: i32) {", "typescript": "function %s(x) {", "javascript": "function %s(x) {", "go": "func %s(x int) {", "java": "void %s(int x) {", "scala": "def %s(x: Int) = {"}
EXT = {"python": "py", "rust": "rs", "typescript": "ts", "javascript": "js", "go": "go", "java": "java", "scala": "scala"}


def _bodies(items: DataFrame, key: str, order: list[str], line: Column) -> DataFrame:
    """key and body: the lines of each key's rows in that order, joined; line is made of key and order columns.  Sorted rows need no lists: the strings of a group lie side by side in a batch."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([last, pa.array(["".join(held)], pa.string())], names=["key", "body"])

        for b in batches:
            if not b.num_rows:
                continue
            keys, lines = b.column(0), b.column(1)
            ends = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
            plain = keys.fill_null(0).to_numpy()
            none = keys.is_null().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate(([True], (plain[1:] != plain[:-1]) | (none[1:] != none[:-1]))))
            own = keys.take(pa.array(starts))
            cuts = ends[np.append(starts, len(lines))]
            text = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts.tobytes()), lines.buffers()[2])
            if last is not None and own[:1] != last:
                yield whole()
                held = []
            last = own[:1]
            held.append(text[0].as_py())
            if len(starts) > 1:
                yield whole()
                yield pa.RecordBatch.from_arrays([own[1:-1], text[1:-1]], names=["key", "body"])
                last, held = own[-1:], [text[-1].as_py()]
        if last is not None:
            yield whole()

    rows = items.select(key, *order).repartition(key).sortWithinPartitions(key, *order).select(key, line)
    return rows.mapInArrow(joined, f"key {items.schema[key].dataType.simpleString()}, body string")


def _source(name, body, key):
    """Text of a generated file: comment, definition, calls, end."""
    out = None
    for k, lang in enumerate(CODE):
        head = F.format_string(COMMENT[lang] + "\n" + ("class P" + "%s {\n" if lang == "java" else "%s") + HEAD[lang] + "\n", key.cast("string") if lang == "java" else F.lit(""), name)
        tail = {"python": "", "java": "}\n}\n"}.get(lang, "}\n")
        text = F.concat(head, body, F.lit(tail))
        out = F.when(key % 7 == k, text) if out is None else out.when(key % 7 == k, text)
    return out


def _lang(key, values: dict[str, str] | None = None):
    return F.element_at(F.array(*[F.lit((values or {}).get(x, x)) for x in CODE]), (key % 7 + 1).cast("int"))


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated source files: project, path, language, content; one per part, supplier and order, and SQL files."""
    items = table(spark, sf_dir, "lineitem")
    ended = F.when(_lang(F.col("l_partkey")).isin("rust", "typescript", "javascript", "java"), ";\n").otherwise("\n")
    part_calls = _bodies(items, "l_partkey", ["l_orderkey", "l_linenumber", "l_suppkey"], F.concat(F.lit("    supply_"), "l_suppkey", F.lit("(x)"), ended))
    part = table(spark, sf_dir, "part").join(part_calls, F.col("p_partkey") == F.col("key"))
    k = F.col("p_partkey")
    parts = part.select(F.lit("parts").alias("project"), F.concat(F.lit("src/"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit("/part_"), k, F.lit("."), _lang(k, EXT)).alias("path"), _lang(k).alias("language"), _source(F.concat(F.lit("make_part_"), k), F.col("body"), k).alias("content"))
    s = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier")
    supply = suppliers.select(F.lit("parts").alias("project"), F.concat(F.lit("lib/supply_"), s, F.lit("."), _lang(s, EXT)).alias("path"), _lang(s).alias("language"), _source(F.concat(F.lit("supply_"), s), F.lit(""), s).alias("content"))
    test_calls = _bodies(items, "l_orderkey", ["l_linenumber", "l_suppkey", "l_partkey"], F.concat(F.lit("    make_part_"), "l_partkey", F.lit("(x)\n")))
    o = F.col("key")
    tests = test_calls.select(F.lit("parts").alias("project"), F.concat(F.lit("tests/test_order_"), o, F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.concat(F.lit("# supply_0(x)\ndef test_order_"), o, F.lit("(x):\n"), "body").alias("content"))
    sql = suppliers.select(F.lit("parts").alias("project"), F.concat(F.lit("sql/supply_"), s, F.lit(".sql")).alias("path"), F.lit("sql").alias("language"), F.concat(F.lit("-- uses supply_"), s, F.lit("\nSELECT supply_"), s, F.lit("(x);\n")).alias("content"))
    return parts.unionByName(supply).unionByName(tests).unionByName(sql)


CODE_SQL = """langs as (select list_value('python','rust','typescript','javascript','go','java','scala') as l, list_value('py','rs','ts','js','go','java','scala') as e),
parts as (select p_partkey, 'src/' || lower(replace(p_brand, '#', '')) || '/part_' || p_partkey || '.' || e[p_partkey % 7 + 1] as path, l[p_partkey % 7 + 1] as language from part, langs
  where p_partkey in (select l_partkey from lineitem)),
supps as (select s_suppkey, 'lib/supply_' || s_suppkey || '.' || e[s_suppkey % 7 + 1] as path, l[s_suppkey % 7 + 1] as language from supplier, langs),
items as (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey) as pos from lineitem),
titems as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey) as pos from lineitem),
defs as (select path, language, 'make_part_' || p_partkey as name, (case when language = 'java' then 3 else 2 end) as start_line, n from parts join (select l_partkey, count(*) as n from lineitem group by 1) on l_partkey = p_partkey
  union all select path, language, 'supply_' || s_suppkey, (case when language = 'java' then 3 else 2 end), 0 from supps
  union all select 'tests/test_order_' || l_orderkey || '.py', 'python', 'test_order_' || l_orderkey, 2, count(*) from titems group by l_orderkey),
sites as (select path, 'make_part_' || l_partkey as caller, 'supply_' || l_suppkey as callee, pos + (case when language = 'java' then 3 else 2 end) as line from items join parts on l_partkey = p_partkey
  union all select 'tests/test_order_' || l_orderkey || '.py', 'test_order_' || l_orderkey, 'make_part_' || l_partkey, pos + 2 from titems)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.selectExpr("user_id as session_id", "cast(user_id % 5 as string) as project", "cast(ts as timestamp) as ts", "event_id as seq", "if(value < 20, 'GET', 'POST') as method", "concat('/', event_type) as path", "if(event_id % 50 = 0, repeat(props, 10), props) as response_text")


def annotation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.selectExpr("'docs' as project", "concat('d', user_id) as path", "cast(null as string) as name", "cast(ts as timestamp) as ts", "event_id as seq", "if(event_type = 'error', 'redefine', 'define') as op", "props as value")


def mark_log(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    marks = ["doc", "docs", "test", "tests", "gen", "config", "ignore", "bogus"]
    e = table(spark, sf_dir, "events")
    return e.selectExpr("'docs' as project", "concat('d', user_id) as path", "cast(ts as timestamp) as ts", "event_id as seq", f"{_pick(marks, 'cast(floor(value) as bigint) % 8')} as mark", *more)


def changes(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.selectExpr("'live' as project", "concat('src/f', user_id, '.py') as path", "cast(ts as timestamp) as ts", "if(event_type = 'error', 'delete', 'change') as op", "cast(octet_length(props) as bigint) as size", "cast(ts as timestamp) as modified", "props as content", *more)


#: A file of each language with the shapes that the generated corpus lacks; N is a supplier's key.
SHAPES = {
    "python": "import re\n\n\nclass ShapeN:\n    def match_all(self, text, *rest, limit=3):\n        (first, last) = re.match(text), type(text)\n        for k, part in rest:\n            first.new(key=k)\n        return last\n\n    def match_all(self):\n        return self.twin()\n\n\ndef twin(a, b: int = 2): return a.switch(b)\n",
    "rust": "struct ShapeN { a: i32 }\nimpl ShapeN {\n    pub fn build(&self, key: i32) -> i32 {\n        let (x, mut y) = Pair::new(key);\n        y.try_into();\n        String::from(x); vec![1]\n    }\n}\nfn twin() { s.match_it(1) } fn other(z: i32) { if (z) > 1 { twin() } }\nconst LIMIT: i32 = 3;\n",
    "typescript": "export class ShapeN {\n  build(text: string) { const x = 1, y = 2; return Array.from(text) }\n  other() { p.catch(e); return new Date(1) }\n}\ninterface ViewN { a: number }\nconst twin = (q: number) => q.match(1)\n",
    "javascript": "class ShapeN { build(text) { return text.match(1) } other() { let { b, c } = this.from(2) } }\nfunction twin(a) { if (a) { p.catch(a) } }\n",
    "go": "package main\n\nconst (\n\tFirst = 1\n\tSecond, Third = 2, 3\n)\n\ntype ShapeN struct {\n\ta int\n}\n\nfunc (s ShapeN) Build(key int) {\n\tx, y := s.Range(key)\n\tvar z int\n\tuse(x, y, z)\n}\n\nfunc twin() {}\n",
    "java": "public class ShapeN {\n  public ShapeN(int a) { this.from(a); }\n  int build(String text) { int x = 1, y = 2; for (String t : list) { t.match(x); } return new ShapeN(y).of(); }\n} class TwinN { void run(){} void stop(){} }\n",
    "scala": "object ShapeN {\n  def build(text: Int) = { val x = text.from(1); x.match_it(2) }\n  def one = 1; def two(a: Int) = one\n}\ntrait ViewN\n",
}
#: What holds of them: (name, kind, first line, last line, parent), (callee, line), (function, its first line, variable).
SHAPE_SYMBOLS = {
    "python": [("ShapeN", "class", 4, 12, None), ("match_all", "method", 5, 9, "ShapeN"), ("match_all", "method", 11, 12, "ShapeN"), ("twin", "function", 15, 15, None)],
    "rust": [("ShapeN", "struct", 1, 1, None), ("build", "method", 3, 7, "ShapeN"), ("twin", "function", 9, 9, None), ("other", "function", 9, 9, None), ("LIMIT", "constant", 10, 10, None)],
    "typescript": [("ShapeN", "class", 1, 4, None), ("build", "method", 2, 2, "ShapeN"), ("other", "method", 3, 3, "ShapeN"), ("ViewN", "interface", 5, 5, None), ("twin", "constant", 6, 6, None)],
    "javascript": [("ShapeN", "class", 1, 1, None), ("build", "method", 1, 1, "ShapeN"), ("other", "method", 1, 1, "ShapeN"), ("twin", "function", 2, 2, None)],
    "go": [("First", "constant", 4, 4, None), ("Second", "constant", 5, 5, None), ("Third", "constant", 5, 5, None), ("ShapeN", "struct", 8, 10, None), ("Build", "method", 12, 16, None), ("twin", "function", 18, 18, None)],
    "java": [("ShapeN", "class", 1, 4, None), ("build", "method", 3, 3, "ShapeN"), ("TwinN", "class", 4, 4, None), ("run", "method", 4, 4, "TwinN"), ("stop", "method", 4, 4, "TwinN")],
    "scala": [("build", "function", 2, 2, "ShapeN"), ("one", "function", 3, 3, "ShapeN"), ("two", "function", 3, 3, "ShapeN"), ("ViewN", "trait", 5, 5, None)],
}
SHAPE_CALLS = {
    "python": [("match", 6), ("type", 6), ("new", 8), ("twin", 12), ("switch", 15)],
    "rust": [("new", 4), ("try_into", 5), ("from", 6), ("vec", 6), ("match_it", 9), ("twin", 9)],
    "typescript": [("from", 2), ("catch", 3), ("match", 6)],
    "javascript": [("match", 1), ("from", 1), ("catch", 2)],
    "go": [("Range", 13), ("use", 15)],
    "java": [("from", 2), ("match", 3), ("ShapeN", 3), ("of", 3)],
    "scala": [("from", 2), ("match_it", 2)],
}
SHAPE_VARIABLES = {
    "python": [("match_all", 5, x) for x in ("text", "rest", "limit", "first", "last", "k", "part")] + [("twin", 15, "a"), ("twin", 15, "b")],
    "rust": [("build", 3, "key"), ("build", 3, "x"), ("build", 3, "y"), ("other", 9, "z")],
    "typescript": [("build", 2, "text"), ("build", 2, "x"), ("build", 2, "y")],
    "javascript": [("build", 1, "text"), ("other", 1, "b"), ("other", 1, "c"), ("twin", 2, "a")],
    "go": [("Build", 12, "key"), ("Build", 12, "x"), ("Build", 12, "y"), ("Build", 12, "z")],
    "java": [("build", 3, "text"), ("build", 3, "x"), ("build", 3, "y"), ("build", 3, "t")],
    "scala": [("build", 2, "text"), ("build", 2, "x"), ("two", 3, "a")],
}


def shape_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each language per supplier: project, path, language, content."""
    langs = F.explode(F.array(*[F.struct(F.lit(x).alias("language"), F.lit(EXT[x]).alias("ext"), F.lit(text).alias("body")) for x, text in SHAPES.items()]))
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("n"), langs.alias("x"))
    return own.selectExpr("'shapes' as project", "concat('shape_', n, '.', x.ext) as path", "x.language", "replace(x.body, 'N', n) as content")


def shape_sql(rows: dict[str, list[tuple]], columns: str) -> str:
    """SQL of what the shapes hold, for every supplier."""
    quoted = [f"({', '.join('null' if v is None else str(v) if isinstance(v, int) else chr(39) + v + chr(39) for v in (EXT[x], *row))})" for x, own in rows.items() for row in own]
    return f"(select 'shape_' || s_suppkey || '.' || ext as path, t.*, cast(s_suppkey as varchar) as n from supplier, (values {', '.join(quoted)}) t(ext, {columns}))"


#: Declarations that need more than one pattern a form.  A part's name fills {n}, its comment {c}; each symbol stands between the signs ⟦ and ⟧.
#: Then (name, kind, parent) of each symbol and (callee, caller) of each call.
FORMS = [
    ("java", "// {c}\n⟦class Box {\n  ⟦@Override public void {n}(int é) { a.b(é); }⟧\n}⟧\n", [("Box", "class", None), ("{n}", "method", "Box")], [("b", "{n}")]),
    ("java", "⟦@Deprecated\npublic final class Box {\n⟦@Test(timeout = 5)\nvoid {n}() throws A, B { go(1); }⟧\n}⟧\n", [("Box", "class", None), ("{n}", "method", "Box")], [("go", "{n}")]),
    ("java", "record R(int a) { /* {c} */ ⟦<T extends C> List<T> {n}(final T x, int... y) { return of(x); }⟧ }\n", [("{n}", "method", None)], [("of", "{n}")]),
    ("java", "⟦enum {n} { ONE(1), TWO(2); {n}(int x) { } ⟦int run() { return ONE.to(2); }⟧ }⟧\n", [("{n}", "enum", None), ("run", "method", "{n}")], [("to", "run")]),
    ("rust", "//! é {c}\n⟦pub(crate) fn {n}(a: i32, b: i32) { if let Some(x) = get(a) { } match b { Ok(y) => f(y), Err(E(z)) if h(z) => { k() } _ => () } }⟧\n", [("{n}", "function", None)], [("get", "{n}"), ("f", "{n}"), ("h", "{n}"), ("k", "{n}")]),
    ("rust", "#[derive(Debug)]\n⟦struct {n}(i32);⟧\nimpl<T> Tr for {n}<T> where T: C { ⟦const fn ü<F: Fn(i32) -> T>(f: F) -> [T; 2] { call::<T>(f) }⟧ }\n", [("{n}", "struct", None), ("ü", "method", "{n}<T>")], [("call", "ü")]),
    ("rust", "⟦trait {n} { fn sig(&self); ⟦fn own(&self) { println!(\"{}\", not(1)) }⟧ }⟧ // {c}\n⟦enum Kind { A(i32), B }⟧\n", [("{n}", "trait", None), ("own", "function", None), ("Kind", "enum", None)], [("println", "own")]),
    ("typescript", "/* {c} */ export ⟦class {n}<T> {\n  ⟦run<U>(a: U): Promise<U> { return f<U>(a) }⟧\n  ⟦#p(x) { this.q(1) }⟧\n  ⟦static async *gen(a) { yield b(a) }⟧\n  sig(a: string): void;\n}⟧\n", [("{n}", "class", None), ("run", "method", "{n}"), ("#p", "method", "{n}"), ("gen", "method", "{n}")], [("f", "run"), ("q", "#p"), ("b", "gen")]),
    ("typescript", "⟦interface {n} { m(a: number): void }⟧\nexport ⟦const f = async (a: number): Promise<void> => g(a);⟧\n⟦type Q<T> = T[];⟧\n", [("{n}", "interface", None), ("f", "constant", None), ("Q", "type", None)], [("g", None)]),
    ("javascript", "// {c}\nexport default ⟦class {n} extends B { ⟦#p() { return q() }⟧ ⟦get v() { return new N(1).m() }⟧ }⟧\n", [("{n}", "class", None), ("#p", "method", "{n}"), ("v", "method", "{n}")], [("q", "#p"), ("m", "v")]),
    ("python", "# {c}\n@app.route('/')\n⟦class {n}(A, metaclass=M):\n    @property\n    ⟦async def é(self, *ys, k: int = f(1)):\n        return {1: g()}⟧⟧\n\n⟦def h(): pass⟧\n", [("{n}", "class", None), ("é", "method", "{n}"), ("h", "function", None)], [("route", None), ("f", "é"), ("g", "é")]),
    ("go", "package p // {c}\n⟦type {n}[T any] struct { a T }⟧\n⟦func (s *{n}[T]) Do(a, b int, cb func(x int) int) (r int, err error) { return cb(a), nil }⟧\n⟦func Map[K comparable](m map[K]int) { s.Do(1) }⟧\n", [("{n}", "struct", None), ("Do", "method", None), ("Map", "function", None)], [("cb", "Do"), ("Do", "Map")]),
    ("scala", "object {n} { // {c}\n  ⟦@tailrec private[this] final def go(a: Int)(b: Int): Int = { go(a)(b) }⟧\n  ⟦def m(o: Option[Int]) = o match {\n    case Some(y) => g(y)\n  }⟧\n}\n", [("go", "function", "{n}"), ("m", "function", "{n}")], [("go", "go"), ("g", "m")]),
]


def _spans_of(marked: str) -> list[tuple[str, str]]:
    """What stands before each symbol, and the symbol, in the order in which they begin."""
    plain, open_, out = "", [], []
    for c in marked:
        if c == "⟦":
            open_.append(len(out))
            out.append((len(plain), 0))
        elif c == "⟧":
            k = open_.pop()
            out[k] = (out[k][0], len(plain))
        else:
            plain += c
    return [(plain[:s], plain[s:e]) for s, e in out]


def form_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per part, with the declarations of one of FORMS: project, path, language, content."""
    forms = F.element_at(F.array(*[F.struct(F.lit(x[0]).alias("language"), F.lit(EXT[x[0]]).alias("ext"), F.lit(x[1].replace("⟦", "").replace("⟧", "")).alias("body")) for x in FORMS]), F.expr(f"cast(p_partkey % {len(FORMS)} + 1 as int)"))
    own = table(spark, sf_dir, "part").select("p_partkey", F.expr("concat(regexp_replace(lower(p_name), '[^a-z]+', '_'), '_', p_partkey)").alias("n"), F.regexp_replace("p_type", "[*/]", " ").alias("c"), forms.alias("x"))
    return own.selectExpr("'forms' as project", "concat('form_', p_partkey, '.', x.ext) as path", "x.language", "replace(replace(x.body, '{n}', n), '{c}', c) as content")


def form_sql(columns: dict[str, list[tuple]]) -> str:
    """SQL rows of the forms: path, and the columns of each form's rows with {n} and {c} filled."""
    (names, rows), = columns.items()
    values = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "null" if v is None else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in row) + ")" for row in rows)
    filled = ", ".join(f"replace(replace({x}, '{{n}}', n), '{{c}}', c) as {x}" for x in names.split(", ")[2:])
    return f"""(select 'form_' || p_partkey || '.' || ext as path, {filled} from (select p_partkey, regexp_replace(lower(p_name), '[^a-z]+', '_', 'g') || '_' || p_partkey as n, regexp_replace(p_type, '[*/]', ' ', 'g') as c from part)
  join (values {values}) t({names}) on p_partkey % {len(FORMS)} = form)"""


def form_symbol_sql() -> str:
    rows = [(k, EXT[x[0]], x[0], *symbol, *span) for k, x in enumerate(FORMS) for symbol, span in zip(x[2], _spans_of(x[1]), strict=True)]
    return form_sql({"form, ext, language, name, kind, parent, before, body": rows})


def form_call_sql() -> str:
    return form_sql({"form, ext, callee, caller": [(k, EXT[x[0]], *call) for k, x in enumerate(FORMS) for call in x[3]]})
