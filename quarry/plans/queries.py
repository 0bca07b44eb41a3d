"""Registered queries over the derived corpora, each with the SQL for the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import names
from quarry.functions.names import is_test_symbol, normalize_kind
from quarry.functions.text import preview, rfc3339
from quarry.operators import content, filters, graph, history, notes, search_index, structure, symbols
from quarry.operators.scratch import DIFFERENCES, SMALL, scratch_path, stored
from quarry.plans import corpora as c
from quarry.plans.corpora import CODE_SQL, DOC_FILES_SQL, URL_FILES_SQL
from quarry.sources import clustered, folder
from quarry.sources.files import read_index, write_index
from quarry.streaming import activity, bursts
from quarry.streaming import changes as ch

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LINES = "lines as (select project, path, language, list_filter(l, lambda x, i: not (i = len(l) and x = '')) as l from (select *, string_split(content, chr(10)) as l from doc_files where content is not null))"
HITS = f"with {DOC_FILES_SQL}, {LINES}, hits as (select project, path, language, i, l[i] as text, l from (select *, unnest(range(1, len(l) + 1)) as i from lines) where regexp_matches(l[i], 'tion'))"


@query(f"{HITS} select project, path, i as line, text, l[greatest(i - 2, 1):i - 1] as context_before, l[i + 1:i + 2] as context_after from hits")
def grep_matches(spark, d):
    return content.matches(c.doc_files(spark, d), "tion")


@query(f"{HITS} select project, path, i as line, text, l[greatest(i - 2, 1):i - 1] as context_before, l[i + 1:i + 2] as context_after from hits order by project, path, i limit 50")
def grep_documents(spark, d):
    return content.grep(c.doc_files(spark, d), "tion")


@query(f"{HITS} select count(*) as total_matches, count(*) > 50 as truncated from hits")
def grep_summary(spark, d):
    return content.grep_summary(c.doc_files(spark, d), "tion")


@query(f"{HITS} select language, count(*) as matches from hits group by language")
def grep_by_language(spark, d):
    return content.grep_count_by(c.doc_files(spark, d), "tion", ["language"])


@query(f"""with {DOC_FILES_SQL}, {LINES}, each as (select project, path, unnest(range(1, len(l) + 1)) as i, unnest(l) as text from lines),
pats as (select item_id, string_split(text, '. ')[1] as p from benchmark), hits as (select item_id as pattern_id, project, path, i as line, text from each join pats on contains(text, p) where p <> '')
select *, count(*) over (partition by pattern_id) as total from hits qualify row_number() over (partition by pattern_id order by project, path, line) <= 5""")
def grep_many(spark, d):
    pats = c.table(spark, d, "benchmark").select(F.col("item_id").alias("pattern_id"), F.get(F.split("text", r"\. "), F.lit(0)).alias("pattern")).where("pattern != ''")
    return content.grep_many(c.doc_files(spark, d), pats, 5, literal=True)


@query(f"""with {DOC_FILES_SQL}, raw as (select project, path, language, string_split(content, chr(10)) as l from doc_files where content is not null),
each as (select project, path, language, len(l) as n, unnest(range(1, len(l) + 1)) as k, unnest(l) as text from raw)
select project, path, language, k as line_no, text, cast(coalesce(sum(strlen(text) + 1) over (partition by project, path order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as start_byte from each
qualify not (k = n and text = '')""")
def lines_offsets(spark, d):
    return content.lines(c.doc_files(spark, d))


@query(f"""with {DOC_FILES_SQL}, {LINES} select project, path, least(2, len(l)) + 1 as start_line, greatest(least(2, len(l)), least(7, len(l))) as end_line, len(l) as total_lines,
array_to_string(list_transform(l[3:7], lambda x, i: printf('%6d │ %s', i + 2, x)), chr(10)) as content from lines""")
def peek_files(spark, d):
    return content.peek(c.doc_files(spark, d), 2, 7)


CHUNKS = f"""with {DOC_FILES_SQL}, t as (select project, path, content, size as total_bytes, unnest(range(0, 1 + cast(ceil(greatest(size - 1000, 0) / 800.0) as bigint))) as k from doc_files where size > 0)"""


@query(f"{CHUNKS} select project, path, k as index, k * 800 as start, least(k * 800 + 1000, total_bytes) as end, total_bytes from t")
def chunk_indices(spark, d):
    return content.chunk_indices(c.doc_files(spark, d), 1000, 200)


@query(f"""{CHUNKS}, signs as (select project, path, strlen(ch) as b, ch, k, coalesce(sum(strlen(ch)) over (partition by project, path order by k rows between unbounded preceding and 1 preceding), 0) as pos
  from (select project, path, unnest(cs) as ch, unnest(range(len(cs))) as k from (select project, path, regexp_extract_all(content, '(?s).') as cs from doc_files)))
select t.project, t.path, cast(t.k as int) as index, cast(min(pos) as bigint) as start, cast(max(pos + b) as bigint) as end, string_agg(ch, '' order by pos) as text
from t join signs s on s.project = t.project and s.path = t.path and s.pos >= t.k * 800 and s.pos < t.k * 800 + 1000 group by t.project, t.path, t.k""")
def chunk_text(spark, d):
    return content.chunk_text(c.doc_files(spark, d), 1000, 200)


@query(f"""with {DOC_FILES_SQL} select project, path, language, size from doc_files where not regexp_matches(path, '^node_modules/|/node_modules/') and not regexp_matches(path, '(^|/)[.]')
and not regexp_matches(path, '[.](min[.]js|lock)$') and size <= 20000""")
def filter_ignored(spark, d):
    f = filters.filter_hidden(filters.filter_ignored_extensions(filters.filter_ignored_dirs(c.doc_files(spark, d))))
    return filters.filter_max_size(f, 20000).select("project", "path", "language", "size")


@query(f"with {DOC_FILES_SQL} select language, count(*) as count from doc_files group by language")
def language_breakdown(spark, d):
    return structure.language_breakdown(c.doc_files(spark, d))


@query(f"with {DOC_FILES_SQL} select count(*) as file_count from doc_files")
def file_count(spark, d):
    return structure.file_count(c.doc_files(spark, d))


@query(f"""with {URL_FILES_SQL}, p as (select project, string_split(path, '/') as p, size from url_files), e as (select project, size, array_to_string(p[1:k], '/') as dir from (select *, unnest(range(1, len(p))) as k from p))
select project, dir, count(*) as files, cast(sum(size) as bigint) as bytes from e group by all""")
def directory_rollup(spark, d):
    return structure.directory_rollup(c.url_files(spark, d))


@query(f"""with {URL_FILES_SQL}, p as (select project, string_split(path, '/') as p from url_files),
nodes as (select distinct project, array_to_string(p[1:k], '/') as path, array_to_string(p[1:k - 1], '/') as parent, p[k] as name, k as depth, k < len(p) as dir from (select project, p, unnest(range(1, len(p) + 1)) as k from p)),
ranked as (select *, row_number() over (partition by project, parent order by name desc) = 1 as ends from nodes),
pre as (select r.project, r.path, string_agg(case when u.ends then '    ' else '│   ' end, '' order by u.depth) as prefix from ranked r join ranked u on u.project = r.project and starts_with(r.path, u.path || '/') group by all)
select project, path, coalesce(prefix, '') || case when ends then '└── ' else '├── ' end || name || case when dir then '/' else '' end as line from ranked left join pre using (project, path)""")
def tree_lines(spark, d):
    return structure.tree_lines(c.url_files(spark, d)).select("project", F.array_join("parts", "/").alias("path"), "line")


@query(f"""with {DOC_FILES_SQL}, o as (select * from doc_files where doc_id % 10 <> 0), n as (select project, path, content || case when doc_id % 7 = 0 then 'x' else '' end as content from doc_files where doc_id % 10 <> 1)
select coalesce(o.project, n.project) as project, coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'deleted' else 'changed' end as status
from o full join n on o.project = n.project and o.path = n.path where o.path is null or n.path is null or o.content <> n.content""")
def snapshot_diff(spark, d):
    f = c.doc_files(spark, d)
    new = f.where("doc_id % 10 != 1").withColumn("content", F.concat("content", F.expr("if(doc_id % 7 = 0, 'x', '')"))).withColumn("size", F.octet_length("content").cast("long"))
    return structure.snapshot_diff(f.where("doc_id % 10 != 0"), new)


@query(f"with {DOC_FILES_SQL} select project, path from doc_files where not (path like '.cache/%' or (ext in ('md', 'toml') and not path like 'src/en/%'))")
def gitignore(spark, d):
    f = c.doc_files(spark, d).select("project", "path", "content")
    rules = f.select("project").distinct().withColumn("path", F.explode(F.array(F.lit(".gitignore"), F.lit("src/en/.gitignore"))))
    rules = rules.withColumn("content", F.expr("if(path = '.gitignore', '# generated\n*.md\n*.toml\n.cache/\n', '!*.md\n!*.toml\n')"))
    return filters.filter_gitignore(f, filters.gitignore_rules(rules)).select("project", "path")


def _facts(spark, d, *wanted):
    """The code corpus after the one lexer pass, with the wanted facts, stored: several operators read it."""
    f = c.code_corpus(spark, d)
    return stored(symbols.with_facts(f.where(F.col("language") != "sql"), *wanted).select("project", "path", "language", "facts"), "facts")


DEFS = f"with {CODE_SQL}"


@query(f"{DEFS} select 'parts' as project, path, name, case when language = 'java' then 'method' else 'function' end as kind, start_line, cast(start_line + n + case when language = 'python' then 0 else 1 end as int) as end_line from defs")
def extract_symbols(spark, d):
    s = symbols.extract_symbols(c.code_corpus(spark, d)).where("kind != 'class'")
    return s.select("project", "path", "name", "kind", "start_line", "end_line")


@query(f"{DEFS} select 'parts' as project, path, name, start_line from defs order by path, start_line limit 100")
def list_symbols(spark, d):
    s = symbols.extract_symbols(c.code_corpus(spark, d)).where("kind != 'class'")
    return symbols.list_symbols(s).select("project", "path", "name", "start_line")


@query(f"{DEFS} select 'parts' as project, path, name, start_line from defs where contains(name, 'supply_1') order by path, start_line limit 20")
def search_symbols(spark, d):
    return symbols.search_symbols(symbols.extract_symbols(c.code_corpus(spark, d)), "SUPPLY_1").select("project", "path", "name", "start_line")


@query(f"{DEFS}, q as (select unnest(['make_part_1', 'order_2', 'supply_3']) as query) select query, path, name, row_number() over (partition by query order by path, start_line) as rank from defs join q on contains(name, query) qualify rank <= 20")
def search_many(spark, d):
    s = symbols.extract_symbols(c.code_corpus(spark, d))
    return symbols.search_many(s, ["make_part_1", "order_2", "supply_3"]).select("query", "path", "name", "rank")


@query(f"{DEFS} select path, count(*) + cast(bool_or(language = 'java') as int) as symbols from defs group by path")
def symbol_count_by_file(spark, d):
    return structure.symbol_count_by(symbols.extract_symbols(c.code_corpus(spark, d)), ["path"])


@query(f"{DEFS} select path, name, 'parts' as project from defs")
def dedup_symbols(spark, d):
    return symbols.dedup_symbols(symbols.extract_symbols(c.code_corpus(spark, d)).where("kind != 'class'")).select("project", "path", "name")


@query(f"""{DEFS}, body as (select path, caller as name, string_agg('    ' || callee || '(x)' || case when language in ('rust', 'typescript', 'javascript', 'java') then ';' else '' end, chr(10) order by line) as calls
  from sites join defs using (path) group by all)
select path, d.name, md5(case language when 'python' then 'def ' || d.name || '(x):' when 'rust' then 'fn ' || d.name || '(x: i32) {{' when 'go' then 'func ' || d.name || '(x int) {{' when 'java' then 'void ' || d.name || '(int x) {{'
  when 'scala' then 'def ' || d.name || '(x: Int) = {{' else 'function ' || d.name || '(x) {{' end || coalesce(chr(10) || calls, '') || case when language = 'python' then '' else chr(10) || '}}' end) as digest
from defs d left join body using (path)""")
def implementation(spark, d):
    s = stored(symbols.extract_symbols(c.code_corpus(spark, d), source=True).where("kind != 'class'").select("project", "path", "name", "start_byte", "source"), "symbols")
    return symbols.implementation(s, None, s.select("project", "path", "name")).select("path", "name", F.md5(F.col("source").cast("binary")).alias("digest"))


def _shapes(spark, d):
    return symbols.with_facts(c.shape_files(spark, d))


@query(f"select path, replace(name, 'N', n) as name, kind, start_line, end_line, replace(parent, 'N', n) as parent from {c.shape_sql(c.SHAPE_SYMBOLS, 'name, kind, start_line, end_line, parent')}")
def symbol_shapes(spark, d):
    return symbols.extract_symbols(_shapes(spark, d)).select("path", "name", "kind", "start_line", "end_line", "parent")


@query(f"select path, replace(callee, 'N', n) as callee, line from {c.shape_sql(c.SHAPE_CALLS, 'callee, line')}")
def call_shapes(spark, d):
    return symbols.extract_calls(_shapes(spark, d)).select("path", "callee", "line")


@query(f"select path, function, name from {c.shape_sql(c.SHAPE_VARIABLES, 'function, line, name')}")
def variable_shapes(spark, d):
    return symbols.all_variables(_shapes(spark, d)).select("path", "function", "name")


@query(f"select path, replace(name, 'N', n) as name, max(start_line) as start_line from {c.shape_sql(c.SHAPE_SYMBOLS, 'name, kind, start_line, end_line, parent')} group by all")
def dedup_shapes(spark, d):
    return symbols.dedup_symbols(symbols.extract_symbols(_shapes(spark, d))).select("path", "name", "start_line")


@query(f"""select path, language, name, kind, parent, cast(octet_length(encode(before)) as bigint) as start_byte, cast(octet_length(encode(before)) + octet_length(encode(body)) as bigint) as end_byte, string_split(body, chr(10))[1] as signature,
  cast(len(before) - len(replace(before, chr(10), '')) + 1 as int) as start_line from {c.form_symbol_sql()}""")
def declared_symbols(spark, d):
    """Declarations of many forms, with their bytes and signatures, in a file per part."""
    return symbols.extract_symbols(c.form_files(spark, d)).select("path", "language", "name", "kind", "parent", "start_byte", "end_byte", "signature", "start_line")


@query(f"select path, callee, caller from {c.form_call_sql()}")
def declared_calls(spark, d):
    """Calls among declarations of many forms, with the functions around them; patterns, signatures and constants are none."""
    return symbols.extract_calls(c.form_files(spark, d)).select("path", "callee", "caller")


@query(f"{DEFS} select path, callee, line from sites")
def call_sites(spark, d):
    return symbols.call_sites(c.code_corpus(spark, d)).select("path", "callee", "line")


@query(f"{DEFS} select path, line, trim(callee) || '(x)' || case when language in ('rust','typescript','javascript','java') then ';' else '' end as text from sites join parts using (path) where callee = 'supply_1' order by path, line limit 50")
def find_callers(spark, d):
    f = stored(symbols.facts_of_name(c.code_corpus(spark, d), "supply_1"), "facts")
    path = "lib/supply_1.rs"
    return symbols.find_callers(symbols.extract_calls(f), symbols.extract_symbols(f), "supply_1", path).select("path", "line", "text")


@query("""with s as (select s_suppkey, 'sql/supply_' || s_suppkey || '.sql' as path from supplier where starts_with(cast(s_suppkey as varchar), '1'))
select path, 1 as line, '-- uses supply_' || s_suppkey as text from s union all select path, 2, 'SELECT supply_' || s_suppkey || '(x);' from s""")
def callers_text(spark, d):
    return symbols.find_callers_text(c.code_corpus(spark, d), "supply_1", "lib/supply_1.rs", None).select("path", "line", "text")


@query(f"{DEFS} select s.path, s.callee, count(*) as n_calls, cast(min(s.line) as int) as first_line, f.path as def_path from sites s join defs f on f.name = s.callee group by all")
def call_edges(spark, d):
    f = _facts(spark, d, "symbols", "callees")
    return graph.call_edges(symbols.count_calls(f), symbols.extract_symbols(f)).select("path", "callee", "n_calls", "first_line", "def_path")


@query(f"""{DEFS}, s as (select callee, count(*) as n_calls, count(distinct path) as n_files from sites group by callee), f as (select name as callee, count(*) as n_defs from defs group by name)
select callee, n_calls, n_files, n_defs, n_files * n_defs as n_edges from s join f using (callee)""")
def call_classes(spark, d):
    return graph.call_classes_of(c.code_corpus(spark, d))


@query(f"{DEFS} select s.path, s.callee, count(*) as n_calls, cast(min(s.line) as int) as first_line, f.path as def_path from sites s join defs f on f.name = s.callee join supplier on s.callee = 'supply_' || s_suppkey where s_acctbal < 0 group by all")
def call_edges_of(spark, d):
    """The edges of the suppliers that owe money, out of the name classes."""
    f = _facts(spark, d, "symbols", "callees")
    names = c.table(spark, d, "supplier").where("s_acctbal < 0").selectExpr("concat('supply_', s_suppkey) as callee")
    return graph.expanded(symbols.count_calls(f), symbols.extract_symbols(f), names).select("path", "callee", "n_calls", "first_line", "def_path")


@query(f"{DEFS} select path, callee, line, caller from sites")
def enclosing_symbol(spark, d):
    return graph.enclosing_symbol(symbols.extract_calls(c.code_corpus(spark, d))).select("path", "callee", "line", "caller")


@query(f"""{DEFS}, one as (select distinct caller as symbol from sites where callee = 'supply_7'), two as (select distinct caller as symbol from sites where callee in (select symbol from one))
select symbol, 1 as depth from one union all select symbol, 2 from two""")
def trace_callers(spark, d):
    return graph.trace_callers(graph.caller_pairs(symbols.extract_calls(c.code_corpus(spark, d))), "supply_7").select("symbol", "depth")


@query(f"""{DEFS}, starts as (select 'supply_' || s_suppkey as start from supplier where s_acctbal < 0), one as (select distinct callee as start, caller as symbol from sites join starts on callee = start),
two as (select distinct o.start, s.caller as symbol from sites s join one o on s.callee = o.symbol) select start, symbol, 1 as depth from one union all select start, symbol, 2 from two anti join one using (start, symbol)""")
def trace_many(spark, d):
    """Everything that calls, at any remove, the suppliers that owe money."""
    starts = c.table(spark, d, "supplier").where("s_acctbal < 0").selectExpr("concat('supply_', s_suppkey) as start")
    return graph.trace_many(graph.caller_pairs_of(c.code_corpus(spark, d)), starts, via=False).select("start", "symbol", "depth")


def _with_test_bodies(spark, d):
    """The symbols, stored, tests with their source."""
    s = symbols.extract_symbols(c.code_corpus(spark, d), source=True).where("kind != 'class'")
    body = F.when(is_test_symbol(F.col("language"), F.col("name"), F.col("path")), F.col("source"))
    return stored(s.select("project", "path", "language", "name", "start_line", "signature", body.alias("source")), "symbols", SMALL)


TESTS = f"{DEFS}, t as (select caller as test, callee from sites where starts_with(caller, 'test_')), names as (select distinct name from defs)"


@query(f"{TESTS} select distinct test as name, 2 as start_line from t where contains(callee, 'make_part_1') order by 'tests/' || test || '.py' limit 20")
def find_tests(spark, d):
    return graph.find_tests(symbols.extract_symbols(c.code_corpus(spark, d), source=True), None, "make_part_1").select("name", "start_line")


@query(f"{TESTS} select distinct test, name from t join (select distinct c.callee, name from (select distinct callee from t) c join names on contains(c.callee, name)) using (callee) union select t.test, names.name from (select distinct test from t) t join names on contains(t.test, names.name)")
def test_coverage(spark, d):
    return graph.test_coverage(_with_test_bodies(spark, d), None).select("test", "name")


@query(f"{TESTS}, seen as (select distinct name from (select distinct callee from t) t join names on contains(callee, name)) select name, path from defs anti join seen using (name) where not starts_with(path, 'tests/')")
def untested_symbols(spark, d):
    return graph.untested_symbols(_with_test_bodies(spark, d), None).select("name", "path")


@query(f"{DEFS} select path, name as function, 'x' as name from defs")
def variables(spark, d):
    return symbols.all_variables(c.code_corpus(spark, d)).select("path", "function", "name")


@query(f"{DEFS} select path, cast(0 as bigint) as start, cast(case when language = 'python' then 13 else 14 end as bigint) as end from defs")
def code_spans(spark, d):
    return symbols.code_spans(c.code_corpus(spark, d)).select("path", "start", "end")


@query(f"{DEFS} select path, cast(line as int) as line from sites where contains(callee, 'supply_1') or callee = 'supply_0'")
def grep_code_scope(spark, d):
    f = c.code_corpus(spark, d).where("language != 'sql'")
    return content.code_matches(f, r"supply_(0|1\d*)\(x\)").where(~F.col("text").contains("{") & ~F.col("text").contains("def ")).select("path", "line")


PART_LINES = f"{DEFS}, h as (select p_partkey as pattern_id, path, line from (select cast(substr(callee, 11) as bigint) as p_partkey, path, line from sites where starts_with(callee, 'make_part_') union all select cast(substr(name, 11) as bigint), path, start_line from defs where starts_with(name, 'make_part_')))"


@query(f"{PART_LINES} select pattern_id, path, cast(line as int) as line, count(*) over (partition by pattern_id) as total from h qualify row_number() over (partition by pattern_id order by path, line) <= 3")
def grep_parts(spark, d):
    """The first lines that name each part, all parts' patterns in one automaton."""
    pats = c.table(spark, d, "part").selectExpr("p_partkey as pattern_id", "concat('make_part_', p_partkey, '(') as pattern")
    return content.grep_many(c.code_corpus(spark, d), pats, 3, literal=True).select("pattern_id", "path", "line", "total")


@query(f"{PART_LINES} select pattern_id, path, cast(line as int) as line from h")
def grep_indexed(spark, d):
    """All lines that name a part, by way of stored trigram postings."""
    f = stored(c.code_corpus(spark, d).withColumn("file", F.monotonically_increasing_id()), "corpus")
    postings = stored(search_index.trigram_lists(f), "postings", DIFFERENCES)
    pats = c.table(spark, d, "part").selectExpr("p_partkey as pattern_id", "concat('make_part_', p_partkey, '(') as pattern")
    return search_index.grep_indexed(f, postings, pats, text=False).select("pattern_id", "path", "line")


@query(f"{DEFS} select path, name from defs where starts_with(path, 'lib/')")
def remove_files(spark, d):
    s = symbols.extract_symbols(c.code_corpus(spark, d)).where("kind != 'class'")
    return symbols.remove_files(s, s.where("path not like 'lib/%'").select("project", "path").distinct()).select("path", "name")


SOURCES = "(select p_partkey, p_name, p_size, case when p_size > 25 then '/srv/code/' else '/opt/' end || lower(replace(p_brand, '#', '')) || '/' || p_partkey || case when p_size < 10 then '.py' when p_size < 20 then '.RS' when p_size < 30 then '.md' when p_size < 40 then '.java' else '' end as path from part)"


def _sources(spark, d):
    """A path for each part, with one of two roots and an extension by its size."""
    return c.table(spark, d, "part").selectExpr("p_name", "p_size > 10 as readable", "concat(if(p_size > 25, '/srv/code/', '/opt/'), lower(replace(p_brand, '#', '')), '/', p_partkey, case when p_size < 10 then '.py' when p_size < 20 then '.RS' when p_size < 30 then '.md' when p_size < 40 then '.java' else '' end) as path")


@query(f"""select path, case when starts_with(path, '/srv/code/') then substr(path, 11) else path end as relative, p_size < 20 or p_size between 30 and 39 as has_symbols, path || '::' || p_name as key, path as key_path, p_name as key_name from {SOURCES}""")
def paths_and_keys(spark, d):
    """Paths relative to a root, languages with symbols, and keys of symbols put together and taken apart."""
    own = _sources(spark, d).withColumn("key", names.symbol_key(F.col("path"), F.col("p_name")))
    of, name = names.split_symbol_key(F.col("key"))
    return own.select("path", names.relative_path(F.col("path"), "/srv/code").alias("relative"), names.has_symbols(names.language_of(F.col("path"))).alias("has_symbols"), "key", of.alias("key_path"), name.alias("key_name"))


@query(f"select path from {SOURCES} where p_size > 10")
def readable_files(spark, d):
    return filters.readable_only(_sources(spark, d)).select("path")


@query("select event_id, strftime(cast(ts as timestamp), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as at from events")
def timestamps(spark, d):
    return c.history(spark, d).select(F.col("seq").alias("event_id"), rfc3339(F.col("ts")).alias("at"))


KIND_ALIASES = ["fn", "func", "VAR", "mod", "use", "class", "bogus"]


@query("select event_id, (list_value('function','function','variable','module','import','class',null))[event_id % 7 + 1] as kind from events")
def normalized_kinds(spark, d):
    return c.table(spark, d, "events").select("event_id", normalize_kind(F.element_at(F.array(*map(F.lit, KIND_ALIASES)), (F.col("event_id") % 7 + 1).cast("int"))).alias("kind"))


LOG = "log as (select 'd' || user_id as path, ts, event_id, case when event_type = 'error' then 'redefine' else 'define' end as op, props as value from events)"


@query(f"with {LOG} select path, coalesce(arg_max(value, (ts, event_id)) filter (where op = 'redefine'), arg_min(value, (ts, event_id))) as value from log group by path")
def fold_definitions(spark, d):
    return notes.fold_definitions(c.annotation_log(spark, d)).select("path", "value")


@query(f"with {LOG} select event_id, op = 'redefine' or row_number() over (partition by path order by ts, event_id) = 1 as accepted from log")
def definition_events(spark, d):
    return notes.definition_events(c.annotation_log(spark, d)).select(F.col("seq").alias("event_id"), "accepted")


MARKS = """marks as (select path, ts, event_id, case m when 'doc' then 'documentation' when 'docs' then 'documentation' when 'tests' then 'test' when 'gen' then 'generated' when 'bogus' then null else m end as mark from
 (select 'd' || user_id as path, ts, event_id, (list_value('doc','docs','test','tests','gen','config','ignore','bogus'))[cast(floor(value) as bigint) % 8 + 1] as m from events))"""


@query(f"with {MARKS}, f as (select path, mark, min((ts, event_id)) as first_seen from marks where mark is not null group by path, mark) select path, list(mark order by first_seen) as marks from f group by path")
def fold_marks(spark, d):
    return notes.fold_marks(c.mark_log(spark, d)).select("path", "marks")


@query("select event_id from events where user_id not in (select doc_id from labels)")
def reject_missing(spark, d):
    known = c.table(spark, d, "labels").selectExpr("'docs' as project", "concat('d', doc_id) as path")
    return notes.reject_missing(c.annotation_log(spark, d), known).select(F.col("seq").alias("event_id"))


@query("select 'd' || doc_id as path, case when quality is not null then 'q' || quality end as definition, case when toxic = 1 then ['ignore'] else [] end as marks, doc_id from documents left join labels using (doc_id)")
def attach_annotations(spark, d):
    files = c.table(spark, d, "documents").selectExpr("doc_id", "'docs' as project", "concat('d', doc_id) as path")
    own = c.table(spark, d, "labels").selectExpr("'docs' as project", "concat('d', doc_id) as path", "explode(array_compact(array(struct('file_definition' as target, concat('q', quality) as value), if(toxic = 1, struct('file_mark' as target, 'ignore' as value), null)))) as e").select("project", "path", "e.*")
    return notes.attach_annotations(files, own).select("path", "definition", F.coalesce("marks", F.array().cast("array<string>")).alias("marks"), "doc_id")


@query("select 'file_definition' as target, count(*) as entries from labels union all select 'file_mark', count(*) from labels where toxic = 1")
def annotation_counts(spark, d):
    own = c.table(spark, d, "labels").selectExpr("explode(array_compact(array('file_definition', if(toxic = 1, 'file_mark', null)))) as target")
    return notes.annotation_counts(own)


HISTORY = "h as (select user_id as session_id, cast(user_id % 5 as varchar) as project, ts, event_id as seq from events)"


@query(f"with {HISTORY} select session_id, seq, row_number() over (partition by session_id order by ts desc, seq desc) as rank from h qualify rank <= 50")
def all_history(spark, d):
    return history.all_history(c.history(spark, d)).select("session_id", "seq", "rank")


@query(f"with {HISTORY} select seq from h where session_id = 1 order by ts desc, seq desc limit 50")
def session_tail(spark, d):
    return history.session_history(c.history(spark, d), 1).select("seq")


@query(f"with {HISTORY} select session_id, min(project) as project, count(*) as history_count, epoch_us(min(ts)) as created_us, epoch_us(max(ts)) as active_us from h group by session_id")
def session_summary(spark, d):
    return history.session_summary(c.history(spark, d)).select("session_id", "project", "history_count", F.unix_micros("created_at").alias("created_us"), F.unix_micros("last_active").alias("active_us"))


@query(f"with {HISTORY} select count(distinct project) as projects, count(distinct session_id) as active_sessions from h")
def totals(spark, d):
    h = c.history(spark, d)
    return history.totals(h, h.select("project"))


@query(f"""with {CODE_SQL}, {HISTORY}, f as (select count(distinct path) as n, sum(1 + cast(language = 'java' as int)) as s from defs), q as (select count(*) as n from supplier)
select '0' as project, f.n + q.n as file_count, cast(f.s as bigint) as symbol_count, (select count(distinct session_id) from h where project = '0') as session_count from f, q""")
def project_summary(spark, d):
    f = c.code_corpus(spark, d).withColumn("project", F.lit("0"))
    return history.project_summary(f, symbols.extract_symbols(f), c.history(spark, d).where("project = '0'")).drop("last_active")


@query(f"with {HISTORY} select session_id, epoch_us(time_bucket(interval '1 hour', ts)) as window_us, count(*) as entries from h group by all")
def activity_windows(spark, d):
    return history.activity_windows(c.history(spark, d)).select("session_id", F.unix_micros("window_start").alias("window_us"), "entries")


@query("select event_id, case when strlen(r) > 200 then r[1:200] || '...' else r end as preview from (select event_id, case when event_id % 50 = 0 then repeat(props, 10) else props end as r from events)")
def previews(spark, d):
    return c.history(spark, d).select(F.col("seq").alias("event_id"), preview(F.col("response_text")).alias("preview"))


BURSTS = """e as (select 'src/f' || user_id || '.py' as path, ts, event_type, event_id, sum(case when prev is null or ts - prev >= interval '30 minutes' then 1 else 0 end) over (partition by user_id order by ts, event_id) as burst
 from (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events))"""


@query(f"with {BURSTS} select path, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as ts_us, count(*) as n_events from e group by path, burst")
def debounce_batch(spark, d):
    out = ch.debounce(c.changes(spark, d), "30 minutes", late=None)
    return out.select("path", F.unix_micros("burst_start").alias("start_us"), F.unix_micros("ts").alias("ts_us"), "n_events")


LAST = """select path, max(ts) as ts, arg_max(op, (ts, op)) as op from (select 'src/f' || user_id || '.py' as path, ts, event_type, case when event_type = 'error' then 'delete' else 'change' end as op from events)"""


@query(f"""with held as (select path, ts from ({LAST} where event_type in ('view', 'click', 'error') group by path) where op = 'change'), last as ({LAST} where event_type not in ('view', 'click') group by path)
select path, epoch_us(case when l.ts is null or l.ts < h.ts then h.ts else l.ts end) as modified_us from held h full join last l using (path) where case when l.ts is null or l.ts < h.ts then true else l.op = 'change' end""")
def apply_changes(spark, d):
    """Views, clicks and deletions make the first state; all but views and clicks are applied to it."""
    all_ = c.changes(spark, d, "event_type")
    empty = all_.selectExpr("project", "path", "size", "modified", "'python' as language", "content").where("false")
    first = ch.apply_changes(empty, all_.where("event_type in ('view', 'click', 'error')").drop("event_type"))
    return ch.apply_changes(first, all_.where("event_type not in ('view', 'click')").drop("event_type")).select("path", F.unix_micros("modified").alias("modified_us"))


@query(f"select path, epoch_us(ts) as modified_us from ({LAST} group by path) where op = 'change'")
def maintained_index(spark, d):
    """The changes as a stream of files, applied to an index micro-batch by micro-batch."""
    at = scratch_path(spark, "live")
    c.changes(spark, d).repartition(4, "path").write.parquet(f"{at}/in")
    ch.maintain_index(ch.read_changes(spark, f"{at}/in", files_per_trigger=1), f"{at}/index", f"{at}/checkpoint").awaitTermination()
    return ch.Index(spark, f"{at}/index").files().select("path", F.unix_micros("modified").alias("modified_us"))


@query(f"with {BURSTS} select path, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as ts_us, count(*) as n_events from e group by path, burst")
def debounce_stream(spark, d):
    """debounce_batch as a stream; an event long after all others closes the last bursts."""
    at = scratch_path(spark, "bursts")
    own = c.changes(spark, d)
    end = own.agg(F.max("ts").alias("ts")).selectExpr("'live' as project", "'end' as path", "ts + interval 10 days as ts", "'change' as op", "cast(0 as bigint) as size", "ts as modified", "'' as content")
    own.unionByName(end).write.parquet(f"{at}/in")
    bursts = ch.debounce(ch.read_changes(spark, f"{at}/in"), "30 minutes", "1 day")
    bursts.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema(bursts.schema).parquet(f"{at}/out").where("path != 'end'").select("path", F.unix_micros("burst_start").alias("start_us"), F.unix_micros("ts").alias("ts_us"), "n_events")


@query(f"with {BURSTS} select path, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as ts_us, count(*) as n_events from e group by path, burst")
def debounce_timers(spark, d):
    """The same bursts by state and timers, with no event after the last; a path's events lie in one file, so that the clock splits no burst."""
    at = scratch_path(spark, "timers")
    c.changes(spark, d).repartition(4, "path").write.parquet(f"{at}/in")
    out = bursts.debounce_quiet(ch.read_changes(spark, f"{at}/in"), gap_ms=1_800_000, quiet_ms=500, late_ms=86_400_000)
    with bursts.rocksdb_state(spark):
        stream = out.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").start(f"{at}/out")
    bursts.drain(stream)
    return spark.read.schema(out.schema).parquet(f"{at}/out").select("path", F.unix_micros("burst_start").alias("start_us"), F.unix_micros("ts").alias("ts_us"), "n_events")


@query(f"{DEFS} select path, name, start_line from defs")
def index_round_trip(spark, d):
    at = scratch_path(spark, "index")
    write_index({"symbols": symbols.extract_symbols(c.code_corpus(spark, d)).where("kind != 'class'")}, at, 1000)
    return read_index(spark, at, "symbols").select("path", "name", "start_line")


@query(f"{DEFS} select d.path, d.name, case when s_acctbal > 0 then s_name end as definition from defs d left join supplier on d.name = 'supply_' || s_suppkey")
def attach_symbol_annotations(spark, d):
    key = F.col("s_suppkey")
    own = c.table(spark, d, "supplier").where("s_acctbal > 0").select(F.lit("parts").alias("project"), F.concat(F.lit("lib/supply_"), key, F.lit("."), c._lang(key, c.EXT)).alias("path"), F.concat(F.lit("supply_"), key).alias("name"), F.lit("symbol_definition").alias("target"), F.col("s_name").alias("value"))
    s = symbols.extract_symbols(c.code_corpus(spark, d)).where("kind != 'class'")
    return notes.attach_symbol_annotations(s, own).select("path", "name", "definition")


@query("with langs as (select list_value('py','rs','ts','js','go','java','scala') as e) select 'lib/supply_' || c_custkey || '.' || e[c_custkey % 7 + 1] as path, 'supply_' || c_custkey as name from customer, langs where c_custkey not in (select s_suppkey from supplier)")
def not_found(spark, d):
    """Symbols asked for by customer keys; only those of suppliers exist."""
    key = F.col("c_custkey")
    wanted = c.table(spark, d, "customer").select(F.lit("parts").alias("project"), F.concat(F.lit("lib/supply_"), key, F.lit("."), c._lang(key, c.EXT)).alias("path"), F.concat(F.lit("supply_"), key).alias("name"))
    return symbols.not_found(symbols.extract_symbols(c.code_corpus(spark, d)), wanted).select("path", "name")


@query(f"""with {DOC_FILES_SQL}, lens as (select project, path, cast(right(cast(size as varchar), 1) as int) as start, list_filter(string_split(content, chr(10)), lambda x, i: not (i = len(string_split(content, chr(10))) and x = '')) as l from doc_files where content is not null),
cut as (select *, least(start, len(l)) as s, greatest(least(start, len(l)), least(start + 4, len(l))) as e from lens)
select project, path, s + 1 as start_line, e as end_line, len(l) as total_lines, array_to_string(list_transform(l[s + 1:e], lambda x, i: printf('%6d │ %s', i + s, x)), chr(10)) as content from cut""")
def peek_ranges(spark, d):
    """Four lines of each file, from the line that the last digit of its size names."""
    f = c.doc_files(spark, d)
    return content.peek_many(f, f.selectExpr("project", "path", "cast(right(cast(size as string), 1) as int) as start", "cast(right(cast(size as string), 1) as int) + 4 as end"))


@query(f"with {HISTORY} select distinct session_id from h where project not in (select cast(r_regionkey as varchar) from region where r_name > 'AMERICA')")
def orphan_sessions(spark, d):
    """Sessions of projects that are gone; the regions after the second are the projects there are."""
    return history.orphan_sessions(c.history(spark, d), c.table(spark, d, "region").where("r_name > 'AMERICA'").selectExpr("cast(r_regionkey as string) as project"))


@query("""with marks as (select path, ts, event_id, later, case m when 'doc' then 'documentation' when 'docs' then 'documentation' when 'tests' then 'test' when 'gen' then 'generated' when 'bogus' then null else m end as mark from
 (select 'd' || user_id as path, ts, event_id, event_type = 'error' as later, (list_value('doc','docs','test','tests','gen','config','ignore','bogus'))[cast(floor(value) as bigint) % 8 + 1] as m from events)),
f as (select path, mark, min((later, ts, event_id)) as seen from marks where mark is not null group by path, mark) select path, list(mark order by seen) as marks from f group by path""")
def merge_marks(spark, d):
    """The marks of errors are added to those of all other events."""
    log = c.mark_log(spark, d, "event_type")
    held, new = (notes.fold_marks(log.where(x)) for x in ("event_type != 'error'", "event_type = 'error'"))
    return notes.merge_marks(held, new).select("path", "marks")


FOLDER_DOCS = f"with {DOC_FILES_SQL}, docs as (select doc_id, path, language, content, size from doc_files where content is not null and size <= 1000000)"


@query(f"{FOLDER_DOCS} select 'docs' as project, path, size, language, md5(content) as digest, true as readable from docs")
def folder_files(spark, d):
    """The documents written as files, hidden folders among them, and the folder read back."""
    at = scratch_path(spark, "folder")
    folder.write_folder(c.doc_files(spark, d), at)
    return folder.read_folder(spark, at, "docs").select("project", "path", "size", "language", F.md5("content").alias("digest"), "readable")


@query(f"{FOLDER_DOCS} select 'docs' as project, path, size, language, md5(content) as digest from docs where starts_with(path, '.cache/en') or starts_with(path, 'src/fr/d1')")
def folder_part(spark, d):
    """Only the folders that can hold such paths are listed."""
    at = scratch_path(spark, "folder")
    folder.write_folder(c.doc_files(spark, d), at)
    return folder.read_folder(spark, at, "docs", [".cache/en", "src/fr/d1"]).select("project", "path", "size", "language", F.md5("content").alias("digest"))


@query(f"""{FOLDER_DOCS}, two as (select path, 'change' as op, content as text from docs where doc_id % 10 <> 0 union all select path, 'delete', null from docs where doc_id % 10 = 1
 union all select path, 'change', content from docs where doc_id % 10 = 0 union all select path, 'change', content || ' more' from docs where doc_id % 10 = 7)
select path, op, cast(coalesce(strlen(text), 0) as bigint) as size, md5(text) as digest from two""")
def folder_changes(spark, d):
    """A folder before and after additions, changes and deletions, told by one stream that is stopped between the two."""
    at = scratch_path(spark, "watched")
    own = c.doc_files(spark, d).where("content is not null and size <= 1000000")
    folder.write_folder(own.where("doc_id % 10 <> 0"), f"{at}/tree")

    def told():
        stream = folder.watch_folder(spark, f"{at}/tree", "docs", f"{at}/listings", max_file_size=2_000_000)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out").awaitTermination()

    told()
    folder.delete_files(own.where("doc_id % 10 = 1"), f"{at}/tree")
    folder.write_folder(own.where("doc_id % 10 = 0"), f"{at}/tree")
    folder.write_folder(own.where("doc_id % 10 = 7").withColumn("content", F.concat("content", F.lit(" more"))), f"{at}/tree")
    told()
    return spark.read.schema(folder.CHANGES).parquet(f"{at}/out").select("path", "op", "size", F.md5("content").alias("digest"))


def _supplies(df, key):
    """The symbol that a supplier's key names, whether there is one or not."""
    k = F.col(key)
    return df.select(F.lit("parts").alias("project"), F.concat(F.lit("lib/supply_"), k, F.lit("."), c._lang(k, c.EXT)).alias("path"), F.concat(F.lit("supply_"), k).alias("name"))


def _clustered(spark, d):
    at = scratch_path(spark, "clustered")
    clustered.write_clustered(symbols.extract_symbols(c.code_corpus(spark, d)), at)
    return at


@query(f"{DEFS} select d.path, d.name, d.start_line from defs d join supplier on d.name = 'supply_' || s_suppkey where s_acctbal > 9000")
def index_lookup(spark, d):
    """Symbols of the largest balances, by a clustered index that gives their row groups alone."""
    return clustered.lookup(spark, _clustered(spark, d), _supplies(c.table(spark, d, "supplier").where("s_acctbal > 9000"), "s_suppkey")).select("path", "name", "start_line")


@query("with langs as (select list_value('py','rs','ts','js','go','java','scala') as e) select 'lib/supply_' || c_custkey || '.' || e[c_custkey % 7 + 1] as path, 'supply_' || c_custkey as name, cast(c_custkey in (select s_suppkey from supplier) as bigint) as n_symbols from customer, langs")
def index_found(spark, d):
    """Symbols asked for by customer keys, with 0 for those that are not there."""
    return clustered.found(spark, _clustered(spark, d), _supplies(c.table(spark, d, "customer"), "c_custkey"), few=1000).select("path", "name", "n_symbols")


@query(f"{DEFS} select path, name, start_line from defs where name in ('supply_3', 'make_part_7', 'test_order_5', 'nowhere')")
def index_names(spark, d):
    return clustered.lookup_names(spark, _clustered(spark, d), ["supply_3", "make_part_7", "test_order_5", "nowhere"]).select("path", "name", "start_line")


@query(f"{DEFS} select path, name, start_line as line from defs")
def definition_lines(spark, d):
    """Of all lines of the code, those that define what their file is named after."""
    named = F.coalesce(*[F.when(F.col("path").rlike(p), F.concat(F.lit(q), F.regexp_extract("path", p, 1))) for p, q in ((r"^src/.*/part_(\d+)[.]", "make_part_"), (r"^lib/supply_(\d+)[.]", "supply_"), (r"^tests/test_order_(\d+)[.]", "test_order_"), (r"^sql/supply_(\d+)[.]", "supply_"))])
    lines = c.code_corpus(spark, d).select("path", "language", named.alias("name"), F.posexplode(content.line_array(F.col("content"))).alias("i", "text"))
    return lines.where(names.is_definition_line(F.col("text"), F.col("name"), F.col("language"))).select("path", "name", (F.col("i") + 1).alias("line"))


@query(f"with {DOC_FILES_SQL} select path, case when size > 600 then 'delete' else 'change' end as op, size from doc_files where not regexp_matches(path, '^node_modules/|/node_modules/') and not regexp_matches(path, '(^|/)[.]') and not regexp_matches(path, '[.](min[.]js|lock)$')")
def filtered_changes(spark, d):
    """Changes of ignored, hidden and large files in a stream: the first two go, the last are deletions."""
    at = scratch_path(spark, "filtered")
    own = c.doc_files(spark, d).select("project", "path", F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("ts"), F.lit("change").alias("op"), "size", F.lit(None).cast("timestamp").alias("modified"), "content")
    own.write.parquet(f"{at}/in")
    stream = ch.filter_changes(ch.read_changes(spark, f"{at}/in"), 600)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out").select("path", "op", "size")


KNOWN = "known as (select distinct 'd' || doc_id as path from labels where quality = 1)"


@query(f"with {LOG}, {KNOWN} select event_id, path in (select path from known) and (op = 'redefine' or row_number() over (partition by path order by ts, event_id) = 1) as accepted from log")
def definition_events_known(spark, d):
    """Events of documents that no label calls good are not accepted."""
    known = c.table(spark, d, "labels").where("quality = 1").selectExpr("'docs' as project", "concat('d', doc_id) as path")
    return notes.definition_events(c.annotation_log(spark, d), known).select(F.col("seq").alias("event_id"), "accepted")


@query(f"with {LOG}, {KNOWN} select path, coalesce(arg_max(value, (ts, event_id)) filter (where op = 'redefine'), arg_min(value, (ts, event_id))) as value from log where path in (select path from known) group by path")
def fold_definitions_known(spark, d):
    known = c.table(spark, d, "labels").where("quality = 1").selectExpr("'docs' as project", "concat('d', doc_id) as path")
    return notes.fold_definitions(c.annotation_log(spark, d), known).select("path", "value")


@query(f"with {HISTORY} select session_id, epoch_us(time_bucket(interval '1 hour', ts)) as window_us, count(*) as entries, epoch_us(max(ts)) as last_us from h group by all")
def activity_stream(spark, d):
    """The log as a stream of four files, its windows counted as they grow."""
    at = scratch_path(spark, "activity")
    log = c.history(spark, d)
    log.repartition(4).write.parquet(f"{at}/in")
    stream = ch.read_changes(spark, f"{at}/in", log.schema, files_per_trigger=1)
    activity.maintain_activity(stream, f"{at}/out", f"{at}/checkpoint", late="3650 days").awaitTermination()
    return activity.current_activity(spark, f"{at}/out").select("session_id", F.unix_micros("window_start").alias("window_us"), "entries", F.unix_micros("last_active").alias("last_us"))
