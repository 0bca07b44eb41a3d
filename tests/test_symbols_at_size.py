"""Symbol queries: what they exchange, and their rows against SQL."""

import os

import duckdb
import pyarrow as pa
import pytest

from quarry.catalog import ORACLES, QUERIES
from quarry.functions import shapes
from quarry.functions.lexer import code_facts
from quarry.operators import graph, symbols
from quarry.plans import corpora as c

SF = "/root/testdata/sf0.001"


def agrees(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    df = QUERIES[name](spark, SF)
    rows = sorted(map(str, con.execute(f"select {', '.join(df.columns)} from ({ORACLES[name]})").fetchall()))
    return rows and sorted(str(tuple(r)) for r in df.collect()) == rows


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_calls_in_brief_are_those_of_each_text_alone():
    texts = [("def a(x):\n    b(1)\n    b(2); c(é)\n    b(3)\n", "python"), ("", "go"), (None, "java"), ("x", "markdown")] + [(f"fn make_{k}() {{\n    supply_{k % 3}(x);\n    supply_1(x);\n    other(supply_{k % 2}(1));\n}}\n", "rust") for k in range(3000)]
    got = shapes.facts_of_batch(pa.array([x[0] for x in texts], pa.string()), pa.array([x[1] for x in texts]), ("callees", "lines", "sites"), {}).to_pylist()
    for (text, language), own in zip(texts, got, strict=True):
        facts = code_facts(text or "", language)
        sites = [(x["callee"], x["line"]) for x in facts["calls"]]
        assert [(x["callee"], x["line"]) for x in own["sites"]] == sites and own["lines"] == facts["lines"]
        assert sorted(tuple(x.values()) for x in own["callees"]) == sorted((n, sum(s[0] == n for s in sites), min(s[1] for s in sites if s[0] == n)) for n in {s[0] for s in sites})


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_call_classes_count_files_where_they_are_read(spark):
    files = c.shape_files(spark, SF).unionByName(c.form_files(spark, SF))
    facts = symbols.with_facts(files)
    want = sorted(map(tuple, graph.call_classes(symbols.extract_calls(facts), symbols.extract_symbols(facts)).collect()))
    assert want and sorted(map(tuple, graph.call_classes_of(files).collect())) == want
    edges = [sorted(map(tuple, graph.call_edges(calls, symbols.extract_symbols(facts)).collect())) for calls in (symbols.extract_calls(facts), symbols.count_calls(files))]
    assert edges[0] == edges[1]
    assert "path" not in plan(QUERIES["call_classes"](spark, SF)).split("Generate")[0]  # above the facts no row names its file
    assert agrees(spark, "call_classes")


def strange(spark):
    """Files with texts beyond ASCII, tests and none, and a null text."""
    rows = [("p", "tests/test_a.py", "python", "# é\ndef test_a(x):\n    b('漢')\n    b(2)\n\ndef b(y): pass\n"), ("p", "src/a.go", "go", "func b(x int) {\n\tb(x)\n}\n"), ("q", "test_b.py", "python", "def test_b(): return cb(b(1))"), ("q", "a.md", "markdown", "b(1)"), ("q", "c.js", "javascript", "class A { # /* */ p() { return this.b(1) } }"), ("q", "n.py", "python", None)]
    return spark.createDataFrame(rows, "project string, path string, language string, content string")


def joins(df):
    return sum(" Join" in line for line in plan(df).splitlines())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_tests_hold_their_bodies_without_a_join(spark):
    files = strange(spark)
    s = symbols.extract_symbols(files)
    want = sorted(map(tuple, graph.tests_of(s, files).collect()))
    assert len(want) == 3 and sorted(map(tuple, graph.tests_of(symbols.extract_symbols(files, source=True), None).collect())) == want
    for path in (None, "src/a.go"):
        assert graph.find_tests(symbols.extract_symbols(files, source=True), None, "b(", path=path).collect() == graph.find_tests(s, files, "b(", path=path).collect()
    assert joins(QUERIES["find_tests"](spark, SF)) == joins(c.code_corpus(spark, SF)) and agrees(spark, "find_tests")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_implementation_joins_no_files(spark):
    files = strange(spark)
    s = symbols.extract_symbols(files)
    want = sorted(map(tuple, symbols.implementation(s, files, s).collect()))
    assert len(want) == 6 and sorted(map(tuple, symbols.implementation(symbols.extract_symbols(files, source=True), None, s).collect())) == want
    assert joins(QUERIES["implementation"](spark, SF)) == 1 and agrees(spark, "implementation")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_call_sites_make_no_texts(spark):
    files = strange(spark)
    columns = ["project", "path", "language", "callee", "line"]
    want = sorted(map(tuple, symbols.extract_calls(files).select(columns).collect()))
    assert want and sorted(map(tuple, symbols.call_sites(files).select(columns).collect())) == want
    assert "caller" not in QUERIES["call_sites"](spark, SF)._jdf.queryExecution().analyzed().toString() + str(symbols.call_sites(files).columns) and agrees(spark, "call_sites")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_callers_are_sought_where_the_name_stands(spark, monkeypatch):
    files = strange(spark)
    for name, path in (("b", "src/a.go"), ("b", "tests/test_a.py"), ("cb", "src/a.go"), ("test_a", "tests/test_a.py"), ("#p", "c.js")):
        own = symbols.facts_of_name(files, name)
        assert symbols.find_callers(symbols.extract_calls(own), symbols.extract_symbols(own), name, path).collect() == symbols.find_callers(symbols.extract_calls(files), symbols.extract_symbols(files), name, path).collect()
        assert sorted(symbols.extract_symbols(own).collect()) == sorted(symbols.extract_symbols(files).where(f"name = '{name}'").collect())
        assert all({x["name"] for x in r.facts["symbols"]} | {x["callee"] for x in r.facts["calls"]} == {name} for r in own.collect())
    kept, own = [], symbols.facts_of_name
    monkeypatch.setattr(symbols, "facts_of_name", lambda *a: kept.append(own(*a)) or kept[-1])
    assert agrees(spark, "find_callers") and "supply_1)" in plan(kept[0])
