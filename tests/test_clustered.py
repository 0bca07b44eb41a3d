"""Lookups in clustered tables against plain filters, and the rows that their scans read."""

import random

import pytest

from quarry.sources import clustered
from quarry.sources.files import read_index, write_index

SCHEMA = "project string, path string, name string, kind string, start_byte long"


@pytest.fixture
def plain_plans(spark):
    """Plans whose scans can be asked for their metrics."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def scanned(df):
    """Rows that the file scans gave out; row groups that are skipped give none."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [n for n in (leaves.apply(k) for k in range(leaves.size())) if "Scan parquet" in n.nodeName()]
    assert scans
    return sum(n.metrics().apply("numOutputRows").value() for n in scans)


def symbols():
    rnd = random.Random(3)
    rows = [(rnd.choice(["p", "p", "p", "q", None]), f"src/f{k % 997}.py", f"name_{rnd.randrange(10**9):x}_{k % 10}", "function", k) for k in range(20_000)]
    rows += [("p", "src/hot.py", f"gen_{rnd.randrange(10**9)}", "function", k) for k in range(10_000)]  # a third in one file
    return rows + [("p", "src/f1.py", "twice", "function", k) for k in range(2)] + [(None, "src/f1.py", "twice", "class", 5)]


def test_lookups_equal_filters_and_read_few_groups(spark, tmp_path, plain_plans):
    rows, at = symbols(), f"{tmp_path}/index"
    clustered.write_clustered(spark.createDataFrame(rows, SCHEMA), at, rows_per_file=6000, rows_per_group=500)
    assert spark.read.parquet(at).count() == len(rows) and spark.read.parquet(at).select("_metadata.file_path").distinct().count() >= 5
    rnd = random.Random(4)
    wanted = [r[:3] for r in rnd.sample(rows, 5)] + [("p", "src/f1.py", "twice"), ("p", "src/f1.py", "twice"), (None, "src/f1.py", "twice"), ("p", "never.py", "x"), ("p", None, "x"), ("p", "src/f1.py", None)]
    keys = spark.createDataFrame(wanted, "project string, path string, name string")
    want = sorted(map(str, (r for r in rows if r[:3] in set(wanted))))
    for few in (100, 3):  # given to the scan, and joined
        got = clustered.lookup(spark, at, keys, few)
        assert sorted(str(tuple(r)) for r in got.collect()) == want
        if few == 100:
            print("rows read", scanned(got))
            assert 0 < scanned(got) <= 9 * 2 * 500 < len(rows) / 3
    names = [rows[7][2], "twice", "no such name"]
    got = clustered.lookup_names(spark, at, names)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(r) for r in rows if r[2] in names)
    print("rows read", scanned(got))
    assert scanned(got) < len(rows) / 4
    counts = {tuple(r)[:3]: r.n_symbols for r in clustered.found(spark, at, keys).collect()}
    assert counts == {k: sum(r[:3] == k for r in rows) for k in set(wanted)}


def test_empty_tables(spark, tmp_path):
    clustered.write_clustered(spark.createDataFrame([], SCHEMA), f"{tmp_path}/e")
    none = spark.createDataFrame([], "project string, path string, name string")
    one = spark.createDataFrame([("p", "a", "b")], none.schema)
    assert clustered.lookup(spark, f"{tmp_path}/e", one).collect() == [] and clustered.lookup(spark, f"{tmp_path}/e", none).collect() == []
    assert [r.n_symbols for r in clustered.found(spark, f"{tmp_path}/e", one).collect()] == [0]


def test_what_an_index_comes_from_runs_once(spark, tmp_path):
    ran = spark.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    rows = spark.range(500).selectExpr("'p' as project", "concat('f', id) as path", "concat('n', id) as name", "'function' as kind", "id as start_byte").mapInArrow(each, SCHEMA)
    clustered.write_clustered(rows, f"{tmp_path}/clustered", rows_per_file=100)
    assert ran.value == 500 and spark.read.parquet(f"{tmp_path}/clustered").count() == 500
    write_index({"symbols": rows}, f"{tmp_path}/index", 100)
    assert ran.value == 1000 and read_index(spark, f"{tmp_path}/index", "symbols").count() == 500
