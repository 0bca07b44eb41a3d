"""Generated files from sorted rows: groups that lie across batches, and no lists in aggregates."""

import random

from pyspark.sql import functions as F

from quarry.plans import corpora


def test_bodies_join_the_lines_of_each_key_in_order(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 0, 1, 2, 3, 40, 41]), k, rnd.choice([None, "a", "é", "xyz"])) for k in range(200)] + [(7, 1, None)]
    rnd.shuffle(rows)
    items = spark.createDataFrame(rows, "k long, n int, c string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 3, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            for some in (items, items.limit(0)):
                found = [tuple(r) for r in corpora._bodies(some, "k", ["n", "c"], F.concat("c", F.lit("\n"))).collect()]
                want = {k: "".join(f"{c}\n" for _, n, c in sorted((r for r in some.collect() if r[0] == k), key=lambda r: r[1]) if c) for k in {r[0] for r in some.collect()}}
                assert dict(found) == want and len(found) == len(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_the_corpus_collects_no_lists(spark):
    plan = corpora.code_corpus(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan  # an aggregate of lists sorts each of them and falls back to sorting beyond 128 keys a task
