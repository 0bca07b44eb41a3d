"""What the Jaccard join compares when many documents share a passage or have no id."""

import random

from quarry.llm import jaccard_join


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_a_shared_passage_costs_pairs_in_proportion(spark, monkeypatch):
    rnd, made = random.Random(1), []
    passage = words(rnd, 60)
    compared = jaccard_join.compared

    def counting(pairs, texts, n):
        made.append(pairs.count())
        return compared(pairs, texts, n)

    monkeypatch.setattr(jaccard_join, "compared", counting)
    total = []
    for n in (150, 300):
        made.clear()
        docs = spark.createDataFrame([(i, f"{words(rnd, 40)} {passage} {words(rnd, 40)}") for i in range(n)], "doc_id long, text string")
        found = jaccard_join.jaccard_components(docs, count_links=False).collect()
        assert len({r.component_id for r in found}) == n
        total.append(sum(made))
    assert total[1] <= 4 * 300, total


def test_order_adds_up_what_parts_repeat(spark):
    rnd = random.Random(2)
    passage = words(rnd, 8)
    docs = spark.createDataFrame([(f"{words(rnd, 20)} {passage}",) for _ in range(60)] + [(words(random.Random(3), 30),)] * 50, "text string").repartition(4)
    h, n = jaccard_join.shingle_order(docs, 5, part_shingles=200)
    assert len(h) == 4 and n.min() > 20  # the passage's four shingles; equal texts count once


def test_many_rows_without_ids(spark):
    rnd = random.Random(4)
    base = [words(rnd, 60) for _ in range(100)]
    rows = [(None, base[i % 100] + f" tail{i % 7}") for i in range(2000)] + [(7, base[0] + " tail0"), (7, base[1] + " tail1")]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), count_links=False).collect()
    assert len(found) == 2002
    assert sum(r.component_id == 7 for r in found) == 2 * 21 and sum(r.component_id is None for r in found) == 2002 - 42
    assert len({r.class_id for r in found}) == 700
