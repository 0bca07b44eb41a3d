"""The pipeline against a plain version of all its stages, and its edge cases."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import jaccard_join, line_rules, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def shingles(text):
    w = jaccard_join.words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def write(spark, path, rows, items):
    docs = spark.createDataFrame([(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows], SCHEMA)
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    return docs


def test_pipeline_against_plain_version(spark, tmp_path):
    path, common, item = f"file://{tmp_path}", "this line stands on every page of the host", words(999, 20)
    rows = [(k, f"{words(k, 40)}\n{common}", "h") for k in range(60)]
    rows += [(100 + k, f"{words(7, 39)} edit{k}\n{common}", "h") for k in range(5)]  # near copies of document 7
    rows += [(200, f"{words(200, 30)} {item} {words(201, 30)}", "g"), (201, f"{words(300, 30)} password=hunter2222 end", "g"), (202, "too short", "g"), (203, " ".join(["again and again and"] * 20), "g")]
    rows += [(300, None, None), (301, "", "g"), (302, f"{common}\n{common}", "h"), (303, words(303, 6000), "g"), (303, words(303, 6000), "g"), (None, words(304, 30), None)]
    write(spark, path, rows, [(1, item), (2, None), (3, "")])

    kept = []
    for d, t, s in rows:
        w = (t or "").split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)} if len(w) < 1000 else set()
        if len(w) < 10 or 100 * len(covered) > 20 * len(w):
            continue
        left = "\n".join(x for x in t.split("\n") if s != "h" or x != common)
        if len(left.split()) >= 10 and len(left.split()) >= 0.3 * len(w):
            kept.append((d, left))
    unique = []
    for d, t in kept:
        own = shingles(t)
        if not any(100 * len(own & x) >= 80 * len(own | x) for _, _, x in unique):
            unique.append((d, t, own))
    clean = [(d, t.replace("password=hunter2222", "[assign]")) for d, t, _ in unique if item not in t]
    assert {200, 202, 203, 302, 300, 100}.isdisjoint({d for d, _ in clean}) and {7, 201, 303, None} <= {d for d, _ in clean}
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted((str(d), len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for d, t in clean)
    out = corpus_pipeline.run(spark, path).collect()
    assert sorted({(str(r["doc_id"]), r["doc_tokens"]) for r in out}) == want
    assert sum(r["length"] for r in out) == sum(n for _, n in want)


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_and_edge_rows(spark, tmp_path, stage):
    path = f"file://{tmp_path}"
    rows = [(1, None, None), (2, "", "a"), (2, "", "a"), (None, words(1, 40), "a"), (4, words(2, 40), ""), (4, words(2, 40), ""), (5, "x" * 40_000 + " " + words(3, 20_000), "a")]
    docs = write(spark, path, rows, [(1, "not in any text at all"), (2, None)]).withColumns({k: F.lit(k) for k in ("h", "k1", "d", "b", "cell", "region", "root", "gone", "g_key", "row_key", "item_id", "r")})
    run = corpus_pipeline.STAGES[stage][1]
    out = run(spark, docs, path)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = sorted(str(r["doc_id"]) for r in out.collect())
    assert got == [["4", "4", "5", "None"], ["1", "2", "2", "4", "5", "None"], ["1", "2", "2", "4", "4", "5", "None"], ["1", "2", "2", "4", "4", "5", "None"]][stage]
    assert run(spark, docs.where("false"), path).count() == 0


def test_empty_table_through_all_stages(spark, tmp_path):
    path = f"file://{tmp_path}"
    write(spark, path, [], [])
    assert corpus_pipeline.run(spark, path).count() == 0


def test_texts_are_not_exchanged_for_their_common_lines(spark):
    rows = [(k, f"This line stands in all the texts of host {k % 4}.\n" + "\n".join(words(f"{k} {j}", 12) for j in range(3)), f"h{k % 4}") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # smaller than a row for each text
        out = line_rules.cleaned(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert {r.doc_id: r.text for r in out.collect()} == {k: text.split("\n", 1)[1] for k, text, _ in rows}
