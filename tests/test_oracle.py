"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quarry.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
FEW = ["grep_matches", "chunk_indices", "filter_ignored", "directory_rollup", "snapshot_diff", "call_edges", "test_coverage", "untested_symbols", "implementation", "symbol_shapes", "call_shapes", "variable_shapes", "dedup_shapes", "apply_changes", "maintained_index", "debounce_stream", "definition_lines", "filtered_changes", "definition_events_known", "fold_definitions_known", "activity_stream", "index_lookup", "index_found", "index_names", "folder_files", "folder_part", "folder_changes", "debounce_timers", "index_round_trip", "reject_missing", "variables", "fold_definitions", "fold_marks", "all_history", "debounce_batch"]


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", FEW)
def test_query(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(ORACLES[name])
    at = [[d[0] for d in want.description].index(c) for c in cols]
    assert sorted(str([plain(r[c]) for c in cols]) for r in df.collect()) == sorted(str([plain(r[k]) for k in at]) for r in want.fetchall())
