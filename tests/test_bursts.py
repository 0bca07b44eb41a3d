"""Debouncing by timers against plain sorting: events in any order, over several batches, with nulls, and no event after the last burst."""

import random
from datetime import UTC, datetime, timedelta

from quarry.streaming import bursts
from quarry.streaming import changes as ch

BASE = datetime(2024, 1, 1, tzinfo=UTC)


def plain(events, gap):
    out = {}
    for e in sorted(events, key=lambda e: (e[0] or "", e[1] or "", bursts._rank(e[2:]))):
        key, held = e[:2], out.setdefault(e[:2], [])
        if held and e[2] - held[-1][1] < gap:
            held[-1] = (held[-1][0], e[2], held[-1][2] + 1, max(held[-1][3], e[2:], key=bursts._rank))
        else:
            held.append((e[2], e[2], 1, e[2:]))
    return {(k, *b) for k, v in out.items() for b in v}


def test_bursts_merge_in_any_order():
    rnd = random.Random(4)
    for _ in range(300):
        events = [("p", "a", rnd.randrange(200), rnd.choice([None, "x", "y"])) for _ in range(rnd.randrange(1, 40))]
        held, rest = [], list(events)
        while rest:  # several batches
            n = rnd.randrange(1, len(rest) + 1)
            held, rest = bursts.merged(held, (e[2:] for e in rest[:n]), 7), rest[n:]
        assert {(("p", "a"), *b) for b in held} == plain(events, 7)
        assert held == sorted(held, key=lambda b: b[0])


def test_stream_closes_bursts_by_the_clock(spark, tmp_path):
    rnd = random.Random(5)
    rows = []
    for k in range(120):
        at = BASE + timedelta(seconds=rnd.randrange(4000), microseconds=rnd.randrange(3))
        rows.append((rnd.choice(["p", "p", None]), rnd.choice(["a", "a", "b", None]), at, rnd.choice(["change", "delete"]), rnd.choice([None, k]), rnd.choice([None, at]), rnd.choice([None, "", "text"])))
    for k in range(3):  # three batches, in no order of time
        spark.createDataFrame(rows[k::3] + ([("p", "a", None, "change", 1, None, "no time")] if k == 0 else []), ch.SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    before = spark.conf.get(bursts.PROVIDER)
    stream = bursts.debounce_quiet(ch.read_changes(spark, f"{tmp_path}/in/*", files_per_trigger=1), gap_ms=60_000, quiet_ms=12_000, late_ms=3_600_000 * 2)
    with bursts.rocksdb_state(spark):
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="0 seconds").start(f"{tmp_path}/out")
    assert spark.conf.get(bursts.PROVIDER) == before
    bursts.drain(query, 120)
    got = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()
    batch = ch.debounce(spark.createDataFrame(rows, ch.SCHEMA), "60 seconds", late=None).select(stream.columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, batch)) and len(got) > 20


def test_long_lived_paths_give_bursts_before_they_are_quiet(spark, tmp_path):
    for k in range(2):
        at = BASE + timedelta(hours=k)
        spark.createDataFrame([("p", "a", at, "change", k, at, "x")], ch.SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = bursts.debounce_quiet(ch.read_changes(spark, f"{tmp_path}/in/*", files_per_trigger=1), gap_ms=500, quiet_ms=3_600_000, late_ms=10_000)
    with bursts.rocksdb_state(spark):
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination(120)
    query.stop()
    assert [(r["size"], r.n_events) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(0, 1)]  # the second is still open


def test_empty_stream_drains(spark, tmp_path):
    spark.createDataFrame([], ch.SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = bursts.debounce_quiet(ch.read_changes(spark, f"{tmp_path}/in"), quiet_ms=100)
    with bursts.rocksdb_state(spark):
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").start(f"{tmp_path}/out")
    bursts.drain(query, 60)
