"""Streams replayed file by file give what the batch forms give."""

import os

from fleetlens.operators import telemetry, vitals
from fleetlens.streaming import alerts


def replayed(spark, folder, frames, apply, name):
    for i, df in enumerate(frames):
        df.coalesce(1).write.parquet(f"{folder}/{name}-in/{i}")
        for f in os.listdir(f"{folder}/{name}-in/{i}"):
            if f.endswith(".parquet"):
                os.utime(f"{folder}/{name}-in/{i}/{f}", (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}-in/*")
    apply(stream).writeStream.format("parquet").option("path", f"{folder}/{name}-out").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(f"{folder}/{name}-out").collect()


def test_cooldown_outlives_a_batch(spark, tmp_path):
    rows = [("r", x) for x in (0, 899, 900, 1500)] + [("s", 5)], [("r", x) for x in (1700, 1800, 1800, None, 2699)] + [(None, 1)]
    frames = [spark.createDataFrame(r, "rule_id string, at long") for r in rows]
    got = replayed(spark, tmp_path, frames, alerts.fired_alerts, "cooldown")
    want = telemetry.fired_alerts(frames[0].unionByName(frames[1]).where("rule_id is not null")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) == [("r", 0), ("r", 900), ("r", 1800), ("s", 5)]


def test_baselines_outlive_a_batch(spark, tmp_path):
    values = [10.0, 11.0, 9.0, 10.5, 9.5, 10.0, 40.0, 10.0, 90.0]
    store = spark.createDataFrame([(q, i, i, 1, v + q) for q in (1, 2) for i, v in enumerate(values)], "query_id long, captured_at long, event_id long, executions long, total_duration_ms double")
    samples = store.select("query_id", "captured_at", "event_id", store["total_duration_ms"].alias("ms"))
    got = replayed(spark, tmp_path, [samples.where("event_id < 5"), samples.where("event_id >= 5")], alerts.judged_samples, "baseline")
    want = vitals.judged_samples(store).collect()
    assert len(want) > 0 and sorted((r["query_id"], r["event_id"], r["n"], round(r["mean_ms"], 4)) for r in got) == sorted((r["query_id"], r["event_id"], r["n"], r["mean_ms"]) for r in want)


def test_cooldown_of_a_stream_is_by_instance(spark, tmp_path):
    rows = [(1, "r", 0), (2, "r", 10), (1, "r", 899)], [(2, "r", 905), (1, "r", 900), (2, "r", 910)]
    frames = [spark.createDataFrame(r, "instance_id long, rule_id string, at long") for r in rows]
    got = replayed(spark, tmp_path, frames, alerts.fired_alerts, "fleet")
    assert {tuple(r) for r in got} == {(1, "r", 0), (2, "r", 10), (1, "r", 900), (2, "r", 910)}


def test_deltas_of_a_stream(spark, tmp_path):
    from fleetlens.operators import fleet

    snaps = [[(1, 0, "a", 5), (1, 0, "b", 1)], [(1, 60, "a", 9), (1, 60, "b", 1), (1, 60, "c", 4)], [(1, 120, "a", 1), (1, 120, "b", 2)], [(1, 180, "a", 3), (1, 180, "b", 2)], [(1, 9000, "a", 8), (2, 9000, "a", 8)]]
    frames = [spark.createDataFrame(s, "instance_id long, at long, key string, total long") for s in snaps]
    got = replayed(spark, tmp_path, frames, lambda df: alerts.counter_deltas(df, ["total"]), "deltas")
    whole = spark.createDataFrame([r for s in snaps for r in s], "instance_id long, at long, key string, total long").selectExpr("instance_id", "timestamp_seconds(at) as captured_at", "key", "total")
    want = {(r["instance_id"], int(r["captured_at"].timestamp()), r["key"], r["total"]) for r in fleet.trusted_deltas(whole, ["key"], ["total"], ["total"]).collect()}
    assert {tuple(r) for r in got} == want == {(1, 60, "a", 4), (1, 60, "c", 4), (1, 180, "a", 2)}


def test_events_of_a_stream_come_once(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "x"), ("2024-01-01 00:00:01", "x"), ("2024-01-01 00:00:02", None)], [("2024-01-01 01:00:00", "x"), ("2024-01-01 01:00:00", "y")]
    frames = [spark.createDataFrame(r, "at string, text string").selectExpr("cast(at as timestamp) as captured_at", "text") for r in rows]
    got = replayed(spark, tmp_path, frames, lambda df: alerts.events_once(df, "text"), "events")
    assert sorted(r["text"] for r in got) == ["x", "y"]


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def minutes(m, seconds=0):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(minutes=m, seconds=seconds)


def alerts_of(spark, folder, batches, **how):
    """What a stream of captures fires, a file of captures a batch."""
    from fleetlens.streaming import vital_alerts

    schema = "instance_id long, surface string, item string, captured_at timestamp, metrics map<string,double>"
    frames = [spark.createDataFrame(b, schema) for b in batches]
    spark.conf.set(*ROCKS)
    try:
        return sorted(tuple(r) for r in replayed(spark, folder, frames, lambda s: vital_alerts.vital_alerts(s, **how), "vitals"))
    finally:
        spark.conf.unset(ROCKS[0])


def test_vitals_of_a_stream_fire_as_the_batch_does(spark, tmp_path):
    import random

    from pyspark.sql import functions as F

    from fleetlens.streaming.vital_alerts import broken, combined

    rng, captures = random.Random(8), []
    for m in range(40):
        for i in (1, 2):
            captures.append((i, "cpu_pressure_snapshot", "", minutes(m, 10 * i), {"runnable_tasks": float(rng.randrange(5, 14))}))
            captures += [(i, "io_latency_delta", f, minutes(m, 10 * i), {"data_latency_ms": float(rng.randrange(5, 25))}) for f in "ab"]
            captures += [(i, "live_request_snapshot", str(n), minutes(m, 10 * i), {"blocked": 1.0}) for n in range(rng.randrange(3))]
            if m % 15 == 7:
                captures.append((i, "deadlock_capture", "h", minutes(m, 5), {}))
    batches = [[c for c in captures if a <= (c[3] - minutes(0)).seconds // 60 < a + 1] for a in range(40)]
    how = {"period": 60, "cooldown": 300, "window": 120, "late": "0 seconds"}
    got = alerts_of(spark, tmp_path, [*batches, [(9, "cpu_pressure_snapshot", "", minutes(40, 30), {"runnable_tasks": 0.0})]], **how)
    breaches = []
    for i in (1, 2):
        tick = min(c[3] for c in captures if c[0] == i)
        while tick <= minutes(40, 30):
            seen = [c for c in captures if c[0] == i and c[3] <= tick]
            latest = {s: max(c[3] for c in seen if c[1] == s) for s in {c[1] for c in seen} - {"deadlock_capture"}}
            newest = {s: (0, [c[4] for c in seen if c[1] == s and c[3] == at]) for s, at in latest.items()}
            locked = sum(c[1] == "deadlock_capture" and (tick - c[3]).total_seconds() <= 120 for c in seen)
            breaches += [(i, rule, int((tick - minutes(0)).total_seconds())) for rule, *_ in broken(combined(newest, locked))]
            tick = tick + (minutes(1) - minutes(0))
    want = telemetry.fired_alerts(spark.createDataFrame(breaches, "instance_id long, rule_id string, at long"), 300)
    assert {r[2] for r in got} > {"cpu.runnable_tasks_high", "reliability.deadlocks", "reliability.blocking"}
    assert sorted((r[0], r[2], int((r[1] - minutes(0)).total_seconds())) for r in got) == sorted(tuple(r) for r in want.select("instance_id", "rule_id", F.col("fired_at")).collect())


def test_missed_ticks_come_once_and_late_captures_not_at_all(spark, tmp_path):
    cpu = lambda m, v, s=0: (1, "cpu_pressure_snapshot", "", minutes(m, s), {"runnable_tasks": v})
    batches = [[cpu(0, 50.0)], [cpu(1, 50.0)], [cpu(60, 70.0)], [cpu(2, 99.0)], [cpu(61, 70.0, 1)], [cpu(61, 70.0, 30)], [cpu(90, 1.0)]]
    got = alerts_of(spark, tmp_path, batches, period=60, cooldown=60, late="0 seconds")
    assert [(r[1], r[4]) for r in got] == [(minutes(0), 50.0), (minutes(1), 50.0), (minutes(60), 70.0), (minutes(61), 70.0)]  # none between, nor for the hour that was missed


def test_captures_of_stored_tables(spark):
    from fleetlens.sources.tables import TABLES
    from fleetlens.streaming.vital_alerts import _METRICS, captures

    assert set(_METRICS) < set(TABLES)
    row = {"cpu_pressure_snapshot": "4 online_schedulers, 50 runnable_tasks", "memory_headroom_snapshot": "100 page_life_expectancy, 0 total_server_memory_kb", "io_latency_delta": "'d' database_name, 'f' file_logical_name, 'log' file_type, 9.0 avg_read_latency_ms, 7.5 avg_write_latency_ms", "live_request_snapshot": "1 session_id, 2 request_id, 3 blocking_session_id", "plan_cache_snapshot": "0 total_size_kb, 5 single_use_size_kb", "deadlock_capture": "'h' graph_hash"}
    want = {"cpu_pressure_snapshot": {"runnable_tasks": 12.5}, "memory_headroom_snapshot": {"ple_seconds": 100.0}, "io_latency_delta": {"log_latency_ms": 7.5}, "live_request_snapshot": {"blocked": 1.0}, "plan_cache_snapshot": {}, "deadlock_capture": {}}
    for name, columns in row.items():
        rows = spark.sql(f"select 1L instance_id, timestamp '2024-01-01' captured_at, {columns} union all select null, null, {', '.join(c.rsplit(' ', 1)[0] for c in columns.split(', '))}")
        full = spark.createDataFrame([], TABLES[name].ddl).unionByName(rows, allowMissingColumns=True)
        (got,) = captures(name, full).collect()
        assert got["metrics"] == want[name] and got["surface"] == name
