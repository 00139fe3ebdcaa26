"""The telemetry store: whole commits, pinned readers, merges by key, retention, streams."""

import os
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import fleet
from fleetlens.sources import store as stores
from fleetlens.sources.store import Conflict, Store, opened
from fleetlens.sources.tables import TABLES

DAY = datetime(2024, 1, 10)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def runs(spark, *ids, at=DAY):
    return spark.createDataFrame([(i, at) for i in ids], "id string, occurred_at timestamp")


def findings(spark, *rows):
    return spark.createDataFrame(list(rows), "run_id string, rule_id string")


def ids(snapshot, table="analysis_runs", column="id"):
    return sorted(r[0] for r in snapshot.read(table).select(column).collect())


def test_parents_and_children_show_together(spark, store):
    store.write({"analysis_runs": runs(spark, "a"), "analysis_findings": findings(spark, ("a", "r"), ("a", "s"))})
    before = store.snapshot()
    broken = findings(spark, ("b", "x")).withColumn("rule_id", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.write({"analysis_runs": runs(spark, "b"), "analysis_findings": broken})
    assert ids(store.snapshot()) == ["a"] and ids(store.snapshot(), "analysis_findings", "rule_id") == ["r", "s"] and store.versions() == [1]
    store.write({"analysis_runs": runs(spark, "b"), "analysis_findings": findings(spark, ("b", "x"))})
    assert ids(store.snapshot()) == ["a", "b"] and ids(before) == ["a"]


def test_a_writer_killed_between_stage_and_commit_leaves_nothing_to_see(spark, store, monkeypatch):
    store.write({"analysis_runs": runs(spark, "a")})
    monkeypatch.setattr(stores.Files, "published", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.write({"analysis_runs": runs(spark, "b"), "analysis_findings": findings(spark, ("b", "x"))})
    monkeypatch.undo()
    assert ids(store.snapshot()) == ["a"] and store.snapshot().read("analysis_findings").count() == 0
    assert store.vacuum() == 0 and store.vacuum(grace_hours=0) == 2 and ids(store.snapshot()) == ["a"]


def test_readers_beside_writers(spark, store, tmp_path):
    assert opened(spark, str(tmp_path / "nothing")) is None and opened(spark, store.root) is None
    store.write({"analysis_runs": runs(spark, "a")})
    pinned = opened(spark, store.root)
    rows = pinned.read("analysis_runs")
    store.write({"analysis_runs": runs(spark, "b")})
    store.compact("analysis_runs")
    assert [r["id"] for r in rows.collect()] == ["a"] and ids(pinned) == ["a"] and not hasattr(pinned, "write")
    assert ids(opened(spark, store.root)) == ["a", "b"] and store.manifest().version == 3


def test_writers_at_the_same_time_lose_nothing(spark, store):
    many = [threading.Thread(target=store.write, args=({"analysis_runs": runs(spark, f"r{i}")},)) for i in range(6)]
    for t in many:
        t.start()
    for t in many:
        t.join()
    assert ids(store.snapshot()) == [f"r{i}" for i in range(6)] and store.versions() == list(range(1, 7))


def test_upserts_merge_on_read_and_compact_only_what_changed(spark, store):
    schema = "instance_id long, query_id long, count long, last_updated timestamp"
    first = spark.createDataFrame([(1, q, 1, DAY) for q in range(200)], schema)
    changes = spark.createDataFrame([(1, 3, 9, DAY + timedelta(1)), (1, 4, 8, DAY - timedelta(1)), (1, 5, 7, DAY), (None, 3, 5, DAY), (1, 900, 2, None)], schema)
    store.write({"query_baseline": first})
    before = {p.value: p.commit for p in store.manifest().parts["query_baseline"]}
    store.write({"query_baseline": changes})
    want = sorted(str(tuple(r)) for r in fleet.upserted(first, changes, ["instance_id", "query_id"], "last_updated").collect())
    read = lambda: sorted(str(tuple(r)) for r in store.snapshot().read("query_baseline").select(first.columns).collect())
    assert read() == want
    touched = {p.value for p in store.manifest().parts["query_baseline"][len(before):]}
    store.compact("query_baseline")
    after = {p.value: p.commit for p in store.manifest().parts["query_baseline"]}
    assert read() == want and {v for v in after if after[v] != before.get(v)} == touched and len(touched) < len(before)


def test_the_first_deadlock_of_a_graph_stays(spark, store):
    schema = "instance_id long, captured_at timestamp, xml_blob string, graph_hash string"
    store.write({"deadlock_capture": spark.createDataFrame([(1, DAY, "one", "h"), (1, DAY - timedelta(1), "earlier", "h")], schema)})
    store.write({"deadlock_capture": spark.createDataFrame([(1, DAY - timedelta(9), "again", "h"), (2, DAY, "other", "h")], schema)})
    for _ in range(2):
        assert sorted(r["xml_blob"] for r in store.snapshot().read("deadlock_capture").collect()) == ["earlier", "other"]
        store.compact("deadlock_capture")


def test_retention_drops_days_and_cuts_the_edge(spark, store):
    hours = spark.createDataFrame([(1, DAY + timedelta(hours=6 * i)) for i in range(-12, 12)] + [(1, None)], "instance_id long, captured_at timestamp")
    aging = [t for t in TABLES.values() if t.ages]
    store.write({t.name: hours.select("instance_id", F.col("captured_at").alias(t.at), *[F.monotonically_increasing_id().cast("string").alias(k) for k in t.keys if k != "instance_id" and not k.endswith("_id")], *[F.monotonically_increasing_id().alias(k) for k in t.keys if k == "query_id"]) for t in aging})
    store.write({"analysis_runs": runs(spark, "old", at=DAY - timedelta(900))})
    cutoff, pinned = DAY + timedelta(hours=9), store.snapshot()
    left = {t.name: sorted(map(str, fleet.kept_since(pinned.read(t.name), cutoff, t.at).collect())) for t in aging}
    removed = store.prune(cutoff)
    assert removed == {t.name: 14 for t in aging} and len(aging) == 14
    for t in aging:
        assert sorted(map(str, store.snapshot().read(t.name).collect())) == left[t.name] and pinned.read(t.name).count() == 25
    assert ids(store.snapshot()) == ["old"] and store.prune(cutoff) == {}
    assert store.vacuum(keep=1, grace_hours=0) > 0
    days = {d for t in aging if not t.keys for c in os.listdir(f"{store.root}/data/{t.name}") for d in os.listdir(f"{store.root}/data/{t.name}/{c}") if d.startswith("day=2")}
    assert min(days) == "day=2024-01-10"
    for t in aging:
        assert sorted(map(str, store.snapshot().read(t.name).collect())) == left[t.name]


def test_windows_read_only_their_days(spark, store):
    rows = spark.createDataFrame([(1, DAY + timedelta(days=i)) for i in range(8)], "instance_id long, captured_at timestamp")
    store.write({"cpu_pressure_snapshot": rows})
    inside = store.snapshot().read("cpu_pressure_snapshot", DAY + timedelta(days=2), DAY + timedelta(days=4))
    assert inside.count() == 2 and len(inside.inputFiles()) <= 3
    assert fleet.within(store.snapshot().read("cpu_pressure_snapshot"), DAY + timedelta(days=2), DAY + timedelta(days=4)).count() == 2


def test_a_change_against_replaced_folders_is_refused(spark, store):
    for i in "ab":
        store.write({"analysis_runs": runs(spark, i)})
    old = store.manifest().parts["analysis_runs"]
    store.compact("analysis_runs")
    with pytest.raises(Conflict):
        store.publish(lambda m: m.changed("analysis_runs", old, ()))
    with pytest.raises(ValueError, match="no column"):
        store.write({"analysis_runs": runs(spark, "c").withColumn("other", F.lit(1))})
    assert ids(store.snapshot()) == ["a", "b"]


def test_batches_of_a_stream_count_once(spark, store, tmp_path):
    for i in range(3):
        runs(spark, f"s{i}").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("id string, occurred_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    pinned = store.snapshot()
    for checkpoint in ("one", "two"):  # the second replays all batches, as after a lost checkpoint
        store.sink(stream, "analysis_runs", "runs", str(tmp_path / checkpoint)).awaitTermination(120)
        assert ids(store.snapshot()) == ["s0", "s1", "s2"]
    assert store.manifest().batches == {"runs": 2} and pinned.read("analysis_runs").count() == 0


def test_monthly_folders(spark, store):
    store.write({"analysis_runs": runs(spark, "a", at=datetime(2024, 1, 31)).unionByName(runs(spark, "b", at=datetime(2024, 2, 1))).unionByName(runs(spark, "c", at=datetime(2024, 2, 29)))})
    shot = store.snapshot()
    assert [p.value for p in shot.parts("analysis_runs")] == ["2024-01-01", "2024-02-01"]
    assert sorted(r["id"] for r in shot.read("analysis_runs", datetime(2024, 2, 1), datetime(2024, 2, 29)).collect()) == ["b"]
    assert store.prune(datetime(2024, 2, 10), ["analysis_runs"]) == {"analysis_runs": 2} and ids(store.snapshot()) == ["c"]


def test_vitals_are_cut_before_they_meet(spark):
    from fleetlens.operators import vitals

    rows = spark.createDataFrame([(1, DAY + timedelta(hours=i % 50), i) for i in range(200)] + [(2, None, 1)], "instance_id long, captured_at timestamp, runnable_tasks long")
    newest = vitals.newest_ticks(rows, 3)
    assert newest.count() == 12 and "WindowGroupLimit" in newest._jdf.queryExecution().executedPlan().toString()
    table = lambda name: rows if name == "cpu_pressure_snapshot" else spark.createDataFrame([], TABLES[name].ddl)
    got = {r["instance_id"]: r for r in vitals.deep_vitals(spark.createDataFrame([(1,), (2,), (3,)], "instance_id long"), table, points=3).collect()}
    assert got[1]["has_data"] and [p["value"] for p in got[1]["cpu_runnable_tasks"]] == [197.0, 198.0, 199.0] and got[1]["cpu_pressure"]["runnable_tasks"] == 199 and got[1]["io_latency"] == [] and got[1]["memory_headroom"] is None
    assert not got[2]["has_data"] and got[3]["captured_at"] is None and got[3]["memory_ple"] == []
