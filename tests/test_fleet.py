"""Fleet reads, issues, sources, deadlocks and exports on rows by hand."""

import json

from pyspark.sql import functions as F

from fleetlens.operators import advisor, exports, fleet, issues, telemetry
from fleetlens.plans import deadlocks
from fleetlens.sources import files


def test_cooldown_of_one_instance_leaves_others_alone(spark):
    rows = [(1, "r", 0), (2, "r", 10), (1, "r", 890), (2, "r", 905), (1, "r", 905), (2, "r", 910), (1, "r", 905), (1, "s", 3), (3, None, 7), (None, "r", 8), (1, "r", None)]
    got = telemetry.fired_alerts(spark.createDataFrame(rows, "instance_id long, rule_id string, at long")).collect()
    assert {tuple(r) for r in got} == {(1, "r", 0), (2, "r", 10), (2, "r", 910), (1, "r", 905), (1, "s", 3), (3, None, 7), (None, "r", 8)} and len(got) == 7


def test_long_runs_of_breaches_fold_in_order(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(3), f"r{rng.randrange(2)}", rng.randrange(40_000)) for _ in range(3000)]
    want = set()
    for key in {r[:2] for r in rows}:
        last = None
        for t in sorted({r[2] for r in rows if r[:2] == key}):
            if last is None or t - last >= 900:
                want.add((*key, t))
                last = t
    df = spark.createDataFrame(rows, "instance_id long, rule_id string, at long").repartition(3)
    assert {tuple(r) for r in telemetry.fired_alerts(df).collect()} == want


def test_encodings():
    assert files.decoded("é".encode()) == ("é", False, None)
    assert files.decoded(b"\xef\xbb\xbfSELECT 1") == ("SELECT 1", False, None)
    for encoding, mark in (("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")):
        assert files.decoded(mark + "SELECT é".encode(encoding))[:2] == ("SELECT é", False)
        assert files.decoded("SELECT 1 FROM t".encode(encoding))[:2] == ("SELECT 1 FROM t", False)
    assert files.decoded("é".encode("cp1252"))[:2] == ("é", True)
    assert files.decoded(b"") == ("", False, None)


def test_files_are_found_and_told_apart(spark, tmp_path):
    (tmp_path / "a").mkdir()
    texts = {"a/one.SQL": "SELECT 1", "a/two.sql": "-- nothing\n/* at all */ ;", "three.sql": "﻿<ShowPlanXML/>", "four.sql": "lorem ipsum", "five.txt": "SELECT 2"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = files.texts(files.found(spark, str(tmp_path)))
    kinds = {r["path"].rpartition("/")[2]: r["kind"] for r in got.select("path", files.kind(F.col("text")).alias("kind")).collect()}
    assert kinds == {"one.SQL": "sql", "two.sql": "empty", "three.sql": "plan", "four.sql": "unknown"}
    assert {(r["path"].rpartition("/")[2], r["rule"]) for r in files.input_findings(got).collect()} == {("two.sql", "lint.empty_file"), ("four.sql", "lint.unrecognized_input")}
    assert {r["path"].rpartition("/")[2] for r in files.scripts(got).collect()} == {"one.SQL", "four.sql"}


def test_bundles(spark):
    bundle = {"index_usage": [{"schema_name": "[dbo]", "table_name": "T", "index_name": "i", "user_seeks": 3}], "counter_age_secs": 5, "later_field": 1}
    df = files.bundles(spark.createDataFrame([("x", json.dumps(bundle)), ("y", "no bundle"), ("z", None)], "path string, text string"))
    rows = files.row_set(df, "index_usage").collect()
    assert [(r["path"], r["object_key"], r["user_seeks"], r["user_scans"]) for r in rows] == [("x", "dbo.t", 3, None)]
    assert files.row_set(df, "query_skew").count() == 0


def test_deadlock_summary(spark):
    graph = '<deadlock><victim-list><victimProcess id="a"/></victim-list><process-list><process id="a"/><process id="b"/></process-list><resource-list><pagelock objectname="t"><owner-list><owner id="b" mode="IX"/></owner-list><waiter-list><waiter id="a" mode="S"/><waiter id="c" mode="X"/></waiter-list></pagelock><exchangeEvent/></resource-list></deadlock>'
    rows = [(1, graph), (2, None), (3, "<broken"), (4, "<e><data/></e>")]
    events = spark.createDataFrame(rows, "deadlock_id long, xml string")
    assert [tuple(r) for r in deadlocks.summary(events).collect()] == [(1, ["a"], ["t"], True, False)]
    assert deadlocks.edges(events).count() == 2


def test_exports(spark):
    rows = [("a.sql", "hygiene.nolock", "error", 2, 5, 9), ("a.sql", "hygiene.nolock", "error", 1, 1, 0), ("a.sql", "x.y", "info", None, None, None), ("b.sql", "security.xp_cmdshell", "critical", 1, 1, 0)]
    found = spark.createDataFrame(rows, "path string, rule string, severity string, line int, col int, start int")
    told = {r["path"]: json.loads(r["json"]) for r in exports.json_lines(found).collect()}
    assert [(f["rule"], f.get("line")) for f in told["a.sql"]["findings"]] == [("hygiene.nolock", 1), ("hygiene.nolock", 2), ("x.y", None)]
    document = json.loads(exports.sarif(found).first()["sarif"])
    run = document["runs"][0]
    assert document["version"] == "2.1.0" and len(run["results"]) == 4 and {r["id"] for r in run["tool"]["driver"]["rules"]} == {r[1] for r in rows}
    assert {r["level"] for r in run["results"]} == {"error", "note"}
    assert [r["text"][:9] for r in exports.lines(found, 1).where("path = 'a.sql'").orderBy("place").collect()] == ["a.sql:1:1", "a.sql:1:1"]
    assert exports.exit_code(found).first()[0] == 1 and exports.exit_code(found.where("severity = 'info'")).first()[0] == 0
    assert json.loads(exports.sarif(found.limit(0)).first()["sarif"])["runs"][0]["results"] == []


def test_reconciled_issues(spark):
    rows = [
        (1, "a", "advisor", "create_index", "warning", "t", "T", 10, "X;"), (1, "b", "advisor", "create_index", "info", "t", "t", 90, "Y;"), (1, "c", "static", "dmv.missing_index", "error", "t", "t", 5, None),
        (1, "d", "static", "structure.heap_table", "info", "h", "h", 7, None), (1, "e", "static", "structure.no_primary_key", "warning", "h", "h", 8, None), (1, "f", "static", "structure.no_primary_key", "warning", "h", "other", 8, None),
        (1, "g", "monitor", "monitor.blocking", "error", "w", None, 3, None), (2, "c", "static", "dmv.missing_index", "error", "t", "t", 5, None),
    ]
    got = issues.reconciled(spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'instance_id' else 'int' if c == 'impact' else 'string'}" for c in issues.COLUMNS))).collect()
    assert {(r["instance_id"], r["issue_id"], r["severity"], r["impact"], r["fix"], r["merged"]) for r in got} == {(1, "b", "error", 90, "X;\n\nY;", 3), (1, "d", "warning", 8, None, 2), (1, "f", "warning", 8, None, 1), (1, "g", "error", 3, None, 1), (2, "c", "error", 5, None, 1)}


def test_pains_slugs_and_ladders(spark):
    pains = spark.createDataFrame([(1, "LCK_M_X", 120_001, 51, 11), (2, "SLEEP", 900_000, 0, 0), (3, "CXPACKET", 30_000, 501, 1), (4, None, None, None, None)], "instance_id long, top_wait string, top_wait_ms long, blocked long, deadlocks long")
    got = {(r["instance_id"], r["rule"]): r["severity"] for r in issues.from_pains(pains).collect()}
    assert got == {(1, "monitor.top_wait"): "warning", (1, "monitor.blocking"): "warning", (1, "monitor.deadlocks"): "critical", (3, "monitor.top_wait"): "info", (3, "monitor.blocking"): "error", (3, "monitor.deadlocks"): "error"}
    assert spark.range(1).select(issues.slug(F.lit(" 12 Rows, on [dbo].T! "))).first()[0] == "rows-on-dbo-t"
    steps = issues.with_steps(spark.createDataFrame([("locking",), ("?",), (None,)], "kind string"), "kind").collect()
    assert [bool(r["steps"]) for r in steps] == [True, False, False]
    scores = spark.createDataFrame([("merge_index", 0.0), ("merge_index", 1024.0 * 1000), ("rebuild_index", 999.0), ("create_index", 20_000.0), ("drop_index", None)], "kind string, score double")
    assert [r[0] for r in scores.select(issues.recommendation_impact(F.col("kind"), F.col("score"))).collect()] == [0, 3000, 4200, 10_000, 0]
    slower = issues.from_regressions(spark.createDataFrame([(1, 5, 300.0), (1, 6, 99.9)], "instance_id long, query_id long, delta_pct double")).collect()
    assert [(r["issue_id"], r["severity"]) for r in slower] == [("monitor.regression:5", "error"), ("monitor.regression:6", "info")]


def test_snapshot_of_metrics(spark):
    row = lambda schema, *rows: spark.createDataFrame(list(rows), "instance_id long, captured_at long, " + schema)
    found = fleet.metric_snapshot(
        row("runnable long, schedulers long", (1, 1, 9, 1), (1, 2, 40, 4)), row("ple_seconds long, pending_grants long, total_kb long", (1, 1, 500, 2, 8 << 20)), row("single_use_kb long, total_kb long", (1, 1, 1, 4)),
        row("file_type string, read_ms double, write_ms double", (1, 1, "ROWS", 99.0, 1.0), (1, 2, "ROWS", 5.0, 7.0), (1, 2, "LOG", 50.0, 3.0)), row("waiters long", (2, 1, 12)), row("signal_ms long, delta_ms long", (1, 1, 1, 4)),
        row("session_id long, blocking_session_id long, duration_ms double", (1, 1, 5, 6, 1.0)), row("event_id long", (1, 9, 1), (1, 1, 2)), spark.createDataFrame([(1,), (2,)], "instance_id long"), 5)
    got = {r["instance_id"]: r.asDict() for r in found.collect()}
    assert got[1] == {"instance_id": 1, "runnable_tasks": 10.0, "ple_seconds": 500, "pending_grants": 2, "memory_gb": 8.0, "single_use_pct": 25.0, "pagelatch_waiters": None, "data_latency_ms": 7.0, "log_latency_ms": 3.0, "signal_pct": 25.0, "blocked": 1, "deadlocks": 1}
    assert got[2]["pagelatch_waiters"] == 12 and got[2]["deadlocks"] == 0 and got[2]["runnable_tasks"] is None


def test_history_and_stamps(spark):
    indexes = spark.createDataFrame([(1, "t", "i"), (1, "t", "j"), (2, "t", "i")], "instance_id long, table_name string, index_name string")
    history = spark.createDataFrame([(1, "t", "i", 3, 4)], "instance_id long, table_name string, index_name string, days_with_reads int, days_with_writes int")
    assert sorted(map(str, map(tuple, fleet.with_index_history(indexes, history).collect()))) == ["(1, 't', 'i', 3, 4)", "(1, 't', 'j', 0, 0)", "(2, 't', 'i', None, None)"]
    found = spark.createDataFrame([("drop_index", "observed"), ("rebuild_index", "observed")], "kind string, confidence string")
    assert [tuple(r) for r in advisor.stamped(found, 86_399).collect()] == [("drop_index", "estimated", 86_399), ("rebuild_index", "observed", None)]
    seen = advisor.with_days_seen(spark.createDataFrame([("t",), ("u",)], "table_name string"), spark.createDataFrame([("t", 2, 9)], "table_name string, days_seen int, days_observed int")).collect()
    assert {tuple(r) for r in seen} == {("t", "seen on 2 of 9 days"), ("u", None)}


def test_reports_and_hooks(spark):
    rows = spark.createDataFrame([("a<b", 2), ("c", 1)], "name string, n int")
    lines = fleet.report_lines([("First", rows, "concat(name, ' ', n)"), ("Second", rows.limit(0), "name")])
    assert fleet.markdown(lines).first()[0] == "## First\n\n- a<b 2\n- c 1\n\n## Second\n\n- nothing in this window"
    assert "<li>a&lt;b 2</li>" in fleet.html(lines).first()[0]
    alert = spark.createDataFrame([("r", "error", "box", 1.5)], "rule_id string, severity string, instance_name string, value double")
    assert json.loads(fleet.webhook_body(alert, "slack").first()["body"]) == {"text": "[ERROR] r on box value 1.5"}
    assert json.loads(fleet.webhook_body(alert, "teams").first()["body"])["@type"] == "MessageCard"


def test_tables_by_day(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00")], "id long, at string").select("id", F.col("at").cast("timestamp").alias("captured_at"))
    for _ in range(2):
        fleet.stored(df, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 4 and fleet.within(back, "2024-01-02").count() == 2
    once = fleet.inserted_once(df.where("id = 1"), df, "id").collect()
    assert [r["id"] for r in once] == [2]


def test_findings_of_a_run(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "run_id long, place int, rule string")
    assert [r["rule"] for r in fleet.findings_of_run(rows, 1).collect()] == ["a", "b"]
