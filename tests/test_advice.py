from pyspark.sql import functions as F

from fleetlens.operators import advisor, health, vitals


def test_prefixes_fold_into_longer_keys(spark):
    rows = [("t", ["a"], ["x"], 10.0, 1.0, 5), ("t", ["a", "b"], ["y"], 20.0, 2.0, 7), ("t", ["a", "b"], None, 5.0, 9.0, 1), ("t", ["b"], [], 1.0, 1.0, 1), ("u", ["a"], [], 1.0, 1.0, 1)]
    got = advisor.without_prefixes(spark.createDataFrame(rows, "table_name string, key_columns array<string>, included_columns array<string>, impact double, cost double, seeks long")).collect()
    assert {(r["table_name"], tuple(r["key_columns"]), r["impact"], r["cost"], r["seeks"]) for r in got} == {("t", ("a", "b"), 20.0, 9.0, 13), ("t", ("b",), 1.0, 1.0, 1), ("u", ("a",), 1.0, 1.0, 1)}


def test_structure_findings_at_their_limits(spark):
    rows = [("a", 999, True, 0, True, None, None), ("b", 1_000, True, 1_000, True, None, None), ("c", 100_000, True, 0, False, None, None), ("d", 1_000_000, None, None, False, ["uniqueidentifier"], 20), ("e", None, True, 9, None, ["int"] * 4, None), ("f", 99, False, 0, False, ["int"], 17)]
    got = advisor.structure_findings(spark.createDataFrame(rows, "table_name string, rows long, is_heap boolean, forwarded_records long, has_primary_key boolean, clustered_types array<string>, clustered_bytes int")).collect()
    assert {tuple(r) for r in got} == {("b", "structure.heap_table", "warning"), ("c", "structure.heap_table", "warning"), ("c", "structure.no_primary_key", "warning"), ("d", "structure.no_primary_key", "error"), ("d", "structure.guid_clustered_key", "warning"), ("e", "structure.wide_clustered_key", "info"), ("f", "structure.wide_clustered_key", "info")}


def test_breaches_at_the_threshold(spark):
    rows = [(1, 0, 10.0, 0, 299, None, 20.0), (2, 0, 9.99, 1, 300, 4.0, 20.1), (3, 0, None, None, 599, 8.0, 100.1)]
    got = vitals.breaches(spark.createDataFrame(rows, "instance_id long, captured_at long, runnable_tasks double, pending_grants long, ple_seconds long, memory_gb double, data_latency_ms double")).collect()
    assert {(r["instance_id"], r["rule_id"]) for r in got} == {(1, "cpu.runnable_tasks_high"), (1, "memory.ple_below_floor"), (2, "memory.pending_memory_grants"), (2, "io.data_file_latency_ms.warning"), (3, "memory.ple_below_floor"), (3, "io.data_file_latency_ms.warning"), (3, "io.data_file_latency_ms.critical")}


def test_io_deltas_clamp(spark):
    rows = [(1, "f", t, *x) for t, x in enumerate([(5, 5, 10, 10), (7, 5, 30, 10), (1, 9, 0, 18), (1, 9, 0, 18)])]
    got = vitals.io_deltas(spark.createDataFrame(rows, "instance_id long, file_name string, captured_at long, reads long, writes long, read_stall_ms long, write_stall_ms long")).collect()
    assert [(r["captured_at"], r["reads"], r["writes"], r["read_ms"], r["write_ms"]) for r in sorted(got)] == [(1, 2, 0, 10.0, 0.0), (2, 0, 4, 0.0, 2.0)]


def test_scores_by_lane(spark):
    instances = spark.createDataFrame([(1, 0, None, 0), (2, 21_600, None, None), (3, 21_600, 21_599, 0), (4, 21_600, None, 1)], "instance_id long, monitored_seconds long, counter_seconds long, signals long")
    issues = spark.createDataFrame([(3, "reliability", "critical")] * 4 + [(3, "opportunity", "error")] * 6 + [(3, None, None), (3, "operational", "warning")], "instance_id long, lane string, severity string")
    got = {tuple(r) for r in health.lane_scores(instances, issues).collect()}
    assert got == {(1, 95, 95, 95, True, 95, "A"), (2, 98, 98, 98, False, 98, "A"), (3, 20, 40, 96, True, 20, "F"), (4, 100, 100, 100, False, 100, "A")}


def test_one_row_an_issue_and_plan(spark):
    rows = [(1, "x", "monitor", "r", "error", "t", 9), (1, "x", "advisor", "r", "warning", "t", 3), (1, "x", "advisor", "r", "warning", "t", 4), (1, "y", None, "q", "info", None, 1)]
    one = health.one_an_issue(spark.createDataFrame(rows, "instance_id long, issue_id string, source string, rule string, severity string, table_name string, impact int"))
    assert {(r["issue_id"], r["source"], r["impact"]) for r in one.collect()} == {("x", "advisor", 4), ("y", None, 1)}
    assert [(r["issue_id"], r["place"]) for r in health.action_plan(one).collect()] == [("x", 1)]


REQUESTS = "table_name string, key_columns array<string>, included_columns array<string>, impact double, cost double, seeks long"
INDEXES = "table_name string, index_name string, key_columns array<string>, included_columns array<string>, is_primary_key boolean, is_unique boolean, is_clustered boolean"


def test_a_prefix_folds_into_the_wider_request(spark):
    rows = [("orders", ["CustomerId"], ["Total"], 60.0, 5.0, 100), ("orders", ["[customerid]", "OrderDate"], ["Amount"], 90.0, 12.0, 300)]
    (got,) = advisor.consolidated(spark.createDataFrame(rows, REQUESTS)).collect()
    assert (got["key_columns"], got["included_columns"], got["impact"], got["cost"], got["seeks"], got["requests"]) == (["[customerid]", "OrderDate"], ["amount", "total"], 90.0, 12.0, 400, 2)


def test_other_leads_and_other_tables_stay_apart(spark):
    rows = [("orders", ["a"], [], 50.0, 1.0, 10), ("orders", ["b"], [], 50.0, 1.0, 10), ("invoices", ["a"], [], 50.0, 1.0, 10), ("orders", [], [], 1.0, 1.0, 1), ("orders", None, None, 1.0, 1.0, 1), ("x", ["a", "c"], None, 1.0, 1.0, 1), ("x", ["b", "a", "c"], None, 1.0, 1.0, 1)]
    assert advisor.consolidated(spark.createDataFrame(rows, REQUESTS)).count() == 5


def test_seeks_count_once_as_in_the_greedy_fold(spark):
    import random

    rng = random.Random(4)
    for round_ in range(4):
        rows = [(f"t{rng.randrange(3)}", [rng.choice("ab") for _ in range(rng.randrange(1, 5))], [rng.choice("xyz")], float(rng.randrange(9)), float(rng.randrange(9)), rng.randrange(100), i) for i in range(40)]
        want = []
        for table in {r[0] for r in rows}:
            left = [[list(r[1]), set(r[2]), r[3], r[4], r[5]] for r in rows if r[0] == table]
            folded = True
            while folded:  # the plain way: any pair, from the start each time
                folded = False
                for i, a in enumerate(left):
                    j = next((j for j, b in enumerate(left) if j != i and a[0][: len(b[0])] == b[0] and (len(a[0]) > len(b[0]) or i < j)), None)
                    if j is not None:
                        b = left.pop(j)
                        a[1] |= b[1]
                        a[2], a[3], a[4] = max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4]
                        folded = True
                        break
            want += [(table, tuple(k), tuple(sorted(x)), i, c, s) for k, x, i, c, s in left]
        df = spark.createDataFrame(rows, REQUESTS + ", place long").repartition(3)
        got = advisor.consolidated(df).collect()
        assert sorted((r["table_name"], tuple(r["key_columns"]), tuple(r["included_columns"]), r["impact"], r["cost"], r["seeks"]) for r in got) == sorted(want)
        assert sum(r["seeks"] for r in got) == sum(r[5] for r in rows) and sum(r["requests"] for r in got) == 40


def test_advice_knows_the_indexes_there_are(spark):
    requests = [("t", ["a"], ["x"], 50.0, 10.0, 10), ("t", ["b"], ["y"], 50.0, 10.0, 10), ("t", ["c"], [], 50.0, 10.0, 10), ("t", ["d"], [], 50.0, 10.0, 10), ("t", ["e", "f"], [], 50.0, 10.0, 10), ("t", ["e_f"], [], 50.0, 10.0, 10), ("small", ["a"], [], 50.0, 10.0, 10), ("new", ["a"], None, None, 1.0, 1)]
    there = [("t", "serves", ["[A]", "q"], ["X"], False, None, False), ("t", "narrow", ["B"], ["z"], False, False, False), ("t", "pk", ["c"], [], True, True, True), ("t", "IX_t_d", ["z"], [], False, False, False), ("t", "ix_t_d_2", ["z", "y"], [], False, False, False), ("t", None, [], None, None, None, None)]
    rows = spark.createDataFrame([("t", 5000), ("small", 999)], "table_name string, rows long")
    got = {(r["table_name"], tuple(r["key_columns"])): r for r in advisor.advised_indexes(spark.createDataFrame(requests, REQUESTS), rows, spark.createDataFrame(there, INDEXES)).collect()}
    assert {k: (r["kind"], r["index_name"]) for k, r in got.items()} == {("t", ("b",)): ("widen", "narrow"), ("t", ("c",)): ("create", "IX_t_c"), ("t", ("d",)): ("create", "IX_t_d_3"), ("t", ("e", "f")): ("create", "IX_t_e_f"), ("t", ("e_f",)): ("create", "IX_t_e_f_2"), ("new", ("a",)): ("create", "IX_new_a")}
    assert got["t", ("b",)]["ddl"] == "CREATE NONCLUSTERED INDEX [narrow] ON [t] ([b]) INCLUDE ([y], [z]) WITH (DROP_EXISTING = ON);"
    assert got["t", ("c",)]["ddl"] == "CREATE NONCLUSTERED INDEX [IX_t_c] ON [t] ([c]);" and (got["t", ("c",)]["score"], got["t", ("c",)]["priority"]) == (50.0, "high")


def test_heatmap_order_and_unused_indexes(spark):
    schema = "table_name string, index_name string, seeks long, scans long, lookups long, updates long, is_primary_key boolean, is_unique boolean, is_clustered boolean"
    rows = [("t", "a", 1, 1, 1, 7, None, None, None), ("t", "b", 9, 0, 0, 1, False, False, False), ("t", "c", 0, 0, 0, 101, False, None, False), ("t", "d", 0, 0, 0, 100, False, False, False), ("t", "PK_x", 0, 0, 0, 500, False, False, False), ("t", None, 0, 0, 0, 500, None, None, None), ("t", "u", 0, 0, 0, 500, False, True, False)]
    df = spark.createDataFrame(rows, schema)
    assert [r["index_name"] for r in advisor.heatmap_order(df).collect()] == ["PK_x" if i == 1 else n for i, n in enumerate([None, "PK_x", "u", "c", "d", "b", "a"])]
    assert [r["index_name"] for r in advisor.unused_existing(df).collect()] == ["c"]
    assert advisor.heatmap_order(df.withColumns({c: df[c] * 0 for c in ("seeks", "scans", "lookups", "updates")})).count() == 0


def test_merged_indexes_meet_one_row_a_prefix(spark):
    n = 400
    rows = [("t", f"s{i:03}", ["A"], [], None, False, False) for i in range(n)] + [("t", f"w{i:03}", ["a", f"b{i % 7}"], [], False, False, False) for i in range(n)] + [("t", "pk", ["a"], [], True, True, True), ("u", "s", ["a"], [], False, False, False), ("t", "w3", ["a", "b0", "c"], None, False, False, False)]
    got = advisor.merge_index(spark.createDataFrame(rows, INDEXES))
    assert sorted(map(tuple, got.collect())) == sorted([("t", f"s{i:03}", "w000") for i in range(n)] + [("t", f"w{i:03}", "w3") for i in range(0, n, 7)])
    assert max(_joined_rows(got)) < 4 * n


def _joined_rows(df):
    """Rows that came out of each join of an executed query."""
    import re

    df.collect()
    plans, joins = [df._jdf.queryExecution().executedPlan()], []
    while plans:
        p = plans.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            plans.append(p.executedPlan())
        elif re.search("QueryStage", p.nodeName()):
            plans.append(p.plan())
        if p.nodeName().endswith("Join"):
            joins.append(p.metrics().apply("numOutputRows").value())
        plans += [p.children().apply(i) for i in range(p.children().size())]
    return joins


def test_indexes_of_one_shape_meet_a_request_once(spark):
    there = [("t", f"i{i:03}", ["b"], ["z"], False, False, False) for i in range(400)]
    rows = spark.createDataFrame([("t", 5000)], "table_name string, rows long")
    got = advisor.advised_indexes(spark.createDataFrame([("t", ["b"], ["y"], 50.0, 10.0, 10)], REQUESTS), rows, spark.createDataFrame(there, INDEXES))
    assert [(r["kind"], r["index_name"]) for r in got.collect()] == [("widen", "i000")]
    assert max(_joined_rows(got)) < 10


def test_pairs_of_one_column_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(advisor, "PAIRS_BLOCK", 16, raising=False)
    keys = [["A"], ["a", "b"], ["a", "B"]]
    rows = [("t", f"i{i:03}", keys[i % 3], [["x", "Y"], ["y", "X"], None, []][i % 4], False, False, False) for i in range(200)]
    rows += [("t", "i000", ["a"], ["x", "y"], False, False, False), ("t", "z", ["c"], [], False, False, False), ("u", "i001", ["a"], [], False, False, False), (None, "n", ["a"], [], False, False, False), ("t", None, ["a"], [], False, False, False), ("t", "e", [], [], False, False, False), ("t", "k", None, [], False, False, False), ("t", "l", [None, "a"], [], False, False, False), ("t", "m", [None, "a"], [], False, False, False)]
    plain = [(r[1], [k.lower() for k in r[2]], sorted(x.lower() for x in r[3] or [])) for r in rows[:201]]
    want = sorted(("t", a[0], b[0], "error" if a[1:] == b[1:] else "info") for a in plain for b in plain if a[0] < b[0])
    got = advisor.index_pairs(spark.createDataFrame(rows, INDEXES).coalesce(1))
    assert sorted((r["table_name"], r["index_a"], r["index_b"], r["severity"]) for r in got.collect()) == want
    made = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == len(want) and max(made) < 0.6 * len(want)


def test_pairs_are_met_by_runs_of_names(spark, monkeypatch):
    monkeypatch.setattr(advisor, "PAIRS_RUN", 16, raising=False)
    plain = [(f"i{i // 2 if i < 80 else i:03}", [["a"], ["a", "b"]][i % 2], [["x"], []][i % 3 == 0]) for i in range(400)]  # names twice, in one run and over two
    plain += [("i005", ["a"], ["x"])] * 40
    got = advisor.index_pairs(spark.createDataFrame([("t", n, k, x, False, False, False) for n, k, x in plain], INDEXES))
    want = sorted((a[0], b[0], "error" if a[1:] == b[1:] else "info") for a in plain for b in plain if a[0] < b[0])
    assert sorted((r["index_a"], r["index_b"], r["severity"]) for r in got.collect()) == want
    assert max(_joined_rows(got)) < len(want) / 8
