import datetime as dt

import duckdb
import pytest

from fleetlens import catalogue
from fleetlens.functions import tsql
from fleetlens.operators import rules, telemetry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("events", "lineitem", "part", "conversations", "customer", "orders", "supplier", "nation", "region"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalogue.queries()[name](spark, SF), c.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda found, columns: sorted(str([x[columns.index(k)] for k in sorted(columns)]) for x in found)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_deltas_void_a_capture_when_any_counter_goes_down(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    rows = [(1, "a", t(0), 5), (1, "b", t(0), 5), (1, "a", t(30), 9), (1, "b", t(30), 5), (1, "c", t(30), 2), (1, "a", t(60), 1), (1, "b", t(60), 8), (1, "a", t(121), 9), (1, "a", t(181), 10)]
    got = telemetry.counter_deltas(spark.createDataFrame(rows, "instance_id long, wait_type string, captured_at timestamp_ntz, total_ms long")).collect()
    assert {(r["wait_type"], r["captured_at"], r["delta_ms"]) for r in got} == {("a", t(30), 4), ("c", t(30), 2), ("a", t(181), 1)}


def test_cooldown_starts_at_fired_alerts(spark):
    got = telemetry.fired_alerts(spark.createDataFrame([("r", x) for x in (0, 899, 900, 1500, 1800, 1800, None)], "rule_id string, at long"))
    assert sorted(r["fired_at"] for r in got.collect()) == [0, 900, 1800]


def test_tokens_count_bytes_and_nest_comments():
    got = list(tsql.tokenize("é/* a /* b */ c */\n[x y] 'it''s".encode()))
    assert [(k, s, line, col) for k, _, s, _, line, col in got] == [("Punct", 0, 1, 1), ("Punct", 1, 1, 2), ("Comment", 2, 1, 3), ("Word", 20, 2, 1), ("String", 26, 2, 7)]


def test_rules_fire_and_stay_silent(spark):
    sql = ["SELECT * FROM dbo.a WITH (NOLOCK) WHERE b NOT IN (SELECT c FROM dbo.d) AND e LIKE '%f'", "SELECT [*], a /* NOLOCK */ FROM dbo.b WHERE c LIKE 'x%' AND d IN (1)", None]
    got = rules.findings(tsql.tokens(spark.createDataFrame(list(enumerate(sql)), "doc_id long, sql string"))).collect()
    assert {(r["doc_id"], r["rule"]) for r in got} == {(0, x) for x in ("hygiene.select_star", "hygiene.nolock", "sarg.not_in_nullable", "sarg.leading_wildcard")}


def test_cooldown_of_one_large_key_is_many_rows(spark):
    import random

    from pyspark.sql import functions as F

    for cooldown, span in ((900, 3_000_000), (72_000, 40_000_000), (500_000, 9_000_000), (1, 500_000)):
        rng = random.Random(cooldown)
        times = sorted({rng.randrange(-span, span) for _ in range(4000)} | set(range(0, 3000, 7)))
        want, last = [], None
        for t in times:
            if last is None or t - last >= cooldown:
                want.append(t)
                last = t
        df = spark.createDataFrame([(None, t) for t in times] + [(None, times[5])], "rule_id string, at long").repartition(5)
        got = telemetry.fired_alerts(df, cooldown)
        assert sorted(r["fired_at"] for r in got.collect()) == want
    grown = [spark.range(n * 400_000).select(F.lit(1).alias("instance_id"), (F.col("id") * 7).alias("at")) for n in (1, 4)]
    width = 345_600
    sizes = [max(r["n"] for r in g.groupBy(F.floor(F.col("at") / width)).agg(F.count("*").alias("n")).collect()) for g in grown]
    assert sizes[0] == sizes[1]  # rows that meet in one array don't grow with the key
    assert telemetry.fired_alerts(grown[1]).count() == -(-4 * 400_000 * 7 // 903)
