"""Each rule on a script that it fires on and one that it is silent on."""

import pytest

from fleetlens.functions import tsql
from fleetlens.operators import rules
from fleetlens.scenarios import MORE as FIRES


@pytest.fixture(scope="module")
def found(spark):
    sql = [s for pair in FIRES.values() for s in pair] + ["", None]
    got = rules.findings(tsql.tokens(spark.createDataFrame(list(enumerate(sql)), "doc_id long, sql string"))).collect()
    return [(r["doc_id"], r["rule"]) for r in got]


@pytest.mark.parametrize("at,rule", list(enumerate(FIRES)))
def test_fires_once_and_stays_silent(found, at, rule):
    assert [found.count((2 * at + i, rule)) for i in (0, 1)] == [1, 0]


def test_empty_scripts_have_none(found):
    assert not [d for d, _ in found if d >= 2 * len(FIRES)]


def test_no_target_silences_rules_of_newer_servers(spark):
    sql = [(0, "ALTER DATABASE a SET OPTIMIZED_LOCKING = ON SELECT a FROM dbo.b WITH (READCOMMITTEDLOCK)"), (2, "SELECT ',' + a FROM dbo.b FOR XML PATH('')"), (1, "EXEC sp_executesql @a")]
    t = tsql.tokens(spark.createDataFrame(sql, "doc_id long, sql string"))
    assert {r["rule"] for r in rules.findings(t, None).collect()} == {"modern.string_agg_replaces_for_xml"}


@pytest.fixture(scope="module")
def scoped(spark):
    from fleetlens import scenarios
    from fleetlens.functions import scopes

    got = rules.findings_in(scopes.scopes(scenarios.scripts(spark).select("doc_id", "sql"))).collect()
    return [(r["doc_id"], r["rule"]) for r in got]


def test_scoped_rules_fire_once_and_stay_silent(scoped):
    from fleetlens.scenarios import PAIRS

    wrong = {rule: n for i, rule in enumerate(PAIRS) if (n := [scoped.count((2 * i + j, rule)) for j in (0, 1)]) != [1, 0]}
    assert wrong == {}


def test_tokens_and_scripts_give_the_same_findings(spark, scoped):
    from fleetlens import scenarios

    got = rules.findings(tsql.tokens(scenarios.scripts(spark))).collect()
    assert sorted((r["doc_id"], r["rule"]) for r in got) == sorted(scoped)


def test_every_rule_has_its_texts(spark):
    from fleetlens.operators import texts
    from fleetlens.scenarios import PAIRS

    assert not {r for r in [*PAIRS, *FIRES] if r not in texts.TEXTS}
    rows = spark.createDataFrame([("hygiene.nolock",), ("x.y",), (None,)], "rule string")
    got = {r["rule"]: (r["message"], r["recommendation"]) for r in texts.explained(rows).collect()}
    assert got == {"hygiene.nolock": texts.TEXTS["hygiene.nolock"], "x.y": ("x.y", None), None: (None, None)}


def test_compat_by_target(spark):
    from fleetlens.functions import scopes

    df = spark.createDataFrame([(0, "SELECT STRING_AGG(a, ',') FROM dbo.b"), (1, "DROP TABLE IF EXISTS dbo.b"), (2, "SELECT dbo.TRIM(a), 'TRIM(' FROM dbo.b")], "doc_id long, sql string")
    for year, want in ((2014, {0, 1}), (2016, {0}), (2025, set()), (None, set())):
        got = rules.findings_in(scopes.scopes(df), year).where("rule = 'compat.unsupported_on_target'").collect()
        assert {r["doc_id"] for r in got} == want


def test_odd_scripts_have_scopes(spark):
    from fleetlens.functions import scopes

    odd = ["", None, ")", "(((", "SELECT", "WITH", "WITH a AS", "CASE END END", "'", "[", "GO", ";", "EXEC(", "SELECT * FROM", "CREATE TABLE", "CREATE TABLE a (", "é", "@", "N'x", "a..b.c", "MERGE", "UPDATE", "DELETE TOP", "ROW_NUMBER() OVER (", "/* x"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, sql string")
    rules.findings_in(scopes.scopes(df)).count()


def test_money_names_roles_and_hiding_functions(spark):
    from fleetlens.functions import scopes

    sql = [
        "CREATE TABLE dbo.m (Coffee float, RecordTotal float, Taxonomy real, HeartRate float, CostumeWeight real, PaymentLag float, QueryPlanCost float, lookup_cost real, Cost float, FeeBalance float)",
        "CREATE TABLE dbo.m (GrossAmount float, UnitPrice real, [Net Salary] float, shipping_cost float, ITEM_PRICE real, XMLPayment float, TotalCost real)",
        "DECLARE @t TABLE (k int, [UnitPrice] float)",
        *[f"ALTER ROLE {r} ADD MEMBER someone" for r in ("db_accessadmin", "db_securityadmin", "db_owner", "db_ddladmin", "db_backupoperator", "readers")],
        *[f"ALTER SERVER ROLE {r} ADD MEMBER someone" for r in ("sysadmin", "securityadmin", "serveradmin", "processadmin", "setupadmin")],
        "EXEC sp_addsrvrolemember 'someone', 'sysadmin'", "EXEC sp_addrolemember 'db_backupoperator', 'someone'",
        "SELECT a FROM shop.b WHERE ABS(c) = 1", "SELECT a FROM shop.b WHERE LEN(c) = 1", "SELECT a FROM shop.b WHERE YEAR(c) = 1", "SELECT b.a FROM shop.b b JOIN shop.c c ON CONCAT(c.k, 'x') = b.k",
    ]
    df = spark.createDataFrame(list(enumerate(sql)), "doc_id long, sql string")
    watched = ("datatype.float_for_money", "security.add_to_privileged_role", "sarg.function_on_column", "joins.function_on_join_column")
    got = [(r["doc_id"], r["rule"], r["severity"]) for r in rules.findings_in(scopes.scopes(df)).collect() if r["rule"] in watched]
    role, money = "security.add_to_privileged_role", "datatype.float_for_money"
    assert sorted(got) == sorted([(1, money, "warning")] * 7 + [(2, money, "warning")] + [(3, role, "error"), (4, role, "error"), (5, role, "error"), (6, role, "warning"), (9, role, "critical"), (10, role, "error"), (11, role, "error"), (14, role, "critical"), (18, "sarg.function_on_column", "error"), (19, "joins.function_on_join_column", "warning")])


def test_batches_are_cut_where_separators_stand():
    cut = lambda sql: [(b, s, line, col, t.decode()) for b, s, line, col, t in tsql.batches_of(sql.encode())]
    assert cut("") == [(0, 0, 1, 1, "")]
    assert cut("a\nGO\nb\n go 5\nc") == [(0, 0, 1, 1, "a\n"), (1, 2, 2, 1, "GO\nb\n "), (2, 8, 4, 2, "go 5\nc")]
    for one in ("x GO", "GO x", "/*\nGO\n*/", "/* /* */\nGO\n*/", "'\nGO\n'", "[\nGO\n]", '"\nGO\n"', "--\\\n@GO\nGO1\nGO.a\na.GO", "x /* c */ GO", "GO /* c */ x"):
        assert len(cut(one)) == 1, one
    for two in ("GO", "a\nGO", "a\nGO -- c", "a\n/* c */ GO /* d */", "a /*\n*/ GO", "a\nGO 3 -- x", "a -- '\nGO\n'", "GO\r\nb"):
        assert len(cut(two)) == 2, two
    text = "".join(t for *_, t in cut("é'\nGO\nb'\nGO\n/*é*/GO"))
    assert text == "é'\nGO\nb'\nGO\n/*é*/GO"


def test_a_script_gives_the_same_units_whole_and_in_batches(spark):
    from fleetlens import scenarios
    from fleetlens.functions import scopes

    sql = [r["sql"] for r in scenarios.scripts(spark).collect()]
    joined = "\nGO\n".join(s or "" for s in sql)
    df = spark.createDataFrame([(1, joined)], "doc_id long, sql string")
    assert tsql.batches(df).count() > len(sql) * 0.9
    apart = scopes.scopes(df).select("batch", "line", "col", "start", "kind", "v", "clause", "role", "alias", "head", "verb", "first").collect()
    whole = scopes.scopes_of_tokens(tsql.tokens(df)).select("batch", "line", "col", "start", "kind", "v", "clause", "role", "alias", "head", "verb", "first").collect()
    assert sorted(map(str, apart)) == sorted(map(str, whole))
    found = lambda t: sorted((r["rule"], r["line"], r["col"], r["start"]) for r in rules.findings_in(t).collect())
    assert found(scopes.scopes(df)) == found(scopes.scopes_of_tokens(tsql.tokens(df)))


def test_batches_of_a_large_script_are_many_tasks(spark):
    from fleetlens.functions import scopes

    df = spark.createDataFrame([(1, "\nGO\n".join(f"SELECT a{i} FROM dbo.t{i}" for i in range(4000)))], "doc_id long, sql string")
    from pyspark.sql import functions as F

    sizes = [r["n"] for r in scopes.scopes(df).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * min(sizes)


def test_findings_name_what_they_are_about(spark):
    from fleetlens.functions import scopes
    from fleetlens.operators import texts

    sql = [(0, "DELETE FROM shop.basket"), (1, "SELECT a FROM shop.b WHERE YEAR(c) = 1"), (2, "CREATE TABLE dbo.m (UnitPrice float)"), (3, "BEGIN TRAN")]
    found = rules.findings_in(scopes.scopes(spark.createDataFrame(sql, "doc_id long, sql string")), objects=True)
    got = {(r["doc_id"], r["rule"]): r["message"] for r in texts.explained(found).collect()}
    assert got[0, "hygiene.unbounded_dml"].endswith(" (SHOP.BASKET)") and got[1, "sarg.function_on_column"].endswith(" (YEAR)") and got[2, "datatype.float_for_money"].endswith(" (DBO.M.UNITPRICE)")
    assert not got[3, "tran.begin_without_commit"].endswith(")")


def test_units_are_neither_sorted_nor_dealt_for_facts(spark):
    from fleetlens import catalogue

    df = catalogue.queries()["script_findings"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 3  # the longest script of a doc_id in either branch, and which findings are a script's first
