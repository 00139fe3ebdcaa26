from fleetlens.functions import tsql
from fleetlens.operators import reports


def test_specs_name_whole_segments(spark):
    cases = [("*", "a.b", True), (" ALL ", "a.b", True), ("A", "a.b", True), ("a.*", "a.b", True), ("A.B", "a.b", True), ("hyg", "hygiene.x", False), ("", "a.b", False), ("a.b", "a.bc", False), (None, "a.b", False), ("a.b.*", "a.b", True)]
    got = spark.createDataFrame(cases, "spec string, rule string, want boolean").select("want", reports.matches(*map(reports.F.col, ("spec", "rule"))).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_directives_cover_their_lines(spark):
    sql = "-- lint-ignore-file x\nSELECT 'lint-ignore' -- LINT-IGNORE a.b, c\n/* lint-ignore-next-line\n*/\nSELECT 1 -- lint-ignored"
    said = reports.directives(tsql.tokens(spark.createDataFrame([(1, sql), (2, None)], "doc_id long, sql string")))
    assert {tuple(r) for r in said.collect()} == {(1, None, "x"), (1, 2, "a.b"), (1, 2, "c"), (1, 5, "*")}
    found = spark.createDataFrame([(1, "x.y", 9), (1, "a.b", 2), (1, "a.b", 3), (1, "c.d", 2), (1, "z.z", 5), (2, "x.y", 9), (1, "z.z", None)], "doc_id long, rule string, line int")
    assert [r["suppressed"] for r in sorted(reports.suppress(found, said).collect(), key=lambda r: (r["doc_id"], r["rule"], r["line"] or 0))] == [True, False, True, True, False, True, False]
