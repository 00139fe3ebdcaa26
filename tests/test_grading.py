import pytest

from fleetlens.operators import grading

DDL = "scenario_id long, must array<string>, also array<string>, must_not array<string>"


def test_scenarios_pass_and_fail(spark):
    said = [(1, ["a.x@3", "b.*"], ["c.z"], ["d.w"]), (2, ["a.x@4"], None, ["d.*"]), (3, None, None, None), (4, ["a.x"], [], [])]
    fired = [(1, "a.x", 3), (1, "a.x", 9), (1, "b.q", None), (1, "c.z", 1), (2, "a.x", 3), (2, "a.x", None), (2, "d.w", 1), (2, "e.e", 1), (2, "e.e", 2)]
    graded = grading.grade(spark.createDataFrame(said, DDL), spark.createDataFrame(fired, "scenario_id long, rule string, line int"))
    got = {r["scenario_id"]: (r["tp"], r["fn"], r["forbidden"], r["unexpected"], r["passed"]) for r in graded.collect()}
    assert got == {1: (["a.x", "b.*"], [], [], [], True), 2: ([], ["a.x"], ["d.*"], ["e.e"], False), 3: ([], [], [], [], True), 4: ([], ["a.x"], [], [], False)}
    counts = {r["rule"]: (r["tp"], r["fp"], r["fn"]) for r in grading.by_rule(graded).collect()}
    assert counts == {"a.x": (1, 0, 2), "b.*": (1, 0, 0), "d.*": (0, 1, 0), "e.e": (0, 1, 0)}
    row = grading.gate(graded).collect()[0]
    assert (row["open"], row["n_failed"]) == (False, 2) and row["f1"] == pytest.approx(0.5)


def test_nothing_to_grade_is_perfect(spark):
    graded = grading.grade(spark.createDataFrame([], DDL), spark.createDataFrame([], "scenario_id long, rule string, line int"))
    assert [tuple(r) for r in grading.gate(graded).collect()] == [(True, 0, 1.0)]
