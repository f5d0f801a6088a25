"""Conclusions draw answers and evidence from one shuffle of the statements."""

from chronolith.operators import why

STATEMENT = "key long, step int, place string, text string, role string, level string, confidence double, cited array<string>"


def test_evidence_of_many_statements_in_one_shuffle(spark):
    rows = [
        (1, 2, "", "C.", "late", "FACT", 1.0, ["b", "a", "b"]), (1, 0, "", "A.", "first", "DERIVED", 0.5, ["b"]), (1, 1, "", "B.", "first", "FACT", 0.9, ["b", "c"]),
        (2, 0, "", "Nothing.", "absence", "FACT", 1.0, []),
    ]
    out = why.conclude(spark.createDataFrame(rows, STATEMENT))
    found = {r.key: r for r in out.collect()}
    assert (found[1].answer, found[1].confidence, found[1].level, found[1].statements) == ("A. B. C.", 0.5, "DERIVED", 3)
    assert [tuple(e) for e in found[1].evidence] == [("a", "late"), ("b", "first; late"), ("c", "first")]
    assert found[2].evidence is None and found[2].answer == "Nothing."
    plan = why.conclude(spark.createDataFrame(rows, STATEMENT))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
