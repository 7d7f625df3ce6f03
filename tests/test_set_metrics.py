"""Metrics asked for by name compute no others."""

from strandwork.operators import evaluation


def test_columns_alone(spark):
    library, real = (spark.createDataFrame([(s,) for s in x], "sequence string") for x in (["ACDEFGHIKLMN", "KKLLKKLLKKLL", "KKLLKKLLKKLL", "", None], ["ACDEFGHIKLMN", "WWWWRRRRWWWW"]))
    some = evaluation.set_metrics(library, real, identity=False, columns=["novelty_pct", "median_length"])
    plan, found = some._jdf.queryExecution().executedPlan().toString(), some.first().asDict()
    assert "InMemory" not in plan and "hypot" not in plan.lower()  # no moments, nothing kept
    every = evaluation.set_metrics(library, real, identity=False).first().asDict()
    assert found == {k: every[k] for k in found}
