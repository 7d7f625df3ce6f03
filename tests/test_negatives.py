"""Negatives of all kinds of sequences, made in numpy."""

from strandwork.operators import selection


def test_negatives_of_odd_sequences(spark):
    own = ["ACDEFGHIKLMNPQRSTVWY", "KKKKKKKK", "AC", "XÄACDEFG", "ACDEFGHIKL" * 30, "", None]
    table = spark.createDataFrame([(s,) for s in own + own[:2]], "sequence string")
    made = selection.negatives(table)
    assert "md5" not in made._jdf.queryExecution().executedPlan().toString()
    rows = made.collect()
    assert sorted(map(str, rows)) == sorted(map(str, selection.negatives(table.repartition(3)).collect()))
    found = {(r["sequence"], r["kind"]): r["negative"] for r in rows}
    assert len(rows) == len(found) == 3 * len(own)
    for s in own:
        shuffled, drawn, mutated = (found[s, k] for k in ("shuffled", "random", "mutated"))
        if not s:
            assert shuffled == drawn == mutated == s
            continue
        assert sorted(shuffled) == sorted(s) and len(drawn) == len(mutated) == len(s)
        assert set(drawn) <= set("ACDEFGHIKLMNPQRSTVWY")
        assert sum(x != y for x, y in zip(s, mutated, strict=True)) == min(5, len(s))
    assert found[own[4], "random"] != found[own[4], "shuffled"] != own[4]
