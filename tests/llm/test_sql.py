"""Corpus queries against their SQL in DuckDB, and expectation-maximisation against numpy."""

import collections

import numpy as np
import pytest

from strandwork.llm import quality, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    df, found = queries.queries()[name](spark, FOLDER), con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert collections.Counter(tuple(r[c] for c in names) for r in df.collect()) == collections.Counter(found.fetchall())


def test_estimates_equal_numpy(spark):
    r = np.random.default_rng(3)
    votes = r.choice([-1, 0, 1], (400, len(quality.VOTES)), p=[0.1, 0.3, 0.6])
    votes[:60, :3] = -1
    rows = [(bool(i % 10 == 9), *map(int, v)) for i, v in enumerate(votes)]
    table = spark.createDataFrame(rows, "base_failed boolean, " + ", ".join(f"{v} int" for v in quality.VOTES))
    model = quality.estimate(table).first()["model"]
    own = votes[[i % 10 != 9 for i in range(400)]]
    bad, good = own == -1, own == 1
    q = (1 + good.sum(1)) / (2 + good.sum(1) + bad.sum(1))
    for k in range(quality.ROUNDS + 1):
        share = (1 + q.sum()) / (2 + len(q))
        rates = [(1 + (w[:, None] * bad).sum(0)) / (2 + (w[:, None] * (bad | good)).sum(0)) for w in (q, 1 - q)]
        if k < quality.ROUNDS:
            odds = np.log(share / (1 - share)) + (bad * np.log(rates[0] / rates[1])).sum(1) + (good * np.log((1 - rates[0]) / (1 - rates[1]))).sum(1)
            q = 1 / (1 + np.exp(-odds))
    assert abs(model["share"] - share) < 1e-9
    assert np.allclose(model["good"], rates[0], atol=1e-9) and np.allclose(model["bad"], rates[1], atol=1e-9)


def test_one_bad_vote_among_good_ones_is_outvoted(spark):
    good = {v: 1 for v in quality.VOTES}
    rows = [{**good, "base_failed": False}] * 300 + [{**good, "vote_capitals": -1, "base_failed": False}] * 3
    rows += [{**good, "vote_symbols": -1, "vote_symbol_words": -1, "vote_bare_words": -1, "base_failed": False}] * 30
    table = spark.createDataFrame([tuple(r[c] for c in ["base_failed", *quality.VOTES]) for r in rows], "base_failed boolean, " + ", ".join(f"{v} int" for v in quality.VOTES))
    kept = quality.judged(table, quality.estimate(table)).groupBy("vote_capitals", "vote_symbols", "kept").count().collect()
    assert {tuple(r) for r in kept} == {(1, 1, True, 300), (-1, 1, True, 3), (1, -1, False, 30)}
