"""Shortlists over whole tables: names are put in as rows are made, and queries are read once."""

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from strandwork.functions import alignment
from strandwork.operators import similarity
from strandwork.plans import registry

SMALL = "/root/testdata/sf0.001"


def grams(s):
    return {s[i : i + 3] for i in range(max(1, len(s) - 2))}


def listed(s, refs, top):
    scored = sorted((-len(grams(s) & grams(r)) / len(grams(s) | grams(r)), r) for r in refs)
    return [(r, -x) for x, r in scored if x < 0][:top]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("long", [0, 400, 6000])  # counts in a byte or not, similarity and place in 32 bits or 64
def test_rows_of_lists(spark, monkeypatch, long):
    rng = random.Random(long)
    make = lambda n: "".join(rng.choice("ACDE" if n < 50 else "ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    half = make(130)  # a k-mer of 128: half a unit of the sixth place
    own = [make(rng.randint(1, 50)) for _ in range(100)] + [make(long), half, "WWWW", ""]
    refs = [make(rng.randint(3, 40)) for _ in range(60)] + [make(long) + own[0], half[5:8], "ÄÖÜ" * 3]
    queries, table = (spark.createDataFrame([(s,) for s in x], "sequence string") for x in (own, refs))
    near = lambda x: float(Decimal(repr(x)).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    want = {(s, r, near(x), i + 1) for s in set(own) - {""} for i, (r, x) in enumerate(listed(s, set(refs) - {""}, 9))}
    assert any(len(str(x[2])) > 7 for x in want)
    for most in (2048, 20):
        monkeypatch.setattr(similarity, "REFS", most)
        assert sorted(map(tuple, similarity.shortlist_rows(queries, table, top=9).collect())) == sorted(want)
    none = table.limit(0)
    assert similarity.shortlist_rows(queries, none).count() == 0
    assert set(map(tuple, similarity.nearest_shortlisted(queries, none).collect())) == {(s, 0.0, None) for s in set(own) - {""}}


def test_names_of_references_do_not_come_from_python(spark):
    found = plan(registry.queries()["kmer_shortlist"](spark, SMALL))
    assert "ref#" not in found[found.rindex("MapInArrow run") :].split("\n")[0] and "round(" not in found


def test_subsequences_in_long_vectors():
    rng = random.Random(3)
    a, b = (["".join(rng.choice("ACDEF") for _ in range(rng.choice(sizes))) for _ in range(120)] for sizes in ((1, 20, 31, 32, 33, 61, 62), (1, 8, 40, 90, 200)))
    wanted = np.random.default_rng(3).random((len(b), len(a))) < 0.3
    wanted[5] = False
    found, true = alignment.lengths(a, b, wanted), np.where(wanted, alignment.table(a, b).T, 0)
    sums = np.array(list(map(len, b)))[:, None] + np.array(list(map(len, a)))
    top = (2 * true / sums).max(axis=0)
    assert np.array_equal(found[found > 0], true[found > 0]) and (found == true)[2 * true / sums >= top].all()
    assert (found < true).any()


def test_queries_of_nearest_shortlisted_are_read_once(spark):
    found = plan(registry.queries()["nearest_shortlisted"](spark, SMALL))
    assert found.count("documents.parquet") == 1 and "LeftOuter" not in found
