"""Registered peptide queries against their SQL in DuckDB, and small cases by hand."""

import collections
import itertools

import pytest

from strandwork.functions import parsing, sequence
from strandwork.operators import selection
from strandwork.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("lineitem", "documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in registry.queries() if n in registry.oracle_sql()])
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    found = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert collections.Counter(tuple(r[c] for c in names) for r in df.collect()) == collections.Counter(found.fetchall())


def test_parsed_values(spark):
    from pyspark.sql import functions as F

    cases = {"12": (12.0, False), ">128": (128.0, True), "<4": (4.0, False), "2 - 8": (4.0, False), "128-256": (None, False), "1,024": (24.0**0.5, False), "": (None, False), ">x": (None, False), None: (None, False), "0": (None, False)}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", parsing.value(F.col("raw")).alias("v"), parsing.censored(F.col("raw")).alias("c"), parsing.value(F.col("raw"), ranges=True).alias("r")).collect()
    for r in rows:
        v, c = cases[r["raw"]]
        assert r["c"] == c and (r["v"] is None if v is None else abs(r["v"] - v) < 1e-9)
        if r["raw"] == "128-256":
            assert abs(r["r"] - (128 * 256) ** 0.5) < 1e-9


def test_identity_is_by_longest_common_subsequence():
    def brute(a, b):
        best = 0
        for n in range(len(a), 0, -1):
            for pick in itertools.combinations(a, n):
                rest = iter(b)
                if all(c in rest for c in pick):
                    best = n
                    break
            if best:
                break
        return 2 * best / (len(a) + len(b)) if a and b else 0.0

    for a, b in (("ACDEFG", "AEDFG"), ("KKKK", "RRRR"), ("AAKK", "KKAA"), ("", "A"), ("GIGKF", "GIGKF")):
        assert selection.identity(a, b) == brute(a, b)


def brute(a, b):
    rows = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, rows[j] = rows[j], last + 1 if x == y else max(rows[j], rows[j - 1])
    return 2 * rows[-1] / (len(a) + len(b))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with a few documents and benchmark items, one of them in both."""
    import random

    r, folder = random.Random(3), str(tmp_path_factory.mktemp("small"))
    text = lambda n: ". ".join("".join(r.choice("ACDEFGHIKLMNPQRSTVWYacdb ") for _ in range(r.randint(3, 60))) for _ in range(n))
    items = [(i, text(4)) for i in range(6)]
    docs = [(i, text(6), "en", f"src{i % 3}") for i in range(12)] + [(12, items[0][1], "en", "src0"), (13, None, None, None), (14, "", "en", "src1")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_similarity_queries_by_brute_force(spark, small):
    from strandwork.plans.queries import valid
    from strandwork.plans.views import view

    own = [r[0] for r in valid(spark, small).collect()]
    refs = sorted({r["sequence"] for r in view(spark, small, "refset").collect()} - {""})
    best = {a: max((brute(a, b), b) for b in refs) for a in own}
    found = {r["sequence"]: r for r in registry.queries()["nearest_reference"](spark, small).collect()}
    assert found.keys() == best.keys() and any(r["identity"] == 1 for r in found.values())
    for a, r in found.items():
        high = best[a][0] if best[a][0] >= 0.4 else 0
        assert abs(r["identity"] - high) < 1e-5 and r["ref"] == (min(b for b in refs if abs(brute(a, b) - high) < 1e-12) if high else None)
    screen = registry.queries()["library_screen"](spark, small).collect()
    assert {r["sequence"] for r in screen} == {a for a in own if (best[a][0] if best[a][0] >= 0.4 else 0) < 0.75}
    mean = registry.queries()["sampled_diversity"](spark, small).first()[0]
    pairs = [brute(a, b) for a, b in itertools.combinations(own, 2)]
    assert abs(mean - sum(pairs) / len(pairs)) < 1e-5
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    for r in registry.queries()["nearest_shortlisted"](spark, small).collect():
        listed = [brute(r["sequence"], b) for b in refs if len(b) >= 3 and grams(b) & grams(r["sequence"])]
        assert abs(r["identity"] - max(listed, default=0)) < 1e-5


def test_alignment_of_any_length():
    import random

    from strandwork.functions import alignment

    r = random.Random(1)
    text = lambda n: "".join(r.choice("ACDß" if n % 7 == 0 else "ACDE") for _ in range(n))
    a, b = ([text(r.choice([0, 1, 8, 30, 62, 63, 90])) for _ in range(200)] for _ in range(2))
    assert [2 * x / max(1, len(p) + len(q)) for x, p, q in zip(alignment.paired(a, b), a, b, strict=True)] == pytest.approx([brute(p, q) if p or q else 0 for p, q in zip(a, b, strict=True)])


def test_select_diverse_gives_the_references_hundred(spark):
    rows = registry.queries()["select_diverse"](spark, FOLDER).collect()
    assert [r["rank"] for r in rows] == list(range(1, 101)) and all(r["score"] > -5 for r in rows)
    assert all(selection.identity(a["sequence"], b["sequence"]) <= a["rung"] for a, b in itertools.combinations(rows, 2))


def test_splits_and_negatives(spark):
    assert set(selection.packed_splits([(1, 80), (2, 10), (3, 10)], {"train": 0.8, "val": 0.1, "test": 0.1}).items()) == {(1, "train"), (2, "val"), (3, "test")}
    rows = selection.negatives(spark.createDataFrame([("ACDEFGHIKLMN",), ("KKKKKKKK",)], "sequence string")).collect()
    for r in rows:
        assert len(r["sequence"]) == len(r["negative"])
        if r["kind"] == "shuffled":
            assert sorted(r["sequence"]) == sorted(r["negative"])
        if r["kind"] == "mutated":
            assert sum(a != b for a, b in zip(r["sequence"], r["negative"], strict=True)) == 5
    assert sequence.VALID.startswith("^")
