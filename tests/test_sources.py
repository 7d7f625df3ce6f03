"""Readers and writers on small files, and operators that have no query in SQL."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from test_queries import brute

from strandwork.operators import evaluation, sampling
from strandwork.sources import fasta, tables

TEXT = "lost\n  words\n>a one\nacd\n\nEFX\n>b\n>c\r\nKK-K\r\n >a one\nMMM\nNNN\n>\nQQ"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("files")


def test_three_readings_of_fasta(spark, folder):
    (folder / "x.fasta").write_text(TEXT)
    path = str(folder / "x.fasta")
    ordered = lambda df, *c: [tuple(r[x] for x in c) if len(c) > 1 else r[c[0]] for r in df.orderBy("place").collect()]
    assert ordered(fasta.headed(spark, path), "header", "sequence") == [("a one", "ACDEFX"), ("b", ""), ("c", "KK-K"), ("a one", "MMMNNN"), ("", "QQ")]
    assert ordered(fasta.cleaned(spark, path), "sequence") == ["LSTWRDS", "ACDEF", "KKK", "MMMNNN", "QQ"]
    assert ordered(fasta.raw(spark, path), "sequence") == ["acdEFX", "", "KK-K", "MMMNNN", "QQ"]
    assert dict(map(tuple, fasta.by_identifier(spark, path).collect())) == {"a one": "MMM", "c": "KK-K"}
    (folder / "many.fa").write_text("".join(f">h{i}\n{'ACDE' * (i % 5)}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        found = ordered(fasta.headed(spark, str(folder / "many.fa")), "header", "sequence")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == [(f"h{i}", "ACDE" * (i % 5)) for i in range(20_000)]


def test_tables_manifests_and_matrices(spark, folder):
    (folder / "t.tsv").write_text("sequence\tn\nACD\t1\n")
    (folder / "c.tsv").write_text("r1\tm1\nr1\tm2\n")
    assert tables.read_table(spark, str(folder / "t.tsv")).collect() == [("ACD", "1")]
    assert tables.read_table(spark, str(folder / "t.tsv"), "sequence string, n int").collect() == [("ACD", 1)]
    assert [r["member"] for r in tables.read_clusters(spark, str(folder / "c.tsv")).collect()] == ["m1", "m2"]
    with pytest.raises(KeyError):
        tables.read_positives(spark, str(folder / "t.tsv"), "peptide")
    one, two = folder / "one", folder / "two"
    for f, names in ((one, {"a": b"1", "b": b"2"}), (two, {"a": b"1", "b": b"3", "c": b"9"})):
        f.mkdir()
        for k, v in names.items():
            (f / k).write_bytes(v)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    (folder / "sums").write_text(f"# sums\n{digest(b'1')} *a\n\n{digest(b'x')}  b\n{digest(b'')} gone\n")
    manifest = tables.read_manifest(spark, str(folder / "sums"))
    assert {tuple(r) for r in tables.checked(spark, str(one), manifest).collect()} == {("a", "ok"), ("b", "wrong"), ("gone", "missing")}
    assert {tuple(r) for r in tables.same_files(spark, str(one), str(two)).collect()} == {("a", True), ("b", False), ("c", False)}
    np.save(folder / "m.npy", np.arange(12, dtype=np.float64).reshape(4, 3))
    rows = tables.read_embeddings(spark, str(folder / "m.npy")).orderBy("row").collect()
    assert [list(r["embedding"]) for r in rows] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]
    tables.write_json({"a": [1]}, str(folder / "x.json"))
    assert tables.read_config(str(folder / "none.json"), str(folder / "x.json")) == {"a": [1]}
    assert "| 1 | 2 |" in tables.report(spark.createDataFrame([(1, 2)], "a int, b int"), "t")


def test_tails_of_t(spark):
    from pyspark.sql import functions as F

    def exact(t, n, steps=40_000):  # by quadrature
        c = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi)
        h = abs(t) / steps
        f = lambda x: (1 + x * x / n) ** (-(n + 1) / 2)
        return 1 - 2 * c * h * (f(0) / 2 + sum(f(i * h) for i in range(1, steps)) + f(t) / 2)

    cases = [(t, n) for t in (0.3, -1.7, 4.0) for n in (1, 2, 3, 4, 7, 10)]
    rows = spark.createDataFrame(cases, "t double, n int").withColumn("p", evaluation.t_tail(F.col("t"), F.col("n"))).collect()
    assert all(abs(r["p"] - exact(r["t"], r["n"])) < 1e-6 for r in rows)
    few = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 3.0), ("b", 2, 5.0)], "g string, s int, v double")
    assert evaluation.paired_test(few, "g", "a", "b", "s", "v").first()[:4] == (3.0, None, None, None)
    assert evaluation.gates(0.5, -0.1) == [] and len(evaluation.gates(0.3, 0.2)) == 2


def test_deduplication_by_brute_force(spark):
    import random

    r = random.Random(9)
    base = ["".join(r.choice("ACDEFGHIKL") for _ in range(20)) for _ in range(15)]
    library = []
    for i in range(120):
        s = list(base[i % 15])
        for _ in range(r.randint(0, 5)):
            s[r.randrange(20)] = r.choice("ACDEFGHIKL")
        library.append((i, "".join(s)))
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    kept = []
    for i, s in library:
        if not any(s == k or (brute(s, k) >= 0.8 and grams(s) & grams(k)) for _, k in kept):
            kept.append((i, s))
    assert [tuple(x) for x in sampling.deduplicated(spark.createDataFrame(library, "pos long, sequence string")).collect()] == kept
    members = sampling.clustered(spark.createDataFrame(library, "pos long, sequence string")).collect()
    assert {r["member"] for r in members} == {s for _, s in library}
    assert all(r["member"] == r["representative"] or brute(r["member"], r["representative"]) >= 0.4 for r in members)
    negatives = [r[0] for r in spark.createDataFrame(library, "pos long, sequence string").select(sampling.indels(__import__("pyspark.sql.functions", fromlist=["col"]).col("sequence"))).collect()]
    assert all(15 <= len(s) <= 25 for s in negatives)


def test_guards(spark):
    rows = spark.createDataFrame([(f"S{i}",) for i in range(10)], "sequence string")
    with pytest.raises(ValueError):
        sampling.with_clusters(rows, spark.createDataFrame([("r", "S1")], "representative string, member string"))
    with pytest.raises(ValueError):
        sampling.all_found(rows, spark.createDataFrame([("S1", 1)], "sequence string, x int"), "sequence")
    with pytest.raises(ValueError):
        sampling.capped_reference(spark.createDataFrame([(9,)], "length int"), 7)
    make = lambda k, asked: spark.createDataFrame([(f"{x:03d}",) for x in range(4 * k, 4 * k + 4)], "sequence string")
    assert sampling.gathered(make, 6) == [f"{x:03d}" for x in range(6)]
    with pytest.raises(ValueError):
        sampling.gathered(lambda k, asked: make(0, 1), 6, rounds=2)
    draws = sampling.weighted_sample(spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0)], "k string, w double"), "k", "w", 4000).groupBy("k").count().collect()
    assert {r["k"]: round(r["count"] / 1000) for r in draws} == {"a": 1, "b": 3}
    assert len(list(itertools.chain(draws))) == 2
