"""The pipeline's stages on a small table."""

import corpus_pipeline


def test_stages(spark, tmp_path):
    import random

    r = random.Random(4)
    vocabulary = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)) + "."
    rows = [(i, text(120), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0", 0) for i in range(10)]  # exact copies
    rows += [(200 + i, "### " * 60 + text(80), "en", "s1", 0) for i in range(5)] + [(300, "short", "en", "s1", 0), (301, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [len(rows)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.count())
    assert kept[1] == kept[2] == 70 and kept[3] == 60
    ids = {x["doc_id"] for x in spark.read.parquet(f"{tmp_path}/2").select("doc_id").collect()}
    assert ids == set(range(60))
    assert {x["doc_id"] for x in docs.select("doc_id").collect()} <= ids
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[-1]


def test_empty_long_and_odd_tables(spark, tmp_path):
    import random

    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long, doc string, size int, slot long, component_id long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    r = random.Random(7)
    vocabulary = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)) + "."
    rows = [(i, text(120), "en", None if i % 4 else "s", None, "x", 1, 2, 3) for i in range(30)] + [(50, text(150_000), "en", "s", None, None, None, None, None), (7, None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{tmp_path}/odd")
        assert out.columns == docs.columns
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    assert pieces.filter("doc_id = 50").agg(F.sum("length")).first()[0] > 150_000
