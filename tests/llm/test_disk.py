"""What corpus operators leave on disk, and links joined on the driver and in rounds."""

import os
import random
import time

import numpy as np

from strandwork.llm import common, graph, jaccard


def checkpoints(spark):
    top = common.shared_dir(spark).removeprefix("file://")
    return {f"{d}/{x}" for d, names, _ in os.walk(top) for x in names if x.startswith("rdd-")}


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {str(files.apply(i).getName()) for i in range(files.size())}


def test_jaccard_drops_tables_and_shuffles_on_the_way(spark):
    rng = random.Random(3)
    base = [[str(rng.randrange(500)) for _ in range(40)] for _ in range(20)]
    rows = [(k, " ".join([*base[k % 20][:-1], str(k // 20)])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tables, files = checkpoints(spark), shuffle_files(spark)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.components(docs).collect()}
    assert found == {k: k % 20 for k in range(60)}
    assert len(checkpoints(spark) - tables) <= 5
    for _ in range(20):  # files go in the background
        left = shuffle_files(spark) - files
        if len(left) <= 60:
            break
        time.sleep(0.5)
    assert len(left) <= 60  # of the last queries alone, which the caller ran


def test_links_on_the_driver_and_in_rounds_agree(spark):
    rng = random.Random(4)
    links = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)]
    least = {x: x for pair in links if pair[0] != pair[1] for x in pair}
    for _ in least:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    table = spark.createDataFrame(links, "a long, b long")
    assert dict(map(tuple, graph.components(table).collect())) == least
    before = checkpoints(spark)
    assert dict(map(tuple, graph.components(table, on_driver=10).collect())) == least
    assert len(checkpoints(spark) - before) <= 2
    ids, label = graph.joined(np.array([5, 4, 3]), np.array([4, 3, 9]))
    assert dict(zip(ids.tolist(), label.tolist(), strict=True)) == {3: 3, 4: 3, 5: 3, 9: 3}
