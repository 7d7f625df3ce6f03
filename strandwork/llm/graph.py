"""Connected components of a distributed table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: So many links at most are joined on the driver, 16 bytes each: a round over a small table is all tasks and files.
DRIVER_LINKS = 100_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links a[i], b[i], and the smallest that each can reach."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y, label[x], label[y]):  # nodes, and those that were their labels
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def components(links: DataFrame, on_driver: int = DRIVER_LINKS) -> DataFrame:
    """(id, label) of every node of ``links`` (a, b): the smallest id that it can reach.

    ``on_driver`` links at most are joined there; more are never collected, and go in rounds.
    """
    links = common.checkpointed(links.select("a", "b").filter("a <> b"))
    some = links.limit(on_driver + 1).toArrow()
    if some.num_rows <= on_driver:
        ids, label = joined(*(some.column(c).to_numpy().astype(np.int64) for c in "ab"))
        return links.sparkSession.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "label": pa.array(label, pa.int64())}))
    return common.settled(lambda: _rounds(links))


def _rounds(links: DataFrame) -> DataFrame:
    """Each round a node hears the labels of its neighbours' and its own labels. It takes the smallest of
    them, and so does the node that was its label, so whole trees of labels hook on and not their leaves
    alone; on paths, rounds grow with the logarithm of the length whatever the order of ids. Labels only
    fall, and when none does they are settled. Every round is cut off by a checkpoint; none is collected.
    """
    edges = common.checkpointed(links.select("a", F.explode(F.array("a", "b")).alias("b")).union(links.select("b", F.explode(F.array("a", "b")))).distinct())
    label = common.checkpointed(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")))
    while True:
        far = label.join(label.select(F.col("id").alias("label"), F.col("label").alias("far")), "label").select(F.col("id").alias("b"), "far")
        near = edges.join(far, "b").groupBy(F.col("a").alias("id")).agg(F.min("far").alias("near"))
        heard = label.join(near, "id").select(F.explode(F.array(F.struct("id", "near", F.col("label").alias("old")), F.struct(F.col("label").alias("id"), "near", F.lit(None).cast("long").alias("old")))).alias("x"))
        hooked = heard.groupBy(F.col("x.id").alias("id")).agg(F.min("x.near").alias("label"), F.max("x.old").alias("old"))
        hooked = common.checkpointed(hooked)
        label = hooked.select("id", "label")
        if hooked.filter("label <> old").isEmpty():
            return label
