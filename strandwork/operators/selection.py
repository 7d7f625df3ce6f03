"""Scoring over the strain panel, apportionment and constrained selection."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions import alignment, tables
from strandwork.functions import sequence as seq


def stub_log_mic(sequence: Column, species: Column) -> Column:
    """A stand-in for a trained scorer: -1 to 2 by the md5 of sequence and species."""
    h = F.conv(F.substring(F.md5(F.concat(sequence, F.lit("|"), species)), 1, 6), 16, 10).cast("double")
    return F.round(F.lit(-1.0) + 3.0 * h / 16777216.0, 6)


def predictions(candidates: DataFrame, score: Callable[[Column, Column], Column] = stub_log_mic) -> DataFrame:
    """(sequence, species, weight, negative, log_mic): every distinct candidate on the panel's nine species, whose rows are literals."""
    panel = F.array(*[F.struct(F.lit(s).alias("species"), F.lit(w).alias("weight"), F.lit(s in tables.PANEL_NEGATIVE).alias("negative")) for s, w in tables.panel().items()])
    rows = candidates.select("sequence").distinct().select("sequence", F.explode(panel).alias("p")).select("sequence", "p.*")
    return rows.withColumn("log_mic", score(F.col("sequence"), F.col("species")))


def panel_success(predicted: DataFrame) -> DataFrame:
    """Share of strains, weighted, at or below 16 uM: overall and by Gram class; the mean log10 MIC and the score."""
    hit = (F.col("log_mic") <= math.log10(tables.POTENT_UM)).cast("int") * F.col("weight")
    rate = lambda where: F.sum(F.when(where, hit)) / F.sum(F.when(where, F.col("weight")))
    out = predicted.groupBy("sequence").agg(
        rate(F.lit(True)).alias("success_overall"), rate(F.col("negative")).alias("success_gram_negative"), rate(~F.col("negative")).alias("success_gram_positive"),
        F.round(F.sum(F.col("log_mic") * F.col("weight")) / F.sum("weight"), 9).alias("mean_log_mic"),
    )
    eligible = (F.col("success_gram_negative") > 0) & (F.col("success_gram_positive") > 0)
    return out.withColumn("eligible", eligible).withColumn("score", -F.col("mean_log_mic") - F.when(eligible, 0.0).otherwise(tables.INELIGIBLE))


def apportioned(weights: DataFrame, total: int, key: str = "idx", weight: str = "weight") -> DataFrame:
    """Largest remainder: whole counts in proportion to weights that add up to ``total``, ties by ``key``. The rows are few: strata, not data."""
    everything = Window.partitionBy()
    exact = F.lit(total) * F.col(weight) / F.sum(weight).over(everything)
    out = weights.withColumn("exact", exact).withColumn("low", F.floor("exact"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("low"), 12)), key))
    out = out.withColumns({"rank": rank, "rest": F.lit(total) - F.sum("low").over(everything)})
    return out.withColumn("count", (F.col("low") + (F.col("rank") <= F.col("rest")).cast("int")).cast("long")).drop("exact", "low", "rank", "rest")


def grid(spark) -> DataFrame:
    """The conditioning grid: every species with every value of each axis; the weight is the species' times the selectivity's."""
    out = spark.createDataFrame(list(tables.panel().items()), "species string, species_weight int").withColumn("weight", F.col("species_weight"))
    for name, values, weights in tables.GRID_AXES:
        cells = F.array(*[F.struct(F.lit(v).alias(name), F.lit((weights or [1] * len(values))[i]).alias("w")) for i, v in enumerate(values)])
        out = out.withColumn("x", F.explode(cells)).withColumn("weight", F.col("weight") * F.col("x.w")).withColumn(name, F.col(f"x.{name}")).drop("x")
    return out.withColumn("cys_class", F.lit(tables.GRID_CYSTEINE_CLASS)).drop("species_weight")


def capped_top(candidates: DataFrame, k: int, per_cluster: int = 4, ceiling: float | None = None) -> DataFrame:
    """The first ``k`` by score, then sequence, with at most ``per_cluster`` of a cluster (negative ones are no cluster) and no identity above ``ceiling``."""
    out = candidates if ceiling is None else candidates.filter(F.col("identity") <= ceiling)
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "sequence"))
    # a cluster's cap depends on its own order alone, so it may come before the limit
    return out.withColumn("r", rank).filter((F.col("r") <= per_cluster) | (F.col("cluster") < 0)).drop("r").orderBy(F.desc("score"), "sequence").limit(k)


def identity(a: str, b: str) -> float:
    """Twice the longest common subsequence over the sum of lengths, for two strings; 0 if either is empty."""
    return 2.0 * alignment.subsequence(a, b) / (len(a) + len(b)) if a and b else 0.0


def diverse_top(candidates: DataFrame, k: int, least_eligible: int, ladder: tuple[float, ...] = (0.60, 0.65, 0.70, 0.75), ceiling: float = 0.75, long_share: float = 0.20) -> list[dict]:
    """Greedy choice by score, then sequence, of ``k`` that differ: none too like a reference or one chosen before, few of 38 residues and more.

    The candidates stream to the driver in order, and only until ``k`` are chosen; what it keeps are
    those. The first rung of the ladder with enough eligible ones wins; ValueError if none has. The
    candidates are computed once, whatever the number of rungs.
    """
    order = candidates.select("sequence", "score", "identity").filter(F.col("identity") <= ceiling).persist()
    try:
        for rung in ladder:
            chosen: list[dict] = []
            for row in order.orderBy(F.desc("score"), "sequence").toLocalIterator(prefetchPartitions=True):
                if len(chosen) == k:
                    break
                s, n_long = row["sequence"], sum(len(c["sequence"]) >= 38 for c in chosen)
                if len(s) >= 38 and n_long + 1 > long_share * (len(chosen) + 1):
                    continue
                if all(identity(s, c["sequence"]) <= rung for c in chosen):
                    chosen.append({"rank": len(chosen) + 1, "sequence": s, "score": row["score"], "rung": rung})
            if sum(c["score"] > -5 for c in chosen) >= least_eligible:
                return chosen
    finally:
        order.unpersist()
    raise ValueError("too few eligible candidates at every rung")


def first_occurrences(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("r = 1").drop("r")


def hash_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows without replacement: those with the smallest md5 of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def packed_splits(sizes: list[tuple[int, int]], shares: dict[str, float]) -> dict[int, str]:
    """Clusters (id, size), largest first, each to the split that lacks most, ties by order."""
    total = sum(n for _, n in sizes)
    lacks = {k: share * total for k, share in shares.items()}
    out = {}
    for cluster, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        best = max(lacks, key=lambda k: lacks[k])
        out[cluster], lacks[best] = best, lacks[best] - n
    return out


#: Sequences of up to so many residues are worked on together; longer ones alone.
TOGETHER = 64


def spread(x: np.ndarray) -> np.ndarray:
    """``x`` (uint64) with every bit spread over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _three(sequences: list[str], keys: np.ndarray, seed: int) -> list[list[str]]:
    """Shuffled, random and mutated sequences; ``keys`` are the sequences' hashes."""
    width = max(map(len, sequences))
    n = np.array(list(map(len, sequences)))
    own = np.array(sequences, f"U{width}").view(np.uint32).reshape(len(n), width)
    at = np.arange(width, dtype=np.uint64)
    h = lambda what: spread(spread(keys[:, None] ^ spread(np.array([seed * 8 + what], np.uint64))) + at * np.uint64(0x9E3779B97F4A7C15))
    inside = np.arange(width) < n[:, None]
    order = lambda what: np.argsort(np.where(inside, h(what) >> np.uint64(1), np.uint64(2**64 - 1)), axis=1, kind="stable")
    letters = np.array(list(map(ord, tables.AMINO_ACIDS)), np.uint32)
    number = lambda what, k: (h(what) % np.uint64(k)).astype(np.int64)
    shuffled = np.take_along_axis(own, order(0), axis=1)
    drawn = letters[number(1, 20)]
    known = own[:, :, None] == letters
    place = np.where(known.any(axis=2), known.argmax(axis=2), -1)
    chosen = np.zeros(own.shape, bool)
    np.put_along_axis(chosen, order(2)[:, :5], True, axis=1)
    mutated = np.where(chosen, letters[(place + 1 + number(3, 19)) % 20], own)
    return [np.ascontiguousarray(np.where(inside, x, 0).astype(np.uint32)).view(f"U{width}").ravel().tolist() for x in (shuffled, drawn, mutated)]


def negatives(df: DataFrame, seed: str = "0") -> DataFrame:
    """Three negatives of each sequence: its residues shuffled, random ones of its length, and five places changed to other residues.

    All choices come from hashes of seed, sequence and place, in numpy, so reruns agree.
    """
    kinds, number = ("shuffled", "random", "mutated"), zlib.crc32(seed.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, keys = batch.column("sequence").to_pylist(), batch.column("key").to_numpy().view(np.uint64)
            n = np.array([len(s or "") for s in own])
            yield from _batch([s for s in own if not s], [[s for s in own if not s]] * 3)
            some = np.flatnonzero((n > 0) & (n <= TOGETHER))
            for at in [some] * bool(len(some)) + [np.array([i]) for i in np.flatnonzero(n > TOGETHER)]:
                part = [own[i] for i in at]
                yield from _batch(part, _three(part, keys[at], number))

    def _batch(own: list[str], made: list[list[str]]) -> Iterator[pa.RecordBatch]:
        for kind, values in zip(kinds, made, strict=True):
            if own:
                yield pa.RecordBatch.from_pydict({"sequence": pa.array(own, pa.string()), "kind": pa.array([kind] * len(own), pa.string()), "negative": pa.array(values, pa.string())})

    rows = df.select("sequence").distinct().select("sequence", F.xxhash64("sequence").alias("key"))
    return rows.mapInArrow(run, "sequence string, kind string, negative string")
