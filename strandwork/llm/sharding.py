"""Sharding by minimax contiguous partition: shards of near equal bytes that keep equal texts together.

The groups of equal texts are the atoms, ordered by a hash of the text. The smallest capacity that
lets a greedy walk over the atoms fill no more than the given number of shards is found by binary
search, and the walk with that capacity makes the cuts. The driver never sees all atoms: it works on
sums over ranges of the hash, a bounded number of them, and refines only ranges in which a cut can
fall, until each such range is a single atom. The cuts are exactly those of the walk over all atoms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, ranks

SHARDS = 24
#: A row's size besides its text's bytes; ranges that one refinement makes at most.
ROW_BYTES, RANGES = 8, 1 << 15
KEY_BITS = 60


def atom_key(text: Column) -> Column:
    """60 bits of the text's sha-256: the order of atoms, and with it their identity (texts that agree in all 60 stay together)."""
    return F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, KEY_BITS // 4), 16, 10).cast("long")


@dataclass
class Ranges:
    """Ranges of atoms in order: first key, bits of keys inside (0: one atom), total size, largest atom."""

    first: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    largest: np.ndarray


def walks(r: Ranges, capacity: int, shards: int, whole: bool) -> tuple[list[int], bool]:
    """Where the greedy walk's shards end, in bytes from the start, and whether ``shards`` reach the end.

    With ``whole``, ranges are taken whole or not at all, so the true walk gets at least as far; else
    ranges of many atoms are cut anywhere, so the true walk gets no farther. Over single atoms both
    are the true walk.
    """
    ends = np.cumsum(r.size)
    begins, out, done = ends - r.size, [], 0
    for _ in range(shards):
        if done + capacity >= ends[-1]:
            return [*out, int(ends[-1])], True
        k = int(np.searchsorted(ends, done + capacity, "right"))
        ahead = int(begins[k]) if whole or r.bits[k] == 0 else done + capacity
        if ahead <= done:
            break
        out.append(done := ahead)
    return out, False


def smallest(r: Ranges, low: int, shards: int, whole: bool) -> int:
    """The smallest capacity, ``low`` at least, with which the walk reaches the end."""
    high = int(r.size.sum())
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if walks(r, mid, shards, whole)[1] else (mid + 1, high)
    return low


def open_ranges(r: Ranges, shards: int) -> np.ndarray:
    """Ranges of many atoms in which a cut may fall, given what is known; ranges that are large besides."""
    low = smallest(r, max(int(r.largest.max()), -(-int(r.size.sum()) // shards)), shards, whole=False)
    large = (r.size > low // 64) & (r.bits > 0)
    if large.any():
        return large
    high = smallest(r, low, shards, whole=True)
    ends = np.cumsum(r.size)
    begins, found = ends - r.size, np.zeros(len(ends), bool)
    # a larger capacity gets farther with each shard, so each cut is between these two
    far, _ = walks(r, high, shards, whole=False)
    near, _ = walks(r, low, shards, whole=True)
    for j, end in enumerate(far):
        found |= (ends > (near[j] if j < len(near) else near[-1] if near else 0)) & (begins < end)
    return found & (r.bits > 0)


def plan(atoms: DataFrame, shards: int) -> list[int]:
    """The first keys of all shards but the first, for ``atoms`` (key, size), a row for each key."""
    total = atoms.agg(F.sum("size").alias("s")).first()["s"]
    if not total:
        return []
    known = Ranges(np.zeros(1, np.int64), np.array([KEY_BITS]), np.array([total]), np.array([0]))
    wanted = np.ones(1, bool)
    while wanted.any():
        step = max(1, RANGES.bit_length() - int(wanted.sum()).bit_length())
        finer = refined(atoms, known.first[wanted], known.bits[wanted], step)
        parts = [np.concatenate([getattr(known, f)[~wanted], finer[f].to_numpy(np.int64)]) for f in ("first", "bits", "size", "largest")]
        order = np.argsort(parts[0], kind="stable")
        known = Ranges(*(x[order] for x in parts))
        wanted = open_ranges(known, shards)
    cuts, _ = walks(known, smallest(known, int(known.largest.max()), shards, whole=True), shards, whole=True)
    return [int(known.first[k]) for k in np.searchsorted(np.cumsum(known.size), cuts[:-1], "right")]


def refined(atoms: DataFrame, first: np.ndarray, bits: np.ndarray, step: int) -> pd.DataFrame:
    """The given ranges, each cut into at most 2^step, with their sums; a range of one atom has bits 0 and its key."""
    found = None
    for wide in sorted(set(bits.tolist())):
        fine = max(0, wide - step)
        # RANGES rows at most
        tops = F.broadcast(atoms.sparkSession.createDataFrame(pd.DataFrame({"top": first[bits == wide] >> wide})))
        place = F.shiftright("key", fine)
        sums = atoms.join(tops, F.shiftright("key", wide) == F.col("top")).groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("size").alias("largest"), F.min("key").alias("least"))
        one = F.col("n") == 1
        own = sums.select(F.when(one, F.col("least")).otherwise(F.shiftleft("place", fine)).alias("first"), F.when(one, 0).otherwise(fine).alias("bits"), "size", "largest")
        found = own if found is None else found.union(own)
    return found.toPandas()


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs`` (doc_id, text).

    A row's size is its text's UTF-8 bytes and 8 more; a null text counts as the empty one and stays
    with it. Slots number a shard's rows without gaps, in the order of a hash of doc_id, then doc_id.
    A group larger than the mean shard makes its shard as large as itself. There may be fewer shards
    than asked for if there are fewer atoms; an empty table gives no row.
    """
    text = F.coalesce("text", F.lit(""))
    rows = common.checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), atom_key(F.col("text")).alias("key")))
    starts = plan(common.checkpointed(rows.groupBy("key").agg(F.sum("size").alias("size"))), shards)
    shard = sum(((F.col("key") >= s).cast("int") for s in starts), F.lit(0))
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("mixed", ranks.shuffled(F.col("doc_id"), 4))
    numbered = ranks.before(placed, ["shard"], "mixed", ["doc_id", "key"], {"slot": F.lit(1)}, rows.count())
    return numbered.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def write(docs: DataFrame, folder: str, shards: int = SHARDS) -> None:
    """The documents as Parquet, a folder for each shard, with their slots."""
    placed = assign(docs, shards).select("doc_id", "text_crc32", "shard", "slot").dropDuplicates(["doc_id", "text_crc32"])
    keyed = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    keyed.join(placed, ["doc_id", "text_crc32"]).drop("text_crc32").write.partitionBy("shard").parquet(folder)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; the law is that shards' bytes are near equal."""
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
