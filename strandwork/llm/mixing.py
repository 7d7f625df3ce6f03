"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots, blocks of equally many words. Slots are ordered by their van der Corput
points, and each source has a stretch of that order, as long as its share of the cumulative slots; so
every stretch of the mix has the sources' shares, to a few blocks. A source's documents, shuffled, are
one row of words, gone through again from the start when it runs out, until its target is met to the
word; its k-th block of words goes to the k-th of its slots. A document stays whole: it stands in the
slot where it begins. Slots are counted, not made: the k-th slot of a source is found by bisection.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, ranks

#: Weights of the sources in code point order, null last, again and again; words of the mix for each word of the input; a target's most for each word of its source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Words of a slot. It decides how finely sources alternate, and not how much is taken of any document.
BLOCK = 1024
#: The driver and each task hold a row for each source; more than this raise ValueError.
MOST_SOURCES = 10_000
SEED = 6
SIZE = r"cast(coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0) as long)"


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take of each source: ``share`` of all, by weight, a source's excess over ``most`` times its size going to the rest.

    Sources are filled in the order in which they reach their limits, so each is looked at once.
    """
    left, total, out = share * sum(sizes), sum(weights), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    for at, i in enumerate(order):
        if left * weights[i] <= most * sizes[i] * total:
            for j in order[at:]:
                out[j] = left * weights[j] / total
            break
        out[i] = float(most * sizes[i])
        left, total = left - out[i], total - weights[i]
    return out


class Slots:
    """The slots of sources that have ``counts`` of them: which source a slot has, and where a source's k-th slot is."""

    def __init__(self, counts: list[int]) -> None:
        self.ends = list(itertools.accumulate(counts))
        self.n = self.ends[-1] if counts else 0
        self.bits = max(1, (self.n - 1).bit_length())
        # a source's points are those from the limit below which lie the slots before it
        limits = np.array([self._limit(rank) for rank in [0, *self.ends]], np.int64)
        self.set, self.rest = self._parts(limits)

    def _parts(self, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each leading bit j of a limit: whether it is set, and the slot that agrees with the limit in the bits above and has none at j."""
        put, rest, above = [], [], np.zeros(len(limits), np.int64)
        for j in range(self.bits):
            bit = limits >> (self.bits - 1 - j) & 1
            put.append(bit | (limits >> self.bits if j == 0 else 0))
            rest.append(above.copy())
            above |= bit << j
        return np.array(put) > 0, np.array(rest)

    def _below(self, slots: np.ndarray, put: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """How many of the slots 0, 1, ... up to ``slots`` have points below limits."""
        out = np.zeros(np.shape(slots), np.int64)
        for j in range(self.bits):
            out += np.where(put[j], np.maximum(0, (slots - rest[j] + (2 << j) - 1) >> (j + 1)), 0)
        return out

    def _limit(self, rank: int) -> int:
        """The smallest limit that so many of all slots' points lie below."""
        low, high = 0, 1 << self.bits
        while low < high:
            mid = (low + high) // 2
            found = self.n if mid >> self.bits else int(self._below(np.array([self.n]), *self._parts(np.array([mid])))[0])
            low, high = (low, mid) if found >= rank else (mid + 1, high)
        return low

    def source(self, slot: int) -> int:
        point = int(f"{slot:0{self.bits}b}"[::-1], 2)
        rank = int(self._below(np.array([self.n]), *self._parts(np.array([point])))[0])
        return bisect.bisect_right(self.ends, rank)

    def place(self, source: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The slot of each source's k-th block."""
        low, high = np.zeros(len(k), np.int64), np.full(len(k), max(0, self.n - 1), np.int64)
        begin, end = (self.set[:, source], self.rest[:, source]), (self.set[:, source + 1], self.rest[:, source + 1])
        last = np.array([*self.ends])[source] >= self.n  # all points lie below a limit above all
        while (low < high).any():
            mid = (low + high) // 2
            upto = np.where(last, mid + 1, self._below(mid + 1, *end))
            enough = upto - self._below(mid + 1, *begin) > k
            low, high = np.where(enough, low, mid + 1), np.where(enough, mid, high)
        return low


def schedule(docs: DataFrame, **options: object) -> DataFrame:
    """For every row of ``docs`` (doc_id, text, source): doc_id, hash (of the text), source, size, source_size, target, taken and starts.

    Sizes are words; a null text has none. ``taken`` counts the words of the document that the mix
    takes, repeats counted: a source gets its target to the nearest word, a document at most ``most``
    times its size. ``starts`` has (words, slot, offset) for each time that the document is taken: how
    many of its first words, the slot that the first stands in, and how many words of the slot are
    before it. A source's documents are in the order of a hash of doc_id and SEED, so reruns agree. An
    empty table gives no row; a source without words a target of 0. A text of any length is only counted.
    """
    return planned(docs, **options)[0]


def planned(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> tuple[DataFrame, int]:
    """``schedule``, and how many slots the mix has."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.expr(SIZE).alias("size"), F.xxhash64("text").alias("hash"))
    rows = common.checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    sources = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found = {r["source"]: (r["n"], r["size"]) for r in sources}
    names = sorted(found, key=lambda x: (x is None, x or ""))
    sizes = [found[x][1] for x in names]
    aims = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(names))], share, most)
    words = [min(most * n, round(t)) for n, t in zip(sizes, aims, strict=True)]
    slots = Slots([-(-w // block) for w in words])
    table = spark.createDataFrame([(i, x, n, float(t), w) for i, (x, n, t, w) in enumerate(zip(names, sizes, aims, words, strict=True))], "s int, name string, source_size long, target double, words long")
    rows = rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).drop("name")  # MOST_SOURCES rows at most

    placed = ranks.before(rows.withColumn("mixed", ranks.shuffled(F.col("doc_id"), SEED)), ["s"], "mixed", ["doc_id", "hash", "row"], {"begin": F.col("size")}, sum(x[0] for x in found.values()))
    # each round through the source's words that still reaches the document, and how many of its words it takes
    rounds = "if(size > 0 and begin < words, sequence(0L, (words - begin - 1) div source_size), cast(array() as array<long>))"
    times = placed.withColumn("times", F.expr(f"transform({rounds}, r -> named_struct('at', begin + r * source_size, 'words', least(size, words - begin - r * source_size)))"))

    @F.arrow_udf("array<long>")
    def slots_of(s: pa.Array, at: pa.Array) -> pa.Array:
        n = at.value_lengths().to_numpy(zero_copy_only=False)
        k = at.flatten().to_numpy(zero_copy_only=False) // block
        found = slots.place(np.repeat(s.to_numpy(zero_copy_only=False).astype(np.int64), n), k)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(found, pa.int64()))

    out = times.withColumn("slots", slots_of("s", F.transform("times", lambda x: x["at"])))
    starts = F.expr(f"transform(times, (x, i) -> named_struct('words', x.words, 'slot', slots[i], 'offset', x.at % {block}))")
    taken = F.expr("aggregate(times, 0L, (a, x) -> a + x.words)")
    return out.select("doc_id", "hash", "source", "size", "source_size", "target", taken.alias("taken"), starts.alias("starts")), slots.n


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; slot and offset are those of the first time that a document is taken, null if it isn't."""
    first = F.get("starts", F.lit(0))
    return schedule(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", first["slot"].alias("slot"), first["offset"].alias("offset"))


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The documents of the mix in its order, with the columns of ``docs`` whatever their names: a row for each time that a document is taken.

    Rows are sorted by slot over the whole result, so files written from it are the mix in order. The
    last document of a source may be cut to its first words; ``n_chars``, if there, is then set to that
    text's length. Rows of equal doc_id, text and source share their times one by one; documents
    without words are never taken. An empty table gives no row.
    """
    found, n_slots = planned(docs, **options)
    found = found.filter("taken > 0")
    key = [F.col("doc_id").alias("k_id"), F.col("hash").alias("k_hash"), F.col("source").alias("k_source")]
    numbered = lambda df: df.withColumn("k_copy", F.row_number().over(Window.partitionBy("k_id", "k_hash", "k_source").orderBy(F.lit(1))))
    times = numbered(found.select(*key, "size", "starts"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("k_id"), F.xxhash64("text").alias("k_hash"), F.col("source").alias("k_source"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("k_id", "k_hash", "k_source", "k_copy")]
    joined = numbered(own).alias("l").join(times.alias("r"), same[0] & same[1] & same[2] & same[3])
    out = joined.select("l.doc", "r.size", F.explode("r.starts").alias("x"))
    # pieces of the text that end with a word each keep its spacing
    cut = F.expr(r"array_join(slice(split(doc.text, '(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])'), 1, cast(x.words as int)), '')")
    whole = F.col("x.words") == F.col("size")
    out = out.withColumn("doc", F.when(whole, F.col("doc")).otherwise(F.col("doc").withField("text", cut)))
    if "n_chars" in docs.columns:
        length = F.length(F.col("doc.text")).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("doc", F.when(whole, F.col("doc")).otherwise(F.col("doc").withField("n_chars", length)))
    # slots are of equal size, so ranges of them need no sample of the rows
    parts = common.shuffle_partitions(docs.sparkSession)
    ordered = out.repartitionById(parts, (F.col("x.slot") * parts / max(1, n_slots)).cast("int")).sortWithinPartitions("x.slot", "x.offset", "doc.doc_id")
    return ordered.select("doc.*")
