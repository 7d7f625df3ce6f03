"""Document fingerprints by MinHash over five-word shingles.

A fingerprint holds, for each of 128 universal hash functions, the smallest hash of any shingle of the
text; two fingerprints agree in about as many places as their shingle sets' Jaccard similarity. A text
of fewer than five words is cut into runs of five characters instead. A text without words has the
largest value everywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, jaccard, shingles

WORDS, PLACES, SEED = 5, 128, 20_240
LARGEST = 0xFFFFFFFF
_random = np.random.default_rng(SEED)
#: The functions x -> (a x + b mod 2^64) >> 32, universal over 32-bit x.
A = _random.integers(0, 1 << 63, PLACES, np.uint64) * np.uint64(2) + np.uint64(1)
B = _random.integers(0, 1 << 63, PLACES, np.uint64) * np.uint64(2) + _random.integers(0, 2, PLACES, np.uint64)
FIRST = -(1 << 63)


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, and how many each has."""
    found, counts = shingles.hashes(texts, WORDS)
    short = [i for i in np.flatnonzero(counts == 1).tolist() if len(shingles.words_of(texts[i])) < WORDS]
    if not short:
        return found, counts
    letters = [np.frombuffer(" ".join(x.decode() for x in shingles.words_of(texts[i])).encode("utf-32-le"), np.uint32).astype(np.uint64) for i in short]
    more, sizes = shingles.rolled(shingles.mixed(np.concatenate(letters)), np.array(list(map(len, letters))), 5)
    parts = np.split(found, np.cumsum(counts)[:-1])
    for i, part in zip(short, np.split(more, np.cumsum(sizes)[:-1]), strict=True):
        parts[i] = part
    return np.concatenate(parts), np.array(list(map(len, parts)))


def signatures(texts: list[str | None]) -> np.ndarray:
    """A row of PLACES smallest hashes (uint32) for each text."""
    found, counts = shingle_sets(texts)
    out = np.full((len(texts), PLACES), LARGEST, np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        x, starts = found >> np.uint64(32), (np.cumsum(counts) - counts)[full]
        for k in range(PLACES):
            out[full, k] = np.minimum.reduceat((A[k] * x + B[k]) >> np.uint64(32), starts)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of places in which rows of signatures agree."""
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """``text``, its last quarter replaced by as much of what follows."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (block, ahead, doc_id, text), sorted within partitions, where each document is followed by the next in its block.

    Blocks are ranges of doc_id. The first document of a block also stands at the end of the block
    before (the first of all at the end of the last), marked ``ahead``, so no row needs another block.
    Null ids come first; rows that repeat an id follow one another by text.
    """
    spark = docs.sparkSession
    n = common.shuffle_partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(FIRST).cast("long"))
    bounds = [k[0] for k in common.boundaries(docs, ["doc_id"], n)]
    first = docs.select(F.min(key)).first()[0]
    cuts = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def block(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), "right").astype(np.int32))

    own = F.struct(F.col("own").alias("block"), F.lit(False).alias("ahead"))
    before = F.when(F.col("key").isin(bounds), F.struct((F.col("own") - 1).alias("block"), F.lit(True).alias("ahead")))
    last = F.when(F.col("key") == F.lit(first), F.struct(F.lit(len(bounds)).alias("block"), F.lit(True).alias("ahead")))
    dealt = docs.withColumn("key", key).withColumn("own", block("key")).withColumn("to", F.explode(F.array_compact(F.array(own, before, last))))
    return dealt.select("to.*", "doc_id", "text").repartitionById(n, F.col("block")).sortWithinPartitions("block", "ahead", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how like they and the next document's are.

    The next document is the one of the next larger doc_id, after the last the first. Null texts are
    empty; two empty texts are alike (1). One row for each row of ``docs``; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            begun, size = 0, 0
            for i, r in enumerate(rows):
                size += len(r[3])
                if size > common.SLICE_CHARS or i == len(rows) - 1:
                    yield from some(rows[begun : i + 1])
                    begun, size = i, len(r[3])  # the last one waits for its next

        def some(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            pairs = [(i, i + 1) for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            if not pairs:
                return
            texts = [r[3] for r in rows]
            a, b = map(list, zip(*pairs, strict=True))
            changed = [edited(texts[i], texts[j]) for i, j in pairs]
            own, other = signatures(texts), signatures(changed)
            text_of = lambda sig: [x.tobytes().hex() for x in sig.astype(">u4")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][2] for i in a], pa.int64()),
                    pa.array([len(texts[i]) for i in a], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                    pa.array(text_of(own[a])),
                    pa.array(text_of(other)),
                    pa.array(likeness(own[a], other)),
                    pa.array(likeness(own[a], own[b])),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            for piece in common.slices(batch, "text"):
                rows = held + list(zip(*(piece.column(c).to_pylist() for c in ("block", "ahead", "doc_id", "text")), strict=True))
                if rows:
                    yield from out(rows)
                    held = rows[-1:]

    if docs.select(F.lit(1)).isEmpty():
        return docs.sparkSession.createDataFrame([], SCHEMA)
    return with_next(docs).mapInArrow(run, SCHEMA)


#: Bands of a fingerprint and places of a band: at a similarity of 0.8, one pair in twenty million shares no band.
BANDS = 32


def band_keys(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """(id, key): a hash of each band of each document's fingerprint. Documents without words have none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        sig = signatures(texts)
        full = np.flatnonzero((sig != LARGEST).any(axis=1))
        values = np.ascontiguousarray(sig[full]).reshape(len(full) * bands, -1).astype(np.uint64)
        mixed = np.tile(np.arange(bands, dtype=np.uint64), len(full))
        for k in range(values.shape[1]):
            mixed = shingles.mixed(mixed * shingles.PLACES[k] + values[:, k])
        ids = batch.column("doc_id").take(pa.array(np.repeat(full, bands)))
        return pa.RecordBatch.from_arrays([ids, pa.array(mixed.view(np.int64))], names=["id", "key"])

    return common.map_texts(docs.filter(F.col("doc_id").isNotNull()), [F.col("doc_id").cast("long").alias("doc_id"), "text"], "text", run, "id long, key long")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id and component_id of every row: documents that share a band and whose five-word shingle sets are similar enough are linked.

    Each document is first compared with the one of the smallest id in each of its bands, then with all
    those of its bands that are not joined to it yet, so a large group of copies gives few pairs and no
    pair is left out. A row without doc_id has a null component; one without words is alone.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = band_keys(docs)
    first = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("first")).filter("c > 1").select("key", "first")
    shared = common.checkpointed(keys.join(first, "key"))
    star = common.checkpointed(shared.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    links = common.checkpointed(jaccard.similar(docs, star, WORDS, percent))
    label = graph.components(links)
    joined = common.checkpointed(shared.join(label, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label")))
    across = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label"))
    rest = joined.alias("x").join(joined.alias("y"), across).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    more = jaccard.similar(docs, common.checkpointed(rest), WORDS, percent)
    label = graph.components(links.union(more))
    return docs.select(F.col("doc_id")).join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("component_id"))
