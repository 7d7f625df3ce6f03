"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces of 4096 while they last and then of the binary lengths of the
rest, longest first. Each piece is a sequence of its own, and sequences of equal length share a
bucket, so batches need no padding and no sequence crosses documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

#: Longest sequence, a power of two; the id that ends a document.
LONGEST, END_ID = 4096, 2
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The binary lengths that a document of ``n`` ids is cut into."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, path: str | None = None, longest: int = LONGEST, end: int = END_ID, added: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty text is one end id. Rows
    that repeat a doc_id are packed each on its own. Each piece fills its sequence from offset 0.
    sequence_id has the length's exponent above 59 bits that are unique, so equal lengths are adjacent.
    ``added``: added tokens in a text get their own ids. No shuffle: a row needs no other row. An empty table gives no piece.
    """
    path = path or common.tokenizer_path("word_bpe_49k.json")
    assert longest & (longest - 1) == 0, "the longest sequence must be a power of two"

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, starts = bpe.encoder(path, added).encode([x or "" for x in batch.column("text").to_pylist()], end)
        doc, start, length, total, at = [], [], [], [], []
        for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            done = 0
            for n in lengths(b - a, longest):
                doc.append(i)
                start.append(done)
                length.append(n)
                total.append(b - a)
                at.append(a + done)
                done += n
        at.append(len(ids))  # pieces follow one another, so one buffer holds them all
        offsets = pa.py_buffer(np.array(at, np.int32) * 4)
        data = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, offsets, pa.py_buffer(ids.astype("<u4"))])
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), data, pa.array(total, pa.int64())], names=["doc_id", "start", "length", "ids", "doc_tokens"])

    cutted = common.map_texts(docs, [F.col("doc_id").cast("long").alias("doc_id"), "text"], "text", cut, SCHEMA)
    bucket = F.log2("length").cast("long")
    return cutted.select("*", (F.shiftleft(bucket, 59) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(docs: DataFrame, folder: str, **options: object) -> None:
    """The sequences as Parquet, a folder for each length."""
    pieces(docs, **options).withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(folder)


def digest(docs: DataFrame, **options: object) -> DataFrame:
    """The contract's columns: ids as their crc32."""
    return pieces(docs, **options).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
