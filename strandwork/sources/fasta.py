"""FASTA files: records, the three readings of them, and writing.

Files are split where a line begins with ``>``, by Spark's text reader, so one large file is read by
many tasks. Records carry their place (file, block, n), which orders them as in the files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.functions import sequence as seq

SHAPE = "file string, block long, n long, led boolean, header string, lines array<string>"


def records(spark: SparkSession, path: str) -> DataFrame:
    """(place, led, header, lines) of every record; text before a file's first header is a record without one (``led`` is false, header null). Lines are stripped."""
    text = spark.read.text(path, lineSep="\n>").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for batch in batches:
            out = []
            for value, file, block in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block")), strict=True):
                begins = (file, block) != now
                if begins:
                    now, n = (file, block), 0
                # the separator took the mark of all but the first record of a file
                text = value if begins and block == 0 else ">" + value
                held: list = [False, None, []]
                for line in map(str.strip, text.splitlines()):
                    if line.startswith(">"):
                        if held[0] or any(held[2]):
                            out.append((file, block, n, *held))
                            n += 1
                        held = [True, line[1:], []]
                    else:
                        held[2].append(line)
                if held[0] or any(held[2]):
                    out.append((file, block, n, *held))
                    n += 1
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.string())]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SHAPE.split(", ")])

    return text.mapInArrow(run, SHAPE).select(F.struct("file", "block", "n").alias("place"), "led", "header", "lines")


def headed(spark: SparkSession, path: str) -> DataFrame:
    """(place, header, sequence): upper case, records without residues kept, text before the first header dropped."""
    return records(spark, path).filter("led").select("place", "header", F.upper(F.array_join("lines", "")).alias("sequence"))


def cleaned(spark: SparkSession, path: str) -> DataFrame:
    """(place, sequence): standard residues alone, which may leave none; records without residues dropped, text before the first header kept as one."""
    own = F.array_join("lines", "")
    return records(spark, path).filter(own != "").select("place", seq.clean(own).alias("sequence"))


def raw(spark: SparkSession, path: str) -> DataFrame:
    """(place, sequence): one for each header, residues as written."""
    return records(spark, path).filter("led").select("place", F.array_join("lines", "").alias("sequence"))


def by_identifier(spark: SparkSession, path: str) -> DataFrame:
    """(identifier, sequence): the first line after each header that isn't empty; of equal headers the last one's."""
    own = records(spark, path).filter("led and header <> '' and size(lines) > 0")
    return own.groupBy(F.col("header").alias("identifier")).agg(F.max_by(F.get("lines", F.lit(0)), "place").alias("sequence"))


def write(df: DataFrame, path: str, prefix: str = "seq", separator: str = "", order: str = "pos", column: str = "sequence") -> None:
    """The sequences in order, each under ``>{prefix}{separator}{i}`` with i from 1: part files whose names keep the order."""
    rows = df.select(order, column).orderBy(order).rdd.zipWithIndex().map(lambda x: (f">{prefix}{separator}{x[1] + 1}\n{x[0][1] or ''}",))
    rows.toDF("value string").write.text(path)
