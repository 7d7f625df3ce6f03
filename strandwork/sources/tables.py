"""Tables, manifests and configurations from files, and the engine's sinks."""

from __future__ import annotations

import io
import json
import os
import posixpath
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.functions import sequence as seq

from . import fasta

FASTA, TABS, SHEETS = (".fasta", ".fa", ".faa"), (".tsv", ".tab"), (".xlsx", ".xls")


def suffix(path: str) -> str:
    return posixpath.splitext(path.rstrip("/"))[1].lower()


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table with a header line, by the file's suffix: tabs, a spreadsheet, else commas. Without a schema all columns are strings."""
    if suffix(path) in SHEETS:
        return spark.createDataFrame(pd.read_excel(path, dtype=None if schema else str), schema)
    reader = spark.read.option("header", True).option("sep", "\t" if suffix(path) in TABS else ",")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_positives(spark: SparkSession, path: str, column: str = "sequence") -> DataFrame:
    """Sequences of a FASTA file or of a table, which must have the column (KeyError)."""
    if suffix(path) in FASTA:
        return fasta.cleaned(spark, path).select(F.col("sequence").alias(column))
    out = read_table(spark, path)
    if column not in out.columns:
        raise KeyError(f"{path} has no column {column}")
    return out


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(representative, member) of a table of clusters without a header."""
    return spark.read.schema("representative string, member string").option("sep", "\t").csv(path)


def read_config(*paths: str) -> object:
    """The JSON of the first of the paths that is there."""
    for path in paths:
        if os.path.exists(path):
            with open(path) as f:
                return json.load(f)
    raise FileNotFoundError(", ".join(paths))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, digest) of a checksum file: ``digest name`` lines, a mark before the name dropped, comments and empty lines skipped."""
    line = F.trim("value")
    kept = spark.read.text(path).select(line.alias("line")).filter("line <> '' and not startswith(line, '#')")
    return kept.select(F.regexp_replace(F.trim(F.regexp_extract("line", r"^\S+ ?(.*)$", 1)), r"^\*+", "").alias("name"), F.regexp_extract("line", r"^([^ ]+)", 1).alias("digest"))


def checked(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(name, status) of every file of a manifest: ok, wrong (another digest) or missing. Files are hashed where they are read; Spark passes over empty ones, so they count as missing."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.lower("digest"), "ok").otherwise("wrong")
    return manifest.join(files, "name", "left").select("name", status.alias("status"))


def same_files(spark: SparkSession, a: str, b: str) -> DataFrame:
    """(name, same) of every file of two folders: whether both have it with the same bytes."""
    side = lambda folder, x: spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias(x))
    return side(a, "x").join(side(b, "y"), "name", "full").select("name", F.col("x").eqNullSafe(F.col("y")).alias("same"))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(row, embedding) of a matrix in numpy's format; one file is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                matrix = np.load(io.BytesIO(content))
                for at in range(0, len(matrix), 4096):
                    part = matrix[at : at + 4096].astype(np.float32)
                    yield pd.DataFrame({"row": np.arange(at, at + len(part)), "embedding": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row long, embedding array<float>")


def distinct_sequences(df: DataFrame, role: str | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Sorted distinct sequences, perhaps of one role and within lengths."""
    if role is not None:
        df = df.filter(F.col("role") == role)
    if low is not None:
        df = df.filter(F.length("sequence").between(low, high))
    return df.select("sequence").distinct().orderBy("sequence")


def write_csv(df: DataFrame, path: str, places: int | None = None) -> None:
    """CSV with a header; with ``places``, doubles are written with so many decimals."""
    show = lambda c, t: F.format_string(f"%.{places}f", c).alias(c) if places is not None and t in ("double", "float") else F.col(c)
    df.select(*[F.when(F.col(c).isNotNull(), show(c, t)).alias(c) for c, t in df.dtypes]).write.option("header", True).csv(path)


def write_json(value: object, path: str) -> None:
    """A small configuration or report, put in place whole."""
    draft = f"{path}.part"
    with open(draft, "w") as f:
        json.dump(value, f, indent=2, sort_keys=True)
    os.replace(draft, path)


def report(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report of at most ``most`` rows as a markdown table."""
    rows = df.limit(most).collect()
    return "\n".join([f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns), *("| " + " | ".join(map(str, r)) + " |" for r in rows)]) + "\n"


def ledger(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """A run ledger with new rows: the columns of both, nulls where a row has none."""
    return new if old is None else old.unionByName(new, allowMissingColumns=True)


def spaced(s: Column) -> Column:
    """A sequence as a tokenizer of residues wants it: upper case, a space between residues."""
    return F.array_join(seq.residues(F.upper(s)), " ")
