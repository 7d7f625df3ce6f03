"""Checks of libraries and ranked lists, as rows of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions import sequence as seq


def problems(library: DataFrame, excluded: DataFrame) -> DataFrame:
    """(problem, n): invalid sequences by reason, repeats, and members of the excluded set."""
    reasons = library.select(seq.invalid_reason(F.col("sequence")).alias("problem")).filter("problem is not null")
    repeats = library.groupBy("sequence").agg((F.count("*") - 1).alias("extra")).select(F.lit("duplicate").alias("problem"), "extra").filter("extra > 0")
    overlap = library.select("sequence").distinct().join(excluded.select("sequence").distinct(), "sequence", "left_semi").select(F.lit("in excluded set").alias("problem"))
    one = lambda df: df.select("problem", F.lit(1).cast("long").alias("extra"))
    return one(reasons).union(repeats).union(one(overlap)).groupBy("problem").agg(F.sum("extra").alias("n"))


def record_messages(records: DataFrame) -> DataFrame:
    """(pos, message) of every record (pos, sequence) of a sequence file: all that is wrong with it."""
    s, first = F.col("sequence"), F.row_number().over(Window.partitionBy("sequence").orderBy("pos"))
    said = F.array_compact(F.array(
        F.when(F.length(s) == 0, "empty"), F.when((F.length(s) > 0) & ~s.rlike(seq.VALID), "invalid characters"), F.when(F.length(s).between(1, seq.t.MIN_LENGTH - 1), "too short"),
        F.when(F.length(s) > seq.t.MAX_LENGTH, "too long"), F.when(F.col("r") > 1, "duplicate"),
    ))
    return records.withColumn("r", first).select("pos", F.explode(said).alias("message"))


def rank_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """For two ranked lists (rank, sequence): places that agree, sequences shared, the first rank that differs."""
    same = a.join(b.withColumnRenamed("sequence", "other"), "rank").select("rank", (F.col("sequence") == F.col("other")).alias("same"))
    shared = a.select("sequence").distinct().join(b.select("sequence").distinct(), "sequence", "left_semi").agg(F.count("*").alias("shared"))
    out = same.agg(F.count_if("same").alias("agreeing"), F.min(F.when(~F.col("same"), F.col("rank"))).alias("first_mismatch"))
    return out.withColumn("shared", shared.scalar())


def missing_members(part: DataFrame, whole: DataFrame) -> DataFrame:
    return part.select("sequence").distinct().join(whole.select("sequence").distinct(), "sequence", "left_anti")


def file_findings(records: DataFrame, expected: int) -> DataFrame:
    """(pos, message): all that is wrong with a sequence file's records (pos from 1, header, sequence) and, at pos 0, with their number."""
    s, header = F.col("sequence"), F.coalesce("header", F.lit(""))
    first = F.row_number().over(Window.partitionBy("sequence").orderBy("pos"))
    name = F.concat(F.lit("Record "), F.col("pos").cast("string"))
    of = F.concat(name, F.lit(" ('"), header, F.lit("'): "))
    bad = F.array_sort(F.array_distinct(F.filter(F.split(s, ""), lambda c: (c != "") & ~c.rlike(seq.VALID))))
    n = F.length(s)
    said = F.array_compact(F.array(
        F.when(F.trim(header) == "", F.concat(name, F.lit(": missing header."))), F.when(n == 0, F.concat(of, F.lit("empty sequence."))),
        F.when((n > 0) & (F.size(bad) > 0), F.concat(of, F.lit("invalid characters ['"), F.array_join(bad, "', '"), F.lit("']."))),
        F.when((n > 0) & (n < seq.t.MIN_LENGTH), F.concat(of, F.format_string("sequence too short (%d < %d).", n, F.lit(seq.t.MIN_LENGTH)))),
        F.when(n > seq.t.MAX_LENGTH, F.concat(of, F.format_string("sequence too long (%d > %d).", n, F.lit(seq.t.MAX_LENGTH)))),
        F.when((n > 0) & (F.col("first") > 1), F.concat(of, F.lit("duplicate sequence."))),
    ))
    own = records.withColumn("first", first).select("pos", F.explode(said).alias("message"))
    total = records.agg(F.count("*").alias("n"))
    size = F.when(F.col("n") == 0, "FASTA file is empty — no sequences found.").when(F.col("n") != expected, F.format_string("Expected %d sequences, got %d.", F.lit(expected), F.col("n")))
    return own.union(total.select(F.lit(0).cast(records.schema["pos"].dataType), size.alias("message")).filter("message is not null"))


def prefix_findings(top: DataFrame, overflow: DataFrame, k: int) -> DataFrame:
    """(differing, first_mismatch, shared, long_enough) of a ranked list (rank, sequence) and the first ``k`` of a longer one."""
    head = overflow.filter(F.col("rank") <= k)
    both = top.withColumnRenamed("sequence", "x").join(head.withColumnRenamed("sequence", "y"), "rank", "full")
    same = F.col("x").eqNullSafe(F.col("y"))
    out = both.agg(F.count_if(~same).alias("differing"), F.min(F.when(~same, F.col("rank"))).alias("first_mismatch"))
    shared = top.select("sequence").distinct().join(head.select("sequence").distinct(), "sequence", "left_semi").agg(F.count("*"))
    return out.withColumn("shared", shared.scalar()).withColumn("long_enough", head.agg(F.count("*") >= k).scalar())


def looked_up(rows: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``rows`` (row) with the embedding of the same row; rows without one are left out."""
    return rows.join(embeddings, "row")
