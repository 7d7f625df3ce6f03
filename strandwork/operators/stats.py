"""Statistics of peptide libraries: distributions, distances between them, agreement of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions import sequence as seq
from strandwork.functions import tables


def residue_shares(df: DataFrame) -> DataFrame:
    """(residue, share) over the 20 residues, 0 where there is none."""
    rows = df.select(F.explode(seq.residues(F.col("sequence"))).alias("residue")).groupBy("residue").agg(F.count("*").alias("n"))
    letters = df.sparkSession.createDataFrame([(a,) for a in tables.AMINO_ACIDS], "residue string")
    counts = letters.join(rows, "residue", "left").select("residue", F.coalesce("n", F.lit(0)).alias("n"))
    return counts.select("residue", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def jensen_shannon(a: DataFrame, b: DataFrame) -> DataFrame:
    """The divergence, in bits, of two libraries' residue shares."""
    least = lambda c: F.greatest(F.col(c), F.lit(1e-12))
    both = residue_shares(a).select("residue", F.col("share").alias("p")).join(residue_shares(b).select("residue", F.col("share").alias("q")), "residue")
    both = both.select(least("p").alias("p"), least("q").alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    term = lambda x: F.col(x) * F.log2(F.col(x) / F.col("m"))
    return both.agg(((F.sum(term("p")) + F.sum(term("q"))) / 2).alias("jsd"))


def kolmogorov_smirnov(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """The largest gap between two samples' distribution functions: counts of distinct values first, then running sums."""
    side = lambda df, x, y: df.select(F.col(column).alias("v"), F.lit(x).alias("a"), F.lit(y).alias("b"))
    counts = side(a, 1, 0).union(side(b, 0, 1)).filter("v is not null").groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    up, everything = Window.orderBy("v"), Window.partitionBy()
    gap = F.sum("a").over(up) / F.sum("a").over(everything) - F.sum("b").over(up) / F.sum("b").over(everything)
    return counts.select(F.abs(gap).alias("gap")).agg(F.max("gap").alias("ks"))


def seed_summary(runs: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and standard error over seeds; 0 for a single one."""
    v = F.when(~F.isnan(value), F.col(value))
    return runs.groupBy(group).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v) / F.sqrt(F.count(v)), F.lit(0.0)).alias("se"), F.count(v).alias("n"))


def paired(runs: DataFrame, group: str, a: str, b: str, seed: str, value: str) -> DataFrame:
    """Mean, standard error, t and Cohen's d of the differences of two groups over shared seeds."""
    side = lambda x, name: runs.filter(F.col(group) == x).select(seed, F.col(value).alias(name))
    d = side(a, "x").join(side(b, "y"), seed).select((F.col("x") - F.col("y")).alias("d"))
    out = d.agg(F.avg("d").alias("delta"), F.stddev_samp("d").alias("sd"), F.count("d").alias("n"))
    se = F.col("sd") / F.sqrt("n")
    return out.select("delta", se.alias("se"), (F.col("delta") / F.nullif(se, F.lit(0.0))).alias("t"), (F.col("delta") / F.nullif("sd", F.lit(0.0))).alias("d"), "n")


def agreement(df: DataFrame, truth: str, predicted: str, group: str) -> DataFrame:
    """Spearman and Pearson correlation and mean absolute error in each group; equal values share their mean rank."""
    rank = lambda c: F.rank().over(Window.partitionBy(group).orderBy(c)) + (F.count("*").over(Window.partitionBy(group, c)) - 1) / 2
    ranked = df.withColumns({"rx": rank(truth), "ry": rank(predicted)})
    return ranked.groupBy(group).agg(F.corr("rx", "ry").alias("spearman"), F.corr(truth, predicted).alias("pearson"), F.avg(F.abs(F.col(truth) - F.col(predicted))).alias("mae"), F.count("*").alias("n"))


def attrition(df: DataFrame, groups: list[str]) -> DataFrame:
    """How many sequences are left after each filter: alphabet, length, repeats."""
    s = F.upper(F.trim("sequence"))
    letters = s.rlike(seq.VALID)
    both = letters & F.length(s).between(tables.MIN_LENGTH, tables.MAX_LENGTH)
    return df.groupBy(*groups).agg(F.count("*").alias("raw"), F.count_if(letters).alias("after_alphabet"), F.count_if(both).alias("after_length"), F.count_distinct(F.when(both, s)).alias("after_dedup"))


def library_metrics(library: DataFrame, reference: DataFrame) -> DataFrame:
    """Size, uniqueness, novelty, compliance, medians and means of a library (sequence), in one pass over it and a join with the reference."""
    s = F.col("sequence")
    known = reference.select("sequence").distinct().withColumn("known", F.lit(True))
    rows = library.join(known, "sequence", "left").withColumns({"charge": seq.net_charge(s), "eisenberg": seq.mean(s, tables.EISENBERG)})
    ok = seq.compliance(s)
    expert = F.col("charge").between(2, 10) & F.length(s).between(10, 30) & F.col("eisenberg").between(-0.5, 0.8)
    share = lambda c: F.avg(c.cast("double"))
    return rows.agg(
        F.count("*").alias("n"), (F.count_distinct(s) / F.count("*")).alias("uniqueness"), share(F.col("known").isNull()).alias("novelty"),
        share(ok["standard_residues"] & ok["length_ok"] & ok["disulfide_ok"]).alias("compliant"), share(expert).alias("expert_range"), share(seq.count(s, "C") == 0).alias("cysteine_free"),
        F.median(F.length(s)).alias("median_length"), F.median("charge").alias("median_charge"), F.median("eisenberg").alias("median_eisenberg"),
    )


def cluster_stats(df: DataFrame, cluster: str) -> DataFrame:
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"), (F.sum("n") / F.count("*")).alias("redundancy"))
