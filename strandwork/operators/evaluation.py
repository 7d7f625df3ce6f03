"""Evaluation of libraries and of predictions: whole metric sets, paired tests, bootstraps, gates."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions import parsing, tables
from strandwork.functions import sequence as seq

from . import similarity, stats

#: The features whose distributions are compared, and the identity below which a sequence may be submitted.
DISTRIBUTIONS, SUBMITTABLE = ("length", "net_charge", "eisenberg_mean", "mu_h", "gravy_raw"), 0.80


def properties(df: DataFrame) -> DataFrame:
    """Distinct cleaned sequences, blank ones left out, with the dense features, the Eisenberg mean and the fitness."""
    own = df.select(seq.clean(F.col("sequence")).alias("sequence")).filter("sequence <> ''").distinct()
    own = own.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    s = F.col("sequence")
    return own.withColumns(parsing.features(s) | {"eisenberg_mean": seq.mean(s, tables.EISENBERG), "fitness": seq.fitness(s)})


def set_metrics(library: DataFrame, reference: DataFrame, sample: int = 2000, diversity: int = 600, identity: bool = True, columns: list[str] | None = None) -> DataFrame:
    """One row of all metrics of a library (sequence) against a reference (sequence): shares in per cent, medians, distances, sampled identities.

    Of ``columns`` alone only what they need is computed; features are kept for all metrics, which read them again and again.
    """
    frame, real = properties(library), properties(reference)
    if columns is None:
        frame, real = frame.persist(), real.persist()
    known = real.select("sequence").withColumn("known", F.lit(True))
    ok, percent = seq.compliance(F.col("sequence")), lambda c: 100.0 * F.avg(c.cast("double"))
    expert = F.col("net_charge").between(2, 10) & F.col("length").between(10, 30) & F.col("eisenberg_mean").between(-0.5, 0.8)
    out = frame.join(known, "sequence", "left").agg(
        F.count("*").alias("unique"), percent(F.col("known").isNull()).alias("novelty_pct"), percent(ok["standard_residues"] & ok["length_ok"] & ok["disulfide_ok"]).alias("compliant_pct"),
        percent(expert).alias("expert_range_pct"), F.median("length").alias("median_length"), F.median("net_charge").alias("median_net_charge"), F.median("eisenberg_mean").alias("median_eisenberg"),
        F.median("mu_h").alias("median_mu_h"), F.median("gravy_raw").alias("median_gravy"), F.avg("fitness").alias("mean_fitness"), percent(F.col("cys_count") == 0).alias("cys_free_pct"),
    )
    out = out.withColumn("generated", library.agg(F.count("*")).scalar()).withColumn("uniqueness_pct", 100.0 * F.col("unique") / F.greatest("generated", F.lit(1)))
    out = out.withColumn("aa_js_divergence", stats.jensen_shannon(frame, real).scalar())
    for c in DISTRIBUTIONS:
        out = out.withColumn(f"ks_{c}", stats.kolmogorov_smirnov(frame.select(F.col(c).cast("double").alias("v")), real.select(F.col(c).cast("double").alias("v")), "v").scalar())
    if identity:
        some = frame.select("sequence").orderBy(F.md5("sequence"), "sequence").limit(sample)
        near = similarity.nearest(some, real.select("sequence"))
        out = out.withColumn("diversity", similarity.diversity(frame, diversity).scalar())
        out = out.withColumn("mean_max_reference_identity", near.agg(F.avg("identity")).scalar()).withColumn("submittable_pct", near.agg(percent(F.col("identity") < SUBMITTABLE)).scalar())
    return out.select(*columns) if columns else out


def t_tail(t: Column, df: Column) -> Column:
    """The two-sided p-value of Student's t, by the finite sums for whole degrees of freedom."""
    x = F.abs(t) / F.sqrt(df)
    angle, cosine = F.atan(x), 1 / F.sqrt(1 + x * x)
    # sums over cos^(2k), each term from the one before; as many as half the degrees of freedom
    step = lambda first, shift: lambda a, k: F.struct((a["term"] * cosine * cosine * (2 * k - 1 + shift) / (2 * k + shift)).alias("term"), (a["total"] + a["term"] * cosine * cosine * (2 * k - 1 + shift) / (2 * k + shift)).alias("total"))
    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    ks = lambda n: F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    even = F.sin(angle) * F.aggregate(ks(((df - 2) / 2).cast("int")), one, step(1, 0))["total"]
    odd = 2 / math.pi * (angle + F.when(df > 1, F.sin(angle) * cosine * F.aggregate(ks(((df - 3) / 2).cast("int")), one, step(1, 1))["total"]).otherwise(0.0))
    return 1 - F.when(df % 2 == 0, even).otherwise(odd)


def paired_test(runs: DataFrame, group: str, a: str, b: str, seed: str, value: str) -> DataFrame:
    """The difference b - a over shared seeds: mean, standard error, t, two-sided p, Cohen's d; with unequal seeds or fewer than two only the difference of means."""
    own = runs.filter(F.col(group).isin(a, b)).groupBy(seed).pivot(group, [a, b]).agg(F.first(value))
    d = F.col(b) - F.col(a)
    out = own.agg(
        F.avg(b).alias("mean_b"), F.avg(a).alias("mean_a"), F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.count(d).alias("n"), F.avg(d).alias("delta"), F.stddev_samp(d).alias("sd"),
    )
    fair = (F.col("n_a") == F.col("n_b")) & (F.col("n") == F.col("n_a")) & (F.col("n") > 1)
    se = F.col("sd") / F.sqrt("n")
    t = F.col("delta") / F.nullif(se, F.lit(0.0))
    given = lambda c: F.when(fair, c)
    return out.select(
        F.when(fair, F.col("delta")).otherwise(F.col("mean_b") - F.col("mean_a")).alias("delta"), given(se).alias("delta_se"), given(t).alias("t"),
        given(t_tail(t, F.col("n") - 1)).alias("p"), given(F.col("delta") / F.nullif("sd", F.lit(0.0))).alias("cohens_d"), F.col("n"),
    )


def class_weights(df: DataFrame, column: str, ratios: dict[int, float]) -> DataFrame:
    """``df`` with weight: each class's ratio over its number of rows, 0 for other classes."""
    sizes = df.filter(F.col(column).isin(*ratios)).groupBy(column).agg(F.count("*").alias("n"))  # as many rows as ratios
    return df.join(F.broadcast(sizes), column, "left").withColumn("weight", F.coalesce(parsing.lookup(F.col(column), ratios) / F.col("n"), F.lit(0.0))).drop("n")


def stratum_weights(df: DataFrame) -> DataFrame:
    """``df`` (log_mic, species_idx) with weight: one over the size of its stratum, the species if there is a MIC."""
    stratum = F.when(F.col("log_mic").isNotNull(), F.concat(F.lit("mic:"), F.col("species_idx").cast("string"))).otherwise("nomic")
    rows = df.withColumn("stratum", stratum)
    return rows.join(rows.groupBy("stratum").agg(F.count("*").alias("n")), "stratum").withColumn("weight", 1.0 / F.col("n")).drop("n", "stratum")


def split_shares(df: DataFrame, column: str = "split") -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def bootstrap(values: DataFrame, draws: int = 25, times: int = 20_000, seed: int = 42) -> DataFrame:
    """Mean, deviation and 5th and 95th percentiles of the mean of ``draws`` of the values (a list of a hundred or so, kept in a row), by hash."""
    pool = values.agg(F.array_sort(F.collect_list(F.col("value").cast("double"))).alias("pool"))  # a ranked list's head: bounded
    some = F.slice(F.array_sort(F.transform("pool", lambda v, i: F.struct(F.xxhash64(F.lit(seed), F.col("id"), i).alias("h"), v.alias("v")))), 1, draws)
    means = values.sparkSession.range(times).crossJoin(F.broadcast(pool)).select((F.aggregate(some, F.lit(0.0), lambda a, x: a + x["v"]) / F.least(F.lit(draws), F.size("pool"))).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.percentile("m", F.lit(0.05)).alias("p05"), F.percentile("m", F.lit(0.95)).alias("p95"))


def described(df: DataFrame, column: str, above: float) -> DataFrame:
    """Number, median and mean of a column, and the share above a value in per cent."""
    return df.agg(F.count(column).alias("n"), F.median(column).alias("median"), F.avg(column).alias("mean"), (100.0 * F.avg((F.col(column) > above).cast("double"))).alias("above_pct"))


def selection_report(chosen: DataFrame) -> DataFrame:
    """One row on chosen candidates (score, success_gram_negative, success_gram_positive, mean_log_mic, identity): tiers, means, ranges."""
    tier = F.round("score", 4)
    return chosen.agg(
        F.count("*").alias("n"), F.count_distinct(tier).alias("tiers"), F.avg("success_gram_negative").alias("gram_negative"), F.avg("success_gram_positive").alias("gram_positive"),
        F.pow(F.lit(10.0), F.min("mean_log_mic")).alias("least_mic"), F.pow(F.lit(10.0), F.max("mean_log_mic")).alias("most_mic"),
        F.max("identity").alias("identity_max"), F.median("identity").alias("identity_median"), F.min("identity").alias("identity_min"),
    )


def gates(real: float | None, shuffled: float | None, least: float = 0.4, most: float = 0.15) -> list[str]:
    """What a predictor fails: too little agreement on held-out rows, or too much on shuffled labels."""
    out = [] if real is not None and real >= least else [f"agreement {real} is below {least}"]
    return out + ([] if shuffled is not None and abs(shuffled) <= most else [f"agreement on shuffled labels {shuffled} is beyond {most}"])


def diffusion_loss(tokens: DataFrame) -> DataFrame:
    """The loss of a masked generator from rows (logits, target, masked, t): cross entropy over t, on masked places alone."""
    top = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    entropy = top + F.ln(total) - F.get("logits", "target")
    return tokens.agg((F.sum(F.when(F.col("masked"), entropy / F.col("t"))) / F.nullif(F.count_if("masked"), F.lit(0))).alias("loss"))


def scored(df: DataFrame, make, columns: list[str], name: str = "prediction") -> DataFrame:
    """``df`` with a model's predictions: ``make()`` gives, once a task, a function from a pandas frame of ``columns`` to numbers."""

    def run(batches):
        model = make()
        for batch in batches:
            yield batch.assign(**{name: pd.Series(model(batch[columns]), index=batch.index, dtype="float64")})

    return df.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{name}` double")
