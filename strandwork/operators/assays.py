"""Assay tables: harmonised, collapsed to one value, and joined to the peptides they measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions import parsing, sequence, tables

ENDPOINTS = ("mic", "hc50")


def row_filters(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows that match every (column, value); a null matches nothing."""
    for c, v in wanted.items():
        df = df.filter(F.coalesce(F.col(c) == F.lit(v), F.lit(False)))
    return df


def harmonized(df: DataFrame, ranges: bool = False) -> DataFrame:
    """sequence, species, strain, endpoint, value_um, censored and source of the rows of an export that give a positive concentration.

    ``df`` has sequence, value, unit, species, endpoint and source, perhaps strain and relation. Sequences
    are cleaned, invalid ones dropped. A null unit means uM.
    """
    own = sequence.clean(F.col("sequence"))
    bound = parsing.censored(F.col("value"))
    if "relation" in df.columns:
        bound = bound | F.coalesce(F.trim("relation").isin(">", "≥", ">="), F.lit(False))
    # labels repeat, so each is read once
    labels = df.select(F.col("species").alias("label")).distinct().withColumn("name", parsing.species(F.col("label")))
    df = df.join(labels, F.col("species").eqNullSafe(F.col("label")), "left").drop("label").withColumn("species", F.col("name"))
    out = df.select(
        own.alias("sequence"), F.col("species"), (F.col("strain") if "strain" in df.columns else F.lit(None).cast("string")).alias("strain"), "endpoint",
        parsing.value(F.col("value"), ranges).alias("v"), parsing.unit(F.col("unit")).alias("u"), bound.alias("censored"), "source",
    )
    out = out.filter(sequence.is_valid(F.col("sequence")) & F.col("endpoint").isin(*ENDPOINTS))
    out = out.withColumn("value_um", parsing.micromolar(F.col("v"), F.col("u"), F.col("sequence")))
    return out.filter((F.col("value_um") > 0) & (F.col("value_um") < float("inf"))).select("sequence", "species", "strain", "endpoint", "value_um", "censored", "source")


def geometric(v: Column) -> Column:
    return F.exp(F.avg(F.ln(v)))


def aggregated(activity: DataFrame) -> DataFrame:
    """One value for each sequence, species and endpoint: the geometric mean of exact values, or else the largest bound.

    Predicted HC50 rows count only for sequences and species without a measured one. The flag of
    measured rows comes from a window over the groups that the aggregation needs anyway: one shuffle.
    """
    keys = ["sequence", "species", "endpoint"]
    measured = F.max((F.col("endpoint") == "hc50") & (F.col("source") == "hemopi2_measured")).over(Window.partitionBy(*keys))
    rows = activity.withColumn("measured", measured).filter(~F.col("measured") | (F.col("source") == "hemopi2_measured"))
    exact = F.when(~F.col("censored"), F.col("value_um"))
    out = rows.groupBy(*keys).agg(
        F.coalesce(geometric(exact), F.max("value_um")).alias("value_um"), (F.count(exact) == 0).alias("censored"), F.count("*").cast("int").alias("n_measurements"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.max("measured").alias("m"), F.max(F.col("source") == "hemopi2_predicted").alias("p"),
    )
    kind = F.when(F.col("endpoint") == "hc50", F.when(F.col("m"), "measured").when(F.col("p"), "predicted"))
    return out.withColumn("hc50_source", kind).drop("m", "p")


def hc50_by_sequence(collapsed: DataFrame) -> DataFrame:
    """HC50 of a sequence over its species; measured if any of them is."""
    own = collapsed.filter("endpoint = 'hc50'").groupBy("sequence")
    measured, predicted = (F.max(F.coalesce(F.col("hc50_source") == x, F.lit(False))) for x in ("measured", "predicted"))
    return own.agg(geometric(F.col("value_um")).alias("hc50_um"), F.when(measured, "measured").when(predicted, "predicted").alias("hc50_source"))


def metadata(peptides: DataFrame, activity: DataFrame) -> DataFrame:
    """Peptides (sequence) with their MIC for each species, a null row if they have none, and their HC50."""
    own = peptides.select(sequence.clean(F.col("sequence")).alias("sequence")).filter("sequence <> ''").distinct()
    collapsed = aggregated(activity)
    mic = collapsed.filter("endpoint = 'mic'").select("sequence", "species", F.col("value_um").alias("mic_um"), F.col("censored").alias("mic_censored"))
    # inner and anti join in one: a peptide without a MIC keeps a row of nulls
    return own.join(mic, "sequence", "left").join(hc50_by_sequence(collapsed), "sequence", "left")


def selectivity(activity: DataFrame) -> DataFrame:
    """Mean log10 MIC on Gram-positive less that on Gram-negative species, over all rows, for sequences with both."""
    mic = activity.filter("endpoint = 'mic' and value_um > 0 and species is not null").withColumn("gram", parsing.gram(F.col("species")))
    wide = mic.groupBy("sequence").pivot("gram", ["negative", "positive"]).agg(F.avg(F.log10("value_um")))
    return wide.select("sequence", (F.col("positive") - F.col("negative")).alias("gram_selectivity_raw")).na.drop()


def mic_table(activity: DataFrame) -> DataFrame:
    """Mean log10 MIC for each sequence and species, over all rows, with the features of each distinct sequence."""
    rows = activity.filter("endpoint = 'mic' and value_um > 0 and species is not null").withColumn("sequence", sequence.clean(F.col("sequence"))).filter(sequence.is_valid(F.col("sequence")))
    collapsed = rows.groupBy("sequence", "species").agg(F.avg(F.log10("value_um")).alias("log_mic"), F.count("*").cast("int").alias("n_measurements"))
    own = collapsed.select("sequence").distinct().withColumns(parsing.features(F.col("sequence")))
    return collapsed.join(own, "sequence").withColumn("gram", parsing.gram(F.col("species")))


def vocabulary(rows: DataFrame, least: int = 20) -> DataFrame:
    """Species with so many rows, by name, numbered from 1."""
    found = rows.filter("species is not null").groupBy("species").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return found.select("species", F.row_number().over(Window.orderBy("species")).alias("idx"))


def top_species(rows: DataFrame, k: int = 15) -> DataFrame:
    return rows.filter("species is not null").groupBy("species").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "species").limit(k)


def conditioning(rows: DataFrame) -> DataFrame:
    """Normalised axes and indices of metadata rows (sequence, species, mic_um, mic_censored, hc50_um, hc50_source)."""
    log_mic, log_hc50 = parsing.log_axis(F.col("mic_um")), parsing.log_axis(F.col("hc50_um"))
    kind = F.when(F.col("mic_censored"), 2).when(~F.col("mic_censored"), 1).otherwise(0)
    source = F.when(F.col("hc50_source") == "measured", 1).when(F.col("hc50_source") == "predicted", 2).otherwise(0)
    gram = parsing.gram(F.col("species"))
    return rows.withColumns({
        "gram": gram, "gram_idx": parsing.gram_index(gram), "log_mic": log_mic, "log_hc50": log_hc50,
        "mic_censored_idx": F.when(log_mic.isNull(), 0).otherwise(kind), "hc50_source_idx": F.when(log_hc50.isNull(), 0).otherwise(source), "is_amp_idx": F.lit(2),
    })


def panel_frame(spark) -> DataFrame:
    rows = [(k, v, k in tables.PANEL_NEGATIVE) for k, v in tables.panel().items()]
    return spark.createDataFrame(rows, "species string, weight int, negative boolean")
