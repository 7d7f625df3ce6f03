"""Conditions of a generator: requests made into axes with masks, grids of them, and how they are described."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions import parsing, tables

#: The axes in order, and names of two axes' indices.
CATEGORICAL = ("is_amp", "species", "gram", "cys_class", "mic_censored", "hc50_source")
CONTINUOUS = ("log_mic", "log_hc50", "gram_selectivity", "length_norm", "charge_per_res", "mu_h", "gravy")
IS_AMP = {"unknown": 0, "general": 1, "amp": 2}
HC50_SOURCE = {"unknown": 0, "measured": 1, "predicted": 2}
#: Axes whose value no dropout takes; chances of dropping one axis, and all.
EXEMPT, DROP_AXIS, DROP_ALL = ("is_amp",), 0.15, 0.10
REQUEST = (
    "is_amp string, species string, gram string, hc50_source string, mic_um double, mic_censored boolean, hc50_um double, gram_selectivity double, "
    "length int, charge_per_res double, net_charge double, mu_h double, gravy double, cys_class int"
)


def named(value: Column, names: dict[str, int]) -> Column:
    """An index given as such, or by name; 0 if it is null or no name."""
    return F.coalesce(value.try_cast("int"), parsing.lookup(F.lower(F.trim(value)), names), F.lit(0))


def species_index(name: Column, vocabulary: dict[str, int]) -> Column:
    """The vocabulary's index of a species, 0 if it has none. A vocabulary is a configuration: some hundred names."""
    return F.coalesce(parsing.lookup(F.lower(F.trim(name)), vocabulary), F.lit(0)) if vocabulary else F.lit(0)


def built(requests: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """``requests`` (REQUEST) with an index for each categorical axis, 0 if unknown, and a value for each continuous one, null if unspecified.

    A length that isn't given is the middle of the range; a net charge counts if the length is given and
    no charge per residue; the Gram class is the species' own unless it is given.
    """
    c = F.col
    own = F.lower(F.trim("species"))
    gram = F.when(c("species").isNull(), F.coalesce("gram", F.lit("unknown"))).otherwise(F.coalesce(F.nullif("gram", F.lit("")), parsing.gram(own)))
    charge = F.coalesce("charge_per_res", F.when((c("length") != 0) & c("net_charge").isNotNull(), parsing.charge_axis(c("net_charge"), c("length"))))
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return requests.select(
        "*",
        named(c("is_amp"), IS_AMP).alias("is_amp_idx"), species_index(c("species"), vocabulary).alias("species_idx"), parsing.gram_index(F.lower(F.trim(gram))).alias("gram_idx"),
        F.coalesce("cys_class", F.lit(0)).alias("cys_class_idx"), F.when(c("mic_um").isNull(), 0).when(F.coalesce("mic_censored", F.lit(False)), 2).otherwise(1).alias("mic_censored_idx"),
        named(c("hc50_source"), HC50_SOURCE).alias("hc50_source_idx"), parsing.log_axis(c("mic_um")).alias("axis_log_mic"), parsing.log_axis(c("hc50_um")).alias("axis_log_hc50"),
        parsing.selectivity_axis(c("gram_selectivity")).alias("axis_gram_selectivity"), F.coalesce(parsing.length_axis(c("length")), F.lit(0.5)).alias("axis_length_norm"),
        finite(charge).alias("axis_charge_per_res"), finite(c("mu_h")).alias("axis_mu_h"), parsing.gravy_axis(c("gravy")).alias("axis_gravy"),
    )


def masked(conditions: DataFrame) -> DataFrame:
    """Indices, values and masks alone: an absent column or a null is index 0, or value 0 with mask 0; NaN counts as null."""
    have = conditions.columns
    value = lambda a: F.nanvl(F.col(f"axis_{a}").cast("double"), F.lit(None).cast("double")) if f"axis_{a}" in have else F.lit(None).cast("double")
    out = [(F.coalesce(F.col(f"{a}_idx"), F.lit(0)) if f"{a}_idx" in have else F.lit(0)).cast("int").alias(f"{a}_idx") for a in CATEGORICAL]
    for a in CONTINUOUS:
        out += [F.coalesce(value(a), F.lit(0.0)).alias(a), value(a).isNotNull().cast("double").alias(f"{a}_mask")]
    return conditions.select(*[F.col(x) for x in have if not x.endswith("_idx") and x not in (*CONTINUOUS, *(f"axis_{a}" for a in CONTINUOUS))], *out)


def described() -> Column:
    """A masked condition as a line of text."""
    parts = [F.concat(F.lit(f"{a}="), F.col(f"{a}_idx").cast("string")) for a in CATEGORICAL]
    parts += [F.concat(F.lit(f"{a}="), F.when(F.col(f"{a}_mask") > 0, F.format_string("%.3f", F.bround(F.col(a), 3))).otherwise("unknown")) for a in CONTINUOUS]
    return F.concat_ws(" ", *parts)


def null_condition(spark) -> DataFrame:
    """One condition of which nothing is known."""
    return masked(spark.range(1).select())


def selected(conditions: DataFrame, order: str, begin: int, end: int) -> DataFrame:
    """The conditions at places ``begin`` to ``end`` of their order."""
    return conditions.orderBy(order).offset(begin).limit(max(0, end - begin))


def length_grid(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """Each request as often as ``counts`` (length, count) says for each length, with that length; ValueError if no count is positive."""
    own = counts.filter("count > 0")
    if own.isEmpty():
        raise ValueError("no positive count")
    low, high = F.lit(tables.MIN_LENGTH), F.lit(tables.MAX_LENGTH)
    times = own.select(F.greatest(low, F.least(high, F.col("length"))).cast("int").alias("length"), F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"))
    return requests.drop("length").join(F.broadcast(times), how="cross")  # lengths of a peptide times the copies asked for


def conditioned_grid(cells: DataFrame, lengths: DataFrame, seed: int = 0) -> DataFrame:
    """Grid cells (idx, count) expanded to one row for each count, each with one of the ``lengths`` (pos, length), dealt by hash."""
    rows = cells.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))) if "count" in cells.columns else cells
    rows = rows.withColumn("at", F.row_number().over(Window.orderBy("idx", "copy")))
    pool = lengths.withColumn("at", F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("pos").cast("string"))), "pos"))).select("at", "length")
    return rows.join(pool, "at").drop("at")


def dropped(conditions: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Masked conditions with axes dropped at random, by hash: one axis at DROP_AXIS, all at DROP_ALL; exempt axes never."""
    chance = lambda what: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    everything = chance("all") < DROP_ALL
    gone = lambda a: F.lit(False) if a in EXEMPT else everything | (chance(a) < DROP_AXIS)
    out = {f"{a}_idx": F.when(gone(a), 0).otherwise(F.col(f"{a}_idx")) for a in CATEGORICAL}
    for a in CONTINUOUS:
        out |= {a: F.when(gone(a), 0.0).otherwise(F.col(a)), f"{a}_mask": F.when(gone(a), 0.0).otherwise(F.col(f"{a}_mask"))}
    return conditions.withColumns(out)


def axis_errors(realized: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Mean distance of realised features (length, charge_per_res, mu_h, gravy) from a target on each axis that has one, and the mean of these."""
    own = {"length_norm": parsing.length_axis(F.col("length")), "charge_per_res": F.col("charge_per_res"), "mu_h": F.col("mu_h"), "gravy": F.col("gravy")}
    out = realized.agg(*[(F.avg(F.abs(x - F.lit(targets[a]))) if a in targets else F.lit(None).cast("double")).alias(f"error_{a}") for a, x in own.items()])
    errors = F.array_compact(F.array(*[F.col(f"error_{a}") for a in own]))
    return out.withColumn("mean_axis_error", F.when(F.size(errors) > 0, F.aggregate(errors, F.lit(0.0), lambda a, x: a + x) / F.size(errors)))


def best_setting(sweep: DataFrame, floor: float = 0.5) -> DataFrame:
    """The setting with the smallest error among those whose uniqueness reaches the floor, or among all if none does; the first by its key on ties."""
    ok = F.col("uniqueness") >= floor
    usable = sweep.withColumn("some", F.max(ok).over(Window.partitionBy())).filter(~F.col("some") | ok).drop("some")
    return usable.orderBy(F.col("mean_axis_error").asc_nulls_last(), "steps", "weight").limit(1)
