"""Assay values, units and species labels, and the normalised axes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sequence as seq
from . import tables as t

NUMBER = r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"


def lookup(key: Column, values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def unit(raw: Column) -> Column:
    out = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    for old, new in ((" ", ""), ("−", "-"), ("micro", "u"), ("μ", "u"), ("µ", "u")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def censored(raw: Column) -> Column:
    """Whether a text gives a lower bound only; a text without a number gives nothing."""
    return F.coalesce(F.substring(F.trim(raw), 1, 1).isin(">", "≥") & (F.size(numbers(raw)) > 0), F.lit(False))


def numbers(raw: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.trim(raw), F.lit(NUMBER), F.lit(1)), lambda x: x.try_cast("double"))
    return F.filter(found, lambda x: x.isNotNull() & (x != 0) & (F.abs(x) < float("inf")))


def value(raw: Column, ranges: bool = False) -> Column:
    """The number in a text, or the geometric mean of its first two; null without one.

    A hyphen right before a number is its sign, so "1-2" has no mean; ``ranges`` reads it as a range.
    """
    if ranges:
        raw = F.regexp_replace(raw, r"(?<=\d)-(?=\d)", " - ")
    x = numbers(raw)
    first, second = F.get(x, 0), F.get(x, 1)
    return F.when(F.size(x) == 1, first).when((F.size(x) > 1) & (first > 0) & (second > 0), F.exp((F.ln(first) + F.ln(second)) / 2))


def micromolar(v: Column, unit_: Column, sequence: Column) -> Column:
    """A concentration in uM: molar units by their factors, mass units by the peptide's mass, none as it is; null for unknown units."""
    molar, weight = lookup(unit_, t.MOLAR_UNITS), lookup(unit_, t.MASS_UNITS)
    return F.when(unit_ == "", v).when(unit_ == "log10_um", F.pow(F.lit(10.0), v)).when(molar.isNotNull(), v * molar).when(weight.isNotNull(), v * weight * 1000.0 / seq.mass(sequence))


def species(raw: Column) -> Column:
    """A label as a lower-case binomial, or the genus; abbreviated genera expanded; null if it has no letters."""
    text = F.regexp_replace(F.regexp_replace(raw, r"\(.*?\)", " "), "[^A-Za-z. ]", " ")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    bare = lambda i: F.lower(F.regexp_replace(F.get(words, i), r"^\.+|\.+$", ""))
    genus, epithet = bare(0), F.coalesce(lookup(bare(1), t.MISSPELT), bare(1))
    long = F.when(F.length(genus) == 1, F.coalesce(lookup(F.concat_ws(" ", genus, epithet), t.ABBREVIATED), genus)).otherwise(genus)
    alone = (F.size(words) == 1) | bare(1).isin(*t.NO_EPITHET) | (F.length(bare(1)) < 2)
    return F.when(raw.isNull() | (F.size(words) == 0), None).when(alone, genus).otherwise(F.concat_ws(" ", long, epithet))


def gram(species_: Column) -> Column:
    genus = F.get(F.split(F.lower(F.trim(species_)), " "), 0)
    kinds = {g: kind for kind, names in t.GRAM_GENERA.items() for g in names.split()}
    return F.coalesce(lookup(genus, kinds), F.lit("unknown"))


def gram_index(name: Column) -> Column:
    return F.coalesce(lookup(name, t.GRAM_INDEX), F.lit(0))


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null, unlike in ``greatest`` and ``least`` alone."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def log_axis(v: Column) -> Column:
    return F.when(v > 0, clip((F.log10(v) - t.LOG_LOW) / t.LOG_SPAN, 0.0, 1.0))


def from_log_axis(x: Column) -> Column:
    return F.pow(F.lit(10.0), x * t.LOG_SPAN + t.LOG_LOW)


def selectivity_axis(x: Column) -> Column:
    return clip(x / 6.0 + 0.5, 0.0, 1.0)


def from_selectivity_axis(x: Column) -> Column:
    return (x - 0.5) * 6.0


def length_axis(n: Column) -> Column:
    return clip((n - t.MIN_LENGTH) / float(t.MAX_LENGTH - t.MIN_LENGTH), 0.0, 1.0)


def from_length_axis(x: Column) -> Column:
    """The nearest length, halves to even."""
    return F.greatest(F.lit(t.MIN_LENGTH), F.least(F.lit(t.MAX_LENGTH), F.bround(x * (t.MAX_LENGTH - t.MIN_LENGTH) + t.MIN_LENGTH).cast("int")))


def charge_axis(charge: Column, n: Column) -> Column:
    return F.when(n > 0, clip((charge / n + 1) / 2, 0.0, 1.0)).otherwise(0.5)


def gravy_axis(g: Column) -> Column:
    return clip((g + 4.5) / 9.0, 0.0, 1.0)


def features(s: Column) -> dict[str, Column]:
    """The nine dense features of a sequence."""
    u = F.upper(s)
    n = F.length(u)
    return {
        "length": n, "length_norm": length_axis(n), "net_charge": seq.net_charge(u), "charge_per_res": charge_axis(seq.net_charge(u), n), "mu_h": clip(seq.hydrophobic_moment(u), 0.0, t.MOMENT_CEILING),
        "gravy_raw": seq.mean(u, t.HYDROPATHY), "gravy": gravy_axis(seq.mean(u, t.HYDROPATHY)), "cys_count": seq.count(u, "C"), "cys_class_idx": seq.cysteine_class(u),
    }
