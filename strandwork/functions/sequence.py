"""Features of peptide sequences, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as t

VALID = f"^[{t.AMINO_ACIDS}]+$"
TURN = math.radians(100.0)


def clean(s: Column) -> Column:
    """Upper case, without anything but the 20 residues."""
    return F.regexp_replace(F.upper(s.cast("string")), f"[^{t.AMINO_ACIDS}]", "")


def is_valid(s: Column) -> Column:
    """Of 8 to 50 residues, all standard, as written."""
    return F.coalesce(F.length(s).between(t.MIN_LENGTH, t.MAX_LENGTH) & s.rlike(VALID), F.lit(False))


def invalid_reason(s: Column) -> Column:
    """The first reason why a sequence is invalid: residues, too short, too long; null if it is valid."""
    bad = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(s, ""), lambda c: (c != "") & ~c.rlike(VALID)))), ",")
    return F.when(bad != "", F.concat(F.lit("non-standard residues: "), bad)).when(F.length(s) < t.MIN_LENGTH, "too short").when(F.length(s) > t.MAX_LENGTH, "too long")


def residues(s: Column) -> Column:
    """One string for each residue; none of an empty sequence."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def scale(c: Column, values: dict[str, float]) -> Column:
    """A residue's value on a scale, 0 if it has none: an array lookup."""
    row = F.array(F.lit(0.0), *[F.lit(float(values.get(a, 0.0))) for a in t.AMINO_ACIDS])
    return F.element_at(row, F.instr(F.lit(t.AMINO_ACIDS), c) + 1)


def total(s: Column, values: dict[str, float]) -> Column:
    return F.aggregate(residues(s), F.lit(0.0), lambda a, c: a + scale(c, values))


def mean(s: Column, values: dict[str, float]) -> Column:
    return F.when(F.length(s) > 0, total(s, values) / F.length(s)).otherwise(0.0)


def count(s: Column, letters: str) -> Column:
    return F.length(s) - F.length(F.translate(s, letters, ""))


def mass(s: Column) -> Column:
    return F.when(F.length(s) > 0, total(s, t.MASS) + t.WATER)


def net_charge(s: Column) -> Column:
    return count(s, "KR") + 0.1 * count(s, "H") - count(s, "DE")


def let(value: Column, f) -> Column:
    """``f`` of ``value``, which is computed once however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def hydrophobic_moment(s: Column, window: int = 11) -> Column:
    """The largest moment of any window, 100 degrees between residues; 0 of an empty sequence."""
    turns = {name: F.array(*[F.lit(f(i * TURN)) for i in range(window)]) for name, f in (("cos", math.cos), ("sin", math.sin))}

    def largest(h: Column) -> Column:
        w = F.least(F.lit(window), F.size(h))
        part = lambda start, name: F.aggregate(F.zip_with(F.slice(h, start, w), F.slice(turns[name], F.lit(1), w), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        return F.array_max(F.transform(F.sequence(F.lit(1), F.size(h) - w + 1), lambda i: F.hypot(part(i, "cos"), part(i, "sin")) / w))

    return F.when(F.length(s) > 0, let(F.transform(residues(s), lambda c: scale(c, t.EISENBERG)), largest)).otherwise(0.0)


def cysteine_class(s: Column) -> Column:
    n = count(s, "C")
    return F.when(n <= 0, 1).when(n <= t.MAX_CYSTEINES, 2).otherwise(3)


def fitness(s: Column) -> Column:
    """Length of the sum of turned hydrophobicities, residue i (from 1) by 100 i degrees, over the sum of exponentials."""
    value = lambda c, i: F.struct((scale(c, t.FITNESS_H) * F.cos((i + 1) * TURN)).alias("x"), (scale(c, t.FITNESS_H) * F.sin((i + 1) * TURN)).alias("y"), F.exp(scale(c, t.FITNESS_HX)).alias("z"))
    total_ = lambda h, k: F.aggregate(h, F.lit(0.0), lambda a, v: a + v[k])
    return F.when(F.length(s) > 0, let(F.transform(residues(s), value), lambda h: F.hypot(total_(h, "x"), total_(h, "y")) / total_(h, "z"))).otherwise(0.0)


def kmers(s: Column, k: int = 3) -> Column:
    """Distinct runs of k residues; the whole sequence if it is shorter."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - k + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(k)))
    return F.when(F.length(s) < k, F.array(s)).otherwise(F.array_distinct(runs))


def length_band(n: Column) -> Column:
    return F.least(F.floor((n - t.MIN_LENGTH) / 6).cast("int"), F.lit(6))


def band_label(band: Column) -> Column:
    low = band * 6 + t.MIN_LENGTH
    return F.concat(low.cast("string"), F.lit("-"), F.when(band >= 6, t.MAX_LENGTH).otherwise(low + 5).cast("string"))


def structural_cluster(s: Column) -> Column:
    charge = F.greatest(F.lit(-2), F.least(F.lit(12), count(s, "KR") - count(s, "DE")))
    return (length_band(F.length(s)) * 8 + F.floor(charge / 3)).cast("int")


def tokens(s: Column, length: int = t.MAX_LENGTH) -> Column:
    """Indices of standard residues, cut or filled with 20 to a fixed length."""
    known = F.transform(F.filter(residues(s), lambda c: F.instr(F.lit(t.AMINO_ACIDS), c) > 0), lambda c: F.instr(F.lit(t.AMINO_ACIDS), c) - 1)
    return F.slice(F.concat(known, F.array_repeat(F.lit(20), length)), 1, length)


def decoded(x: Column) -> Column:
    """Letters up to the first filling (20), without masks (21)."""
    stop = F.array_position(x, F.lit(20))
    own = F.when(stop > 0, F.slice(x, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(x)
    return F.array_join(F.transform(F.filter(own, lambda i: i < 20), lambda i: F.substring(F.lit(t.AMINO_ACIDS), i + 1, F.lit(1))), "")


def compliance(s: Column) -> dict[str, Column]:
    u = F.upper(s)
    return {"standard_residues": u.rlike(VALID), "length_ok": F.length(u).between(t.MIN_LENGTH, t.MAX_LENGTH), "disulfide_ok": count(u, "C") <= t.MAX_CYSTEINES}
