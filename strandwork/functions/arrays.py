"""Operators on fixed-length arrays: masks, guidance, constraints, pooling, feature rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import parsing, tables

LENGTH, FILLING = tables.MAX_LENGTH, 20


def positions(n: int = LENGTH) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def face_mask(phase: Column, share: Column) -> Column:
    """Places on one face of a helix of 100 degrees a residue, from ``phase`` over ``share`` of the turn."""
    return F.transform(positions(), lambda i: F.pmod(F.pmod(i * 100, F.lit(360)) - phase, F.lit(360)) < 360 * share)


def span_mask(start: Column, share: Column) -> Column:
    return F.transform(positions(), lambda i: (i >= start) & (i < start + F.greatest(share * LENGTH, F.lit(1))))


def span_priority(anchor: Column) -> Column:
    """Nearness to an anchor on the ring of places: nearer places come first."""
    return F.transform(positions(), lambda i: -F.least(F.abs(i - anchor), LENGTH - F.abs(i - anchor)))


def face_priority(phase: Column) -> Column:
    turn = lambda i: F.pmod(i * 100 - phase, F.lit(360))
    return F.transform(positions(), lambda i: -F.least(turn(i), 360 - turn(i)))


def reveal(masked: Column, priority: Column, k: Column) -> Column:
    """The first k masked places by priority, ties by place."""
    items = F.filter(F.transform(F.arrays_zip(masked.alias("m"), priority.alias("p")), lambda x, i: F.struct((-x["p"]).alias("p"), i.alias("i"), x["m"].alias("m"))), lambda x: x["m"])
    return F.transform(F.slice(F.array_sort(items), F.lit(1), F.greatest(k, F.lit(0))), lambda x: x["i"])


def guided(unconditional: Column, conditional: Column, weight: float) -> Column:
    return F.zip_with(unconditional, conditional, lambda u, c: u + weight * (c - u))


def constrained(logits: Column, length: Column, cysteines: Column, bias: float = 0.0) -> Column:
    """A row of logits for each place: filling only beyond ``length`` and never before, no cysteine once two stand."""
    low, c = F.lit(-1e9), tables.AMINO_ACIDS.index("C")
    value = lambda x, j, i: F.when((i >= length) != (j == FILLING), low).when((j == c) & (cysteines >= tables.MAX_CYSTEINES), low).when(j == FILLING, x + bias).otherwise(x)
    return F.transform(logits, lambda row, i: F.transform(row, lambda x, j: value(x, j, i)))


def masked_mean(values: Column, weights: Column) -> Column:
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return total(F.zip_with(values, weights, lambda v, w: v * w)) / F.nullif(total(weights), F.lit(0.0))


def target_length(axis: Column) -> Column:
    return parsing.from_length_axis(axis)


def feature_row(descriptors: list[Column], species: Column, levels: list[str], gram: Column, embedding: Column) -> Column:
    """Descriptors, the species' and Gram class's indicators and the embedding, in this order: a model's row."""
    known = species.isin(*levels)
    hot = [(species == s).cast("double") for s in levels] + [(~F.coalesce(known, F.lit(False))).cast("double")]
    classes = [(gram == g).cast("double") for g in tables.GRAM_INDEX]
    return F.concat(F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in [*descriptors, *hot, *classes]]), embedding.cast("array<double>"))
