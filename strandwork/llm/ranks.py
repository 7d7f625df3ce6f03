"""Running sums and ranks over ordered groups of any size, in DataFrame functions.

Rows are dealt to chunks by a hash, so a chunk is a range of the hash's order; a window sums inside
each chunk of a group, and another over the chunks' totals. No task gets a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a chunk at most, about; chunks for each shuffle partition at least.
CHUNK_ROWS, SPREAD = 65_536, 4


def shuffled(doc_id: Column, seed: int) -> Column:
    """A hash to order documents by: 60 bits of an md5 of the seed and the id, spread over all 64-bit integers."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    return F.shiftleft(bits - F.lit(1 << 59), 4)


def chunk_bits(df: DataFrame, rows: int) -> int:
    chunks = max(rows / CHUNK_ROWS, SPREAD * common.shuffle_partitions(df.sparkSession))
    return max(1, (int(chunks) - 1).bit_length())


def before(df: DataFrame, groups: list[str], order: str, ties: list[str], values: dict[str, Column], rows: int) -> DataFrame:
    """``df`` with, for each of ``values``, the sum over the rows before in its group by ``order`` (a 64-bit hash), then ``ties``.

    ``rows`` is the number of rows, which sets how many chunks there are; the sums don't depend on it.
    """
    bits = chunk_bits(df, rows)
    # shifted so that unsigned order is the hash's signed order
    df = df.withColumn("_chunk", F.shiftright(order, 64 - bits))
    inside = Window.partitionBy(*groups, "_chunk").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*groups).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*groups, "_chunk").agg(*[F.sum(v).alias(f"_{k}") for k, v in values.items()])
    totals = totals.select(*groups, "_chunk", *[F.coalesce(F.sum(f"_{k}").over(across), F.lit(0)).alias(f"_{k}") for k in values])
    summed = df.withColumns({k: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in values.items()})
    same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in [*groups, "_chunk"]]
    joined = summed.alias("l").join(totals.alias("r"), on=_all(same))
    own = [c for c in summed.columns if c not in values and c != "_chunk"]
    return joined.select(*[F.col(f"l.{c}") for c in own], *[(F.col(f"l.{k}") + F.col(f"r._{k}")).alias(k) for k in values])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
