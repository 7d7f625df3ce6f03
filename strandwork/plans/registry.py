"""Every registered query of the peptide operators with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import more as _more  # noqa: F401  registers its queries with the others'
from . import queries as own


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own.library_screen(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(own.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(own.SQL)
