"""Queries over the driver tables, one for each operator, and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import cataloging, evaluating, impact, retrieving, scanning
from .plans.tables import Tables

FAMILIES = [impact, scanning, retrieving, evaluating, cataloging]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, path, f=f: f(Tables(spark, path))) for family in FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
