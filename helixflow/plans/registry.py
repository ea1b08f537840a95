"""Queries of the analytics operators over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import genetics, samples, tables

FAMILIES = (genetics, samples, tables)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for f in FAMILIES for k, v in f.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for f in FAMILIES for k, v in f.ORACLES.items()}
