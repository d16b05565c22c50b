"""Operators for large training-data pipelines; nothing else in the library imports this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import annsearch, classifier, htmltext, langid, packing, pieces_lattice, quality_rules, secret_scan, simhash, tokenfile

_MODULES = (pieces_lattice, quality_rules, secret_scan, simhash, htmltext, tokenfile, langid, annsearch, packing, classifier)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(m, "ORACLES", {}).items()}
