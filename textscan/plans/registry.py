"""All checked queries of the package by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textscan.plans import extraction_checks, text_checks, validator_checks

Query = Callable[[SparkSession, str], DataFrame]


def _all() -> dict[str, tuple[Query, str | None]]:
    return {**extraction_checks.checks(), **validator_checks.checks(), **text_checks.checks()}


def all_queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _all().items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
