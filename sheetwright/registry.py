"""Every query of the safety-data-sheet engine by name, with its DuckDB SQL where one can be stated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheetwright.plans import banding, extraction, relational, sheets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**relational.QUERIES, **banding.QUERIES, **extraction.QUERIES, **sheets.QUERIES}
ORACLE_SQL: dict[str, str] = {**relational.ORACLE_SQL, **banding.ORACLE_SQL, **extraction.ORACLE_SQL, **sheets.ORACLE_SQL}
FLAGSHIP = extraction.flagship
