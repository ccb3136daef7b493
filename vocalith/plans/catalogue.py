"""All queries of the library proper, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vocalith.plans import analysis, contracts, recordings, scoring, sequence, signal, stateful, store, text, usecases

_ALL = (scoring, sequence, signal, store, text, stateful, contracts, analysis, usecases, recordings)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in _ALL for k, q in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in _ALL for k, q in m.ORACLE_SQL.items()}
