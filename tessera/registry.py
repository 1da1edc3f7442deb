"""Queries by name. Every plan module registers what it implements; the driver entry point reads the result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    operators: tuple[str, ...]
    oracle: str | None


CATALOGUE: dict[str, Entry] = {}


def query(name: str, operators: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register ``run`` under ``name``. ``operators`` are the survey ids it covers, ``oracle`` its DuckDB form."""

    def add(run: Query) -> Query:
        if name in CATALOGUE:
            raise ValueError(f"{name} is registered twice")
        CATALOGUE[name] = Entry(run, tuple(operators.split()), oracle)
        return run

    return add
