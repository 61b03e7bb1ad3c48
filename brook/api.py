"""Entry points: run a query text on a Spark session."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .catalog import Catalog, Settings
from .lang.nodes import Query, Setting
from .lang.parser import parse
from .plans.lower import Lowering


def run_all(
    spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | None = None, catalog: Catalog | None = None, settings: Settings | None = None, **options: Any
) -> list[DataFrame]:
    """One DataFrame for each query of ``text``.  ``set name = value;`` holds for this call only."""
    own = Settings(**{**(settings or Settings()).__dict__, **options})
    catalog = catalog or Catalog()
    out: list[DataFrame] = []
    for statement in parse(text):
        if isinstance(statement, Setting):
            own = own.with_value(statement.name, statement.value)
        elif isinstance(statement, Query):
            out.append(Lowering(spark, catalog, own, tables).rows(statement))
    return out


def run(spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | None = None, catalog: Catalog | None = None, settings: Settings | None = None, **options: Any) -> DataFrame:
    """The rows of the last query of ``text``."""
    found = run_all(spark, text, tables, catalog, settings, **options)
    if not found:
        raise ValueError("no query in the text")
    return found[-1]


def run_json(spark: SparkSession, spec: str | list | dict, tables: Mapping[str, DataFrame] | None = None, **options: Any) -> DataFrame:
    """A query as JSON (see ``brook.lang.visual``)."""
    from .lang.visual import to_text

    return run(spark, to_text(json.loads(spec) if isinstance(spec, str) else spec), tables, **options)


def as_json(text: str) -> list[dict]:
    """The query of ``text`` in the form that ``run_json`` reads."""
    from .lang.visual import to_json

    return to_json(text)
