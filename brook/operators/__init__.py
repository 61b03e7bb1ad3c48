"""The language's operators as plain functions on DataFrames, for use without query text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..api import run
from ..catalog import Catalog


class Pipeline:
    """Steps one after the other: ``Pipeline(df).where("x > 1").group("region", "sum(x) as s").df()``."""

    def __init__(self, source: DataFrame, name: str = "source", tables: Mapping[str, DataFrame] | None = None, catalog: Catalog | None = None, steps: Sequence[str] = ()):
        self.source, self.name, self.tables, self.catalog, self.steps = source, name, dict(tables or {}), catalog, tuple(steps)

    def step(self, text: str) -> Pipeline:
        return Pipeline(self.source, self.name, self.tables, self.catalog, (*self.steps, text))

    def where(self, condition: str) -> Pipeline:
        return self.step(f"where {condition}")

    def select(self, *items: str) -> Pipeline:
        return self.step("select " + ", ".join(items))

    def extend(self, *items: str) -> Pipeline:
        return self.step("extend " + ", ".join(items))

    def group(self, keys: str, *aggregates: str) -> Pipeline:
        return self.step(f"group by {keys} ({', '.join(aggregates)})")

    def spine(self, keys: str, *aggregates: str) -> Pipeline:
        return self.step(f"spine by {keys} ({', '.join(aggregates)})")

    def join(self, table: str, on: str | None = None, how: str = "inner") -> Pipeline:
        sign = {"inner": "&", "left": "&?", "right": "?&", "full": "?&?", "cross": "*"}[how]
        return self.step(f"{sign} {table}" + (f" on {on}" if on else ""))

    def per(self, keys: str, what: str) -> Pipeline:
        return self.step(f"per {keys} {what}")

    def order(self, *by: str) -> Pipeline:
        return self.step("order by " + ", ".join(by))

    def limit(self, n: int) -> Pipeline:
        return self.step(f"limit {n}")

    def text(self) -> str:
        return "\n".join([f"from {self.name}", *self.steps])

    def df(self) -> DataFrame:
        return run(self.source.sparkSession, self.text(), {**self.tables, self.name: self.source}, self.catalog)
