"""Tables by name from files, and results to files: Spark's own readers and writers behind one call each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv", "text", "jdbc")


def read(spark: SparkSession, path: str, kind: str = "parquet", **options: Any) -> DataFrame:
    return spark.read.format(kind).options(**options).load(path)


class Folder(Mapping):
    """name -> rows of ``folder/name.kind`` (a file or a folder of files).

    A table is opened, which reads its schema, when a query first names it.
    """

    def __init__(self, spark: SparkSession, folder: str, names: Iterable[str], kind: str = "parquet", **options: Any):
        self.spark, self.folder, self.names, self.kind, self.options = spark, folder, tuple(names), kind, options
        self.opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        if name not in self.opened:
            self.opened[name] = read(self.spark, f"{self.folder}/{name}.{self.kind}", self.kind, **self.options)
        return self.opened[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


def tables_in(spark: SparkSession, folder: str, names: Iterable[str], kind: str = "parquet", **options: Any) -> Folder:
    """The tables of a folder by name."""
    return Folder(spark, folder, names, kind, **options)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: Iterable[str] = (), **options: Any) -> None:
    w = df.write.format(kind).mode(mode).options(**options)
    by = list(partition_by)
    (w.partitionBy(*by) if by else w).save(path)


def bucketed(df: DataFrame, table: str, buckets: int, *columns: str, path: str | None = None) -> None:
    """Saved so that later joins and groups on ``columns`` need no shuffle."""
    w = df.write.bucketBy(buckets, *columns).sortBy(*columns).format("parquet")
    (w.option("path", path) if path else w).saveAsTable(table)


def register(tables: Mapping[str, DataFrame]) -> None:
    """As views, for nested SQL and other users of the session."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
