"""Pipelines over streams.

The language itself has no streaming steps.  A table may be a streaming DataFrame, though: steps that Spark
allows on streams (where, select, extend, explode, group with a complete or update sink) then run as a
streaming query, and this module starts it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..api import run


def stream_files(spark: SparkSession, folder: str, schema, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(folder)


def start(
    spark: SparkSession, text: str, tables: dict[str, DataFrame], name: str, checkpoint: str, mode: str = "append", once: bool = True, kind: str = "memory", **options
) -> StreamingQuery:
    """The query of ``text`` as a stream into a sink; with ``once`` it ends when what is there has been read."""
    w = run(spark, text, tables).writeStream.format(kind).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).options(**options)
    return (w.trigger(availableNow=True) if once else w).start()
