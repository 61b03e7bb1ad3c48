"""Exact deduplication with keyed streaming state.

``dedup_state`` runs a Structured Streaming query over the files of a table.  Its state has one entry per
content digest, without expiry, in RocksDB on the executors' disks with a copy in the checkpoint folder: how
often the digest came, the smallest id, and where that row lies (file and row number).  A later call with
the same checkpoint folder reads only files that are new and goes on from there.

``exact_dedup`` joins every row with its state entry.  A digest only proposes equality: the full normalised texts of
every digest that was met again are read once more and the least and the greatest text of a digest compared, byte for
byte; where these differ (``clashes``), the rows of that digest are resolved among themselves by their texts.

Defined cases: null text counts as empty, so all null and blank texts are one group; a null id is larger than
every id; of rows with equal text and equal id the first by file and row number stays; an empty table gives an
empty result; other columns of the table are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_RUN, doc_key, salt_bytes, shared_dir, spread_join, stored, text_of

#: State on disk; without space set aside beforehand (some MB for each of many small stores).
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Digests that were met again are broadcast up to this many (32 bytes each); more of them are joined by digest.
BROADCAST_HITS = 250_000


def normalised(c: Column) -> Column:
    return F.regexp_replace(c, WS_RUN, " ")


def sha256(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def _rows(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    norm = normalised(text_of(text_col))
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        doc_key(id_col).alias("did"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"),
        norm.alias("norm"),
        digest(norm).alias("digest"),
    )


def dedup_state(
    spark: SparkSession,
    path: str,
    checkpoint: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    max_bytes_per_batch: int = 64 << 30,
) -> DataFrame:
    """State after all files under ``path``: digest, n, keep_did, keep_at (the content locator)."""
    checkpoint = checkpoint or shared_dir(spark)
    schema = spark.read.parquet(path).schema
    # as a pattern, the path may name a single file as well as a folder
    source = re.sub(r"([^/])/*$", r"[\1]", path)
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes_per_batch).parquet(source)
    keyed = (
        _rows(stream, id_col, text_col, digest)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("did", "at")).alias("first"))
    )
    with _settings(spark, STATE_STORE):
        query = (
            keyed.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        n, first = state.schema["value"].dataType.names
        return stored(
            spark,
            state.select(
                F.col("key.digest").alias("digest"),
                F.col(f"value.`{n}`").alias("n"),
                F.col(f"value.`{first}`.did").alias("keep_did"),
                F.col(f"value.`{first}`.at").alias("keep_at"),
            ),
        )


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def clashes(spark: SparkSession, path: str, state: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The digests (stored) under which the table has different normalised texts."""
    rows = _rows(spark.read.parquet(path), id_col, text_col, digest)
    hits = state.filter("n > 1").select("digest")
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
    met = rows.select("digest", "norm").join(hits, "digest", "left_semi")
    # in the tasks that read, thousands of copies become one row
    return stored(spark, met.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most")).filter("least <> most").select("digest"))


def exact_dedup(
    spark: SparkSession,
    path: str,
    checkpoint: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    max_bytes_per_batch: int = 64 << 30,
) -> DataFrame:
    """One row per row of the table: id, keep_id, group_size, kept, digest, text_sha256."""
    state = dedup_state(spark, path, checkpoint, id_col, text_col, digest, max_bytes_per_batch)
    apart_digests = clashes(spark, path, state, id_col, text_col, digest)
    rows = _rows(spark.read.parquet(path), id_col, text_col, digest)
    slim = rows.select("id", "did", "at", "digest", *([F.col("digest").alias("sha")] if digest is sha256 else [sha256(F.col("norm")).alias("sha")]))
    total = state.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = spread_join(slim, state.withColumn("copies", F.col("n")), "digest", total, salt_bytes("did", "at.file", "at.row")).withColumnRenamed("copies", "n")
    if not apart_digests.isEmpty():
        of_clash = rows.join(apart_digests, "digest", "left_semi")
        groups = of_clash.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("did", "at")).alias("first"))
        apart = of_clash.join(groups, ["digest", "norm"]).select(
            "digest", "id", "did", "at", sha256(F.col("norm")).alias("sha"), "n", F.col("first.did").alias("keep_did"), F.col("first.at").alias("keep_at")
        )
        out = out.join(apart_digests, "digest", "left_anti").unionByName(apart.select(*out.columns))
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("keep_did") == F.lit(9223372036854775807), F.lit(None).cast("long")).otherwise(F.col("keep_did")).alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("did") == F.col("keep_did")) & (F.col("at") == F.col("keep_at"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("keep_at").alias("keep_locator"),
    )
