"""Shared helpers: the shared scratch folder, written intermediates, ids and ASCII-only lower-casing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
WS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_ID = 9223372036854775807


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which every executor sees.

    Only a session on this machine alone (tests, a notebook) may do without that setting; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dir()
    return f"{base.rstrip('/')}/brook-{uuid.uuid4().hex}"


_OWN: list[str] = []


def _own_dir() -> str:
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="brook-shared-"))
    return _OWN[0]


def stored(spark: SparkSession, df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read again: lost executors then cost nothing above it."""
    path = path or shared_dir(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_key(column: str = "doc_id") -> Column:
    """The id as long; a null id sorts last."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII values take the fast path of lower()."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside a lambda Spark computes an outer expression for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(c: Column) -> Column:
    """The words of a text, split at ASCII white space; none for an empty text."""
    t = F.btrim(c, F.lit(WS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS_RUN))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer where ``df`` has such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


#: Keys that are looked up by broadcast at most.
HOT_KEYS = 10_000


def hot_from(total: int, least: int = 1000) -> int:
    """So many rows make a key hot; no more than HOT_KEYS of ``total`` rows' keys can have as many."""
    return max(least, total // HOT_KEYS + 1)


def spread_join(rows: DataFrame, found: DataFrame, key: str, total: int, salt: Column) -> DataFrame:
    """``rows`` with what ``found`` has for a key; rows without an entry go.

    ``found`` has one row a key, read twice, with ``n``, the number of rows of the key.  Entries of hot keys (``hot_from``
    of ``total`` rows) are broadcast: there are HOT_KEYS of them at most.  Their rows go on under ``salt``, a value of the
    key's type that differs from row to row, so that no task of the shuffled join gets all rows of a key.  If that meets
    another key's entry, it does no harm: the broadcast one comes first.
    """
    values = [c for c in found.columns if c not in (key, "n")]
    hot = F.col("n") >= hot_from(total)
    few = found.filter(hot).select(F.col(key), F.struct(F.lit(True).alias("one_"), *values).alias("hot_"))
    rest = found.filter(~hot).select(F.col(key).alias("key_"), F.struct(F.lit(True).alias("one_"), *values).alias("cold_"))
    met = rows.join(F.broadcast(few), key, "left")
    dealt = F.when(F.col("hot_").isNull(), F.col(key)).otherwise(salt)
    both = met.withColumn("dealt_", dealt).join(rest, F.col("dealt_") == F.col("key_"), "left")
    one = F.coalesce("hot_", "cold_")
    return both.filter(one.isNotNull()).select(*rows.columns, *[one[c].alias(c) for c in values])


def split_join(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """``spread_join`` for rows that are cheap to read twice, as stored ones: rows of hot keys are not shuffled at all, and
    the others without anything beside them."""
    values = [c for c in found.columns if c not in (key, "n")]
    hot = F.col("n") >= hot_from(total)
    met = rows.join(F.broadcast(found.filter(hot).select(key, *values)), key)
    others = rows.join(F.broadcast(found.filter(hot).select(key)), key, "left_anti").join(found.filter(~hot).select(key, *values), key)
    return met.select(*rows.columns, *values).unionByName(others.select(*rows.columns, *values))


def salt_bytes(*columns: str) -> Column:
    """Eight bytes at most from a hash of the columns."""
    return F.unhex(F.hex(F.xxhash64(*columns)))
