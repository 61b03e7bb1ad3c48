"""A cleaning pipeline over ``documents``: quality rules, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the columns of ``documents``; the
last one returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brook.llm.common import doc_key, documents, fresh, stored
from brook.llm.line_dedup import line_dedup
from brook.llm.mixing import mix
from brook.llm.ngram_join import ngram_join
from brook.llm.packing import pack
from brook.llm.quality_rules import quality_rules
from brook.llm.queries import MIX_TEMPER, labels, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects."""
    return quality_rules(docs, labels(spark, sf_dir)).filter("__kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one has; n_chars follows the text."""
    out = line_dedup(docs)
    return out.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (rows with a null id count as one document, kept)."""
    (gone,) = fresh(docs, "__gone")
    away = ngram_join(docs).filter("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(away, doc_key() == F.col(gone), "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled with the probabilities that bring sources, languages and topics to their targets, as flat as those of op2."""
    return mix(docs, temper=MIX_TEMPER).filter("__kept").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset."""
    return pack(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("mixing", mixture), ("best-fit packing", packing)]

#: Learned rules and the tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(spark, docs)
    return docs
