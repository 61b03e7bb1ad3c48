"""The pipeline, stage by stage, against plain versions on the small corpus."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import corpus
import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus.rows(), corpus.SCHEMA).select(*COLUMNS).write.parquet(f"{d}/documents.parquet")
    found = [(i, int("spam" not in (t or "")), 0) for i, t in corpus.texts() if i is not None]
    spark.createDataFrame(found, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k < 4:
            assert docs.columns == COLUMNS
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        tables.append(docs)
    n = [t.count() for t in tables[:5]]
    assert n[0] > n[1] == n[2] > n[3] >= n[4] > 0
    # quality: short and repetitive texts go, ordinary ones stay
    kept = {r["doc_id"] for r in tables[1].collect()}
    assert 77 not in kept and 71 not in kept and {1, 2, 3, 58, 64} & kept
    # lines: no line of ten characters is left in two documents
    seen: dict[str, set] = {}
    for r in tables[2].collect():
        for line in (r["text"] or "").split("\n"):
            key = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= 10:
                seen.setdefault(key, set()).add(r["doc_id"])
    assert all(len(v) == 1 for v in seen.values())
    # packing: pieces of exactly the documents that were left
    assert {r["doc_id"] for r in tables[5].collect()} == {r["doc_id"] for r in tables[4].collect()}


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    assert len(corpus_pipeline.STAGES) == 5


def test_mixture_moves_shares(spark):
    """900 and 100 documents of two languages: the small one stays whole, the large one by 9 to the power -0.3 (0.52)."""
    rows = [(k, f"some words of document {k}", "de" if k % 10 == 0 else "en", "a", 30) for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r["lang"] for r in corpus_pipeline.mixture(spark, docs, "").collect()]
    assert kept.count("de") == 100
    assert 420 < kept.count("en") < 510
