"""The registered query of each operator, over the whole ``documents`` table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .exact_dedup import exact_dedup
from .language_model import lm_score
from .license_scan import license_scan
from .line_dedup import line_dedup
from .mixing import mix
from .ngram_join import ngram_join
from .packing import pack
from .quality_rules import quality_rules
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))


#: How flat the registered query makes the cells: their shares to this power.
MIX_TEMPER = 0.7


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir), temper=MIX_TEMPER)
    return out.select(
        "doc_id",
        F.col("__tokens").alias("n_tokens"),
        F.col("__topic").alias("topic"),
        F.round("__probability", 6).alias("probability"),
        F.col("__kept").alias("kept"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir))
    return out.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *[F.col("__" + n).alias(n) for n in names])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mixing": op2_mixing,
    "op3_license_scan": op3_license_scan,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_join": op7_ngram_join,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL = {
    # every byte place as two hexadecimal digits; windows of 50 bytes by md5
    "op1_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        b AS (SELECT doc_id, h, octet_length(encode(coalesce(text, ''))) AS n FROM (SELECT d.doc_id, d.h, x.text FROM d JOIN documents x USING (doc_id))),
        w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM b WHERE n >= 50)),
        f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
        hit AS (SELECT w.doc_id, w.p FROM w JOIN f USING (s) WHERE f.first < w.doc_id),
        g AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM hit),
        r AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
        spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS e FROM r GROUP BY doc_id, k),
        cuts AS (SELECT doc_id, CAST(sum(e - a) AS BIGINT) AS removed, count(*) AS spans, list(e ORDER BY a) AS ends, list(a ORDER BY a) AS starts FROM spans GROUP BY doc_id),
        j AS (SELECT b.doc_id, b.n, b.h, coalesce(removed, 0) AS removed, coalesce(spans, 0) AS spans, [0] || coalesce(ends, []) AS froms, coalesce(starts, []) || [b.n] AS tos FROM b LEFT JOIN cuts USING (doc_id))
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans,
               sha256(unhex(array_to_string(list_transform(range(1, len(froms) + 1), lambda i: substr(h, 2 * froms[i] + 1, 2 * (tos[i] - froms[i]))), ''))) AS kept_sha256
        FROM j""",
    "op5_line_dedup": r"""
        WITH l AS (
          SELECT doc_id, u.pos AS pos, u.line AS line,
                 translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
               LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) u
        ), shared AS (
          SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
        ), marked AS (
          SELECT l.doc_id, l.pos, l.line, (s.k IS NOT NULL AND l.doc_id > s.first) AS gone
          FROM l LEFT JOIN shared s ON l.k = s.k
        )
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op7_ngram_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
          FROM documents
        ), s AS (
          SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
          FROM w
        ), u AS (
          SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s
        ), p AS (
          SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c
          FROM u a JOIN u b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL
        ), e AS (
          SELECT x, y FROM p WHERE 100 * c >= 80 * (nx + ny - c)
        ), r AS (
          SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.node = e.x
        )
        SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id
        FROM s JOIN (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)""",
}
