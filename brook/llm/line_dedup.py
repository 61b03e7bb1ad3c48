"""Line deduplication across documents.

Lines are exploded to (document, position, key hash), which are written once; the distinct documents of each hash are
counted, and a line goes from all but the first document of its key once the count reaches ``min_docs``.  What goes
is gathered per document as sorted positions, and the rest is put together again in order of position.

The lookup of a line's key deals lines out by hash; hashes of very many lines are broadcast instead, and their number is
bounded by the number of lines.

A key is the line without white space at its ends, A-Z in lower case; keys under ``min_chars`` code points
never go.  Defined cases: a null or empty text is one empty line; rows with the same id count as one document
and a null id as one document larger than every other; a line repeated inside the first document stays there;
other columns pass through, whatever their names (__n_lines and __n_dropped are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, ascii_lower, doc_key, fresh, let, salt_bytes, spread_join, stored, text_of


def line_hash(line: Column, min_chars: int) -> Column:
    key = ascii_lower(F.btrim(line, F.lit(WS)))
    return F.when(F.length(key) >= min_chars, F.unhex(F.md5(key)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """``docs`` with the remaining lines as its text, and __n_lines, __n_dropped (long) added."""
    spark, text = docs.sparkSession, text_of(text_col)
    exploded = docs.select(
        doc_key(id_col).alias("did"),
        F.xxhash64(text).alias("th"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    ).select("did", "th", "pos", line_hash(F.col("line"), min_chars).alias("h"))
    lines = stored(spark, exploded.filter("h is not null"))
    if min_docs == 2:  # two different ids: no need to tell all of them apart
        keys = lines.groupBy("h").agg(F.min("did").alias("first"), F.max("did").alias("last"), F.count(F.lit(1)).alias("n")).filter("first < last").drop("last")
    else:
        docs_of = lines.groupBy("h", "did").agg(F.count(F.lit(1)).alias("m"))
        keys = docs_of.groupBy("h").agg(F.min("did").alias("first"), F.count(F.lit(1)).alias("d"), F.sum("m").alias("n")).filter(F.col("d") >= min_docs).drop("d")
    keys = stored(spark, keys)
    met = spread_join(lines, keys, "h", lines.count(), salt_bytes("did", "pos"))
    did, th, pos, key, hashed = fresh(docs, "__did", "__th", "__pos", "__key", "__hash")
    gone = (
        met.filter("did > first")
        .groupBy(F.col("did").alias(did), F.col("th").alias(th))  # the text too: rows may share an id
        .agg(F.sort_array(F.collect_set("pos")).alias(pos))
    )
    keyed = docs.withColumns({key: doc_key(id_col), hashed: F.xxhash64(text)})
    out = keyed.join(gone, (F.col(key) == F.col(did)) & (F.col(hashed) == F.col(th)), "left")
    split = F.split(text, "\n")
    # the slices between one dropped position and the next
    kept = let(
        F.struct(split.alias("lines"), F.concat(F.array(F.lit(-1)), F.col(pos), F.array(F.size(split))).alias("ends")),
        lambda x: F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.size(x["ends"]) - 1),
                lambda i: F.slice(x["lines"], F.element_at(x["ends"], i) + 2, F.element_at(x["ends"], i + 1) - F.element_at(x["ends"], i) - 1),
            )
        ),
    )
    return out.withColumns(
        {
            "__n_lines": F.size(split).cast("long"),
            "__n_dropped": F.coalesce(F.size(pos), F.lit(0)).cast("long"),
            text_col: F.when(F.col(pos).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
        }
    ).drop(key, hashed, did, th, pos)
