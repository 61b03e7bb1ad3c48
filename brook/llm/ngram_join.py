"""N-gram Jaccard join: documents whose sets of word 5-shingles have a similarity of 0.8 or more.

The join is exact.  Shingles are ordered by the number of documents that hold them, rare ones first.

* A set of n shingles has a prefix of n - ceil(0.8 n) + 1; two similar sets share their first common shingle
  within both prefixes.  Shingles of one document only come first, so a document with more of them than its
  prefix holds has no partner and goes no further.
* Rare shingles (up to ``rare`` documents) of the prefix are indexed alone.
* Frequent ones are indexed in combinations of two: the prefix is extended to 2 floor(n/4) + 2 shingles and each
  pair of neighbours, both frequent, is a key.  If the first common shingle is frequent then all common ones
  are; at most floor(n/4) shingles differ, they break at most as many of the gaps between the first
  floor(n/4) + 2 common shingles, and so some two common shingles are neighbours in both sets.  (Different sets
  that are similar have at least five shingles together, which makes these counts hold.)
* Documents that share a key are verified by their whole sets.

Sets that are equal are one class from the start.  In a few rounds each class is verified against one other, of
those that speak for its keys; components of these links are formed, and then only pairs that lie in different
components, and whose common shingles may be enough, are left to verify: a large group of near copies
costs its size and not its square.

Defined cases: null, empty and blank texts have no shingles and no links; a text under five words is one
shingle; rows with the same id are one node of the graph; null ids share one node, larger than all others; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, split_join, stored
from .components import components
from .text_bytes import LOWER, chunks, mix, shingles
from .tiles import Found, Tile, bucket_bits, rows_of, shared_keys, tile_table

#: A shingle in more documents than this is frequent.
RARE = 8
#: Rounds of one verification for each class before the remaining pairs are formed.
ROUNDS = 1
CANDIDATE = "did long, n long, sig1 long, sig2 long, tokens array<long>, keys array<long>"


def sets_of(tile: Tile, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for a, b in chunks(tile.lengths):
        data, offsets = tile.part(a, b)
        yield a, shingles(LOWER[data], offsets, size)


def _keys_of(size: int):
    def run(tile: Tile) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=np.uint64), *[s for _, sets in sets_of(tile, size) for s in sets]])

    return run


def keys_of_set(ordered: np.ndarray, df: np.ndarray, rare: int, percent: int = 80) -> np.ndarray:
    """Index keys of a set in global order: rare prefix shingles alone, frequent neighbours in pairs."""
    n = len(ordered)
    prefix = n - -(-percent * n // 100) + 1
    alone = ordered[:prefix][(df[:prefix] > 1) & (df[:prefix] <= rare)]
    extended = min(n, 2 * (n * (100 - percent) // percent) + 2)
    many = df[:extended] > rare
    pair = many[:-1] & many[1:]
    left, right = ordered[:extended][:-1][pair], ordered[:extended][1:][pair]
    return np.concatenate([mix(alone), mix(left * np.uint64(3) + mix(right))])


def _candidates(size: int, bits: int, rare: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            tile, found = Tile(row), Found(row["found"], bits)
            for first, sets in sets_of(tile, size):
                flat = np.concatenate([np.zeros(0, dtype=np.uint64), *sets])
                df = found.counts(flat)
                at, ns, one, two, tokens, keys = 0, [], [], [], [], []
                for s in sets:
                    n = len(s)
                    own = df[at : at + n]
                    at += n
                    ns.append(n)
                    prefix = n - -(-percent * n // 100) + 1
                    if not n or int((own == 1).sum()) >= prefix:
                        one.append(None), two.append(None), tokens.append(None), keys.append(None)
                        continue
                    order = np.lexsort((s, own))
                    ranked, own = s[order], own[order]
                    one.append(int(np.add.reduce(mix(s)).view(np.int64)))
                    two.append(int(np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64)))
                    tokens.append(ranked.view(np.int64))
                    keys.append(np.unique(keys_of_set(ranked, own, rare, percent)).view(np.int64))
                m = len(sets)
                long_list = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(tile.ids[first : first + m], pa.int64()), pa.array(ns, pa.int64()), pa.array(one, pa.int64()),
                        pa.array(two, pa.int64()), pa.array(tokens, long_list), pa.array(keys, long_list),
                    ],
                    names=["did", "n", "sig1", "sig2", "tokens", "keys"],
                )

    return run


def verified(spark: SparkSession, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, stored."""
    of = lambda x: sets.select(F.col("did").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect("t_a", "t_b"))
    n = F.col("n_a") + F.col("n_b")
    return stored(spark, met.withColumn("shared", shared).filter(100 * F.col("shared") >= percent * (n - F.col("shared"))).select("a", "b"))


def with_component(post: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return post.withColumn("c", F.col("did"))
    found = post.join(comp.withColumnRenamed("node", "did"), "did", "left")
    return found.select("key", "did", "n", F.coalesce("component", "did").alias("c"))


def favourites(placed: DataFrame, r: int, total: int) -> DataFrame:
    """For each class the class of another component that speaks for most of its keys: pairs (a, b).

    The smallest id speaks for a key in the first round, in later ones the smallest by a hash of id and round.
    """
    rank = F.struct(F.xxhash64("did", F.lit(r)).alias("h"), "did", "c") if r else F.struct(F.col("did").alias("h"), "did", "c")
    speaker = placed.groupBy("key").agg(F.min(rank).alias("s"), F.min("c").alias("m"), F.max("c").alias("x"), F.count(F.lit(1)).alias("n")).filter("m < x")
    speaker = stored(placed.sparkSession, speaker.select("key", F.col("s.did").alias("to"), F.col("s.c").alias("to_c"), "n"))
    votes = split_join(placed.drop("n"), speaker, "key", total).filter("c <> to_c")
    best = votes.groupBy("did", "to").agg(F.count(F.lit(1)).alias("k")).groupBy("did").agg(F.max(F.struct("k", "to")).alias("v"))
    return best.select(F.col("v.to").alias("a"), F.col("did").alias("b"))


def possible_pairs(spark: SparkSession, rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes left in different components that may be similar enough.

    The prefix filter once more, over these classes alone.  Only shingles that another of them has too can be
    common to a pair; with the rarest of these first, a pair's first common one at place i of u leaves at most
    u - i common ones, and (100 + percent) (u - i) >= percent (n + n') must hold on both sides.  Near copies that
    all differ from each other drop out by this, before any pair is formed.
    """
    left = sets.join(rest.select("did", "c").distinct(), "did")
    tokens = left.select("did", "n", "c", F.explode("tokens").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = tokens.join(common, "token").groupBy("did", "n", "c").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts"))
    cap = (100 + percent) * (F.size("ts") - F.col("i")) - percent * F.col("n")
    keys = ranked.select("did", "n", "c", "ts", F.posexplode("ts").alias("i", "t")).withColumn("cap", cap).filter(100 * F.col("cap") >= percent * percent * F.col("n"))
    keys = stored(spark, keys.select(F.col("t.token").alias("key"), "did", "n", "c", "cap"))
    per_key = keys.groupBy("key").agg(F.min("n").alias("least"), F.max("cap").alias("most"), F.min("c").alias("m"), F.max("c").alias("x")).filter("m < x")
    able = keys.join(per_key.select("key", "least", "most"), "key").filter((F.col("cap") >= percent * F.col("least")) & (percent * F.col("n") <= F.col("most")))
    able = stored(spark, able.select("key", "did", "n", "c", "cap"))
    x, y = (able.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("did", "n", "c", "cap")]) for side in "ab")
    return (
        x.join(y, "key")
        .filter("did_a < did_b and c_a <> c_b")
        .filter((100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a")))
        .filter((F.col("cap_a") >= percent * F.col("n_b")) & (F.col("cap_b") >= percent * F.col("n_a")))
        .select(F.col("did_a").alias("a"), F.col("did_b").alias("b"))
        .distinct()
    )


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, rare: int = RARE
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id."""
    spark = docs.sparkSession
    tiles = tile_table(docs, id_col, text_col)
    bits = bucket_bits(tiles)
    found = shared_keys(tiles, _keys_of(size), bits)
    rows = stored(spark, tiles.join(found, "tile", "left").mapInArrow(_candidates(size, bits, rare, percent), CANDIDATE))

    some = rows.filter("sig1 is not null")
    # one class for each different set, named by its smallest id
    classes = stored(
        spark,
        some.groupBy("sig1", "sig2", "n").agg(F.min("did").alias("did"), F.any_value("tokens").alias("tokens"), F.any_value("keys").alias("keys")),
    )
    sets = classes.select("did", "n", "tokens")
    post = stored(spark, classes.select("did", "n", F.explode("keys").alias("key")))
    shared = post.groupBy("key").agg(F.min("did").alias("m"), F.max("did").alias("x"), F.count(F.lit(1)).alias("n")).filter("m < x").select("key", "n")
    post = stored(spark, split_join(post, stored(spark, shared), "key", post.count()))
    total = post.count()

    # rounds in which each class is verified against one other: of those that speak for its keys, the one it shares most with
    links, comp = None, None
    for r in range(ROUNDS):
        placed = with_component(post, comp)
        new = verified(spark, favourites(placed, r, total), sets, percent)
        links = new if links is None else links.union(new)
        comp = stored(spark, components(links))
        if new.isEmpty():
            break
    # ... then whatever pairs of classes still lie in different components
    placed = stored(spark, with_component(post, comp))
    apart = placed.groupBy("key").agg(F.min("c").alias("m"), F.max("c").alias("x"), F.count(F.lit(1)).alias("n")).filter("m < x").select("key", "n")
    rest = stored(spark, split_join(placed, stored(spark, apart), "key", total))
    open_pairs = possible_pairs(spark, rest, sets, percent)
    more = verified(spark, open_pairs, sets, percent)

    members = some.join(classes.select("sig1", "sig2", "n", F.col("did").alias("class")), ["sig1", "sig2", "n"]).select("did", "class")
    # rows that share an id may be in several classes: that ties these classes together
    ties = members.groupBy("did").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a < b")
    tied = members.join(ties.select("did"), "did", "left_semi").select(F.col("did").alias("a"), F.col("class").alias("b"))
    edges = links.union(more).union(tied)
    final = stored(spark, components(edges))
    of_class = members.groupBy("did").agg(F.min("class").alias("class")).join(final.withColumnRenamed("node", "class"), "class", "left")
    reached = of_class.select(F.col("did").alias("node"), F.coalesce("component", "class").alias("component"))
    out = rows.select("did", "n").join(reached, F.col("did") == F.col("node"), "left")
    back = lambda c: F.when(c == LAST_ID, F.lit(None).cast("long")).otherwise(c)
    return out.select(
        back(F.col("did")).alias(id_col), F.col("n").alias("n_shingles"), back(F.coalesce(F.col("component"), F.col("did"))).alias("component_id")
    )
