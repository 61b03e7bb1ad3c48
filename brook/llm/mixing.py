"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed in cells of source x language x topic.  Raking scales the cells until their sums meet
the target shares of every source, every language and every topic; a cell's factor becomes the probability
with which its documents are kept, scaled so that the largest is 1.  A document's draw is a hash of its id and
a seed, so the same rows are kept wherever and however often the job runs.

Values listed by given targets have cells of their own and all others form one; what has no targets then is left free.
Without any targets every source and
every language is a value of its own, whatever their number, and the targets are the shares that the cells have when
each cell's share is raised to the power ``temper`` (under 1: flatter); the cells can always meet these.  Up to
``local_cells`` cells are raked on the driver, more of them as a table by the same steps.

Raking goes on until every sum is within ``TOLERANCE`` of its target.  Given targets that the cells can't meet together
(a source with one language, say, and other shares for the two) raise ``ValueError``.

Defined cases: null source or language is the value "(null)"; null and empty texts have no tokens and are kept
with probability 1 (they weigh nothing); rows that share an id are drawn together; null ids draw as one id; an
empty table gives an empty result; other columns pass through, whatever their names (the added ones are replaced).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, WS_RUN, fresh, stored, text_of

NONE, OTHER = "(null)", "(other)"
#: Sums are met within this share of themselves.  Targets count as out of reach after so many rounds, or when PATIENCE
#: rounds bring the sums no nearer.
TOLERANCE, ROUNDS, PATIENCE = 1e-6, 1000, 20
#: Cells raked on the driver at most; more are raked as a table.
LOCAL_CELLS = 200_000
AXES = ("s", "l", "t")
CELL = "s string, l string, t string, weight double, probability double"


def tokens(text_col: str = "text") -> Column:
    t = F.btrim(text_of(text_col), F.lit(WS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WS_RUN))).cast("long")


def topic(text_col: str = "text") -> Column:
    """A coarse topic from the form of the whole text: notice, table, list or prose."""
    t = text_of(text_col)
    return (
        F.when(F.contains(F.lower(t), F.lit("licen")), "notice")
        .when(F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit(""))) >= 5, "table")
        .when(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) >= 20, "list")
        .otherwise("prose")
    )


def draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) for each id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(NONE)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def stuck(offs: list[float]) -> bool:
    return len(offs) > PATIENCE and offs[-1] > 0.98 * offs[-1 - PATIENCE]


def not_met(off: float, rounds: int) -> ValueError:
    return ValueError(f"the targets can't be met together: after {rounds} rounds a sum is off by {off:.3%}")


def rake(
    cells: Mapping[tuple[str, str, str], float], targets: tuple[Mapping[str, float] | None, ...], rounds: int = ROUNDS, tolerance: float = TOLERANCE
) -> dict[tuple[str, str, str], float]:
    """Cells scaled until their sums along each axis meet the target shares, if it has any (cells of no weight stay out)."""
    keys = [k for k, v in cells.items() if v > 0]
    now = np.array([float(cells[k]) for k in keys])
    total, offs = now.sum(), [float("inf")]
    axes = []
    for axis, wanted_shares in enumerate(targets):
        if wanted_shares is None:
            continue
        names = sorted({k[axis] for k in keys})
        place = {n: i for i, n in enumerate(names)}
        axes.append((np.array([place[k[axis]] for k in keys], dtype=np.int64), np.array([wanted_shares.get(n, 0.0) * total for n in names])))
    for _ in range(rounds):
        off = 0.0
        for at, wanted in axes:
            have = np.bincount(at, weights=now, minlength=len(wanted))
            scale = np.divide(wanted, have, out=np.ones_like(wanted), where=have > 0)
            # a value without any weight left can't reach a share
            off = max(off, float(np.abs(scale - 1).max(initial=0.0)) if len(wanted) else 0.0, 1.0 if ((have <= 0) & (wanted > 0)).any() else 0.0)
            now = now * scale[at]
        offs.append(off)
        if off < tolerance:
            return dict(zip(keys, now.tolist()))
        if stuck(offs):
            break
    raise not_met(offs[-1], len(offs) - 1)


def shares(wanted: Mapping[str, float], present: set[str]) -> dict[str, float]:
    """Given targets as shares of the values that there are."""
    whole = sum(wanted.get(k, 0.0) for k in present) or 1.0
    return {k: wanted.get(k, 0.0) / whole for k in present}


def local_factors(spark: SparkSession, cells: DataFrame, given: tuple[Mapping[str, float] | None, ...], temper: float) -> DataFrame:
    """Factor and probability of every cell, raked on the driver."""
    found = {tuple(r[a] for a in AXES): float(r["n"]) for r in cells.collect()}
    total = sum(found.values()) or 1.0
    flat = {k: (v / total) ** temper for k, v in found.items()}
    whole = sum(flat.values()) or 1.0
    targets = []
    for axis, wanted in enumerate(given):
        if wanted is not None:
            targets.append(shares(wanted, {k[axis] for k in found}))
            continue
        if any(given_axis is not None for given_axis in given):
            targets.append(None)
            continue
        own: dict[str, float] = defaultdict(float)
        for k, v in flat.items():
            own[k[axis]] += v / whole
        targets.append(own)
    raked = rake(found, tuple(targets)) if found else {}
    factor = {k: raked[k] / v for k, v in found.items() if k in raked}
    most = max(factor.values(), default=1.0) or 1.0
    return F.broadcast(spark.createDataFrame([(*k, float(f), float(f / most)) for k, f in sorted(factor.items())], CELL))


def table_factors(
    spark: SparkSession, cells: DataFrame, given: tuple[Mapping[str, float] | None, ...], temper: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE
) -> DataFrame:
    """The same with the cells as a table: a round is a sum and a join for each axis, written once."""
    total = float(cells.agg(F.sum("n")).first()[0])
    flat = cells.withColumn("flat", F.pow(F.col("n") / total, F.lit(temper)))
    whole_flat = flat.agg(F.sum("flat")).first()[0] or 1.0
    now = cells.withColumn("v", F.col("n").cast("double"))
    axes = [a for a, wanted in zip(AXES, given) if wanted is not None or not any(x is not None for x in given)]
    for a, wanted in zip(AXES, given):
        if a not in axes:
            continue
        if wanted is None:
            own = flat.groupBy(a).agg((F.sum("flat") / whole_flat).alias(f"share_{a}"))
        else:
            listed = spark.createDataFrame([(k, float(x)) for k, x in wanted.items()], f"{a} string, raw double")
            raw = cells.select(a).distinct().join(listed, a, "left").select(a, F.coalesce("raw", F.lit(0.0)).alias("raw"))
            whole = raw.agg(F.sum("raw")).first()[0] or 1.0
            own = raw.select(a, (F.col("raw") / whole).alias(f"share_{a}"))
        now = now.join(own, a)
    now, offs = stored(spark, now), [float("inf")]
    for _ in range(rounds):
        if stuck(offs):
            raise not_met(offs[-1], len(offs) - 1)
        step = now
        for a in axes:
            sums = step.groupBy(a).agg(F.sum("v").alias("h"))
            scale = F.coalesce(F.when(F.col("h") > 0, F.col(f"share_{a}") * total / F.col("h")), F.lit(1.0))
            lost = F.when((F.col("h") <= 0) & (F.col(f"share_{a}") > 0), 1.0).otherwise(F.abs(scale - 1))
            step = step.join(sums, a).withColumns({"v": F.col("v") * scale, f"off_{a}": lost}).drop("h")
        done = stored(spark, step)
        now = done.drop(*[f"off_{a}" for a in axes])
        offs.append(max(done.agg(*[F.max(f"off_{a}") for a in axes]).first()))
        if offs[-1] < tolerance:
            break
    else:
        raise not_met(offs[-1], rounds)
    factor = now.select(*AXES, (F.col("v") / F.col("n")).alias("weight"))
    most = factor.agg(F.max("weight")).first()[0] or 1.0
    return factor.withColumn("probability", F.col("weight") / most)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_targets: Mapping[str, float] | None = None,
    lang_targets: Mapping[str, float] | None = None,
    topic_targets: Mapping[str, float] | None = None,
    temper: float = 0.97,
    seed: int = 7,
    source_col: str = "source",
    lang_col: str = "lang",
    topic_col: str | None = None,
    local_cells: int = LOCAL_CELLS,
) -> DataFrame:
    """``docs`` with __tokens, __topic, __weight (the cell's factor), __probability and __kept added."""
    spark = docs.sparkSession
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    about = topic(text_col) if topic_col is None else name(topic_col)
    flat = docs.select(name(source_col).alias("s"), name(lang_col).alias("l"), about.alias("t"), tokens(text_col).alias("n"))

    def value(c: Column, wanted: Mapping[str, float] | None) -> Column:
        return c if wanted is None else F.when(c.isin(list(wanted)), c).otherwise(OTHER)

    folded = flat.select(value(F.col("s"), source_targets).alias("s"), value(F.col("l"), lang_targets).alias("l"), "t", "n")
    cells = stored(spark, folded.groupBy(*AXES).agg(F.sum("n").alias("n")).filter("n > 0"))
    factors = local_factors if cells.count() <= local_cells else table_factors
    found = factors(spark, cells, (source_targets, lang_targets, topic_targets), temper)
    keyed = docs.withColumns({"__tokens": tokens(text_col), "__topic": about})
    s, l, t = fresh(keyed, "__s", "__l", "__t")
    lookup = found.select(F.col("s").alias(s), F.col("l").alias(l), F.col("t").alias(t), "weight", "probability")
    weight, probability = fresh(keyed, "__cell_weight", "__cell_probability")
    lookup = lookup.withColumnsRenamed({"weight": weight, "probability": probability})
    same = (value(name(source_col), source_targets) == F.col(s)) & (value(name(lang_col), lang_targets) == F.col(l)) & (F.col("__topic") == F.col(t))
    out = keyed.join(lookup, same, "left")
    empty = F.col("__tokens") == 0
    out = out.withColumns({c: F.when(empty, 1.0).otherwise(F.coalesce(F.col(v), F.lit(0.0))) for c, v in (("__weight", weight), ("__probability", probability))})
    return out.drop(s, l, t, weight, probability).withColumn("__kept", draw(id_col, seed) < F.col("__probability"))
