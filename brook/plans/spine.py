"""Gap filling: every period and every category gets a row, whether or not there is data for it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PlanProblem
from ..functions import TRUNCATIONS, truncated
from ..lang.nodes import Between, Call, Cast, Col, Group, Lit, Node, Op
from ..lang.parser import has_aggregate
from ..lang.render import Context, render
from .naming import named

UNITS = (*TRUNCATIONS, "week", "week_monday", "week_sunday")
#: Coarse to fine; weeks do not nest in the others.
FINENESS = {u: k for k, u in enumerate(("year", "quarter", "month", "day", "hour", "minute", "second"))}
STEP = {
    "year": "INTERVAL '1' YEAR", "quarter": "INTERVAL '3' MONTH", "month": "INTERVAL '1' MONTH", "week": "INTERVAL '7' DAY", "day": "INTERVAL '1' DAY",
    "hour": "INTERVAL '1' HOUR", "minute": "INTERVAL '1' MINUTE", "second": "INTERVAL '1' SECOND",
}


@dataclass
class Bounds:
    """The tightest ends that the filters give, as SQL."""

    lows: list[str] = field(default_factory=list)
    highs: list[str] = field(default_factory=list)

    def low(self) -> str | None:
        return _one("greatest", self.lows)

    def high(self) -> str | None:
        return _one("least", self.highs)


def _one(f: str, values: list[str]) -> str | None:
    return f"{f}({', '.join(values)})" if len(values) > 1 else next(iter(values), None)


def period(n: Node) -> tuple[str, Node] | None:
    if isinstance(n, Call) and n.name in UNITS and len(n.args) == 1:
        return n.name, n.args[0]
    return None


def conjuncts(n: Node) -> list[Node]:
    return [x for a in n.args for x in conjuncts(a)] if isinstance(n, Op) and n.op == "and" else [n]


def same(a: Node, b: Node) -> bool:
    return a == b or isinstance(a, Col) and isinstance(b, Col) and a.name.lower() == b.name.lower()


def bounds_of(conditions: list[Node], column: Node, is_date: bool) -> Bounds:
    """Bounds that the conditions put on a column; both ends are needed for a spine to follow them.

    An open upper end counts as the moment before it, so that the last period is the one that can still have rows,
    whatever the unit; an open lower end of dates as the next day.
    """
    out = Bounds()
    literal = lambda x: isinstance(x, (Lit, Cast)) and (not isinstance(x, Lit) or x.kind in ("date", "timestamp", "string"))
    show = lambda x: f"CAST({render(x, Context())} AS TIMESTAMP_NTZ)"
    flip = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
    for c in conditions:
        if isinstance(c, Between) and not c.negated and same(c.expr, column) and literal(c.low) and literal(c.high):
            out.lows.append(show(c.low))
            out.highs.append(show(c.high))
        if not (isinstance(c, Op) and c.op in flip and len(c.args) == 2):
            continue
        op, (a, b) = c.op, c.args
        if same(b, column) and literal(a):
            op, a, b = flip[op], b, a
        if not (same(a, column) and literal(b)):
            continue
        if op == ">=":
            out.lows.append(show(b))
        elif op == ">":
            out.lows.append(f"(date_trunc('DAY', {show(b)}) + INTERVAL '1' DAY)" if is_date else show(b))
        elif op == "<=":
            out.highs.append(show(b))
        else:
            out.highs.append(f"({show(b)} - INTERVAL '0.000001' SECOND)")
    return out


def grouped(lower, s, step: Group):
    """A group for every period and category; an empty one counts 0 and sums to null."""
    source, keys, _ = lower.keys_of(s, step)
    aggs = [(lower.entities(i.expr, s), named(i, lower.settings, k)) for k, i in enumerate(step.aggs or ())]
    s = replace(s, spine=(step.spined, s.conditions))
    df = lower.aggregate(s, source, keys, aggs)
    return replace(s, df=df, grouped=(source, keys, aggs), order=(), conditions=())


def filled(lower, s, source: DataFrame, keys: list[tuple[Node, str]], aggs: list[tuple[Node, str]]) -> DataFrame:
    """__k0, __k1 ... and the outputs, for the groups of ``source`` and those of the spine that it lacks.

    The rows are aggregated by their keys first; periods and categories are read off these few groups, and only
    they meet the spine.  An aggregate is a column __a0, __a1 ... until then; outputs are made of them at the end.
    """
    at = replace(s, df=source, spine=())
    inner = {n: Col((f"__k{k}",)) for k, (n, _) in enumerate(keys)}
    plain = {n.name.lower(): v for n, v in inner.items() if isinstance(n, Col)}
    have = {c.lower() for c in source.columns}
    parts: list[Node] = []

    def part(x: Node) -> Col:
        if x not in parts:
            parts.append(x)
        return Col((f"__a{parts.index(x)}",))

    def taken_apart(x: Node) -> Node | None:
        if x in inner:
            return inner[x]
        if isinstance(x, Call) and has_aggregate(x) and not any(has_aggregate(a) for a in x.args):
            return part(x)
        if isinstance(x, Col) and len(x.parts) == 1:
            return plain.get(x.name.lower())
        return None

    outputs: list[tuple[Node, str]] = []
    made: dict[str, Node] = {}
    for n, name in aggs:
        n = n.rewrite(lambda x: made.get(x.name.lower()) if isinstance(x, Col) and len(x.parts) == 1 and x.name.lower() not in have else None)
        made[name.lower()] = n
        own = n.rewrite(taken_apart)
        known = {f"__k{k}" for k in range(len(keys))} | {f"__a{k}" for k in range(len(parts))}
        if any(isinstance(x, Col) and x.name not in known for x in own.walk()):
            own = part(n)  # an aggregate that is known to Spark alone
        outputs.append((own, name))
    ks = [f"__k{k}" for k in range(len(keys))]
    values = [F.expr(lower.text(n, at, block=True)).alias(f"__a{k}") for k, n in enumerate(parts)]
    groups = source.groupBy(*ks).agg(*values) if values else source.select(*ks).distinct()
    spine = series(lower, at, s.spine, groups, keys, [f"__a{k}" for k in range(len(parts))])
    spined = [k for k in range(len(keys)) if s.spine[0][k]]
    on = None
    for k in spined:
        c = F.col(f"__k{k}").eqNullSafe(F.col(f"__s{k}"))
        on = c if on is None else on & c
    empty = source.filter(F.lit(False)).agg(*[v.alias(f"__e{k}") for k, v in enumerate(values)]) if values else None
    if len(spined) == len(keys):  # as many groups as the spine has rows, at most
        joined = spine.join(groups.withColumn("__in", F.lit(True)), on, "left")
    else:  # the groups stay where they are; only what the spine has beyond them is added
        seen = groups.select(*[F.col(f"__k{k}") for k in spined]).distinct()
        lacking = spine.join(seen, on, "left_anti")
        inside = groups.filter(F.expr(" AND ".join([f"__k{k} IS NOT NULL" for k in spined if period(keys[k][0])] or ["true"])))
        joined = inside.withColumn("__in", F.lit(True)).withColumns({f"__s{k}": F.col(f"__k{k}") for k in spined})
        joined = joined.unionByName(lacking, allowMissingColumns=True)
    if empty is not None:
        joined = joined.crossJoin(F.broadcast(empty))  # one row, made without reading
        joined = joined.withColumns({f"__a{k}": F.when(F.col("__in"), F.col(f"__a{k}")).otherwise(F.col(f"__e{k}")) for k in range(len(parts))})
    joined = joined.withColumns({f"__k{k}": F.col(f"__s{k}") for k in spined})
    last = replace(at, df=joined, tables={}, columns={}, grouped=None)
    return joined.select(*ks, *[lower.col(n, last).alias(name) for n, name in outputs])


def series(lower, s, spine: tuple, groups: DataFrame, keys: list[tuple[Node, str]], aggregates: list[str]) -> DataFrame:
    """__s0, __s1 ... for the spined keys: every period between the ends, every category, and their product."""
    flags, conditions = spine
    dates: dict[Node, list[tuple[int, str]]] = {}
    for k, (n, _) in enumerate(keys):
        found = period(n) if flags[k] else None
        if found:
            dates.setdefault(found[1], []).append((k, found[0]))
    out: DataFrame | None = None
    # what reads the groups again asks for all their columns: then both readings are one exchange
    every = F.max(F.xxhash64(*[F.col(c).cast("string") for c in aggregates])) if aggregates else F.max(F.lit(0))

    def cross(df: DataFrame) -> None:
        nonlocal out
        out = df if out is None else out.crossJoin(df)

    week = lower.settings.week_start
    for column, own in dates.items():
        units = [u for _, u in own]
        weeks = [u for u in units if u.startswith("week")]
        if weeks and any(u in ("month", "quarter", "year") for u in units):
            raise PlanProblem("weeks do not fit into months, quarters or years: spine by one of them")
        fine = weeks[0] if weeks and not any(u in ("day", "hour", "minute", "second") for u in units) else max((u for u in units if not u.startswith("week")), key=lambda u: FINENESS[u])
        x = lower.text(column, s)
        is_date = dict(s.df.select(F.expr(x).alias("x")).dtypes)["x"] == "date"
        b = bounds_of(list(conditions), column, is_date)
        low, high = b.low(), b.high()
        if low and high:
            ends = lower.spark.range(1).select(F.expr(low).alias("lo"), F.expr(high).alias("hi"))
        else:
            key = f"__k{next(k for k, u in own if u == fine)}"
            ends = groups.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), every.alias("n")).filter("n IS NOT NULL")
        lo, hi = (truncated(fine, e, week) for e in ("lo", "hi"))
        steps = f"CASE WHEN lo <= hi THEN sequence({lo}, {hi}, {STEP[fine.split('_')[0]]}) ELSE array() END"
        periods = ends.select(F.explode(F.expr(steps)).alias("__p"))
        cross(periods.select(*[F.expr(truncated(u, "__p", week)).alias(f"__s{k}") for k, u in own]).distinct())
    in_dates = {k for own in dates.values() for k, _ in own}
    for k in range(len(keys)):
        if flags[k] and k not in in_dates:
            cross(groups.groupBy(F.col(f"__k{k}").alias(f"__s{k}")).agg(every.alias("n")).filter("n IS NOT NULL").drop("n"))
    assert out is not None
    return out
