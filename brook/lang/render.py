"""Expressions as Spark SQL text, for ``F.expr``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from ..errors import PlanProblem, SyntaxProblem
from ..functions import AGGREGATE_NAMES, NUMERIC_PARTS, RUNNING, SCALARS, TRUNCATIONS, TYPES, difference, interval, truncated
from .nodes import (
    Array, AtZone, Between, Call, Case, Cast, Col, Comprehension, Exists, In, Interval, IsNull, Lit, Node, Op, Ordered, Over, Query, Slice, Star, Sub,
)

#: Window functions that need no aggregate around them.
RANKS = {"row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead", "first_value", "last_value", "nth_value"}
ORDER_MATTERS = {"row_number", "rank", "dense_rank", "lag", "lead", "prior", "next", "fill_forward", "fill_backward"} | {f"{a}_{b}" for a in ("running", "rolling") for b in RUNNING}


@dataclass
class Context:
    """What an expression is rendered against."""

    aliases: frozenset[str] = frozenset()
    columns: frozenset[str] = frozenset()
    order: tuple[Ordered, ...] = ()
    block: bool = False  # in an aggregate block: first() and arg_max() are aggregates
    week_start: str = "monday"
    relative: str = "timestamp"
    subquery: Callable[[Query], str] | None = None
    exists: Callable[[Query], str] | None = None
    local: frozenset[str] = field(default_factory=frozenset)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_frame_function(node: Node) -> bool:
    return isinstance(node, Call) and (node.name in ORDER_MATTERS) and not (node.over and node.over.order)


def sort_text(o: Ordered, c: Context) -> str:
    nulls = o.nulls or ("last" if o.desc else "first")
    return f"{render(o.expr, c)} {'DESC' if o.desc else 'ASC'} NULLS {nulls.upper()}"


def render(n: Node, c: Context) -> str:
    match n:
        case Col(parts):
            return column(parts, c)
        case Star(table):
            return f"{quoted(table)}.*" if table else "*"
        case Lit(value, kind):
            return literal(value, kind)
        case Op(op, args):
            return operator(op, args, c)
        case Call():
            return call(n, c)
        case Case(whens, default):
            body = " ".join(f"WHEN {render(a, c)} THEN {render(b, c)}" for a, b in whens)
            return f"CASE {body}{f' ELSE {render(default, c)}' if default is not None else ''} END"
        case Cast(x, kind, safe):
            return f"{'TRY_CAST' if safe else 'CAST'}({render(x, c)} AS {TYPES.get(kind.lower(), kind)})"
        case AtZone(x, zone):
            return f"convert_timezone('UTC', {text(zone)}, CAST({render(x, c)} AS TIMESTAMP_NTZ))"
        case In(x, items, negated):
            inner = ", ".join(nested(i, c) if isinstance(i, Sub) else render(i, c) for i in items)
            return f"({render(x, c)} {'NOT ' if negated else ''}IN ({inner}))"
        case Between(x, low, high, negated):
            return f"({render(x, c)} {'NOT ' if negated else ''}BETWEEN {render(low, c)} AND {render(high, c)})"
        case IsNull(x, negated):
            return f"({render(x, c)} IS {'NOT ' if negated else ''}NULL)"
        case Interval(amount, unit):
            return interval(render(amount, c), unit)
        case Sub():
            return f"({nested(n, c)})"
        case Exists(q):
            if not c.exists:
                raise PlanProblem("a nested query is not possible here")
            return f"EXISTS ({c.exists(q)})"
        case Array(items):
            return f"array({', '.join(render(i, c) for i in items)})"
        case Comprehension(body, name, source, condition):
            own = replace(c, local=c.local | {name})
            out = render(source, c)
            if condition is not None:
                out = f"filter({out}, {quoted(name)} -> {render(condition, own)})"
            return out if body == Col((name,)) else f"transform({out}, {quoted(name)} -> {render(body, own)})"
        case Slice():
            return part(n, c)
    raise SyntaxProblem(f"no expression: {n}")


def column(parts: tuple[str, ...], c: Context) -> str:
    if len(parts) > 1 and parts[0] not in c.local and parts[0].lower() not in c.aliases and parts[0].lower() not in c.columns:
        parts = parts[-1:]  # the table closed with an earlier stage; its column may still be there
    return ".".join(quoted(p) for p in parts)


def literal(value, kind: str) -> str:
    if kind == "string":
        return text(value)
    if kind == "null":
        return "NULL"
    if kind == "bool":
        return "TRUE" if value else "FALSE"
    if kind == "date":
        return f"DATE'{value}'"
    if kind == "timestamp":
        return f"TIMESTAMP_NTZ'{value}'"
    return str(value)


def operator(op: str, args: tuple[Node, ...], c: Context) -> str:
    if op in ("=", "!=", "<", "<=", ">", ">="):
        for a, b in (args, args[::-1]):
            if isinstance(a, Call) and a.name in (*TRUNCATIONS, "week") and isinstance(b, Lit) and b.kind == "number":
                raise PlanProblem(f"{a.name}() is the start of a period, not a number; compare a date, or use extract()")
    parts = [render(a, c) for a in args]
    if op == "not":
        return f"(NOT {parts[0]})"
    if op == "neg":
        return f"(- {parts[0]})"
    if op == "/":
        return f"try_divide({parts[0]}, {parts[1]})"
    return f"({parts[0]} {op.upper()} {parts[1]})"


def nested(n: Sub, c: Context) -> str:
    if not c.subquery:
        raise PlanProblem("a nested query is not possible here")
    return c.subquery(n.query)


def part(n: Slice, c: Context) -> str:
    x, a, b = render(n.expr, c), n.start, n.stop
    if isinstance(a, Op) and a.op == "neg" and b is None:
        return f"right({x}, {render(a.args[0], c)})"
    if a is None:
        return f"left({x}, {render(b, c)})" if b is not None else x
    if b is None:
        return f"substring({x}, {render(a, c)})"
    if isinstance(a, Lit) and isinstance(b, Lit) and a.value.isdigit() and b.value.isdigit():
        return f"substring({x}, {a.value}, {max(0, int(b.value) - int(a.value) + 1)})"
    return f"substring({x}, {render(a, c)}, {render(b, c)} - {render(a, c)} + 1)"


def window(over: Over, c: Context, frame: str = "", inherit: bool = False, what: str = "") -> str:
    order = over.order
    if not order and inherit:
        order = c.order
        if not order:
            raise PlanProblem(f"{what}() needs an order: give it one with over, or order the query")
    bits = []
    if over.partition:
        bits.append("PARTITION BY " + ", ".join(render(p, c) for p in over.partition))
    if order:
        if any(has_frame_call(o.expr) for o in order):
            raise PlanProblem("an order can't depend on the window that it orders")
        bits.append("ORDER BY " + ", ".join(sort_text(o, c) for o in order))
    if over.frame or frame:
        bits.append((over.frame or frame).upper())
    return f"OVER ({' '.join(bits)})"


def has_frame_call(n: Node) -> bool:
    return any(isinstance(x, Call) and x.name in ORDER_MATTERS for x in n.walk())


def call(n: Call, c: Context) -> str:
    name = n.name
    args = [render(a, c) for a in n.args]
    over = n.over or Over()
    head, _, tail = name.partition("_")
    if head in ("running", "rolling") and tail in RUNNING:
        return framed(n, head, RUNNING[tail], args, over, c)
    if name in ("fill_forward", "fill_backward"):
        forward = name == "fill_forward"
        frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW" if forward else "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
        return f"{'last' if forward else 'first'}({args[0]}, true) {window(over, c, frame, True, name)}"
    if name in ("prior", "next", "lag", "lead"):
        f = {"prior": "lag", "next": "lead"}.get(name, name)
        return f"{f}({', '.join(args)}) {window(over, c, '', True, name)}"
    if name in ("first", "last") and (n.order or c.block or n.over):
        return edge(n, args, over, c)
    if name in ("arg_max", "arg_min") and not c.block:
        o = replace(over, order=(Ordered(n.args[1], name == "arg_max"),))
        return f"first_value({args[0]}) {window(o, c, 'ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING')}"
    if name in RANKS:
        return f"{name}({', '.join(args)}) {window(over, c, '', name in ORDER_MATTERS, name)}"
    if n.over is not None and (n.distinct or name == "uniq") and name in ("count", "uniq"):
        return distinct_over(n, args[0], over, c)
    out = plain(n, name, args, c)
    if n.where is not None:
        out += f" FILTER (WHERE {render(n.where, c)})"
    if n.over is not None:
        out += " " + window(over, c)
    return out


def distinct_over(n: Call, x: str, over: Over, c: Context) -> str:
    """Distinct values of a window, which Spark has not: the ranks from both ends add up to them."""
    if n.where is not None:
        x = f"CASE WHEN {render(n.where, c)} THEN {x} END"
    if over.order or over.frame:
        return f"CAST(size(collect_set({x}) {window(over, c)}) AS BIGINT)"
    by = f"PARTITION BY {', '.join(render(p, c) for p in over.partition)} " if over.partition else ""
    ends = " + ".join(f"dense_rank() OVER ({by}ORDER BY {x} {way})" for way in ("ASC", "DESC"))
    nulls = f"max(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END) OVER ({by.strip()})"
    return f"CAST({ends} - 1 - {nulls} AS BIGINT)"


def framed(n: Call, head: str, f: str, args: list[str], over: Over, c: Context) -> str:
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    if head == "rolling" and len(n.args) > 1 and isinstance(n.args[1], Lit) and str(n.args[1].value).isdigit():
        frame = f"ROWS BETWEEN {int(n.args[1].value) - 1} PRECEDING AND CURRENT ROW"
    out = f"{f}({args[0] if args else '*'}) {window(over, c, frame, True, n.name)}"
    return f"coalesce({out}, 0)" if f == "sum" else out


def edge(n: Call, args: list[str], over: Over, c: Context) -> str:
    """first(x order by k) and last: an aggregate in a block, a window elsewhere."""
    if c.block and n.over is None:
        if len(n.order) != 1:
            if not n.order:
                return f"{n.name}({args[0]})"
            keys = ", ".join(render(o.expr, c) for o in n.order)
            if len({o.desc for o in n.order}) > 1:
                raise PlanProblem("first() with both directions in its order has no aggregate form")
            return f"{'max_by' if n.order[0].desc == (n.name == 'first') else 'min_by'}({args[0]}, struct({keys}))"
        o = n.order[0]
        return f"{'max_by' if o.desc == (n.name == 'first') else 'min_by'}({args[0]}, {render(o.expr, c)})"
    order = n.order
    if n.name == "last":
        order = tuple(replace(o, desc=not o.desc) for o in order)
    o = replace(over, order=order or over.order)
    return f"first_value({args[0]}) {window(o, c, 'ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING', True, n.name)}"


def plain(n: Call, name: str, args: list[str], c: Context) -> str:
    if name == "uniq":
        return f"count(DISTINCT {args[0]})"
    if name in ("count", "count_entity"):
        return f"count({'DISTINCT ' if n.distinct else ''}{', '.join(args) or '*'})"
    if name == "week":
        return truncated("week", args[0], c.week_start)
    if name in ("now", "current_timestamp"):
        if args:
            raise SyntaxProblem("now() takes no arguments")
        return "current_date()" if c.relative == "date" else "localtimestamp()"
    if name == "current_date":
        return "current_date()"
    head, _, tail = name.partition("_")
    if tail in ("since", "until") and head.endswith("s"):
        now = "current_date()" if c.relative == "date" else "localtimestamp()"
        return difference(head[:-1], *((args[0], now) if tail == "since" else (now, args[0])))
    if name in ("date_diff", "datediff", "datesub") and len(args) == 3:
        unit = n.args[0].value if isinstance(n.args[0], Lit) else n.args[0].name  # type: ignore[attr-defined]
        return difference(unit.lower(), args[1], args[2])
    if name == "days" and len(n.args) == 1:
        x = n.args[0]
        if isinstance(x, Op) and x.op == "-":
            return difference("day", render(x.args[1], c), render(x.args[0], c))
    if name == "date_part":
        p = n.args[0].value.lower()  # type: ignore[attr-defined]
        return NUMERIC_PARTS["day_of_week"].format(args[1]) if p in ("dow", "dayofweek") else f"extract({p} FROM {args[1]})"
    if name == "date_trunc" and isinstance(n.args[0], Lit):
        return truncated(n.args[0].value.lower(), args[1], c.week_start)
    if name == "bucket":
        return bucket(n, args, c)
    if name == "string_agg":
        inner = f"listagg({'DISTINCT ' if n.distinct else ''}{args[0]}, {args[1] if len(args) > 1 else text(',')})"
        return inner + (f" WITHIN GROUP (ORDER BY {', '.join(sort_text(o, c) for o in n.order)})" if n.order else "")
    if name == "explode_outer" or name not in SCALARS:
        name = AGGREGATE_NAMES.get(name, name)
        star = ", ".join(args)
        return f"{name}({'DISTINCT ' if n.distinct else ''}{star})"
    return SCALARS[name](*args)


def number_of(n: Node) -> float | int:
    if isinstance(n, Op) and n.op == "neg":
        return -number_of(n.args[0])
    if isinstance(n, Lit) and n.kind == "number":
        return float(n.value) if any(ch in n.value for ch in ".eE") else int(n.value)
    raise PlanProblem("bucket() bounds are numbers")


def bucket(n: Call, args: list[str], c: Context) -> str:
    """Left-inclusive bins, the last one closed; anything outside is null."""
    options = dict(n.options)
    if options:
        lo, hi, width = (number_of(options[k]) for k in ("start", "end", "width"))
        if width <= 0 or hi <= lo:
            raise PlanProblem("bucket() needs start < end and a width over 0")
        bounds = [lo]
        while bounds[-1] + width < hi:
            bounds.append(bounds[-1] + width)
        bounds.append(hi)
    elif len(n.args) > 1 and isinstance(n.args[1], Array):
        bounds = [number_of(x) for x in n.args[1].items]
    else:
        raise PlanProblem("bucket() needs a list of bounds, or start, end and width")
    if len(bounds) < 2 or any(b <= a for a, b in zip(bounds, bounds[1:])):
        raise PlanProblem("bucket() bounds must rise")
    bins = list(zip(bounds, bounds[1:]))
    labels = [text(f"{a}-{b}") for a, b in bins]
    if len(n.args) > 2 and isinstance(n.args[2], Array):
        labels = [render(x, c) for x in n.args[2].items]
        if len(labels) != len(bins):
            raise PlanProblem("bucket() needs a label for each bin")
    whens = [f"WHEN {args[0]} >= {a} AND {args[0]} {'<=' if k == len(bins) - 1 else '<'} {b} THEN {labels[k]}" for k, (a, b) in enumerate(bins)]
    return f"CASE {' '.join(whens)} END"
