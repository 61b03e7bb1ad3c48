"""Functions of the language as Spark SQL text.

``SCALARS`` maps a name to a function of the rendered arguments.  Names that are not here go to Spark's own
function registry, so registered UDFs work as well.
"""

from __future__ import annotations

from collections.abc import Callable

from ..errors import SyntaxProblem

TRUNCATIONS = ("year", "quarter", "month", "day", "hour", "minute", "second")
NUMERIC_PARTS = {
    "day_of_week": "(dayofweek({0}) - 1)",  # 0 is Sunday
    "day_of_month": "dayofmonth({0})",
    "day_of_year": "dayofyear({0})",
    "week_of_year": "weekofyear({0})",
    "month_of_year": "month({0})",
    "quarter_of_year": "quarter({0})",
}


def truncated(unit: str, x: str, week_start: str = "monday") -> str:
    """Start of the period, as a timestamp without zone."""
    if unit == "week" and week_start == "sunday" or unit == "week_sunday":
        return f"(CAST(date_trunc('WEEK', {x} + INTERVAL '1' DAY) AS TIMESTAMP_NTZ) - INTERVAL '1' DAY)"
    return f"CAST(date_trunc('{unit.removesuffix('_monday').upper()}', {x}) AS TIMESTAMP_NTZ)"


def difference(unit: str, a: str, b: str) -> str:
    """Boundaries of the unit between a and b; for weeks, whole sevens of days."""
    if unit == "year":
        return f"(year({b}) - year({a}))"
    if unit in ("month", "quarter"):
        per = 12 if unit == "month" else 4
        return f"((year({b}) - year({a})) * {per} + {unit}({b}) - {unit}({a}))"
    if unit == "day":
        return f"datediff(CAST({b} AS DATE), CAST({a} AS DATE))"
    if unit == "week":
        return f"(datediff(CAST({b} AS DATE), CAST({a} AS DATE)) DIV 7)"
    if unit in ("hour", "minute", "second"):
        return f"timestampdiff({unit.upper()}, {truncated(unit, a)}, {truncated(unit, b)})"
    raise SyntaxProblem(f"unknown unit {unit}")


def interval(amount: str, unit: str) -> str:
    months = {"month": 1, "quarter": 3, "year": 12}
    if unit in months:
        return f"make_ym_interval(0, CAST({amount} AS INT) * {months[unit]})" if months[unit] > 1 else f"make_ym_interval(0, CAST({amount} AS INT))"
    place = {"week": 0, "day": 0, "hour": 1, "minute": 2, "second": 3}[unit]
    parts = ["0", "0", "0", "0"]
    parts[place] = f"CAST({amount} AS INT)" + (" * 7" if unit == "week" else "") if unit != "second" else f"CAST({amount} AS DECIMAL(18,6))"
    return f"make_dt_interval({', '.join(parts)})"


def _slug(x: str) -> str:
    return f"trim(BOTH '-' FROM regexp_replace(lower({x}), '[^a-z0-9]+', '-'))"


def _key(*xs: str) -> str:
    return "md5(concat_ws('||', " + ", ".join(f"coalesce(CAST({x} AS STRING), '')" for x in xs) + "))"


SCALARS: dict[str, Callable[..., str]] = {
    **{u: (lambda x, u=u: truncated(u, x)) for u in TRUNCATIONS},
    "week_monday": lambda x: truncated("week_monday", x),
    "week_sunday": lambda x: truncated("week_sunday", x),
    **{k: v.format for k, v in NUMERIC_PARTS.items()},
    "slugify": _slug,
    "key": _key,
    "concat": lambda *xs: f"concat_ws('', {', '.join(f'CAST({x} AS STRING)' for x in xs)})",
    "array_length": lambda x: f"size({x})",
    "list_length": lambda x: f"size({x})",
    "len": lambda x: f"length({x})",
    "strpos": lambda s, x: f"locate({x}, {s})",
    "safe_divide": lambda a, b: f"try_divide({a}, {b})",
    "ifnull": lambda a, b: f"coalesce({a}, {b})",
    "split": lambda s, d: rf"split({s}, concat('\\Q', {d}, '\\E'))",
    "unnest": lambda x: f"explode({x})",
}
AGGREGATE_NAMES = {
    "total": "sum",
    "average": "avg",
    "minimum": "min",
    "maximum": "max",
    "array_agg": "collect_list",
    "arg_max": "max_by",
    "arg_min": "min_by",
    "argmax": "max_by",
    "argmin": "min_by",
}
RUNNING = {"sum": "sum", "total": "sum", "avg": "avg", "average": "avg", "count": "count", "min": "min", "minimum": "min", "max": "max", "maximum": "max"}
TYPES = {
    "numeric": "DECIMAL(18,3)",
    "decimal": "DECIMAL(18,3)",
    "text": "STRING",
    "varchar": "STRING",
    "string": "STRING",
    "char": "STRING",
    "integer": "INT",
    "int4": "INT",
    "int8": "BIGINT",
    "float8": "DOUBLE",
    "real": "FLOAT",
    "bool": "BOOLEAN",
    "timestamp": "TIMESTAMP_NTZ",
    "datetime": "TIMESTAMP_NTZ",
    "timestamptz": "TIMESTAMP",
}
