"""Syntax tree: expressions and pipeline steps, all immutable and comparable."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Node:
    def children(self) -> Iterator[Node]:
        for f in fields(self):
            yield from _inside(getattr(self, f.name))

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()

    def rewrite(self, f: Callable[[Node], Node | None]) -> Node:
        """Top-down: where ``f`` gives a node, that takes the place of the old one."""
        new = f(self)
        if new is not None:
            return new
        return replace(self, **{x.name: _mapped(getattr(self, x.name), f) for x in fields(self)})


def _inside(value: Any) -> Iterator[Node]:
    if isinstance(value, Node):
        yield value
    elif isinstance(value, tuple):
        for v in value:
            yield from _inside(v)


def _mapped(value: Any, f: Callable) -> Any:
    if isinstance(value, Node):
        return value.rewrite(f)
    if isinstance(value, tuple):
        return tuple(_mapped(v, f) for v in value)
    return value


@dataclass(frozen=True)
class Col(Node):
    parts: tuple[str, ...]

    @property
    def name(self) -> str:
        return self.parts[-1]


@dataclass(frozen=True)
class Star(Node):
    table: str | None = None


@dataclass(frozen=True)
class Lit(Node):
    value: Any
    kind: str = "string"  # string, number, bool, null, date, timestamp


@dataclass(frozen=True)
class Ordered(Node):
    expr: Node
    desc: bool = False
    nulls: str = ""


@dataclass(frozen=True)
class Over(Node):
    partition: tuple[Node, ...] = ()
    order: tuple[Ordered, ...] = ()
    frame: str = ""
    name: str = ""


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...] = ()
    distinct: bool = False
    where: Node | None = None
    order: tuple[Ordered, ...] = ()
    over: Over | None = None
    options: tuple[tuple[str, Node], ...] = ()
    ignore_nulls: bool = False


@dataclass(frozen=True)
class Op(Node):
    op: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Case(Node):
    whens: tuple[tuple[Node, Node], ...]
    default: Node | None = None


@dataclass(frozen=True)
class Cast(Node):
    expr: Node
    type: str
    safe: bool = False


@dataclass(frozen=True)
class AtZone(Node):
    expr: Node
    zone: str


@dataclass(frozen=True)
class In(Node):
    expr: Node
    items: tuple[Node, ...]
    negated: bool = False


@dataclass(frozen=True)
class Between(Node):
    expr: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass(frozen=True)
class IsNull(Node):
    expr: Node
    negated: bool = False


@dataclass(frozen=True)
class Interval(Node):
    amount: Node
    unit: str


@dataclass(frozen=True)
class Sub(Node):
    """A nested query as a value, a list of values, or under EXISTS."""

    query: Query


@dataclass(frozen=True)
class Exists(Node):
    query: Query


@dataclass(frozen=True)
class Array(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Comprehension(Node):
    body: Node
    name: str
    source: Node
    condition: Node | None = None


@dataclass(frozen=True)
class Slice(Node):
    expr: Node
    start: Node | None
    stop: Node | None


@dataclass(frozen=True)
class Item(Node):
    """An expression with an optional output name."""

    expr: Node
    alias: str | None = None


@dataclass(frozen=True)
class Step(Node):
    pass


@dataclass(frozen=True)
class Source(Node):
    """A table, or a query in parentheses, with its name in the query."""

    table: str | None
    query: Query | None
    alias: str


@dataclass(frozen=True)
class From(Step):
    source: Source


@dataclass(frozen=True)
class Where(Step):
    condition: Node


@dataclass(frozen=True)
class Having(Step):
    condition: Node


@dataclass(frozen=True)
class Qualify(Step):
    condition: Node


@dataclass(frozen=True)
class Select(Step):
    items: tuple[Item, ...]
    distinct: bool = False


@dataclass(frozen=True)
class Extend(Step):
    items: tuple[Item, ...]


@dataclass(frozen=True)
class Join(Step):
    kind: str
    source: Source
    on: Node | None = None
    on_column: str | None = None
    using: tuple[str, ...] = ()


@dataclass(frozen=True)
class Group(Step):
    keys: tuple[Item, ...]
    aggs: tuple[Item, ...] | None = None
    spined: tuple[bool, ...] = ()
    mode: str = ""  # rollup, cube, sets
    sets: tuple[tuple[Node, ...], ...] = ()


@dataclass(frozen=True)
class OrderBy(Step):
    items: tuple[Ordered, ...]


@dataclass(frozen=True)
class Limit(Step):
    count: int


@dataclass(frozen=True)
class Offset(Step):
    count: int


@dataclass(frozen=True)
class Distinct(Step):
    on: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Drop(Step):
    columns: tuple[Col, ...]


@dataclass(frozen=True)
class Rename(Step):
    pairs: tuple[tuple[Col, str], ...]


@dataclass(frozen=True)
class Replace(Step):
    pairs: tuple[tuple[Col, Node], ...]


@dataclass(frozen=True)
class Rank(Step):
    """number / rank / dense_rank / first / last by an order, per keys or over everything."""

    how: str
    keys: tuple[Node, ...]
    order: tuple[Ordered, ...]
    alias: str | None = None


@dataclass(frozen=True)
class Sample(Step):
    amount: float
    percent: bool = False
    per: Node | None = None


@dataclass(frozen=True)
class Pivot(Step):
    agg: Node
    column: Node
    values: tuple[Item, ...] | None = None
    keys: tuple[Node, ...] | None = None


@dataclass(frozen=True)
class Unpivot(Step):
    columns: tuple[str, ...]
    name: str
    value: str


@dataclass(frozen=True)
class Explode(Step):
    expr: Node
    alias: str


@dataclass(frozen=True)
class Recurse(Step):
    key: str
    depth: int = 100


@dataclass(frozen=True)
class Stash(Step):
    name: str


@dataclass(frozen=True)
class SetOp(Step):
    kind: str  # union, intersect, except
    query: Query
    all: bool = False
    by_name: bool = False
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Query(Node):
    """Pipelines in a row; each ends in a stash but the last, whose rows are the result."""

    pipelines: tuple[tuple[Step, ...], ...]


@dataclass(frozen=True)
class Setting(Node):
    name: str
    value: Any
