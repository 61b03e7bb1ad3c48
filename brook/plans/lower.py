"""Steps of a pipeline, one after the other, on DataFrames.

Each step works on the rows of the step before, so what closes a stage in SQL needs nothing here.  Only a
few steps are looked at together: a bare ``group by`` waits for its ``select``; windows without an order take
that of the query; ``having`` and ``order by`` may use aggregates that the block does not return.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import Catalog, Settings
from ..errors import PlanProblem, ResolutionProblem
from ..lang.nodes import (
    Call, Col, Distinct, Drop, Explode, Extend, From, Group, Having, Item, Join, Limit, Lit, Node, Offset, Op, OrderBy, Ordered, Pivot, Qualify, Query,
    Rank, Recurse, Rename, Replace, Sample, Select, SetOp, Source, Star, Stash, Step, Unpivot, Where,
)
from ..lang.parser import has_aggregate
from ..lang.render import Context, is_frame_function, quoted, render, sort_text
from .naming import named


@dataclass
class Stage:
    """Rows so far, with what is known about their columns."""

    df: DataFrame
    tables: dict[str, str] = field(default_factory=dict)  # alias -> table
    columns: dict[str, list[str]] = field(default_factory=dict)  # alias -> columns
    order: tuple[Ordered, ...] = ()
    conditions: tuple[Node, ...] = ()  # filters on the rows of this stage
    pending: Group | None = None
    grouped: tuple[DataFrame, list[tuple[Node, str]], list[tuple[Node, str]]] | None = None  # input with keys, keys, aggregates
    kept: tuple[Node, ...] = ()  # filters on the groups so far
    spine: tuple = ()  # which keys of the groups are filled, and the filters that bound them

    def then(self, df: DataFrame, **changes) -> Stage:
        return replace(self, df=df, **{"grouped": None, **changes})

    def closed(self, df: DataFrame, **changes) -> Stage:
        """A new table without a past."""
        return Stage(df, order=changes.pop("order", ()), **changes)


class Lowering:
    def __init__(self, spark: SparkSession, catalog: Catalog, settings: Settings, tables: Mapping[str, DataFrame] | None = None):
        self.spark, self.catalog, self.settings = spark, catalog, settings
        self.given = tables or {}
        self.tables = {k.lower(): k for k in self.given}
        self.stashed: dict[str, DataFrame] = {}
        self.views: list[str] = []

    # tables -----------------------------------------------------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        low = name.lower()
        if low in self.stashed:
            return self.stashed[low]
        if low in self.tables:
            df = self.given[self.tables[low]]
        elif self.spark.catalog.tableExists(name):
            df = self.spark.table(name)
        else:
            raise ResolutionProblem(f"no table {name}")
        self.catalog.see(low, df.columns)
        return df

    def source(self, s: Source, fraction: float | None = None) -> tuple[DataFrame, str]:
        df = self.table(s.table) if s.table else self.query(s.query)
        if fraction is not None:
            df = df.sample(fraction)
        return df.alias(s.alias), (s.table or s.alias).lower()

    def view(self, df: DataFrame) -> str:
        name = f"brook_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(name)
        self.views.append(name)
        return name

    # rendering --------------------------------------------------------------------------------------------------
    def context(self, s: Stage, **options) -> Context:
        return Context(
            aliases=frozenset(a.lower() for a in s.columns),
            columns=frozenset(c.lower() for c in s.df.columns),
            order=options.pop("order", s.order),
            week_start=self.settings.week_start,
            relative=self.settings.relative_date_type,
            subquery=self.nested,
            exists=self.nested,
            **options,
        )

    def nested(self, q: Query) -> str:
        """A nested query as SQL: written out where it is plain (it may then look at the outer row), else as a view."""
        if len(q.pipelines) == 1 and all(isinstance(x, (From, Where, Select)) for x in q.pipelines[0]):
            steps = q.pipelines[0]
            first = steps[0]
            if isinstance(first, From) and first.source.table and [type(x) for x in steps].count(Select) <= 1 and isinstance(steps[-1], (Select, Where, From)):
                df = self.table(first.source.table)
                alias = first.source.alias
                c = Context(aliases=frozenset({alias.lower(), *self._outer}), columns=frozenset(x.lower() for x in df.columns), week_start=self.settings.week_start, subquery=self.nested, exists=self.nested)
                where = [render(x.condition, c) for x in steps if isinstance(x, Where)]
                chosen = next((x for x in steps if isinstance(x, Select)), None)
                items = ", ".join(render(i.expr, c) + (f" AS {quoted(i.alias)}" if i.alias else "") for i in chosen.items) if chosen else "*"
                return f"SELECT {'DISTINCT ' if chosen and chosen.distinct else ''}{items} FROM {self.view(df)} AS {quoted(alias)}" + (f" WHERE {' AND '.join(where)}" if where else "")
        return f"SELECT * FROM {self.view(self.query(q))}"

    _outer: tuple[str, ...] = ()

    def text(self, n: Node, s: Stage, **options) -> str:
        self._outer = tuple(a.lower() for a in s.columns)
        return render(self.entities(n, s), self.context(s, **options))

    def col(self, n: Node, s: Stage, **options) -> Column:
        return F.expr(self.text(n, s, **options))

    def sorts(self, order: tuple[Ordered, ...], s: Stage) -> list[Column]:
        return [self.sort(o, s) for o in order]

    def sort(self, o: Ordered, s: Stage) -> Column:
        c = self.col(o.expr, s)
        last = (o.nulls or ("last" if o.desc else "first")) == "last"
        if o.desc:
            return c.desc_nulls_last() if last else c.desc_nulls_first()
        return c.asc_nulls_last() if last else c.asc_nulls_first()

    def entities(self, n: Node, s: Stage) -> Node:
        """# users: distinct keys of a table of the query, else values of a column."""

        def f(x: Node) -> Node | None:
            if not (isinstance(x, Call) and x.name == "count_entity"):
                return self.natural(x, s)
            name = x.args[0].name.lower()  # type: ignore[attr-defined]
            if name in {c.lower() for c in s.df.columns}:
                return replace(x, name="count")
            for alias, table in s.tables.items():
                if name in (alias.lower(), table) or self.catalog.find(name) == table:
                    t = self.catalog.table(table)
                    key = t.key() if t else None
                    if not key:
                        raise ResolutionProblem(f"# {name}: no key is known for {table}")
                    return Call("count", (Col((alias, key)),), True)
            raise ResolutionProblem(f"# {name}: neither a column nor a table of this query")

        return n.rewrite(f)

    def natural(self, x: Node, s: Stage) -> Node | None:
        """sum_amount and days_since_created_at, where no column has that name."""
        if not isinstance(x, Col) or len(x.parts) > 1:
            return None
        low, names = x.name.lower(), {c.lower() for c in s.df.columns}
        if low in names or low in {a for a, _ in self.output_names(s)}:
            return None
        head, _, tail = low.partition("_")
        if head in ("sum", "avg", "min", "max", "count", "total", "average") and tail in names:
            return Call(head, (Col((tail,)),))
        for word in ("since", "until"):
            unit, sep, column = low.partition(f"_{word}_")
            if sep and column in names and unit in ("seconds", "minutes", "hours", "days", "weeks", "months", "years"):
                return Call(f"{unit}_{word}", (Col((column,)),))
        return None

    def output_names(self, s: Stage) -> list[tuple[str, Node]]:
        return [(name.lower(), n) for n, name in ((s.grouped[1] + s.grouped[2]) if s.grouped else [])]

    # queries ----------------------------------------------------------------------------------------------------
    def rows(self, q: Query) -> DataFrame:
        """The rows of a statement.  Its plan is analysed by then, so the views that nested queries went through can go."""
        try:
            return self.query(q)
        finally:
            for name in self.views:
                self.spark.catalog.dropTempView(name)
            self.views.clear()

    def query(self, q: Query) -> DataFrame:
        out: DataFrame | None = None
        kept = dict(self.stashed)
        for steps in q.pipelines:
            out = self.pipeline(steps)
        self.stashed = kept | {k: v for k, v in self.stashed.items() if k not in kept}
        assert out is not None
        return out

    def pipeline(self, steps: tuple[Step, ...]) -> DataFrame:
        from . import fanout, semantic

        steps = semantic.rewrite(self, steps)
        share = [x.amount / 100 for x in steps if isinstance(x, Sample) and x.percent]
        first = steps[0]
        if not isinstance(first, From):
            raise PlanProblem("a query begins with from")
        df, table = self.source(first.source, share[0] if share else None)
        alias = first.source.alias
        s = Stage(df, {alias: table}, {alias: df.columns})
        k = 1
        while k < len(steps):
            step = steps[k]
            if isinstance(step, Join) and k == self.first_join(steps):
                found = fanout.protect(self, s, steps, k)
                if found is not None:
                    s, k = found
                    continue
            ahead = steps[k + 1] if k + 1 < len(steps) else None
            if isinstance(step, (Select, Extend)) and isinstance(ahead, OrderBy) and not s.order:
                s = replace(s, order=self.before_select(ahead.items, step))
            s = self.step(s, step, steps[:k])
            k += 1
        if s.pending:
            raise PlanProblem("group by without aggregates needs a select after it")
        return s.df

    @staticmethod
    def first_join(steps: tuple[Step, ...]) -> int:
        return next(k for k, x in enumerate(steps) if isinstance(x, Join))

    @staticmethod
    def before_select(order: tuple[Ordered, ...], step: Select | Extend) -> tuple[Ordered, ...]:
        """An order that names outputs, in terms of what they are made of (as far as no window is in it)."""
        made = {i.alias.lower(): i.expr for i in step.items if i.alias}
        out = [replace(o, expr=made.get(o.expr.name.lower(), o.expr)) if isinstance(o.expr, Col) and len(o.expr.parts) == 1 else o for o in order]
        return tuple(o for o in out if not any(is_frame_function(x) for x in o.expr.walk()))

    def step(self, s: Stage, step: Step, before: tuple[Step, ...]) -> Stage:
        if s.pending and not isinstance(step, (Select, Having)):
            raise PlanProblem("group by without aggregates needs a select after it")
        return getattr(self, "do_" + type(step).__name__.lower())(s, step, before) if isinstance(step, Recurse) else getattr(self, "do_" + type(step).__name__.lower())(s, step)

    def do_where(self, s: Stage, step: Where) -> Stage:
        if s.grouped and has_aggregate(step.condition):
            return self.do_having(s, Having(step.condition))
        from .spine import conjuncts

        condition = self.known(step.condition, s)
        return replace(s, df=s.df.filter(self.col(condition, s)), conditions=(*s.conditions, *conjuncts(condition)), kept=(*s.kept, condition) if s.grouped else ())

    def known(self, n: Node, s: Stage) -> Node:
        """Keys and aggregates of the last block, written again, stand for their outputs."""
        if not s.grouped:
            return n
        outputs = {x: Col((name,)) for x, name in s.grouped[1] + s.grouped[2]}
        return n.rewrite(lambda x: outputs.get(x) or (Col((x.name,)) if isinstance(x, Col) and len(x.parts) > 1 and x.name.lower() in {c.lower() for c in s.df.columns} else None))

    def with_hidden(self, s: Stage, nodes: list[Node]) -> tuple[Stage, list[Node]]:
        """Aggregates that the block did not return, as extra columns that later go."""
        if not s.grouped:
            return s, nodes
        nodes = [self.known(n, s) for n in nodes]
        extra: list[tuple[Node, str]] = []

        def f(x: Node) -> Node | None:
            if isinstance(x, Call) and has_aggregate(x) and not any(has_aggregate(a) for a in x.args):
                name = next((m for y, m in extra if y == x), None) or f"__hidden{len(extra)}"
                if all(y != x for y, _ in extra):
                    extra.append((x, name))
                return Col((name,))
            return None

        nodes = [n.rewrite(f) for n in nodes]
        if not extra:
            return s, nodes
        # the groups are made again with these and with what their filters need, and filtered again
        filters = [self.known(n, s).rewrite(f) for n in s.kept]
        source, keys, aggs = s.grouped
        t = replace(s, df=self.aggregate(s, source, keys, aggs + extra))
        for n in filters:
            t = replace(t, df=t.df.filter(self.col(n, t)))
        return t, nodes

    def do_having(self, s: Stage, step: Having) -> Stage:
        if s.pending:
            raise PlanProblem("having comes after the aggregates")
        names = s.df.columns
        t, (condition,) = self.with_hidden(s, [step.condition])
        df = t.df.filter(self.col(condition, t))
        return replace(s, df=df.select(*[quoted(c) for c in names]) if t is not s else df, kept=(*s.kept, step.condition))

    def do_qualify(self, s: Stage, step: Qualify) -> Stage:
        name = "__qualify"
        df = s.df.withColumn(name, self.col(step.condition, s))
        return s.then(df.filter(F.col(name)).drop(name))

    # projection -------------------------------------------------------------------------------------------------
    def expanded(self, items: tuple[Item, ...], s: Stage) -> list[tuple[Node, str]]:
        """Items with names; a star becomes columns, without those that an alias of the same select replaces."""
        given = {i.alias.lower() for i in items if i.alias}
        out: list[tuple[Node, str]] = []
        for k, i in enumerate(items):
            if isinstance(i.expr, Star):
                aliases = [i.expr.table] if i.expr.table else list(s.columns) or [None]
                if i.expr.table and i.expr.table not in s.columns:
                    raise ResolutionProblem(f"no table {i.expr.table} in this query")
                if not s.columns:
                    out += [(Col((c,)), c) for c in s.df.columns if c.lower() not in given]
                for a in aliases:
                    if a is not None:
                        out += [(Col((a, c)) if len(s.columns) > 1 else Col((c,)), c) for c in s.columns[a] if c.lower() not in given]
            else:
                out.append((i.expr, named(i, self.settings, k)))
        return out

    def do_select(self, s: Stage, step: Select) -> Stage:
        if s.pending:
            return self.grouped_select(s, step)
        pairs = self.expanded(step.items, s)
        if any(has_aggregate(self.entities(n, s)) for n, _ in pairs):
            df = s.df.agg(*[F.expr(self.text(n, s, block=True)).alias(name) for n, name in pairs])
            return s.closed(df)
        df = self.project(s, pairs)
        return s.closed(df.distinct() if step.distinct else df, order=self.kept_order(s, pairs))

    @staticmethod
    def kept_order(s: Stage, pairs: list[tuple[Node, str]]) -> tuple[Ordered, ...]:
        names = {n: name for n, name in pairs}
        out = []
        for o in s.order:
            hit = names.get(o.expr) or next((name for n, name in pairs if isinstance(n, Col) and isinstance(o.expr, Col) and n.name == o.expr.name), None)
            if hit is None:
                return ()
            out.append(replace(o, expr=Col((hit,))))
        return tuple(out)

    def project(self, s: Stage, pairs: list[tuple[Node, str]]) -> DataFrame:
        """Aliases may be used by later items of the same select (a source column of that name wins)."""
        return s.df.select(*[self.col(n, s).alias(name) for n, name in self.inlined(pairs, s)])

    def inlined(self, pairs: list[tuple[Node, str]], s: Stage) -> list[tuple[Node, str]]:
        have, made, out = {c.lower() for c in s.df.columns}, {}, []
        for n, name in pairs:
            n = n.rewrite(lambda x: made.get(x.name.lower()) if isinstance(x, Col) and len(x.parts) == 1 and x.name.lower() not in have else None)
            out.append((n, name))
            made[name.lower()] = n
        return out

    def do_extend(self, s: Stage, step: Extend) -> Stage:
        pairs = self.inlined([(i.expr, named(i, self.settings, k)) for k, i in enumerate(step.items)], s)
        stars = self.all_columns(s)
        return s.closed(s.df.select(*stars, *[self.col(n, s).alias(name) for n, name in pairs]), order=s.order)

    def all_columns(self, s: Stage, without: set[tuple[str | None, str]] = frozenset()) -> list[Column]:
        if len(s.columns) > 1:
            return [F.col(f"{quoted(a)}.{quoted(c)}") for a, cs in s.columns.items() for c in cs if (a.lower(), c.lower()) not in without]
        return [F.col(quoted(c)) for c in s.df.columns if (None, c.lower()) not in without]

    def where_of(self, c: Col, s: Stage) -> tuple[str | None, str]:
        if len(s.columns) > 1:
            if len(c.parts) < 2:
                raise PlanProblem(f"say which table {c.name} belongs to: several are joined")
            return c.parts[0].lower(), c.name.lower()
        if c.name.lower() not in {x.lower() for x in s.df.columns}:
            raise ResolutionProblem(f"no column {c.name}")
        return None, c.name.lower()

    def do_drop(self, s: Stage, step: Drop) -> Stage:
        gone = {self.where_of(c, s) for c in step.columns}
        return s.closed(s.df.select(*self.all_columns(s, gone)), order=s.order)

    def do_rename(self, s: Stage, step: Rename) -> Stage:
        gone = {self.where_of(c, s) for c, _ in step.pairs}
        new = [self.col(c, s).alias(name) for c, name in step.pairs]
        return s.closed(s.df.select(*self.all_columns(s, gone), *new))

    def do_replace(self, s: Stage, step: Replace) -> Stage:
        gone = {self.where_of(c, s) for c, _ in step.pairs}
        new = [self.col(e, s).alias(c.name) for c, e in step.pairs]
        return s.closed(s.df.select(*self.all_columns(s, gone), *new))

    def do_distinct(self, s: Stage, step: Distinct) -> Stage:
        if not step.on:
            return s.then(s.df.distinct())
        return self.pick(s, "row_number", step.on, s.order, "__first", keep=1)

    # joins ------------------------------------------------------------------------------------------------------
    def join_condition(self, s: Stage, step: Join, right: str) -> Node | None:
        if step.kind == "cross" or step.on is not None:
            return step.on
        alias = step.source.alias
        if step.using:
            out: Node | None = None
            for c in step.using:
                left = next((a for a, cols in s.columns.items() if c.lower() in {x.lower() for x in cols}), None)
                if left is None:
                    raise ResolutionProblem(f"no column {c} to join on")
                one = Op("=", (Col((left, c)), Col((alias, c))))
                out = one if out is None else Op("and", (out, one))
            return out
        if step.on_column:
            c, t = step.on_column, self.catalog.table(right)
            key = (t and t.key()) or "id"
            if t and key not in t.columns and c.lower() in t.columns:
                key = c
            left = next((a for a, cols in reversed(s.columns.items()) if c.lower() in {x.lower() for x in cols}), None)
            if left is None:
                raise ResolutionProblem(f"no column {c} to join on")
            return Op("=", (Col((left, c)), Col((alias, key))))
        left = list(s.tables)[-1]  # the table joined last
        r = self.catalog.infer_join(s.tables[left], right, self.settings.infer_join_keys)
        if r.table == s.tables[left]:
            return Op("=", (Col((left, r.column)), Col((alias, r.other_column))))
        return Op("=", (Col((left, r.other_column)), Col((alias, r.column))))

    def do_join(self, s: Stage, step: Join) -> Stage:
        if s.grouped or not s.tables:
            name = "_left"
            s = Stage(s.df.alias(name), {name: name}, {name: s.df.columns}, s.order) if not s.tables else Stage(s.df.alias(next(iter(s.tables))), dict(list(s.tables.items())[:1]), {next(iter(s.tables)): s.df.columns}, s.order)
        if step.kind in ("right", "full") and s.conditions and len(s.tables) > 1:
            raise PlanProblem("a right or full join after where and another join is ambiguous: stash what comes before it")
        df, table = self.source(step.source)
        alias = step.source.alias
        if alias in s.tables:
            raise PlanProblem(f"two tables are called {alias}; give one another name with as")
        condition = self.join_condition(s, step, table)
        if step.using:
            return self.join_using(s, step, df, table)
        after = replace(s, tables={**s.tables, alias: table}, columns={**s.columns, alias: df.columns}, grouped=None)
        if condition is None:
            return replace(after, df=s.df.crossJoin(df))
        both = Context(aliases=frozenset(a.lower() for a in after.columns), columns=frozenset(), week_start=self.settings.week_start)
        return replace(after, df=s.df.join(df, F.expr(render(condition, both)), step.kind))

    def join_using(self, s: Stage, step: Join, df: DataFrame, table: str) -> Stage:
        """The columns in ``using`` are there once; in a right or full join the tables behind them have no names any more."""
        out = s.df.join(df, list(step.using), step.kind)
        if step.kind in ("right", "full"):
            return s.closed(out)
        named_ = {c.lower() for c in step.using}
        own = [c for c in df.columns if c.lower() not in named_]
        return replace(s, df=out, tables={**s.tables, step.source.alias: table}, columns={**s.columns, step.source.alias: own}, grouped=None)

    # groups -----------------------------------------------------------------------------------------------------
    def do_group(self, s: Stage, step: Group) -> Stage:
        from . import spine

        s = replace(s, spine=(), kept=())
        if any(step.spined):
            if step.mode:
                warnings.warn("a spine has no meaning with rollup, cube or grouping sets; it is left out", stacklevel=2)
            elif step.aggs is not None:
                return spine.grouped(self, s, step)
        if step.aggs is None:
            return replace(s, pending=step)
        return self.grouped(s, step)

    def keys_of(self, s: Stage, step: Group) -> tuple[DataFrame, list[tuple[Node, str]], list[str]]:
        """The input with its keys as columns: outputs __k0, __k1 ... and their names."""
        taken: set[str] = set()
        keys, names = [], []
        for k, i in enumerate(step.keys):
            name = named(i, self.settings, k)
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            names.append(name)
            keys.append((i.expr, name))
        return s.df.select("*", *[self.col(n, s).alias(f"__k{k}") for k, (n, _) in enumerate(keys)]), keys, names

    def aggregate(self, s: Stage, source: DataFrame, keys: list[tuple[Node, str]], aggs: list[tuple[Node, str]], mode: str = "", sets=()) -> DataFrame:
        if s.spine:
            from .spine import filled

            df = filled(self, s, source, keys, aggs)
            names = {name.lower() for _, name in aggs}
            return df.select(*[F.col(f"__k{k}").alias(name) for k, (_, name) in enumerate(keys) if name.lower() not in names], *[F.col(quoted(name)) for _, name in aggs])
        at = replace(s, df=source)
        inner = {n: Col((f"__k{k}",)) for k, (n, _) in enumerate(keys)}
        plain = {n.name.lower(): v for n, v in inner.items() if isinstance(n, Col)}

        def f(x: Node) -> Node | None:
            if x in inner:
                return inner[x]
            if isinstance(x, Call) and has_aggregate(x):
                return x  # inside an aggregate the rows are still there
            if isinstance(x, Col) and x.name.lower() in plain and not (len(x.parts) > 1 and x not in inner):
                return plain[x.name.lower()]
            return None

        made: dict[str, Node] = {}
        have = {c.lower() for c in source.columns}
        columns = []
        for n, name in aggs:
            n = n.rewrite(lambda x: made.get(x.name.lower()) if isinstance(x, Col) and len(x.parts) == 1 and x.name.lower() not in have else None)
            made[name.lower()] = n
            columns.append(F.expr(self.text(n.rewrite(f), at, block=True)).alias(name))
        on = [F.col(f"__k{k}") for k in range(len(keys))]
        if mode == "rollup":
            g = source.rollup(*on)
        elif mode == "cube":
            g = source.cube(*on)
        elif mode == "sets":
            place = {n: F.col(f"__k{k}") for k, (n, _) in enumerate(keys)}
            g = source.groupingSets([[place[n] for n in own] for own in sets], *on)
        else:
            g = source.groupBy(*on)
        df = g.agg(*columns) if columns else source.select(*on).distinct()
        names = {name.lower() for _, name in aggs}
        return df.select(*[F.col(f"__k{k}").alias(name) for k, (_, name) in enumerate(keys) if name.lower() not in names], *[F.col(quoted(name)) for _, name in aggs])

    def grouped(self, s: Stage, step: Group) -> Stage:
        source, keys, _ = self.keys_of(s, step)
        aggs = [(i.expr, named(i, self.settings, k)) for k, i in enumerate(step.aggs or ())]
        df = self.aggregate(s, source, keys, aggs, step.mode, step.sets)
        if step.mode:
            return s.closed(df)
        return replace(s, df=df, grouped=(source, keys, aggs), order=(), kept=())

    def grouped_select(self, s: Stage, step: Select) -> Stage:
        group = s.pending
        assert group is not None
        source, keys, _ = self.keys_of(s, group)
        pairs = self.expanded(step.items, s)
        if any(isinstance(i.expr, Star) for i in step.items):
            raise PlanProblem("a grouped select has no star")
        own = [(n, f"__o{k}") for k, (n, _) in enumerate(pairs)]
        inner = self.aggregate(replace(s, pending=None), source, [(n, f"__x{k}") for k, (n, _) in enumerate(keys)], [(n, o) for n, o in own], group.mode, group.sets)
        df = inner.select(*[F.col(o).alias(name) for (_, o), (_, name) in zip(own, pairs)])
        done = replace(s, df=df.distinct() if step.distinct else df, pending=None, order=())
        return replace(done, grouped=None if group.mode else (source, [(n, name) for n, name in pairs if n in {k for k, _ in keys}] or [], [(n, name) for n, name in pairs if n not in {k for k, _ in keys}])) if not group.mode and {n for n, _ in pairs} >= {k for k, _ in keys} and not step.distinct else done.closed(done.df)

    # order, paging, samples -------------------------------------------------------------------------------------
    def do_orderby(self, s: Stage, step: OrderBy) -> Stage:
        names = s.df.columns
        nodes: list[Node] = [o.expr for o in step.items]
        t, nodes = self.with_hidden(s, nodes)
        order = tuple(replace(o, expr=n) for o, n in zip(step.items, nodes))
        # positions
        order = tuple(replace(o, expr=Col((names[int(o.expr.value) - 1],))) if isinstance(o.expr, Lit) and o.expr.kind == "number" else o for o in order)
        df = t.df.orderBy(*self.sorts(order, t))
        if t is not s and t.df.columns != names:
            return replace(s, df=df.select(*[quoted(c) for c in names]), order=())
        return replace(s, df=df, order=order)

    def do_limit(self, s: Stage, step: Limit) -> Stage:
        return s.then(s.df.limit(step.count))

    def do_offset(self, s: Stage, step: Offset) -> Stage:
        return s.then(s.df.offset(step.count))

    def do_sample(self, s: Stage, step: Sample) -> Stage:
        if step.percent:
            return s  # done where the table was read
        if step.per is None:
            return s.then(s.df.orderBy(F.rand()).limit(int(step.amount)), order=())
        w = Window.partitionBy(self.col(step.per, s)).orderBy(F.rand())
        return s.then(s.df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= int(step.amount)).drop("__n"), order=())

    # ranks ------------------------------------------------------------------------------------------------------
    def pick(self, s: Stage, f: str, keys: tuple[Node, ...], order: tuple[Ordered, ...], alias: str, keep: int | None = None) -> Stage:
        s = replace(s, df=s.df)
        by = f"PARTITION BY {', '.join(self.text(k, s) for k in keys)} " if keys else ""
        c = self.context(s)
        sort = f"ORDER BY {', '.join(sort_text(o, c) for o in order)}" if order else "ORDER BY 1"
        df = s.df.withColumn(alias, F.expr(f"{f}() OVER ({by}{sort})"))
        if keep is None:
            return s.closed(df)
        return s.then(df.filter(F.col(alias) == keep).drop(alias))

    def do_rank(self, s: Stage, step: Rank) -> Stage:
        if not step.keys and step.how in ("number", "rank", "dense_rank"):
            warnings.warn("a rank over all rows is one task; give it keys with per", stacklevel=2)
        keys = tuple(self.known(k, s) for k in step.keys)
        order = tuple(replace(o, expr=self.known(o.expr, s)) for o in step.order) or s.order
        if step.how in ("first", "last"):
            if step.how == "last":
                order = tuple(replace(o, desc=not o.desc) for o in order)
            return self.pick(s, "row_number", keys, order, "__rank", keep=1)
        f = {"number": "row_number"}.get(step.how, step.how)
        alias = step.alias or {"number": "row_num"}.get(step.how, step.how)
        return self.pick(s, f, keys, order, alias)

    # shapes -----------------------------------------------------------------------------------------------------
    def do_explode(self, s: Stage, step: Explode) -> Stage:
        stars = [c for c in self.all_columns(s)]
        names = [n for cs in s.columns.values() for n in cs] if len(s.columns) > 1 else s.df.columns
        stars = [c for c, n in zip(stars, names) if n.lower() != step.alias.lower()]
        return s.closed(s.df.select(*stars, F.explode(self.col(step.expr, s)).alias(step.alias)), order=s.order)

    def do_pivot(self, s: Stage, step: Pivot) -> Stage:
        agg: Node = step.agg if has_aggregate(step.agg) else Call("max", (step.agg,))
        column = step.column.name  # type: ignore[attr-defined]
        used = {x.name.lower() for x in agg.walk() if isinstance(x, Col)} | {column.lower()}
        if step.keys is not None:
            keys = [k.name for k in step.keys]  # type: ignore[attr-defined]
        else:
            keys = [c for c in s.df.columns if c.lower() not in used]
        values = [i.expr.value for i in step.values] if step.values else None  # type: ignore[attr-defined]
        if values is None:
            for t in s.tables.values():
                known = self.catalog.table(t)
                if known and column.lower() in known.distinct_values:
                    values = known.distinct_values[column.lower()]
        g = s.df.groupBy(*[quoted(k) for k in keys]).pivot(column, values) if values else s.df.groupBy(*[quoted(k) for k in keys]).pivot(column)
        df = g.agg(self.col(agg, s, block=True))
        if step.values:
            for i in step.values:
                if i.alias:
                    df = df.withColumnRenamed(str(i.expr.value), i.alias)  # type: ignore[attr-defined]
        return s.closed(df)

    def do_unpivot(self, s: Stage, step: Unpivot) -> Stage:
        low = {c.lower() for c in step.columns}
        ids = [c for c in s.df.columns if c.lower() not in low]
        df = s.df.unpivot([F.col(quoted(c)) for c in ids], [F.col(quoted(c)) for c in step.columns], step.name, step.value)
        return s.closed(df.filter(F.col(quoted(step.value)).isNotNull()))

    def do_recurse(self, s: Stage, step: Recurse, before: tuple[Step, ...]) -> Stage:
        first = before[0]
        assert isinstance(first, From)
        rows, _ = self.source(first.source)
        a, b = self.view(s.df), self.view(rows)
        key = quoted(step.key)
        df = self.spark.sql(
            f"WITH RECURSIVE r MAX RECURSION LEVEL {step.depth + 1} AS (SELECT *, 1 AS _level FROM {a} UNION ALL "
            f"SELECT t.*, r._level + 1 FROM {b} AS t JOIN r ON t.{key} = r.id WHERE r._level < {step.depth}) SELECT * FROM r LIMIT ALL"
        )
        return s.closed(df)

    def do_stash(self, s: Stage, step: Stash) -> Stage:
        self.stashed[step.name.lower()] = s.df
        return replace(s, df=s.df.alias(step.name), tables={step.name: step.name.lower()}, columns={step.name: s.df.columns})

    def do_setop(self, s: Stage, step: SetOp) -> Stage:
        left, right = s.df, self.query(step.query)
        if step.columns:
            left, right = left.select(*step.columns), right.select(*step.columns)
        if step.by_name and step.kind != "union":
            common = [c for c in left.columns if c.lower() in {x.lower() for x in right.columns}]
            left, right = left.select(*common), right.select(*common)
        if step.kind == "union":
            out = left.unionByName(right, allowMissingColumns=True) if step.by_name else left.union(right)
            out = out if step.all else out.distinct()
        elif step.kind == "intersect":
            out = left.intersectAll(right) if step.all else left.intersect(right)
        else:
            out = left.exceptAll(right) if step.all else left.subtract(right)
        return s.closed(out)

