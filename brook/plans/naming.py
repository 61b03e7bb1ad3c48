"""Output names of expressions that have none."""

from __future__ import annotations

from ..catalog import Settings
from ..lang.nodes import AtZone, Call, Cast, Col, Item, Lit, Node, Star

PREFIXES = {"count": "num", "count_entity": "num", "row_number": "row_num", "running_count": "running_num", "uniq": "uniq"}


def auto_alias(n: Node, settings: Settings) -> str | None:
    if isinstance(n, Col):
        return n.name
    if isinstance(n, (Cast, AtZone)) and isinstance(n.expr, Col):
        return n.expr.name
    if not isinstance(n, Call):
        return None
    name = "distinct_count" if n.name == "count" and n.distinct else n.name
    prefix = settings.alias_prefixes.get(name) or PREFIXES.get(name) or ("uniq" if name == "distinct_count" else name)
    args = [a.name if isinstance(a, Col) else str(a.value) if isinstance(a, Lit) else None for a in n.args]
    template = settings.alias_templates.get(name) or settings.alias_template
    if template and all(args):
        values = {"func": name, "prefix": prefix, "col": args[0] if args else "", **{f"arg{k + 1}": a for k, a in enumerate(args)}}
        for k, v in values.items():
            template = template.replace("{{" + k + "}}", v or "").replace("{{ " + k + " }}", v or "")
        return template
    if not n.args or n.args == (Star(),):
        return prefix
    return "_".join([prefix, *args]) if all(args) else None  # type: ignore[list-item]


def named(item: Item, settings: Settings, k: int) -> str:
    return item.alias or auto_alias(item.expr, settings) or f"_col{k}"
