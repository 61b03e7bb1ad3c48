"""What is known of tables beyond their columns: keys, relationships, models and metrics; and the settings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from .errors import PlanProblem, ResolutionProblem

IRREGULAR = {"person": "people", "child": "children", "man": "men", "woman": "women", "datum": "data", "index": "indices"}
SINGULAR = {v: k for k, v in IRREGULAR.items()}


def plural(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if word.endswith(("s", "x", "z", "ch", "sh")):
        return word + "es"
    if word.endswith("y") and word[-2:-1] not in "aeiou":
        return word[:-1] + "ies"
    return word + "s"


def singular(word: str) -> str:
    if word in SINGULAR:
        return SINGULAR[word]
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    if word.endswith(("ses", "xes", "zes", "ches", "shes")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


@dataclass(frozen=True)
class Relationship:
    """Many rows of ``table`` point at one of ``other``."""

    table: str
    column: str
    other: str
    other_column: str
    explicit: bool = True


@dataclass
class Table:
    name: str
    columns: list[str] = field(default_factory=list)
    primary_key: str | None = None
    unique: set[str] = field(default_factory=set)
    distinct_values: dict[str, list] = field(default_factory=dict)

    def key(self) -> str | None:
        if self.primary_key:
            return self.primary_key
        return next((c for c in ("id", "pk", f"{singular(self.name)}_id") if c in self.columns), None)


@dataclass
class Settings:
    week_start: str = "monday"
    relative_date_type: str = "timestamp"
    infer_join_keys: bool = False
    fanout_protection: bool = True
    alias_prefixes: dict[str, str] = field(default_factory=dict)
    alias_template: str | None = None
    alias_templates: dict[str, str] = field(default_factory=dict)

    def with_value(self, name: str, value) -> Settings:
        if not hasattr(self, name):
            raise PlanProblem(f"unknown setting {name}")
        if name == "week_start" and value not in ("monday", "sunday"):
            raise PlanProblem("week_start is monday or sunday")
        if name == "relative_date_type" and value not in ("timestamp", "date"):
            raise PlanProblem("relative_date_type is timestamp or date")
        return Settings(**{**self.__dict__, name: value})


@dataclass
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)
    relationships: list[Relationship] = field(default_factory=list)
    graph: object | None = None

    @classmethod
    def from_dict(cls, data: Mapping) -> Catalog:
        """{"tables": {name: {"columns": [...], "primary_key": c, "unique": [...], "distinct_values": {}}}, "relationships": ["a.x -> b.y"]}"""
        out = cls()
        for name, spec in (data.get("tables") or {}).items():
            cols = spec.get("columns") or []
            names = [c.lower() if isinstance(c, str) else c["name"].lower() for c in cols]
            t = Table(name.lower(), names, spec.get("primary_key"), {u.lower() for u in spec.get("unique") or []}, dict(spec.get("distinct_values") or {}))
            for c in cols:
                if isinstance(c, Mapping):
                    if c.get("primary_key"):
                        t.primary_key = c["name"].lower()
                    if c.get("unique"):
                        t.unique.add(c["name"].lower())
                    if c.get("distinct_values"):
                        t.distinct_values[c["name"].lower()] = list(c["distinct_values"])
            out.tables[t.name] = t
        for r in data.get("relationships") or []:
            a, b = (r.split("->") if isinstance(r, str) else (f"{r['from_table']}.{r['from_column']}", f"{r['to_table']}.{r['to_column']}"))
            (t, c), (o, d) = (x.strip().lower().split(".") for x in (a, b))
            out.relationships.append(Relationship(t, c, o, d))
        return out

    @classmethod
    def from_yaml(cls, path: str | Path) -> Catalog:
        import yaml

        return cls.from_dict(yaml.safe_load(Path(path).read_text()))

    @classmethod
    def from_model_tests(cls, path: str | Path) -> Catalog:
        """From a YAML file of models whose columns carry tests: unique, and relationships with ``to`` and ``field``."""
        import re

        import yaml

        out = cls()
        for m in yaml.safe_load(Path(path).read_text()).get("models") or []:
            t = out.tables.setdefault(m["name"].lower(), Table(m["name"].lower()))
            for c in m.get("columns") or []:
                name = c["name"].lower()
                t.columns.append(name)
                for test in c.get("tests") or c.get("data_tests") or []:
                    if test == "unique":
                        t.unique.add(name)
                    elif isinstance(test, Mapping) and "relationships" in test:
                        r = test["relationships"]
                        r = r.get("arguments", r)
                        other = re.sub(r"^ref\(['\"](.+)['\"]\)$", r"\1", r["to"].strip())
                        out.relationships.append(Relationship(t.name, name, other.lower(), r["field"].lower()))
                    elif isinstance(test, Mapping) and "accepted_values" in test:
                        v = test["accepted_values"]
                        t.distinct_values[name] = list(v.get("arguments", v)["values"])
        return out

    def to_dict(self) -> dict:
        return {
            "tables": {t.name: {"columns": t.columns, "primary_key": t.primary_key, "unique": sorted(t.unique), "distinct_values": t.distinct_values} for t in self.tables.values()},
            "relationships": [f"{r.table}.{r.column} -> {r.other}.{r.other_column}" for r in self.relationships],
        }

    def table(self, name: str) -> Table | None:
        return self.tables.get(name.lower())

    def see(self, name: str, columns: list[str]) -> None:
        """Columns of a table as Spark knows them."""
        t = self.tables.setdefault(name.lower(), Table(name.lower()))
        if not t.columns:
            t.columns = [c.lower() for c in columns]

    def find(self, name: str) -> str | None:
        """The table that a word names, in singular or plural."""
        for n in (name, plural(name), singular(name)):
            if n in self.tables:
                return n
        return None

    def inferred(self, table: str) -> list[Relationship]:
        """Relationships that column names ending in _id suggest; a prefix may name a role (owner_user_id)."""
        out = []
        for c in self.tables[table].columns if table in self.tables else []:
            if not c.endswith("_id"):
                continue
            words = c[:-3].split("_")
            for k in range(len(words)):
                other = self.find("_".join(words[k:]))
                if other and other != table:
                    key = self.tables[other].key()
                    if key:
                        out.append(Relationship(table, c, other, key, False))
                    break
        return out

    def between(self, a: str, b: str) -> list[Relationship]:
        own = [r for r in self.relationships if {r.table, r.other} == {a, b}]
        return own or [r for t in (a, b) for r in self.inferred(t) if {r.table, r.other} == {a, b}]

    def infer_join(self, left: str, right: str, by_name: bool = False) -> Relationship:
        found = self.between(left, right)
        if len(found) > 1:
            raise ResolutionProblem(f"several relationships between {left} and {right}; say which with on")
        if found:
            return found[0]
        if by_name:
            key = f"{singular(right)}_id"
            t = self.table(left)
            if t and key in t.columns:
                other = self.table(right)
                return Relationship(left, key, right, (other and other.key()) or "id", False)
        raise ResolutionProblem(f"no relationship between {left} and {right}; give an on condition")

    def is_unique(self, table: str, column: str) -> bool:
        t = self.table(table)
        return bool(t and (column.lower() in t.unique or t.key() == column.lower()))
