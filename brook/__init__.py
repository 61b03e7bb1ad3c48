"""brook: a FROM-first pipeline query language that runs on Spark DataFrames."""

from .api import as_json, run, run_all, run_json
from .catalog import Catalog, Relationship, Settings, Table

__all__ = ["Catalog", "Relationship", "Settings", "Table", "as_json", "run", "run_all", "run_json"]
