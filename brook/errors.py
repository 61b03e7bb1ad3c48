"""Errors of the query language."""

from __future__ import annotations


class BrookError(Exception):
    """Any error of this package."""


class SyntaxProblem(BrookError):
    """The text is not a query."""


class PlanProblem(BrookError):
    """The query is well formed but has no defined meaning."""


class ResolutionProblem(PlanProblem):
    """A table, column or relationship can't be found or is ambiguous."""
