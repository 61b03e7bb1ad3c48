"""Lowering of syntax trees to DataFrames, and the rewrites that change what a query means."""
