"""Scalar functions and aggregates with graph-query semantics."""
