"""Registered queries, and what iterative plans share."""
