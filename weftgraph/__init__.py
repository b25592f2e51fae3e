"""Property-graph analytics on Spark DataFrames."""

from weftgraph.session import local_session

__all__ = ["local_session"]
