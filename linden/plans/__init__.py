"""Named queries.  Importing this package registers every query."""

from linden.plans import registry
from linden.plans import attributes, blocks, code, features, learning, lookup, paths, ranking, records, retrieve, search, similarity, spelling, stats, streaming  # noqa: F401

QUERIES = registry.QUERIES
ORACLE = registry.ORACLE

__all__ = ["QUERIES", "ORACLE"]
