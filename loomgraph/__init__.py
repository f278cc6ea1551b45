"""Property graphs as Spark DataFrames: patterns, paths, updates, ingest and checks.

``PropertyGraph`` holds node and edge frames; ``match`` turns a pattern into joins and
returns an ordinary DataFrame with one struct column for each variable.  Everything
after that (filters, projection, grouping, ordering, paging, unions) is the DataFrame
API itself.
"""

from .graph import PropertyGraph
from .pattern import into, node, out, rel, shortest, undirected

__all__ = ["PropertyGraph", "into", "node", "out", "rel", "shortest", "undirected"]
