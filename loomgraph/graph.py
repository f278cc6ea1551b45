"""The property graph: a catalogue of node and edge DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns that every node and edge frame has; all others are properties.
NODE_COLUMNS, EDGE_COLUMNS = ("id", "labels"), ("eid", "src", "dst", "type")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def numbered(edges: DataFrame, *salt: Column) -> DataFrame:
    """``edges`` with an ``eid``.  Equal edges are counted, by a partial aggregate, and told
    apart by their number, so that parallel edges stay several and every evaluation gives
    the same ids.  Ids are 64-bit hashes: in very large graphs a few edges may share one,
    which matters only where both come in one match."""
    names = [F.col(f"`{c}`") for c in edges.columns]
    counted = edges.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    copies = counted.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
    return copies.select(F.xxhash64(*salt, *names, "_copy").alias("eid"), *names)


@dataclass(frozen=True)
class PropertyGraph:
    """Node frames by label set and edge frames by type.

    A node frame has ``id`` (long) and properties; its label set is its key, so labels
    cost no scan.  An edge frame has ``eid``, ``src`` and ``dst`` (long) and properties.
    Frames are lazy: nothing is read until a result is.  Labels and types are matched
    exactly, without regard to case.  An edge is told by its type and ``eid`` together, so
    types may number their edges alike; edges given without ``eid`` get one by
    ``numbered``, which costs a shuffle of them whenever they are read: save the graph to
    have it once.

    ``ends`` says for an edge type which labels its source and target always have; with
    it, nodes bound by id alone need no join.  ``small`` names the labels and types whose
    frames stay small however the data grows; all others are then taken to grow, and joins
    keep them off the driver (``tables.joined``).  Without it Spark chooses.  A graph never
    changes: updates return a new one.
    """

    spark: SparkSession
    node_frames: Mapping[frozenset[str], DataFrame] = field(default_factory=dict)
    edge_frames: Mapping[str, DataFrame] = field(default_factory=dict)
    ends: Mapping[str, tuple[frozenset[str], frozenset[str]]] = field(default_factory=dict)
    small: frozenset[str] | None = None

    @classmethod
    def of(cls, spark: SparkSession, nodes: Mapping[str | tuple[str, ...], DataFrame], edges: Mapping[str, DataFrame], ends: Mapping[str, tuple[str, str]] | None = None, small: Iterable[str] | None = None) -> PropertyGraph:
        named = {frozenset([k] if isinstance(k, str) else k): df for k, df in nodes.items()}
        for df in named.values():
            if "id" not in df.columns:
                raise ValueError("a node frame needs an id")
        for t, df in edges.items():
            if missing := {"src", "dst"} - set(df.columns):
                raise ValueError(f"edges of type {t} lack {sorted(missing)}")
        given = {t: df if "eid" in df.columns else numbered(df, F.lit(t)) for t, df in edges.items()}
        closed = {t: (frozenset([a]), frozenset([b])) for t, (a, b) in (ends or {}).items()}
        return cls(spark, named, given, closed, None if small is None else frozenset(x.lower() for x in small))

    # ------------------------------------------------------------- catalogue
    @property
    def labels(self) -> set[str]:
        return {x for k in self.node_frames for x in k}

    @property
    def types(self) -> set[str]:
        return set(self.edge_frames)

    def node_schema(self, *labels: str) -> StructType:
        return self.nodes(*labels).schema

    def edge_schema(self, *types: str) -> StructType:
        return self.edges(*types).schema

    def label_sets(self, labels: Iterable[str]) -> list[frozenset[str]]:
        """Label sets that hold all of ``labels``."""
        want = {x.lower() for x in labels}
        return [k for k in self.node_frames if want <= {x.lower() for x in k}]

    def nodes_grow(self, labels: Iterable[str]) -> bool | None:
        """Whether nodes with these labels grow with the data; None: not told."""
        return None if self.small is None else not any(x.lower() in self.small for x in labels)

    def edges_grow(self, types: Iterable[str]) -> bool | None:
        return None if self.small is None else not all(t.lower() in self.small for t in list(types) or list(self.edge_frames))

    # ----------------------------------------------------------------- scans
    def nodes(self, *labels: str) -> DataFrame:
        """Nodes with all the labels given: the union of the frames that have them, with
        the union of their properties.  Other frames aren't read."""
        found = self.label_sets(labels)
        if not found:
            return self.spark.createDataFrame([], "id long, labels array<string>")
        return _union([self.node_frames[k].select(F.col("id").cast("long").alias("id"), F.array(*[F.lit(x) for x in sorted(k)]).alias("labels"), *[c for c in self.node_frames[k].columns if c not in NODE_COLUMNS]) for k in found])

    def edges(self, *types: str) -> DataFrame:
        """Edges of any of the types given, or of all types."""
        want = {t.lower() for t in types}
        found = [t for t in self.edge_frames if not want or t.lower() in want]
        if not found:
            return self.spark.createDataFrame([], "eid long, src long, dst long, type string")
        cast = lambda df, t: df.select(F.col("eid").cast("long").alias("eid"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.lit(t).alias("type"), *[c for c in df.columns if c not in EDGE_COLUMNS])
        return _union([cast(self.edge_frames[t], t) for t in found])

    def vouches(self, types: Iterable[str], labels: Iterable[str], source: bool) -> bool:
        """Whether every edge of these types has, at that end, a node with these labels."""
        want, types = {x.lower() for x in labels}, list(types) or list(self.edge_frames)
        known = {t.lower(): e for t, e in self.ends.items()}
        for t in types:
            end = known.get(t.lower())
            if end is None or not want <= {x.lower() for x in end[0 if source else 1]}:
                return False
        return True

    def adjacency(self, *types: str, reverse: bool = False) -> DataFrame:
        """(id, neighbours): each node's neighbours in ascending order, repeats kept.

        For display or export; a node's whole list is one row.  Expansion reads the
        edge frames instead."""
        a, b = ("dst", "src") if reverse else ("src", "dst")
        return self.edges(*types).groupBy(F.col(a).alias("id")).agg(F.sort_array(F.collect_list(b)).alias("neighbours"))

    def with_nodes(self, key: frozenset[str], df: DataFrame | None) -> PropertyGraph:
        frames = {k: v for k, v in self.node_frames.items() if k != key} | ({key: df} if df is not None else {})
        return replace(self, node_frames=frames)

    def with_edges(self, kind: str, df: DataFrame) -> PropertyGraph:
        return replace(self, edge_frames={**self.edge_frames, kind: df})

    # ------------------------------------------------------------- operators
    def match(self, *pattern, uniqueness: str = "edge", path_mode: str = "trail") -> DataFrame:
        from .operators.match import match

        return match(self, *pattern, uniqueness=uniqueness, path_mode=path_mode)
