"""CREATE, DELETE, SET, REMOVE, MERGE and FOREACH: each returns a new graph.

Frames are lazy, so an update is a union, an anti join or a column expression that later
queries see; nothing is copied until a result or ``save_graph`` asks for it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph, numbered
from ..pattern import Node, Rel, equals, filtered
from ..tables import durable


def _next_id(graph: PropertyGraph) -> int:
    frames = list(graph.node_frames.values())
    tops = [df.agg(F.max("id").cast("long").alias("m")) for df in frames]
    all_tops = tops[0] if tops else graph.spark.createDataFrame([(None,)], "m long")
    for more in tops[1:]:
        all_tops = all_tops.union(more)
    top = all_tops.agg(F.max("m")).first()[0]
    return 0 if top is None else top + 1


def add_nodes(graph: PropertyGraph, labels: Sequence[str], nodes: DataFrame) -> PropertyGraph:
    """Adds a frame of nodes (id, properties) with these labels."""
    key = next((k for k in graph.node_frames if {x.lower() for x in k} == {x.lower() for x in labels}), frozenset(labels))
    own = graph.node_frames.get(key)
    return graph.with_nodes(key, nodes if own is None else own.unionByName(nodes, allowMissingColumns=True))


def add_edges(graph: PropertyGraph, kind: str, edges: DataFrame) -> PropertyGraph:
    """Adds a frame of edges (src, dst, properties[, eid]) of one type."""
    kind = next((t for t in graph.edge_frames if t.lower() == kind.lower()), kind)
    if "eid" not in edges.columns:
        # Drawn once for this call, so ids are the same whenever the graph is read.
        edges = numbered(edges, F.lit(kind), F.lit(uuid.uuid4().hex))
    own = graph.edge_frames.get(kind)
    grown = graph.with_edges(kind, edges if own is None else own.unionByName(edges, allowMissingColumns=True))
    return replace(grown, ends={t: e for t, e in grown.ends.items() if t != kind})


def create(graph: PropertyGraph, *pattern: Node | Rel) -> PropertyGraph:
    """CREATE of a chain of new nodes and edges.  A name that comes again is the same new
    node; ids follow the largest one, and edge directions are as written."""
    if len(pattern) % 2 == 0 or any(isinstance(p, Rel) != bool(i % 2) for i, p in enumerate(pattern)):
        raise ValueError("a chain is node, relationship, node, ...")
    free, ids, made, at = _next_id(graph), {}, [], []
    for n in pattern[::2]:
        if n.name is None or n.name not in ids:
            ids[n.name or f"_{len(made)}"] = free + len(made)
            at.append(free + len(made))
            made.append(n)
        else:
            at.append(ids[n.name])
    one = lambda row: graph.spark.range(1).select(*[c.alias(k) for k, c in row.items()])
    for k, n in enumerate(made):
        graph = add_nodes(graph, n.labels, one({"id": F.lit(free + k).cast("long")} | {p: _literal(v) for p, v in n.props.items()}))
    for k, r in enumerate(pattern[1::2]):
        if len(r.types) != 1 or r.direction == "both" or r.hops is not None:
            raise ValueError("a new relationship has one type, one direction and one hop")
        a, b = (at[k], at[k + 1]) if r.direction == "out" else (at[k + 1], at[k])
        eid = F.xxhash64(F.lit(r.types[0]), F.lit(a), F.lit(b), F.lit(f"new {free} {k}"))
        graph = add_edges(graph, r.types[0], one({"eid": eid, "src": F.lit(a).cast("long"), "dst": F.lit(b).cast("long")} | {p: _literal(v) for p, v in r.props.items()}))
    return graph


def _literal(value: Any) -> Column:
    return F.array(*[F.lit(v) for v in value]) if isinstance(value, (list, tuple)) else F.lit(value)


def _picked(graph: PropertyGraph, spec: Node, where: Callable[[DataFrame], Column] | None) -> DataFrame:
    df = filtered(graph.nodes(*spec.labels), spec)
    return df.where(where(df)) if where else df


def delete_nodes(graph: PropertyGraph, spec: Node, where: Callable[[DataFrame], Column] | None = None, detach: bool = True) -> PropertyGraph:
    """DELETE of the nodes that match; with ``detach`` their edges go too, otherwise a node
    that has edges is an error, raised when the result is read."""
    gone = _picked(graph, spec, where).select("id").distinct()
    if not detach:
        tied = graph.edges().select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("_tied", F.lit(True))
        held = F.when(F.col("_tied"), F.raise_error(F.lit("a node with relationships can only be deleted with detach")).cast("long")).otherwise(F.col("id"))
        gone = gone.join(tied, "id", "left").select(held.alias("id"))
    for key in graph.label_sets(spec.labels):
        df = graph.node_frames[key]
        graph = graph.with_nodes(key, df.join(gone, df["id"] == gone["id"], "left_anti"))
    if detach:
        for t, df in graph.edge_frames.items():
            left = df.join(gone, df["src"] == gone["id"], "left_anti")
            graph = graph.with_edges(t, left.join(gone, left["dst"] == gone["id"], "left_anti"))
    return graph


def delete_edges(graph: PropertyGraph, kind: str, where: Callable[[DataFrame], Column] | None = None) -> PropertyGraph:
    """DELETE of the edges of one type that match, all without a condition."""
    df = graph.edge_frames[kind]
    keep = F.lit(False) if where is None else ~F.coalesce(where(df), F.lit(False))
    return graph.with_edges(kind, df.where(keep))


def set_property(graph: PropertyGraph, spec: Node, prop: str, value: Any | Callable[[DataFrame], Column], where: Callable[[DataFrame], Column] | None = None) -> PropertyGraph:
    """SET of one property on the nodes that match; ``value`` may be an expression of the
    node's own columns.  ``None`` removes it."""
    for key in graph.label_sets(spec.labels):
        df = graph.node_frames[key]
        hit = where(df) if where else F.lit(True)
        for k, v in spec.props.items():
            hit &= equals(F.col(f"`{k}`"), v) if k in df.columns else F.lit(False)
        new = value(df) if callable(value) else _literal(value)
        old = F.col(f"`{prop}`") if prop in df.columns else F.lit(None)
        graph = graph.with_nodes(key, df.withColumn(prop, F.when(hit, new).otherwise(old)))
    return graph


def remove_property(graph: PropertyGraph, spec: Node, prop: str, where: Callable[[DataFrame], Column] | None = None) -> PropertyGraph:
    """REMOVE: the property is null afterwards."""
    return set_property(graph, spec, prop, None, where)


def set_edge_property(graph: PropertyGraph, kind: str, prop: str, value: Any | Callable[[DataFrame], Column], where: Callable[[DataFrame], Column] | None = None) -> PropertyGraph:
    df = graph.edge_frames[kind]
    new = value(df) if callable(value) else _literal(value)
    old = F.col(f"`{prop}`") if prop in df.columns else F.lit(None)
    return graph.with_edges(kind, df.withColumn(prop, F.when(where(df) if where else F.lit(True), new).otherwise(old)))


def foreach_set(graph: PropertyGraph, ids: DataFrame, prop: str, value: Any) -> PropertyGraph:
    """FOREACH over matched nodes: sets a property on the nodes whose ids are given (id).

    A hash join on id marks them, however many there are."""
    marked = ids.select(F.col("id").alias("_id")).distinct().withColumn("_hit", F.lit(True))
    for key, df in graph.node_frames.items():
        old = F.col(f"`{prop}`") if prop in df.columns else F.lit(None)
        new = df.join(marked, df["id"] == marked["_id"], "left").withColumn(prop, F.when(F.col("_hit"), _literal(value)).otherwise(old))
        graph = graph.with_nodes(key, new.drop("_id", "_hit"))
    return graph


def merge_node(graph: PropertyGraph, spec: Node, on_create: dict[str, Any] | None = None, on_match: dict[str, Any] | None = None) -> PropertyGraph:
    """MERGE of one node: matched ones get ``on_match``; if there is none, it is created
    with ``on_create``."""
    if _picked(graph, spec, None).isEmpty():
        return create(graph, Node(None, spec.labels, {**spec.props, **(on_create or {})}))
    for k, v in (on_match or {}).items():
        graph = set_property(graph, spec, k, v)
    return graph


# ------------------------------------------------------ updates by matched rows
def _is_edge(rows: DataFrame, name: str) -> bool:
    return "eid" in rows.schema[name].dataType.names


def delete_matched(graph: PropertyGraph, rows: DataFrame, *names: str) -> PropertyGraph:
    """DELETE of the nodes (with their edges) and relationships that variables of ``rows``,
    the result of a match, are bound to.  Nulls, of an optional match, delete nothing."""
    rows = durable(rows.select(*[F.struct(*[F.col(f"{n}.{f}").alias(f) for f in (("type", "eid") if _is_edge(rows, n) else ("id",))]).alias(n) for n in names]), "matched")
    for n in names:
        if _is_edge(rows, n):
            gone = rows.select(F.col(f"{n}.type").alias("_type"), F.col(f"{n}.eid").alias("_eid")).distinct()
            for t, df in graph.edge_frames.items():
                graph = graph.with_edges(t, df.join(gone.where(F.lower("_type") == t.lower()), F.col("eid") == F.col("_eid"), "left_anti"))
        else:
            gone = rows.select(F.col(f"{n}.id").alias("_gone")).distinct()
            for key, df in graph.node_frames.items():
                graph = graph.with_nodes(key, df.join(gone, F.col("id") == F.col("_gone"), "left_anti"))
            for t, df in graph.edge_frames.items():
                left = df.join(gone, F.col("src") == F.col("_gone"), "left_anti")
                graph = graph.with_edges(t, left.join(gone, F.col("dst") == F.col("_gone"), "left_anti"))
    return graph


def create_matched(graph: PropertyGraph, rows: DataFrame, *pattern: Node | Rel) -> PropertyGraph:
    """CREATE of a chain for each row: names that the rows bind are the bound nodes, others
    new ones, one for each row.  Property values may be columns of the rows.

    The rows are written with their new ids first, so that these don't change."""
    if len(pattern) % 2 == 0 or any(isinstance(p, Rel) != bool(i % 2) for i, p in enumerate(pattern)):
        raise ValueError("a chain is node, relationship, node, ...")
    new: dict[str, Node] = {}
    at = []
    for k, n in enumerate(pattern[::2]):
        name = n.name or f"_new{k}"
        at.append(name)
        if name not in rows.columns and name not in new:
            new[name] = n
    free, width = _next_id(graph), max(1, len(new))
    ids = {name: F.col("_row") * width + free + k for k, name in enumerate(new)}
    rows = durable(rows.withColumn("_row", F.monotonically_increasing_id()), "matched")
    value = lambda v: v if isinstance(v, Column) else _literal(v)
    for name, n in new.items():
        graph = add_nodes(graph, n.labels, rows.select(ids[name].alias("id"), *[value(v).alias(p) for p, v in n.props.items()]))
    for k, r in enumerate(pattern[1::2]):
        if len(r.types) != 1 or r.direction == "both" or r.hops is not None:
            raise ValueError("a new relationship has one type, one direction and one hop")
        a, b = (at[k], at[k + 1]) if r.direction == "out" else (at[k + 1], at[k])
        end = lambda name: ids[name] if name in ids else F.col(f"{name}.id")
        eid = F.xxhash64(F.lit(r.types[0]), "_row", F.lit(f"new {k} {uuid.uuid4().hex}"))
        made = rows.select(eid.alias("eid"), end(a).alias("src"), end(b).alias("dst"), *[value(v).alias(p) for p, v in r.props.items()])
        graph = add_edges(graph, r.types[0], made.where("src is not null and dst is not null"))
    return graph


def set_matched(graph: PropertyGraph, rows: DataFrame, name: str, prop: str, value: Any | Column) -> PropertyGraph:
    """SET of a property on the nodes or relationships that ``name`` is bound to; ``value``
    may be an expression over the rows.  If rows differ about one, the largest value counts."""
    edge = _is_edge(rows, name)
    key = [F.col(f"{name}.{f}").alias(f"_{f}") for f in (("type", "eid") if edge else ("id",))]
    new = rows.select(*key, (value if isinstance(value, Column) else _literal(value)).alias("_new")).groupBy(*[f"_{f}" for f in (("type", "eid") if edge else ("id",))]).agg(F.max("_new").alias("_new"))
    new = durable(new.withColumn("_hit", F.lit(True)), "matched")

    def changed(df: DataFrame, news: DataFrame, on: Column) -> DataFrame:
        old = F.col(f"`{prop}`") if prop in df.columns else F.lit(None)
        keep = [F.col(f"`{c}`") for c in df.columns if c != prop]
        return df.join(news, on, "left").select(*keep, F.when(F.col("_hit"), F.col("_new")).otherwise(old).alias(prop))

    if edge:
        for t, df in graph.edge_frames.items():
            graph = graph.with_edges(t, changed(df, new.where(F.lower("_type") == t.lower()).drop("_type"), F.col("eid") == F.col("_eid")))
        return graph
    for labels, df in graph.node_frames.items():
        graph = graph.with_nodes(labels, changed(df, new, F.col("id") == F.col("_id")))
    return graph


def merge_edges(graph: PropertyGraph, rows: DataFrame, start: str, spec: Rel, end: str, on_create: dict[str, Any] | None = None, on_match: dict[str, Any] | None = None) -> PropertyGraph:
    """MERGE (start)-[spec]->(end) for the rows' bound nodes: pairs that have such an edge
    keep it, with ``on_match``; each other pair gets one, with ``on_create``."""
    if len(spec.types) != 1 or spec.direction == "both" or spec.hops is not None:
        raise ValueError("a merged relationship has one type, one direction and one hop")
    a, b = (start, end) if spec.direction == "out" else (end, start)
    pairs = durable(rows.select(F.col(f"{a}.id").alias("_src"), F.col(f"{b}.id").alias("_dst")).where("_src is not null and _dst is not null").distinct(), "pairs")
    held = filtered(graph.edges(*spec.types), spec).select("src", "dst", "eid", "type")
    met = held.join(pairs, (F.col("src") == F.col("_src")) & (F.col("dst") == F.col("_dst")), "left_semi")
    met = durable(met, "merged")
    missing = pairs.join(met, (F.col("_src") == F.col("src")) & (F.col("_dst") == F.col("dst")), "left_anti")
    for k, v in (on_match or {}).items():
        graph = set_matched(graph, met.select(F.struct("type", "eid").alias("e")), "e", k, v)
    props = {**spec.props, **(on_create or {})}
    return add_edges(graph, spec.types[0], missing.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *[_literal(v).alias(k) for k, v in props.items()]))
