"""MATCH: a pattern becomes joins over node and edge frames.

A chain is read from left to right.  During the joins each variable is a group of flat
columns; the result has one struct column for each named variable, so that Catalyst
prunes what a query doesn't use.  A match on rows of an earlier one starts from the ids
that they bind.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..pattern import Node, Rel, equals, filtered
from ..tables import durable, hub_joined, join_parts, joined
from .paths import all_shortest_paths, counted, expand, shortest_paths

_SEP = "·"


def _flat(df: DataFrame, name: str) -> DataFrame:
    """Columns of ``df`` under the variable's name."""
    return df.select(*[F.col(f"`{c}`").alias(f"{name}{_SEP}{c}") for c in df.columns])


def _of(name: str, field: str) -> Column:
    return F.col(f"`{name}{_SEP}{field}`")


def _both_ends(edges: DataFrame, direction: str) -> DataFrame:
    """``edges`` with their near and far ends along ``direction``; src and dst stay as
    stored.  An undirected loop comes once."""
    forth = edges.withColumns({"_near": F.col("src"), "_far": F.col("dst")})
    back = edges.withColumns({"_near": F.col("dst"), "_far": F.col("src")})
    if direction == "both":
        return forth.unionByName(back.where("src <> dst"))
    return forth if direction == "out" else back


def _has_labels(own: Column, labels: tuple[str, ...]) -> Column:
    return F.forall(F.array(*[F.lit(x.lower()) for x in labels]), lambda y: F.array_contains(F.transform(own, F.lower), y))


class _Bound:
    """What the chains have bound so far."""

    def __init__(self, graph: PropertyGraph, uniqueness: str, path_mode: str):
        if uniqueness not in ("edge", "node2hop", "none"):
            raise ValueError(f"unknown uniqueness {uniqueness}")
        self.graph, self.uniqueness, self.path_mode = graph, uniqueness, path_mode
        self.df: DataFrame | None = None
        #: Fields at hand of each bound node and, of earlier rows, relationship.
        self.nodes: dict[str, set[str]] = {}
        self.rels: dict[str, set[str]] = {}
        #: Columns of earlier rows, kept as they are.
        self.whole: list[str] = []
        self.names: list[str] = []
        self.edges: list[tuple[str, bool, set[str]]] = []  # name, of several hops, types
        self.chain: list[str] = []
        #: Whether the rows grow with the data (None: not told), and nodes that stay few.
        self.grows: bool | None = None if graph.small is None else False
        self.few: set[str] = set()
        self.count = 0

    def begin(self, df: DataFrame, nodes: list[str], rels: list[str]) -> None:
        """Starts from rows whose variables are struct columns."""
        self.df, self.grows = df.select(*[F.col(f"`{c}`").alias(f"{c}{_SEP}") for c in df.columns]), None
        self.whole = list(df.columns)
        fields = lambda n: set(df.schema[n].dataType.names)
        self.nodes, self.rels = {n: fields(n) for n in nodes}, {n: fields(n) for n in rels}

    def value(self, name: str, field: str) -> Column:
        return _of(name, "")[field] if name in self.whole else _of(name, field)

    def fresh(self, what: str) -> str:
        self.count += 1
        return f"_{what}{self.count}"

    def node_frame(self, spec: Node, name: str) -> DataFrame:
        return _flat(filtered(self.graph.nodes(*spec.labels), spec), name)

    def start(self, spec: Node) -> str:
        name = spec.name or self.fresh("node")
        self.chain = [name]
        if name in self.nodes:
            self.again(spec)
            return name
        frame = self.node_frame(spec, name)
        self.df = frame if self.df is None else self.df.crossJoin(frame)
        self.grown(self.graph.nodes_grow(spec.labels))
        self.bind(name, spec, frame)
        return name

    def grown(self, more: bool | None) -> None:
        if self.grows is not None:
            self.grows = None if more is None else self.grows or more

    def join(self, frame: DataFrame, on: Column, grows: bool | None) -> None:
        self.df = joined(self.df, frame, on, self.grows, grows)
        self.grown(grows)

    def bind(self, name: str, spec: Node, frame: DataFrame | None) -> None:
        self.nodes[name] = {c.partition(_SEP)[2] for c in frame.columns} if frame is not None else {"id"}
        if self.graph.nodes_grow(spec.labels) is False:
            self.few.add(name)
        if spec.name:
            self.names.append(name)

    def again(self, spec: Node) -> None:
        """A later mention of a name may add labels, properties and conditions."""
        have = self.nodes[spec.name]
        if not (spec.labels or spec.props or spec.conditions):
            return
        if spec.conditions or "labels" not in have or not set(spec.props) <= have:
            # Not at hand: the node's own table tells.
            frame = self.node_frame(spec, self.fresh("again"))
            frame = frame.select(frame[frame.columns[0]].alias("_again"))
            self.df = joined(self.df, frame, self.value(spec.name, "id") == F.col("_again"), self.grows, self.graph.nodes_grow(spec.labels), "left_semi")
            return
        if spec.labels:
            self.df = self.df.where(_has_labels(self.value(spec.name, "labels"), spec.labels))
        for k, v in spec.props.items():
            self.df = self.df.where(equals(self.value(spec.name, k), v))

    def hop(self, left: str, spec: Rel, right: Node) -> str:
        edge, name = spec.name or self.fresh("edge"), right.name or self.fresh("node")
        known = edge in self.rels
        if known:
            edge = self.fresh("edge")
        edges, bound, several = filtered(self.graph.edges(*spec.types), spec), name in self.nodes, spec.hops is not None
        grows, parts = self.graph.edges_grow(spec.types), None
        if several:
            frame = _flat(self.paths(edges, left, spec, right, name if bound else None), edge)
            src, dst = _of(edge, "start"), _of(edge, "end")
            if counted(spec.hops[1]) and not (spec.shortest or bound) and self.grows and grows:
                parts = join_parts(frame.sparkSession, frame.count())
                if parts:
                    self.df, frame = self.df.repartition(parts, self.value(left, "id")), frame.repartition(parts, src)
        else:
            frame, src, dst = _flat(_both_ends(edges, spec.direction), edge), _of(edge, "_near"), _of(edge, "_far")
        condition = self.value(left, "id") == src
        if bound:
            condition &= self.value(name, "id") == dst
        if known:
            condition &= (self.value(spec.name, "eid") == _of(edge, "eid")) & (self.value(spec.name, "type") == _of(edge, "type"))
        if not spec.shortest:
            for other, many, types in self.edges:
                condition &= self.apart(edge, spec, other, many, types)
            self.edges.append((edge, several, {t.lower() for t in spec.types}))
        if spec.name and not known:
            self.names.append(edge)
        hub = self.grows and grows and left in self.few and not (bound or known or several)
        if hub:
            # The far nodes are read before the rows multiply.
            frame = self.far(frame, name, right, spec, dst)
            self.df = hub_joined(self.df, frame, condition, self.value(self.chain[max(len(self.chain) - 2, 0)], "id"), dst)
        else:
            self.join(frame, condition, grows)
        if hub:
            pass
        elif bound:
            self.again(right)
        else:
            self.reach(name, right, spec, dst, parts)
        if self.uniqueness == "node2hop" and len(self.chain) >= 2:
            self.df = self.df.where(self.value(self.chain[-2], "id") != self.value(name, "id"))
        self.chain.append(name)
        return name

    def paths(self, edges: DataFrame, left: str, spec: Rel, right: Node, bound: str | None) -> DataFrame:
        """Paths from the nodes bound to the left: nothing else is expanded."""
        if self.edges or self.whole:
            # Read twice, as seeds and by the join: written once.
            self.df = durable(self.df, "bound")
        seeds = self.df.select(self.value(left, "id").alias("id"))
        edges = edges.select("eid", "src", "dst", "type")
        if not spec.shortest:
            return expand(edges, seeds, *spec.hops, spec.direction, self.path_mode)
        targets = None
        if bound:
            targets = self.df.select(self.value(bound, "id").alias("id"))
        elif right.labels or right.props or right.conditions:
            targets = filtered(self.graph.nodes(*right.labels), right).select("id")
        search = shortest_paths if spec.shortest == "one" else all_shortest_paths
        found = search(edges, seeds, targets, *spec.hops, spec.direction)
        return found.select("start", "end", "depth", F.col("rels.eid").alias("eids"), "rels", F.col("path").alias("nodes"), *[c for c in found.columns if c == "n_paths"])

    def apart(self, edge: str, spec: Rel, other: str, several: bool, types: set[str]) -> Column:
        """No edge, told by type and eid, twice in one match, where the types leave a way to it."""
        own = {t.lower() for t in spec.types}
        if self.uniqueness != "edge" or (own and types and not own & types):
            return F.lit(True)
        one = lambda e: F.struct(_of(e, "type").alias("type"), _of(e, "eid").alias("eid"))
        if several and spec.hops is not None:
            return ~F.arrays_overlap(_of(edge, "rels"), _of(other, "rels"))
        if several:
            return ~F.array_contains(_of(other, "rels"), one(edge))
        if spec.hops is not None:
            return ~F.array_contains(_of(edge, "rels"), one(other))
        differ = _of(edge, "eid") != _of(other, "eid")
        return differ if len(own) == 1 and own == types else differ | (_of(edge, "type") != _of(other, "type"))

    def reach(self, name: str, right: Node, spec: Rel, end: Column, parts: int | None = None) -> None:
        self.df = self.far(self.df, name, right, spec, end, self.grows, parts)
        self.grown(self.graph.nodes_grow(right.labels))

    def far(self, rows: DataFrame, name: str, right: Node, spec: Rel, end: Column, grows: bool | None = True, parts: int | None = None) -> DataFrame:
        """``rows`` with the node at ``end``; dealt over ``parts`` where they are counted and many."""
        lean = right.name is None or not right.fetch
        sides = {"out": [False], "in": [True], "both": [False, True]}[spec.direction]
        plain = not right.props and not right.conditions and spec.hops is None
        if lean and plain and all(self.graph.vouches(spec.types, right.labels, s) for s in sides):
            self.bind(name, right, None)
            return rows.withColumn(f"{name}{_SEP}id", end)
        frame = self.node_frame(right, name)
        if lean:
            frame = frame.select(_of(name, "id"))
        self.bind(name, right, frame)
        more = self.graph.nodes_grow(right.labels)
        if parts and more:
            rows, frame = rows.repartition(parts, end), frame.repartition(parts, _of(name, "id"))
        return joined(rows, frame, end == _of(name, "id"), grows, more)

    def take(self, chains: list[tuple]) -> None:
        todo = list(chains)
        while todo:
            # Chains that begin at a bound node go first, to be joined and not combined.
            k = next((i for i, c in enumerate(todo) if c[0].name in self.nodes), None)
            if k is None and self.nodes:
                k = next((i for i, c in enumerate(todo) if c[-1].name in self.nodes), None)
                if k is not None:
                    todo[k] = _turned(todo[k])
            parts = todo.pop(k or 0)
            at = self.start(parts[0])
            for spec, right in zip(parts[1::2], parts[2::2], strict=True):
                at = self.hop(at, spec, right)

    def rows(self) -> DataFrame:
        fields: dict[str, list[str]] = {}
        for c in self.df.columns:
            name, _, f = c.partition(_SEP)
            fields.setdefault(name, []).append(f)
        made = [F.struct(*[_of(n, f).alias(f) for f in fields[n] if f not in ("_near", "_far")]).alias(n) for n in self.names]
        return self.df.select(*[_of(c, "").alias(c) for c in self.whole], *made)


def _chains(pattern: tuple) -> list[tuple]:
    chains = list(pattern) if pattern and isinstance(pattern[0], tuple) else [pattern]
    for parts in chains:
        if len(parts) % 2 == 0 or any(isinstance(p, Rel) != bool(i % 2) for i, p in enumerate(parts)):
            raise ValueError("a chain is node, relationship, node, ...")
    return chains


def _turned(chain: tuple) -> tuple:
    flip = {"out": "in", "in": "out", "both": "both"}
    return tuple(replace(p, direction=flip[p.direction]) if isinstance(p, Rel) else p for p in reversed(chain))


def match(graph: PropertyGraph, *pattern: Node | Rel | tuple, uniqueness: str = "edge", path_mode: str = "trail") -> DataFrame:
    """One struct column for each named variable; a row for each way to match.

    ``pattern`` is a chain, or several as tuples: chains meet in the names they share, and
    ones that share none are combined, each with each.  A node's struct has id, labels and
    properties (id alone with ``fetch=False`` where the graph vouches for it); an edge's
    eid, src, dst, type and properties; a path's start, end, depth, eids, rels (its edges
    as type and eid) and nodes (the ids it goes by), a shortest path's n_paths as well.

    ``uniqueness``: "edge" (no edge twice in a match; shortest paths are not compared),
    "node2hop" (nodes two hops apart differ) or "none".  ``path_mode``: "trail" or "walk",
    for paths of several hops.  Paths are searched from the nodes that the chain has bound
    before them, so a condition that belongs to a start goes into the pattern
    (``node(...).where(...)``).
    """
    bound = _Bound(graph, uniqueness, path_mode)
    bound.take(_chains(pattern))
    return bound.rows()


# ------------------------------------------------------- matches on top of rows
def _shared(df: DataFrame, chains: list[tuple]) -> tuple[list[str], list[str]]:
    """Node and relationship variables of the pattern that the rows bind."""
    named = lambda kind: [n for n in dict.fromkeys(p.name for c in chains for p in c if isinstance(p, kind)) if n in df.columns]
    nodes, rels = named(Node), named(Rel)
    if not nodes and not rels:
        raise ValueError("the pattern shares no variable with the rows")
    return nodes, rels


def _found(graph: PropertyGraph, df: DataFrame, chains: list[tuple], uniqueness: str = "edge", path_mode: str = "trail") -> tuple[DataFrame, list[str], Column]:
    """Matches from the distinct keys that the rows bind; the keys' columns; their equality."""
    nodes, rels = _shared(df, chains)
    parts = {n: ("id",) for n in nodes} | {n: ("type", "eid") for n in rels}
    keyed = df.select(*[F.struct(*[F.col(f"{n}.{f}").alias(f) for f in fs]).alias(n) for n, fs in parts.items()])
    keyed = keyed.where(" and ".join(f"`{n}`.`{f}` is not null" for n, fs in parts.items() for f in fs)).distinct()
    bound = _Bound(graph, uniqueness, path_mode)
    bound.begin(keyed, nodes, rels)
    bound.take(chains)
    found, keys, on = bound.rows(), [], None
    for k, (n, f) in enumerate((n, f) for n, fs in parts.items() for f in fs):
        keys.append(f"_key{k}")
        found = found.withColumn(keys[-1], F.col(f"{n}.{f}"))
        one = F.col(f"{n}.{f}") == F.col(keys[-1])
        on = one if on is None else on & one
    return found.drop(*parts), keys, on


def extend(graph: PropertyGraph, df: DataFrame, *pattern, how: str = "inner", **options) -> DataFrame:
    """A further MATCH (or, with ``how="left"``, OPTIONAL MATCH) on rows of an earlier
    one.  The pattern is followed from what the rows bind: an inner one joins on directly,
    a left one from the rows' distinct ids."""
    chains = _chains(pattern)
    if how == "inner":
        bound = _Bound(graph, options.get("uniqueness", "edge"), options.get("path_mode", "trail"))
        bound.begin(df, *_shared(df, chains))
        bound.take(chains)
        return bound.rows()
    found, keys, on = _found(graph, df, chains, **options)
    return df.join(found, on, how).drop(*keys)


def optional_match(graph: PropertyGraph, df: DataFrame, *pattern, **options) -> DataFrame:
    """Rows without a match stay, with null variables."""
    return extend(graph, df, *pattern, how="left", **options)


def where_exists(graph: PropertyGraph, df: DataFrame, *pattern, negate: bool = False, **options) -> DataFrame:
    """Rows for which the pattern has a match (or none): a semi or anti join with what the
    pattern gives from the rows' distinct ids."""
    found, keys, on = _found(graph, df, _chains(pattern), **options)
    return df.join(found.select(*keys), on, "left_anti" if negate else "left_semi")
