"""Pattern elements: nodes and relationships, as plain values.

    node("a", "Person", pets=2), out("e", "OWNS"), node("b", "Website")

is the chain a -[e:OWNS]-> b.  Names may be left out; a repeated name is the same node.
Conditions that a node's or an edge's own properties decide are best told with ``where``:
they are applied to its frame, before anything is joined or expanded.

    node("a", "Person").where("age > 30 or pets is null")
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any, Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Direction = Literal["out", "in", "both"]
#: SQL text over the properties, or a function of the frame that has them.
Condition = str | Callable[[DataFrame], Column]


@dataclass(frozen=True)
class Node:
    name: str | None = None
    labels: tuple[str, ...] = ()
    props: dict[str, Any] = field(default_factory=dict)
    #: False: only the id is bound, and where the graph vouches for its edges' ends the
    #: node table isn't read.
    fetch: bool = True
    conditions: tuple[Condition, ...] = ()

    def where(self, condition: Condition) -> Node:
        return replace(self, conditions=(*self.conditions, condition))


@dataclass(frozen=True)
class Rel:
    name: str | None = None
    types: tuple[str, ...] = ()
    direction: Direction = "out"
    #: None: one edge; (low, high): a path of so many edges, high None for any.
    hops: tuple[int, int | None] | None = None
    props: dict[str, Any] = field(default_factory=dict)
    conditions: tuple[Condition, ...] = ()
    #: "one" or "all": only shortest paths between two nodes.
    shortest: Literal["one", "all"] | None = None

    def where(self, condition: Condition) -> Rel:
        return replace(self, conditions=(*self.conditions, condition))


def node(name: str | None = None, /, *labels: str, fetch: bool = True, **props: Any) -> Node:
    return Node(name, labels, props, fetch)


def rel(name: str | None = None, /, *types: str, direction: Direction = "out", hops: int | tuple[int, int | None] | None = None, **props: Any) -> Rel:
    """A relationship; several types are alternatives, ``hops`` a length or a range."""
    if isinstance(hops, int):
        hops = (hops, hops)
    if hops is not None and (hops[0] < 0 or (hops[1] is not None and hops[1] < hops[0])):
        raise ValueError(f"not a range of hops: {hops}")
    return Rel(name, types, direction, hops, props)


def out(name: str | None = None, /, *types: str, **more: Any) -> Rel:
    return rel(name, *types, direction="out", **more)


def into(name: str | None = None, /, *types: str, **more: Any) -> Rel:
    return rel(name, *types, direction="in", **more)


def undirected(name: str | None = None, /, *types: str, **more: Any) -> Rel:
    return rel(name, *types, direction="both", **more)


def shortest(name: str | None = None, /, *types: str, hops: tuple[int, int | None] = (1, None), every: bool = False, direction: Direction = "out", **props: Any) -> Rel:
    """shortestPath (with ``every``: allShortestPaths) between the nodes on both sides."""
    if hops[0] not in (0, 1):
        raise ValueError("shortest paths begin at 0 or 1 edges")
    return replace(rel(name, *types, direction=direction, hops=hops, **props), shortest="all" if every else "one")


def equals(column: Column, value: Any) -> Column:
    """An inline property: equality with a typed literal; a list means the whole array."""
    if isinstance(value, (list, tuple)):
        return column == F.array(*[F.lit(v) for v in value])
    return column == F.lit(value)


def filtered(df: DataFrame, spec: Node | Rel) -> DataFrame:
    """Rows of a frame with the element's properties and conditions; a property that the
    frame hasn't is never equal."""
    for k, v in spec.props.items():
        df = df.where(equals(F.col(f"`{k}`"), v) if k in df.columns else F.lit(False))
    for c in spec.conditions:
        df = df.where(c if isinstance(c, str) else c(df))
    return df
