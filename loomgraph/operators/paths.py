"""Paths: expansion over several hops, closure, shortest paths and fixpoints.

All work on an edge frame (eid, src, dst[, type]) level by level: a level is one join of
the frontier with the edges on ``src``.  An edge is told by its type and eid together.
Frontiers, edges and what was seen all grow with the graph, so none is broadcast.
Searches without a bound write each level to the shared folder, so lineage doesn't grow
with depth and a lost executor reads files.  The rows of what is written are counted from
the files, and the next level is dealt over tasks by that count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import durable, join_parts, joined, parts_for

#: Levels that are left in one plan; further ones are written as they are made.
PLAN_LEVELS = 4
#: Levels after which what was seen is written anew as one table.
COMPACT = 8

_RELS = "array<struct<type:string,eid:bigint>>"
_PATH = ("start", "end", "depth", "eids", "rels", "nodes")


def directed(edges: DataFrame, direction: str = "out") -> DataFrame:
    """``edges`` seen along ``direction``; undirected edges both ways, loops once."""
    if direction == "out":
        return edges
    turned = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return turned if direction == "in" else edges.unionByName(turned.where("src <> dst"))


def _hops(edges: DataFrame, direction: str) -> DataFrame:
    """(_src, _dst, _rel) along ``direction``; edges without a type have the empty one."""
    kind = F.col("type") if "type" in edges.columns else F.lit("")
    rel = F.struct(kind.cast("string").alias("type"), F.col("eid").cast("long").alias("eid"))
    return directed(edges.select("src", "dst", rel.alias("_rel")), direction).select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), "_rel")


def _starts(seeds: DataFrame, parts: int | None = None) -> DataFrame:
    start = seeds.select(F.col("id").cast("long").alias("start")).where("start is not null")
    return (start.repartition(parts, "start") if parts else start).distinct()


def _step(front: DataFrame, hop: DataFrame, parts: int | None = None) -> DataFrame:
    """One hop further, dealt over ``parts`` where rows are counted and many."""
    if parts:
        front, hop = front.repartition(parts, "end"), hop.repartition(parts, "_src")
    return joined(front, hop, F.col("end") == F.col("_src"))


def _union(levels: list[DataFrame]) -> DataFrame:
    found = levels[0]
    for more in levels[1:]:
        found = found.union(more)
    return found


def counted(high: int | None) -> bool:
    """Whether ``expand`` up to ``high`` edges writes its levels, so that their rows can be
    counted from the files."""
    return high is None or high >= PLAN_LEVELS


def expand(edges: DataFrame, seeds: DataFrame, low: int = 1, high: int | None = None, direction: str = "out", mode: str = "trail") -> DataFrame:
    """(start, end, depth, eids, rels, nodes): every path of ``low`` to ``high`` edges from
    ``seeds`` (id).  ``rels`` are its edges as (type, eid), ``nodes`` the ids it goes by.

    Trails use no edge twice; walks may, and then need an upper bound.  A bag: each path
    is a row.  Use ``walk_counts`` where only their number matters."""
    if mode not in ("trail", "walk"):
        raise ValueError(f"unknown path mode {mode}")
    if high is None and mode == "walk":
        raise ValueError("walks without an upper bound don't end")
    spark, written = edges.sparkSession, counted(high)
    hop, hops, rows = _hops(edges, direction), 0, 0
    if written:
        hop = durable(hop, "hops")
        hops = hop.count()
    shown = lambda df: df.select("start", "end", "depth", F.col("rels.eid").alias("eids"), "rels", "nodes")
    front = _starts(seeds, parts_for(spark, hops) if written else None).withColumns({"end": F.col("start"), "depth": F.lit(0), "rels": F.array().cast(_RELS), "nodes": F.array("start")})
    if written:
        front = durable(front, "paths")
        rows = front.count()
    levels, depth = [front] if low == 0 else [], 0
    while high is None or depth < high:
        depth += 1
        # Rows widen with each edge.
        met = _step(front, hop, join_parts(spark, max(rows * (1 + (depth - 1) // 4), hops)))
        if mode == "trail":
            met = met.where(~F.array_contains("rels", F.col("_rel")))
        front = met.select("start", F.col("_dst").alias("end"), F.lit(depth).alias("depth"), F.array_append("rels", F.col("_rel")).alias("rels"), F.array_append("nodes", F.col("_dst")).alias("nodes"))
        if written:
            front = durable(front, "paths")
            rows = front.count()
            if not rows:
                break
        if depth >= low:
            levels.append(front)
    return shown(_union(levels) if levels else front.limit(0))


def _pairs(edges: DataFrame, direction: str) -> tuple[DataFrame, int, float]:
    """(_src, _dst, _n): the edges' ends with their number, written; rows; rows a source."""
    ends = directed(edges.select("src", "dst"), direction).select(F.col("src").alias("_src"), F.col("dst").alias("_dst")).where("_src is not null")
    parts = parts_for(ends.sparkSession, ends.count())
    hop = durable(ends.repartition(parts, "_src", "_dst").groupBy("_src", "_dst").agg(F.count(F.lit(1)).alias("_n")), "hops")
    rows, sources = hop.agg(F.count(F.lit(1)), F.approx_count_distinct("_src")).first()
    return hop, rows, rows / max(1, sources)


def _further(front: DataFrame, rows: int, hop: DataFrame, hops: int, degree: float, *told: Column) -> DataFrame:
    """(start, end, ...): a level's pairs taken one hop further and grouped.

    How many rows that makes is reckoned from the mean degree.  Where hubs make more, tasks
    are larger and Spark spills them."""
    spark = hop.sparkSession
    met = _step(front, hop, join_parts(spark, max(rows, hops))).withColumn("end", F.col("_dst"))
    met = met.repartition(parts_for(spark, int(rows * degree)), "start", "end")
    return met.groupBy("start", "end").agg(*told) if told else met.select("start", "end").distinct()


def walk_counts(edges: DataFrame, seeds: DataFrame, low: int, high: int, direction: str = "out") -> DataFrame:
    """(start, end, depth, n): how many walks of each length join two nodes.

    Each level is aggregated before the next, so rows stay at pairs of nodes where the
    walks themselves would grow with the power of the degree.  Use ``walk_totals`` where
    their ends don't matter."""
    hop, hops, degree = _pairs(edges, direction)
    front = durable(_starts(seeds, parts_for(hop.sparkSession, hops)).withColumns({"end": F.col("start"), "n": F.lit(1).cast("long")}), "walks")
    levels = []
    for depth in range(1, high + 1):
        front = _further(front, front.count(), hop, hops, degree, F.sum(F.col("n") * F.col("_n")).alias("n"))
        front = durable(front, "walks") if depth < high else front
        if depth >= low:
            levels.append(front.select("start", "end", F.lit(depth).alias("depth"), "n"))
    return _union(levels)


def walk_totals(edges: DataFrame, low: int, high: int, direction: str = "out") -> DataFrame:
    """(start, depth, n): how many walks of ``low`` to ``high`` edges begin at each node.

    A node's walks of some length are its neighbours' walks of one edge less, added up: a
    level has a row for each node, not for each pair of ends."""
    hop = directed(edges.select("src", "dst"), direction).select(F.col("src").alias("_src"), F.col("dst").alias("_dst")).where("_src is not null")
    parts = parts_for(hop.sparkSession, hop.count())
    summed = lambda df, n: df.repartition(parts, "_src").groupBy(F.col("_src").alias("start")).agg(n.alias("n"))
    to, levels = hop.repartition(parts, "_dst"), []
    for depth in range(1, high + 1):
        if depth == 1:
            level = summed(hop, F.count(F.lit(1)))
        else:
            level = summed(joined(to, level, F.col("_dst") == F.col("start")).select("_src", "n"), F.sum("n"))
        if depth % PLAN_LEVELS == 0 and depth < high:
            level = durable(level, "walks").repartition(parts, "start")
        if depth >= low:
            levels.append(level.select("start", F.lit(depth).alias("depth"), "n"))
    return _union(levels)


def closure(edges: DataFrame, high: int, direction: str = "out") -> DataFrame:
    """(idl, idr, depth): pairs joined by a walk of ``depth`` edges, each once, up to ``high``."""
    hop, hops, degree = _pairs(edges, direction)
    front, levels = hop.select(F.col("_src").cast("long").alias("start"), F.col("_dst").alias("end")), []
    for depth in range(1, high + 1):
        if depth > 1:
            front = _further(front, front.count(), hop, hops, degree)
            front = durable(front, "closure") if depth < high else front
        levels.append(front.select(F.col("start").alias("idl"), F.col("end").alias("idr"), F.lit(depth).alias("depth")))
    return _union(levels)


class _Seen:
    """What a search has met: the levels' tables, written as one every few levels, so that
    an anti join reads few files however deep the search is."""

    def __init__(self, first: DataFrame | None = None):
        self.df, self.parts = first, 1

    def add(self, more: DataFrame) -> None:
        self.df, self.parts = (more, 1) if self.df is None else (self.df.union(more), self.parts + 1)
        if self.parts > COMPACT:
            self.df, self.parts = durable(self.df, "seen"), 1

    def new(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows if self.df is None else joined(rows, self.df, keys, how="left_anti").select(*rows.columns)


def shortest_paths(edges: DataFrame, seeds: DataFrame, targets: DataFrame | None = None, low: int = 1, high: int | None = None, direction: str = "out", allow_self: bool = False, ways: bool = True) -> DataFrame:
    """(start, end, depth, n_paths, path, rels): for each start in ``seeds`` (id) and each
    node reached, the smallest number of edges, how many shortest paths there are, and the
    one whose nodes come first in order, with its edges as (type, eid), of parallel ones
    the first.

    Breadth first from all seeds at once; pairs seen before drop out by an anti join.
    ``targets`` (id) restricts the ends.  ``low`` is 0 (a start is its own end) or 1;
    ``allow_self`` also reports the shortest way back to the start.  Without ``ways`` path
    and rels are left out, and levels are numbers alone.
    """
    if low not in (0, 1):
        raise ValueError("shortest paths begin at 0 or 1 edges")
    spark = edges.sparkSession
    hop = durable(_hops(edges, direction).groupBy("_src", "_dst").agg(F.count(F.lit(1)).alias("_n"), F.min("_rel").alias("_rel")), "hops")
    hops, sources = hop.agg(F.count(F.lit(1)), F.approx_count_distinct("_src")).first()
    start = durable(_starts(seeds, parts_for(spark, hops)), "starts")
    rows = met_rows = start.count()
    front = start.select("start", F.col("start").alias("end"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("n_paths"), F.array("start").alias("path"), F.array().cast(_RELS).alias("rels"))
    front = front if ways else front.drop("path", "rels")
    origin = front
    seen, found, depth = _Seen(None if allow_self else front.select("start", "end")), None, 0
    while high is None or depth < high:
        depth += 1
        way = F.struct("path", F.array_append("rels", F.col("_rel")).alias("rels"))
        told = [F.sum(F.col("n_paths") * F.col("_n")).alias("n_paths"), *([F.min(way).alias("way")] if ways else [])]
        met = _step(front, hop, join_parts(spark, max(rows * (1 + (depth - 1) // 4 * ways), hops)))
        met = met.repartition(parts_for(spark, max(rows * hops // max(1, sources), met_rows)), "start", "_dst").groupBy("start", F.col("_dst").alias("to")).agg(*told)
        path = [F.array_append("way.path", F.col("to")).alias("path"), F.col("way.rels").alias("rels")] if ways else []
        met = met.select("start", F.col("to").alias("end"), F.lit(depth).alias("depth"), "n_paths", *path)
        front = durable(seen.new(met, ["start", "end"]), "frontier")
        rows = front.count()
        if not rows:
            break
        met_rows += rows
        seen.add(front.select("start", "end"))
        found = front if found is None else found.union(front)
    if low == 0:
        found = origin if found is None else joined(found, start.withColumn("end", F.col("start")), ["start", "end"], how="left_anti").select(*origin.columns).union(origin)
    found = front.limit(0) if found is None else found
    return found if targets is None else joined(found, targets.select(F.col("id").cast("long").alias("end")).distinct(), ["end"], how="left_semi").select(*origin.columns)


def all_shortest_paths(edges: DataFrame, seeds: DataFrame, targets: DataFrame | None = None, low: int = 1, high: int | None = None, direction: str = "out") -> DataFrame:
    """(start, end, depth, path, rels): every shortest path as its nodes and its edges in
    order, parallel edges giving a row each.

    Walks back from the wanted ends over the levels of the search, so nothing is expanded
    that isn't on a shortest path."""
    reached = shortest_paths(edges, seeds, None, low, high, direction, ways=False)
    levels = durable(reached.select("start", F.col("end").alias("via"), F.col("depth").alias("at")).union(_starts(seeds).select("start", F.col("start").alias("via"), F.lit(0).alias("at"))).distinct(), "levels")
    wanted = reached if targets is None else joined(reached, targets.select(F.col("id").cast("long").alias("end")).distinct(), ["end"], how="left_semi")
    open_ = durable(wanted.select("start", "end", "depth", F.col("depth").alias("left"), F.array("end").alias("path"), F.array().cast(_RELS).alias("rels")), "wanted")
    back = _hops(edges, direction)
    done = open_.where("left = 0")
    open_ = open_.where("left > 0")
    while not open_.isEmpty():
        step = joined(open_, back, F.element_at("path", 1) == F.col("_dst"))
        step = joined(step, levels, (step["start"] == levels["start"]) & (F.col("_src") == F.col("via")) & (F.col("at") == F.col("left") - 1))
        step = step.select(open_["start"], "end", "depth", (F.col("left") - 1).alias("left"), F.array_prepend("path", F.col("_src")).alias("path"), F.array_prepend("rels", F.col("_rel")).alias("rels"))
        step = durable(step, "way-back")
        done, open_ = done.union(step.where("left = 0")), step.where("left > 0")
    return done.select("start", "end", "depth", "path", "rels")


def iterate(first: DataFrame, step: Callable[[DataFrame], DataFrame], collect: list[str | Column], on: str = "id", max_rounds: int | None = None) -> DataFrame:
    """Fixpoint: applies ``step`` to a frontier of ids until it gives nothing new.

    ``first`` holds the ids to begin with (column ``on``); ``step`` takes a frame of ids
    and returns rows with the next ids in ``on`` and whatever is to be collected.  All
    rows of all rounds are returned as a bag, as ``collect`` projects them; the next
    frontier is the ids not seen before, so cycles end."""
    front = durable(first.select(F.col(on).alias("id")).where("id is not null").distinct(), "frontier")
    seen, found, rounds = _Seen(front), None, 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        rows = durable(step(front), "step")
        own = rows.select(*collect)
        found = own if found is None else found.union(own)
        front = durable(seen.new(rows.select(F.col(on).alias("id")).where("id is not null").distinct(), ["id"]), "frontier")
        if front.isEmpty():
            break
        seen.add(front)
    return found
