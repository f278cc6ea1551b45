"""What one task holds doesn't grow with the data: searches are dealt by counted rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph import PropertyGraph, node, out, tables
from loomgraph.operators import paths
from loomgraph.plans import catalogue
from tests.test_graph import bag
from tests.test_oracle import DATA


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 50)


def ring(spark, n):
    """Each of ``n`` nodes has edges to the next two."""
    return spark.range(n).select(F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("eid")).select("eid", (F.col("eid") / 2).cast("long").alias("src"), (((F.col("eid") / 2).cast("long") + F.col("eid") % 2 + 1) % n).alias("dst"))


def odd_edges(spark):
    """Parallel edges, loops, dead ends and missing ends."""
    some = random.Random(11)
    pairs = [(some.randrange(8), some.randrange(10)) for _ in range(30)] + [(3, 3), (3, 3), (None, 1), (1, None)]
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "eid long, src long, dst long")


@pytest.mark.parametrize("direction", ["out", "in", "both"])
def test_walks_are_added_up_from_their_ends(spark, direction):
    edges = odd_edges(spark)
    ends = paths.walk_counts(edges, spark.range(10), 1, 6, direction)
    assert bag(paths.walk_totals(edges, 1, 6, direction)) == bag(ends.groupBy("start", "depth").agg(F.sum("n").alias("n")))


def test_walk_levels_hold_a_row_for_each_node(spark):
    """Counts of walks are not made over pairs of a start and an end."""
    plan = catalogue.queries()["walks_of_two_to_four"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    groups = [line.partition("Aggregate [")[2].partition("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert groups and all("," not in g for g in groups)


def test_walk_totals_are_dealt_by_rows(spark, small_tasks):
    for n in (100, 400):
        assert paths.walk_totals(ring(spark, n), 2, 2).rdd.getNumPartitions() == n * 2 // 50


@pytest.mark.parametrize("direction", ["out", "in", "both"])
def test_closure_has_each_pair_once(spark, small_tasks, direction):
    stored = [(r.src, r.dst) for r in odd_edges(spark).collect()]
    hops = {"out": stored, "in": [(b, a) for a, b in stored], "both": stored + [(b, a) for a, b in stored]}[direction]
    hops = {(a, b) for a, b in hops if a is not None}
    level, want = hops, Counter()
    for depth in range(1, 6):
        want.update({(a, b, depth): 1 for a, b in level})
        level = {(a, c) for a, b in level for s, c in hops if s == b}
    assert bag(paths.closure(odd_edges(spark), 5, direction)) == want


def test_closure_is_dealt_by_rows(spark, small_tasks):
    """The last level, of about four pairs for each node, and those before it."""
    for n in (100, 400):
        assert paths.closure(ring(spark, n), 2).where("depth = 2").rdd.getNumPartitions() >= n * 4 // 50


@pytest.mark.parametrize("mode", ["trail", "walk"])
def test_long_paths_have_each_path_once(spark, small_tasks, mode):
    edges = odd_edges(spark).where("eid % 3 > 0")
    hops = [(r.eid, r.src, r.dst) for r in edges.collect()]
    level, want = [(s, s, ()) for s in range(10)], Counter()
    for _ in range(5):
        level = [(s, b, (*used, e)) for s, at, used in level for e, a, b in hops if a == at and (mode == "walk" or e not in used)]
        want.update(level)
    assert Counter((r.start, r.end, tuple(r.eids)) for r in paths.expand(edges, spark.range(10), 1, 5, mode=mode).collect()) == want


def test_long_paths_are_dealt_by_rows(spark, small_tasks):
    """The search's levels, and the joins of what it finds with both its ends."""
    n = 400
    g = PropertyGraph.of(spark, {"N": spark.range(n).withColumn("size", F.col("id") % 7)}, {"E": ring(spark, n).where("eid % 2 = 0")}, small=())
    found = g.match(node("a", "N"), out("p", "E", hops=(1, 4)), node("b", "N")).select("a.size", "p.depth", F.col("b.size").alias("other"))
    assert bag(found) == Counter((k % 7, d, (k + d) % n % 7) for k in range(n) for d in range(1, 5))
    assert found.rdd.getNumPartitions() >= n * 4 // 50
    files = paths.expand(g.edges("E"), spark.range(n), 1, 4).withColumn("file", F.input_file_name()).groupBy("depth").agg(F.countDistinct("file").alias("n"))
    assert min(r.n for r in files.collect()) >= n // 50


@pytest.mark.parametrize("ways", [True, False])
def test_shortest_paths_are_dealt_by_rows(spark, small_tasks, ways):
    n = 400
    found = paths.shortest_paths(ring(spark, n), spark.range(n), high=2, ways=ways)
    ends = ((1, 1, 1), (2, 1, 1), (3, 2, 2), (4, 2, 1))
    assert bag(found.select("start", "end", "depth", "n_paths")) == Counter((k, (k + far) % n, depth, ways_there) for k in range(n) for far, depth, ways_there in ends)
    files = found.withColumn("file", F.input_file_name()).groupBy("depth").agg(F.countDistinct("file").alias("n"))
    assert min(r.n for r in files.collect()) >= n // 50
