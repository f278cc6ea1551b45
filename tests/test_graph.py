"""Semantics on micro graphs, ingest, updates, generation, results and timing."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph import PropertyGraph, node, out, shortest, undirected
from loomgraph import functions as G
from loomgraph.checks import difference, same_rows, time_query, write_report
from loomgraph.operators import paths, results, updates
from loomgraph.operators.counts import match_counts
from loomgraph.operators.match import extend, optional_match, where_exists
from loomgraph.pattern import into, rel
from loomgraph.sources import dump, files
from loomgraph.sources.generate import web_graph
from loomgraph.streaming import ingest_dumps


def graph(spark, edges, n=None, labels="N"):
    n = n or max(max(e) for e in edges) + 1
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(n)], "id long, name string")
    rows = [(k, a, b, k % 2) for k, (a, b) in enumerate(edges)]
    return PropertyGraph.of(spark, {labels: nodes}, {"E": spark.createDataFrame(rows, "eid long, src long, dst long, kind int")})


def bag(df):
    return Counter(tuple(r) for r in df.collect())


# ------------------------------------------------------------------- patterns
def test_parallel_edges_and_loops(spark):
    g = graph(spark, [(0, 1), (0, 1), (1, 1), (1, 2)])
    two = g.match(node("a"), out("e"), node("b"), out("f"), node("c"))
    assert bag(two.select("a.id", "b.id", "c.id")) == {(0, 1, 1): 2, (0, 1, 2): 2, (1, 1, 2): 1}
    again = g.match(node("a"), out("e"), node("b"), out("f"), node("c"), uniqueness="none")
    assert again.count() == 6
    assert g.match(node("a"), undirected("e"), node("b")).count() == 7  # the loop comes once
    there = g.match(node("a"), undirected("e"), node("b"), undirected("f"), node("a"))
    assert bag(there.select("a.id", "b.id"))[0, 1] == 2


def test_direction_is_kept_in_the_edge(spark):
    g = graph(spark, [(0, 1)])
    assert g.match(node("a"), into("e"), node("b")).select("a.id", "b.id", "e.src", "e.dst", "e.type").first() == (1, 0, 0, 1, "E")


def test_triangle_and_shared_variables(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3)])
    m = g.match(node("a"), out(), node("b"), out(), node("c"), out(), node("a"))
    assert bag(m.select("a.id", "b.id", "c.id")) == {(0, 1, 2): 1, (1, 2, 0): 1, (2, 0, 1): 1}
    m = g.match((node("a"), out(), node("b")), (node("c"), out(), node("b")), uniqueness="none")
    assert m.where("a.id <> c.id").count() == 0
    m = g.match((node("a", name="n0"), out(), node("b")), (node("c"), out(), node("a")))
    assert bag(m.select("a.id", "b.id", "c.id")) == {(0, 1, 2): 1}


def test_labels_are_exact_and_case_is_ignored(spark):
    frame = lambda *ids: spark.createDataFrame([(i, f"p{i}") for i in ids], "id long, name string")
    g = PropertyGraph.of(spark, {"Owner": frame(1), "CoOwner": frame(2), ("Owner", "Programmer"): frame(3)}, {"T": spark.createDataFrame([(1, 2)], "src long, dst long")})
    ids = lambda *labels: sorted(r.id for r in g.nodes(*labels).collect())
    assert (ids("owner"), ids("CoOwner"), ids("Programmer", "OWNER"), ids("Gone")) == ([1, 3], [2], [3], [])
    m = g.match((node("a", "Owner"),), (node("a", "Programmer"),))
    assert [r[0] for r in m.select("a.id").collect()] == [3]
    assert g.match(node("a"), out("t", "t"), node("b", "CoOwner")).count() == 1
    assert g.match(node("n")).where(G.has_labels("n", "owner", "programmer")).count() == 1


def test_missing_properties_and_dangling_ends(spark):
    g = graph(spark, [(0, 1), (0, 9)], n=2)
    assert g.match(node("a"), out(), node("b")).count() == 1
    assert g.match(node("a", nothing=1)).count() == 0
    assert g.match(node("a"), out("e", kind=1), node(None)).count() == 0


def test_optional_and_exists(spark):
    g = graph(spark, [(0, 1), (0, 2)])
    m = optional_match(g, g.match(node("a")), node("a"), out(), node("b"))
    assert bag(m.select("a.id", "b.id")) == {(0, 1): 1, (0, 2): 1, (1, None): 1, (2, None): 1}
    assert bag(m.groupBy("a.id").agg(results.count_of("b").alias("n"))) == {(0, 2): 1, (1, 0): 1, (2, 0): 1}
    assert bag(where_exists(g, g.match(node("a")), node("a"), out(), node(), negate=True).select("a.id")) == {(1,): 1, (2,): 1}


def test_malformed_patterns(spark):
    g = graph(spark, [(0, 1)])
    for bad in ((node("a"), out()), (out(),), (node("a"), node("b"))):
        with pytest.raises(ValueError):
            g.match(*bad)
    with pytest.raises(ValueError):
        rel(hops=(3, 2))
    with pytest.raises(ValueError):
        g.match(node("a"), uniqueness="odd")


# ---------------------------------------------------------------------- paths
def brute_trails(edges, start, low, high):
    found, front = Counter(), [(start, ())]
    for depth in range(1, high + 1):
        front = [(b, (*used, k)) for at, used in front for k, (a, b) in enumerate(edges) if a == at and k not in used]
        if depth >= low:
            found.update((end, depth) for end, _ in front)
    return found


def test_trails_and_walks(spark):
    edges = [(0, 1), (1, 0), (1, 2), (2, 0), (0, 1), (2, 2)]
    g = graph(spark, edges)
    seeds = g.nodes().where("id = 0").select("id")
    got = paths.expand(g.edges(), seeds, 1, None)
    assert bag(got.select("end", "depth")) == brute_trails(edges, 0, 1, 6)
    m = g.match(node("a", name="n0"), out("p", hops=(2, 4)), node("b"))
    assert bag(m.select("b.id", "p.depth")) == brute_trails(edges, 0, 2, 4)
    walks = paths.expand(g.edges(), seeds, 1, 6, mode="walk").groupBy("start", "end", "depth").agg(F.count("*").alias("n"))
    assert same_rows(walks, paths.walk_counts(g.edges(), seeds, 1, 6))
    assert bag(paths.expand(g.edges(), seeds, 0, 0).select("end", "depth")) == {(0, 0): 1}
    with pytest.raises(ValueError):
        paths.expand(g.edges(), seeds, 1, None, mode="walk")
    # Edges before a path aren't used again within it.
    m = g.match(node("a", name="n0"), out("e"), node("b"), out("p", hops=(1, 3)), node("c"))
    assert m.where(F.array_contains("p.eids", F.col("e.eid"))).count() == 0


def test_shortest_paths(spark):
    g = graph(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 0), (2, 3), (6, 7)], n=8)
    seeds = g.nodes().where("id in (0, 6)").select("id")
    got = {(r.start, r.end): (r.depth, r.n_paths, r.path) for r in paths.shortest_paths(g.edges(), seeds).collect()}
    assert got == {(0, 1): (1, 1, [0, 1]), (0, 2): (1, 1, [0, 2]), (0, 3): (2, 3, [0, 1, 3]), (0, 4): (3, 3, [0, 1, 3, 4]), (6, 7): (1, 1, [6, 7])}
    assert paths.shortest_paths(g.edges(), seeds, high=1).count() == 3
    assert paths.shortest_paths(g.edges(), seeds, low=0).where("start = end").count() == 2
    assert paths.shortest_paths(g.edges(), seeds, allow_self=True).where("start = end").select("depth").collect() == [(4,)]
    every = paths.all_shortest_paths(g.edges(), seeds, g.nodes().where("id >= 3").select("id"))
    assert Counter(tuple(r.path) for r in every.collect()) == {(0, 1, 3): 1, (0, 2, 3): 2, (0, 1, 3, 4): 1, (0, 2, 3, 4): 2, (6, 7): 1}
    undirected_ = paths.shortest_paths(g.edges(), g.nodes().where("id = 4").select("id"), direction="both")
    assert {r.end: r.depth for r in undirected_.collect()} == {0: 1, 3: 1, 1: 2, 2: 2}
    with pytest.raises(ValueError):
        paths.shortest_paths(g.edges(), seeds, low=2)


def test_iterate_ends_on_cycles(spark):
    g = graph(spark, [(0, 1), (1, 0), (1, 2)])
    edges = g.edges()
    found = paths.iterate(g.nodes().where("id = 0"), lambda f: f.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "eid"), ["id", "eid"])
    assert bag(found) == {(1, 0): 1, (0, 1): 1, (2, 2): 1}
    assert bag(paths.closure(edges, 2)) == {(0, 1, 1): 1, (1, 0, 1): 1, (1, 2, 1): 1, (0, 0, 2): 1, (0, 2, 2): 1, (1, 1, 2): 1}


# -------------------------------------------------------------------- updates
def test_updates_leave_the_graph_alone(spark):
    g = graph(spark, [(0, 1), (1, 2)])
    new = updates.create(g, node("a", "N", name="x"), out("e", "E", kind=7), node("b", "M"), into("f", "F"), node("a"))
    assert (g.nodes().count(), new.nodes().count(), new.edges().count()) == (3, 5, 4)
    assert bag(new.match(node("a", "N"), out("e", "E", kind=7), node("b", "M")).select("a.id", "b.id", "a.name")) == {(3, 4, "x"): 1}
    assert new.match(node("a", "N", name="x"), out(None, "F"), node("b", "M")).count() == 1
    less = updates.delete_nodes(g, node("n", "N", name="n1"))
    assert (less.nodes().count(), less.edges().count(), g.edges().count()) == (2, 0, 2)
    with pytest.raises(Exception, match="detach"):
        updates.delete_nodes(g, node("n", "N", name="n1"), detach=False).nodes().collect()
    assert updates.delete_nodes(updates.delete_edges(g, "E"), node("n", "N"), detach=False).nodes().count() == 0
    changed = updates.foreach_set(g, g.nodes().where("id > 0"), "name", "seen")
    assert bag(changed.nodes().select("id", "name")) == {(0, "n0"): 1, (1, "seen"): 1, (2, "seen"): 1}
    marked = updates.set_edge_property(g, "E", "weight", lambda e: e["kind"] + 1, where=lambda e: e["kind"] == 1)
    assert bag(marked.edges().select("kind", "weight")) == {(0, None): 1, (1, 2): 1}
    assert updates.merge_node(g, node(None, "N", name="n1")).nodes().count() == 3
    assert updates.merge_node(g, node(None, "N", name="new")).nodes("N").where("name = 'new' and id = 3").count() == 1


# -------------------------------------------------------------------- sources
DUMP = """create (_0:`Owner`:`Programmer` {`surname`:"O'Ha
ll", `pets`:0, `cars`:3})
create (_1:`Website` {`host`:"a{b}c", `domain`:"com", `big`:5000000000})

create (_2:`Website` {`host`:"create it", `tags`:["x", "y"], `rank`:1.5, `open`:true})
create (_3:`Website`)
create (_0)-[:`OWNS` {`salary`:3000000}]->(_1)
create (_1)-[:`LINKED_TO`]->(_2);
"""


def test_dump(spark, tmp_path):
    path = tmp_path / "in" / "graph.txt"
    path.parent.mkdir()
    path.write_text(DUMP)
    g = dump.read_dump(spark, str(path))
    assert path.exists() and g.labels == {"Owner", "Programmer", "Website"} and g.types == {"OWNS", "LINKED_TO"}
    assert bag(g.nodes("Owner").select("id", "surname", "pets", "cars")) == {(0, "O'Ha ll", 0, 3): 1}
    kinds = {f.name: f.dataType.simpleString() for f in g.node_schema("Website")}
    assert (kinds["big"], kinds["tags"], kinds["rank"], kinds["open"], kinds["host"]) == ("bigint", "array<string>", "double", "boolean", "string")
    assert [tuple(r) for r in g.nodes("Website").orderBy("id").select("id", "host", "tags").collect()] == [(1, "a{b}c", None), (2, "create it", ["x", "y"]), (3, None, None)]
    assert g.match(node("a", "Owner"), out("e", "OWNS"), node("b", "Website"), out(), node("c")).select("e.salary", "c.id").first() == (3000000, 2)
    assert g.match(node("n", "Website", tags=["x", "y"])).count() == 1
    folded = dump.read_dump(spark, str(path), fold_case=True, overrides={"pets": "string"})
    assert folded.labels == {"owner", "programmer", "website"} and dict(folded.nodes("owner").dtypes)["pets"] == "string"
    path.write_text(DUMP + "create nonsense\n")
    with pytest.raises(ValueError, match="nonsense"):
        dump.read_dump(spark, str(path))
    query = ingest_dumps(spark, str(path.parent), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/nodes").count() == 4 and spark.read.parquet(f"{tmp_path}/out/edges").count() == 2


def test_csv_and_parquet(spark, tmp_path):
    g = web_graph(spark, 300, "sparse")
    files.write_csv_graph(g, f"{tmp_path}/csv")
    back = files.read_csv_graph(
        spark, f"{tmp_path}/csv", {"Website": ("nodes/Website", "webID long, host string, domain string")}, {"LINKED_TO": ("edges/LINKED_TO", "sourceID long, destID long, popularity long, eid long")}
    )
    assert same_rows(back.nodes("Website"), g.nodes("Website")) and same_rows(back.edges("LINKED_TO"), g.edges("LINKED_TO"))
    files.save_graph(g, f"{tmp_path}/pq", buckets=2)
    loaded = files.load_graph(spark, f"{tmp_path}/pq")
    assert same_rows(loaded.nodes(), g.nodes()) and same_rows(loaded.edges(), g.edges())


def test_generated_graph(spark):
    g = web_graph(spark, 2_000, "regular", seed=3)
    assert {tuple(sorted(k)): df.count() for k, df in g.node_frames.items()} == {("Website",): 1400, ("Programmer",): 440, ("Owner",): 100, ("Owner", "Programmer"): 60}
    edges = g.edges()
    assert edges.where("src = dst").count() == 0 and edges.groupBy("src", "dst").count().where("count > 1").count() == 0
    assert 0.85 * 2_000 * 13.49 <= edges.count() <= 2_000 * 13.49
    assert same_rows(edges, web_graph(spark, 2_000, "regular", seed=3).edges())
    degree = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count().agg(F.max("count"), F.avg("count")).first()
    assert degree[0] > 4 * degree[1]  # chosen by degree
    assert g.match(node("a", "Website"), out("e"), node("b")).where("e.type <> 'LINKED_TO'").count() == 0
    assert g.match(node("a"), out("e", "EMPLOYS"), node("b")).where(~G.has_labels("a", "Owner") | ~G.has_labels("b", "Programmer")).count() == 0
    # Programmers aren't friends of owners; of people who are both, half own their websites.
    friends = g.match(node("a"), out("e", "FRIENDS"), node("b"))
    assert friends.count() > 0 and friends.where(~((G.has_labels("a", "Programmer") & G.has_labels("b", "Programmer")) | (G.has_labels("a", "Owner") & G.has_labels("b", "Owner")))).count() == 0
    own = bag(g.match(node("a", "Owner", "Programmer"), out("e"), node("b", "Website")).select("e.type"))
    assert set(own) == {("OWNS",), ("CODES_FOR",)} and 0.4 < own["OWNS",] / sum(own.values()) < 0.6


# ----------------------------------------------------------- results and checks
def test_results_and_checks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None, [1, 2]), (2, None, 3.5, None)], "id long, name string, x double, l array<int>")
    assert files.write_results(df, f"{tmp_path}/r") == 2
    text = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/r").collect())
    assert "name : a" in text and "l : [1,2]" in text and "NUM RECORDS : 2" in text and "id :" not in text
    twice = df.union(df.limit(1))
    assert difference(df, twice).count() == 1 and same_rows(twice, twice.select(*reversed(twice.columns)))
    timings = [time_query(spark, "one", lambda: df, 1, 2), time_query(spark, "bad", lambda: df.select("gone"), 0, 1)]
    assert len(timings[0].seconds) == 2 and timings[0].mean > 0 and "gone" in timings[1].error
    write_report(timings, f"{tmp_path}/report")
    assert (tmp_path / "report" / "report.csv").read_text().count("\n") == 3
    (tmp_path / "q.txt").write_text("one\n// two\n\nthree\n")
    assert list(files.read_query_file(str(tmp_path / "q.txt"))) == ["one", "three"]


def test_functions(spark):
    row = spark.range(1).select(F.array(*map(F.lit, [1, 2, 3, 4])).alias("l"), F.array().cast("array<int>").alias("e"), F.lit("12.7").alias("t"), F.lit("x").alias("w"))
    got = row.select(
        G.part("l", 1, -1), G.part("l", -2), G.part("l", 3, 1), G.at("l", -1), G.at("l", 9), G.head("e"), G.tail("l"), G.comprehension("l", lambda x: x > 2, lambda x: x * 10), G.some("l", lambda x: x == 3),
        G.to_integer("t"), G.to_integer("w"), G.to_integer(F.lit("-12.7")), G.to_float("w"), G.span(1, 5, 2), G.span(3, 1), G.span(3, 1, -1), G.case(None, (F.col("t") == "1", "a"), otherwise="b"), G.matches("t", "12"), G.size(F.lit(None).cast("array<int>")),
    ).first()
    assert list(got) == [[2, 3], [3, 4], [], 4, None, None, [2, 3, 4], [30, 40], True, 12, None, -12, None, [1, 3, 5], [], [3, 2, 1], "b", False, None]


# --------------------------------------------------------------- edge identity
def test_types_may_number_their_edges_alike(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id long")
    one = lambda a, b: spark.createDataFrame([(1, a, b)], "eid long, src long, dst long")
    g = PropertyGraph.of(spark, {"N": nodes}, {"E": one(0, 1), "F": one(1, 2), "G": one(2, 3)})
    assert g.match(node("a"), out(), node("b"), out(), node("c"), out(), node("d")).count() == 1
    assert g.match(node("a", "N"), out("p", hops=(1, None)), node("b")).count() == 6
    m = g.match(node("a"), out("e"), node("b"), out("p", hops=(1, 2)), node("c"))
    assert bag(m.select("a.id", "c.id")) == {(0, 2): 1, (0, 3): 1, (1, 3): 1}
    p = g.match(node("a"), out("p", hops=3), node("b")).select("p.*").first()
    assert (p.nodes, [tuple(r) for r in p.rels], p.eids) == ([0, 1, 2, 3], [("E", 1), ("F", 1), ("G", 1)], [1, 1, 1])
    m = g.match(node("a"), out("e"), node("b"), out("f"), node("c")).select(G.path_of("a", "e", "b", "f", "c").alias("p"))
    assert m.where(F.element_at(G.nodes("p"), 1) == 0).select("p.end", "p.depth").first() == (2, 2)


def test_equal_edges_without_ids_stay_several(spark, tmp_path):
    nodes = spark.createDataFrame([(i,) for i in range(3)], "id long")
    edges = spark.createDataFrame([(0, 1, "x"), (0, 1, "x"), (2, 1, "x"), (0, 1, None)], "src long, dst long, name string")
    g = PropertyGraph.of(spark, {"N": nodes}, {"E": edges})
    assert g.edges().select("eid").distinct().count() == 4 == g.edges().count()
    m = g.match(node("a"), out(), node("b"), into(), node("c"))
    assert bag(m.select("a.id", "c.id")) == {(0, 0): 6, (0, 2): 3, (2, 0): 3}
    twice = updates.add_edges(updates.add_edges(g, "E", edges), "E", edges)
    assert twice.edges().select("eid").distinct().count() == 12
    assert sorted(r.eid for r in twice.edges().collect()) == sorted(r.eid for r in twice.edges().collect())
    (tmp_path / "d.txt").write_text("create (_0)\ncreate (_1)\n" + "create (_0)-[:`E` {`w`:1}]->(_1)\n" * 2)
    assert dump.read_dump(spark, str(tmp_path / "d.txt")).edges().select("eid").distinct().count() == 2


# ---------------------------------------------------- conditions and bound rows
def test_conditions_in_patterns(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3)])
    m = g.match(node("a").where("id = 0"), out("p", hops=(1, 3)).where("kind = 0 or eid = 1"), node("b").where(lambda n: n["id"] > 1))
    assert bag(m.select("b.id", "p.depth")) == {(2, 2): 1, (3, 3): 1}
    # A second mention of a variable bound by its id alone, and one with an unknown property.
    h = PropertyGraph.of(spark, g.node_frames, g.edge_frames, {"E": ("N", "N")})
    m = h.match((node("a"), out(), node("b", fetch=False)), (node("b", "N", name="n1"),))
    assert bag(m.select("a.id", "b.id")) == {(0, 1): 1}
    assert h.match((node("a"), out(), node("b", fetch=False)), (node("b", nothing=1),)).count() == 0
    assert h.match((node("a"), out(), node("b")), (node("b", nothing=1),)).count() == 0
    assert h.match((node("a"), out(), node("b")), (node("b", "M"),)).count() == 0


def test_a_match_on_rows_starts_from_them(spark):
    g = graph(spark, [(0, 1), (0, 2), (2, 3)])
    m = g.match(node("a").where("id = 0"), out("e"), node("b"))
    more = extend(g, m.withColumn("k", F.lit(7)), node("b"), out("f"), node("c", "N"))
    assert bag(more.select("a.id", "b.id", "c.id", "k")) == {(0, 2, 3, 7): 1}
    assert bag(extend(g, m, node("x"), out("e"), node("b")).select("x.id", "b.id")) == {(0, 1): 1, (0, 2): 1}
    rows = optional_match(g, m, node("b"), out("f"), node("c"))
    assert bag(rows.select("b.id", "c.id")) == {(1, None): 1, (2, 3): 1}
    # A null variable matches nothing, and stays null.
    assert bag(extend(g, rows, node("c"), into(), node("d")).select("c.id", "d.id")) == {(3, 2): 1}
    again = optional_match(g, rows, node("c"), into("h"), node("d"))
    assert bag(again.select("b.id", "d.id")) == {(1, None): 1, (2, 2): 1} and again.where("c is null").count() == 1
    assert bag(where_exists(g, m, node("b", name="n2"), out(), node()).select("b.id")) == {(2,): 1}
    plan = optional_match(g, m, node("b"), out(), node("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("id") and "Aggregate" in plan  # from distinct bound ids
    with pytest.raises(ValueError):
        extend(g, m, node("x"), out(), node("y"))


def test_shortest_paths_in_patterns(spark):
    g = graph(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (2, 3)])
    m = g.match(node("a", name="n0"), shortest("p"), node("b").where("id >= 3"))
    assert {r.id: (r.depth, r.n_paths, r.nodes, [x.eid for x in r.rels]) for r in m.select("b.id", "p.*").collect()} == {3: (2, 3, [0, 1, 3], [0, 2]), 4: (3, 3, [0, 1, 3, 4], [0, 2, 4])}
    every = g.match(node("a", name="n0"), shortest("p", every=True, hops=(1, 2)), node("b", name="n3"))
    assert bag(every.select(F.array_join("p.eids", ","))) == {("0,2",): 1, ("1,3",): 1, ("1,5",): 1}
    m = g.match((node("a", name="n0"), out(), node("b", name="n2")), (node("a"), shortest("p"), node("b")))
    assert bag(m.select("p.depth")) == {(1,): 1}
    with pytest.raises(ValueError):
        shortest(hops=(2, 3))


# ------------------------------------------------------ updates by matched rows
def test_updates_by_matched_rows(spark):
    g = graph(spark, [(0, 1), (1, 2), (0, 2)])
    m = g.match(node("a"), out("e"), node("b"))
    less = updates.delete_matched(g, m.where("e.kind = 0"), "e")
    assert bag(less.edges().select("src", "dst")) == {(1, 2): 1} and less.nodes().count() == 3
    less = updates.delete_matched(g, m.where("b.id = 1"), "b")
    assert bag(less.edges().select("src", "dst")) == {(0, 2): 1} and less.nodes().count() == 2
    more = updates.create_matched(g, m, node("a"), out("s", "SAID", to=F.col("b.name")), node("w", "Word", text=F.concat("a.name", F.lit("!"))), into(None, "HEARD"), node("b"))
    said = more.match(node("a"), out("s", "SAID"), node("w", "Word"), into("h", "HEARD"), node("b"))
    assert bag(said.select("a.id", "b.id", "s.to", "w.text")) == {(0, 1, "n1", "n0!"): 1, (1, 2, "n2", "n1!"): 1, (0, 2, "n2", "n0!"): 1}
    assert more.nodes("Word").select("id").distinct().count() == 3 and more.nodes("Word").where("id < 3").count() == 0
    marked = updates.set_matched(updates.set_matched(g, m, "a", "top", F.col("b.id")), m.where("b.id = 2"), "e", "kind", 9)
    assert bag(marked.nodes().select("id", "top")) == {(0, 2): 1, (1, 2): 1, (2, None): 1}
    assert bag(marked.edges().select("eid", "kind")) == {(0, 0): 1, (1, 9): 1, (2, 9): 1}
    pairs = g.match((node("a").where("id < 2"),), (node("b").where("id > 0"),)).where("a.id <> b.id")
    merged = updates.merge_edges(g, pairs, "a", out(None, "E"), "b", on_create={"kind": 5}, on_match={"kind": 6})
    assert bag(merged.edges().select("src", "dst", "kind")) == {(0, 1, 6): 1, (0, 2, 6): 1, (1, 2, 6): 1}
    merged = updates.merge_edges(merged, pairs, "a", into(None, "E"), "b", on_create={"kind": 5})
    assert bag(merged.edges().where("kind = 5").select("src", "dst")) == {(1, 0): 1, (2, 0): 1, (2, 1): 1}


def test_exact_integers_and_whole_matches(spark):
    got = spark.range(1).select(*[G.to_integer(F.lit(t)) for t in ("9007199254740993", "-9223372036854775808", "9223372036854775808", " 7 ", "1e3", "-0.9", "", "1e400")], G.matches(F.lit("ab\n"), "ab"), G.matches(F.lit("ab"), "a|ab")).first()
    assert list(got) == [9007199254740993, -(2**63), None, 7, 1000, 0, None, None, False, True]


def test_dump_is_written_as_it_is_read(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 'a "q" \\ b', ["x", "y"], 1.5), (1, None, None, None)], "id long, name string, tags array<string>, w double")
    g = PropertyGraph.of(spark, {("A", "B"): nodes}, {"E": spark.createDataFrame([(0, 1, True), (0, 1, True), (1, 0, None)], "src long, dst long, ok boolean")})
    dump.write_dump(g, f"{tmp_path}/dump")
    back = dump.read_dump(spark, f"{tmp_path}/dump")
    assert bag(back.nodes("A", "B").select("id", "name", F.array_join("tags", ","), "w")) == {(0, 'a "q" \\ b', "x,y", 1.5): 1, (1, None, None, None): 1}
    assert bag(back.edges("E").select("src", "dst", "ok")) == {(0, 1, True): 2, (1, 0, None): 1}


# ------------------------------------------------------- counts and growing frames
def hub_graph(spark, many=30):
    """``many`` leaves at each of two hubs, one of them with a loop and two equal edges."""
    leaves = [(10 + i, i % 3) for i in range(2 * many)]
    nodes = {"Leaf": spark.createDataFrame(leaves, "id long, kind int"), "Hub": spark.createDataFrame([(0, "a"), (1, "b")], "id long, name string")}
    links = [(i, 10 + i, i % 2) for i in range(2 * many)] + [(1000, 10, 0), (1001, 10, 0), (1002, 0, 0), (1003, 0, 1)]
    return PropertyGraph.of(spark, nodes, {"E": spark.createDataFrame(links, "eid long, src long, dst long")}, small=["Hub"])


@pytest.mark.parametrize("uniqueness", ["edge", "none"])
def test_counts_are_those_of_the_matches(spark, uniqueness):
    g = hub_graph(spark)
    for pattern in (
        (node("a", "Leaf", kind=1), out(None, "E"), node("h", "Hub"), into(None, "E"), node("b", "Leaf")),
        (node("a"), out(), node("h"), into(), node("b"), out(), node("c")),
        (node("h"), out(None, "E"), node("h")),
        ((node("h", "Hub"), into(), node("a")), (node("h"), into(), node("a")), (node("h"), into(), node("b", "Leaf"))),
        (node("a", "Leaf").where("kind > 0"), out(), node("h", "Hub"), into(None, "NONE"), node()),
    ):
        want = bag(g.match(*pattern, uniqueness=uniqueness).groupBy("h.id").agg(F.count("*").alias("n")))
        assert bag(match_counts(g, *pattern, keep={"hub": ("h", "id")}, uniqueness=uniqueness)) == want
    two = (node("a", "Leaf"), out(), node("h", "Hub"), into(), node("b", "Leaf"))
    want = bag(g.match(*two, uniqueness=uniqueness).groupBy("a.kind", F.expr("b.kind = 2")).count())
    assert bag(match_counts(g, *two, keep={"k": ("a", "kind"), "two": ("b", "kind = 2")}, uniqueness=uniqueness)) == want


def test_counts_make_no_pairs(spark):
    """300,000 leaves at one hub have ninety thousand million pairs."""
    n = 300_000
    leaves = spark.range(10, 10 + n)
    g = PropertyGraph.of(spark, {"Leaf": leaves, "Hub": spark.createDataFrame([(0,)], "id long")}, {"E": leaves.select(F.col("id").alias("eid"), F.col("id").alias("src"), F.lit(0).alias("dst"))}, small=["Hub"])
    assert bag(match_counts(g, node("a", "Leaf"), out(None, "E"), node("h", "Hub"), into(None, "E"), node("b", "Leaf"), keep={"h_id": ("h", "id")})) == {(0, n * (n - 1)): 1}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_a_hub_is_dealt_over_many_parts(spark):
    g = hub_graph(spark)
    m = g.match(node("a", "Leaf"), out("e", "E"), node("h", "Hub"), into("f", "E"), node("b", "Leaf"))
    assert m.columns == ["a", "e", "h", "f", "b"] and "_jj" in plan_of(m)
    plain = PropertyGraph.of(spark, {next(iter(k)): v for k, v in g.node_frames.items()}, g.edge_frames)
    ids = ("a.id", "e.eid", "h.id", "f.eid", "b.id")
    assert bag(m.select(*ids)) == bag(plain.match(node("a", "Leaf"), out("e", "E"), node("h", "Hub"), into("f", "E"), node("b", "Leaf")).select(*ids))


def test_growing_frames_are_not_broadcast(spark):
    """Frames of a few KB, which Spark by itself would broadcast."""
    g = hub_graph(spark)
    two = (node("a", "Leaf"), out(None, "E"), node("b"), out(None, "E"), node("c"))
    hub = g.match(node("h", "Hub"), into(None, "E"), node("a", "Leaf"))
    assert "strategy=broadcast" in plan_of(hub)
    starts = g.nodes("Leaf").select("id")
    for df in (g.match(*two), paths.walk_counts(g.edges("E"), starts, 1, 3), paths.expand(g.edges("E"), starts, 1, 3), paths.closure(g.edges("E"), 2), paths.shortest_paths(g.edges("E"), starts, starts, high=2), paths.all_shortest_paths(g.edges("E"), starts, starts, high=2)):
        assert "Broadcast" not in plan_of(df)


def test_levels_without_ways(spark):
    g = graph(spark, [(0, 1), (0, 1), (1, 2), (0, 3), (3, 2), (2, 4)])
    starts = g.nodes("N").select("id")
    lean, whole = (paths.shortest_paths(g.edges("E"), starts, low=low, ways=False) for low in (0, 1)), [paths.shortest_paths(g.edges("E"), starts, low=low) for low in (0, 1)]
    for a, b in zip(lean, whole, strict=True):
        assert a.columns == ["start", "end", "depth", "n_paths"] and bag(a) == bag(b.select(*a.columns))


def test_counted_by_deals_rows_over_more_tasks(spark):
    df = spark.range(1000).selectExpr("id % 100 as k", "id % 3 as other")
    many = results.counted_by(df, 2 * results.TASK_ROWS + 1, "k", "other")
    assert many.rdd.getNumPartitions() == 3 and bag(many) == bag(df.groupBy("k", "other").count())
