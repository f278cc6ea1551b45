"""A synthetic web graph: websites, programmers, owners and people who are both.

The first edges join uniform vertices; each later edge takes an end of an earlier edge,
which is choosing by degree.  An edge's ends depend on its number and the seed alone, so
all edges are made in parallel without a shuffle, and alike on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph

#: Edges of a vertex in the three densities, and shares of the four kinds.
DENSITIES = {"sparse": 7.61, "regular": 13.49, "dense": 25.67}
SHARES = {"website": 0.70, "programmer": 0.22, "owner": 0.05, "both": 0.03}
#: Steps back over earlier edges.  Each halves the number, on average.
_STEPS = 40


def _uniform(n: Column, *key: Column | int) -> Column:
    """A number in [0, n), fixed by the key."""
    return F.pmod(F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in key]), n)


def _word(seed: int, salt: int, size: int, column: Column) -> Column:
    return F.concat(F.lit({1: "host", 2: "name", 3: "city", 4: "state"}[salt]), _uniform(F.lit(size), column, seed, salt).cast("string"))


def web_graph(spark: SparkSession, vertices: int = 40_000, density: str | float = "dense", seed: int = 7) -> PropertyGraph:
    """Vertices 0 .. n-1 in the four kinds, and about n x density edges without loops and
    parallel edges.  The kinds of an edge's ends decide its type: websites link to
    websites, programmers code for and owners own websites, owners employ programmers,
    and programmers, and owners, are friends of their kind."""
    per = DENSITIES[density] if isinstance(density, str) else density
    cuts = [round(vertices * x) for x in (SHARES["website"], SHARES["website"] + SHARES["programmer"], 1 - SHARES["both"])]
    ids, i = spark.range(vertices), F.col("id")
    sites = ids.where(i < cuts[0]).select("id", _word(seed, 1, max(1, vertices // 2), i).alias("host"), F.element_at(F.array(*map(F.lit, ("com", "com", "com", "net", "org"))), (_uniform(F.lit(5), i, seed) + 1).cast("int")).alias("domain"))
    person = [_word(seed, k, n, i).alias(name) for k, n, name in ((2, 500, "surname"), (3, 100, "city"), (4, 50, "state"))]
    pets, cars = (_uniform(F.lit(5), i, seed, s).cast("int").alias(n) for s, n in ((8, "pets"), (9, "cars")))
    coders = ids.where((i >= cuts[0]) & (i < cuts[1])).select("id", *person, pets)
    owners = ids.where((i >= cuts[1]) & (i < cuts[2])).select("id", *person, cars)
    both = ids.where(i >= cuts[2]).select("id", *person, pets, _uniform(F.lit(4), i, seed, 9).cast("int").alias("cars"))

    e, n = F.col("id"), F.lit(vertices).cast("long")

    def end(side: int) -> Column:
        # Back from edge to earlier edge until one of the first, whose ends are uniform.
        back = lambda at, k: F.when(at < n, at).otherwise(_uniform(at, at, k, side, seed))
        first = F.pmod(F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), e, back), n)
        return _uniform(n, first, _uniform(F.lit(2), e, side, seed), seed + 1)

    drawn = spark.range(round(vertices * per)).select(end(0).alias("src"), end(1).alias("dst")).where("src <> dst").distinct()
    kind = lambda c: F.when(F.col(c) < cuts[0], "website").when(F.col(c) < cuts[1], "programmer").when(F.col(c) < cuts[2], "owner").otherwise("both")
    a, b = F.col("a"), F.col("b")
    codes, owns = a.isin("programmer", "both"), a.isin("owner", "both")
    ends = drawn.withColumns({"a": kind("src"), "b": kind("dst")})
    # Edges that no type fits (from websites to people, from programmers to owners) are turned.
    turn = ((a == "website") & (b != "website")) | ((a == "programmer") & (b == "owner"))
    turned = ends.select(F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst")).distinct().withColumns({"a": kind("src"), "b": kind("dst")})
    draw = lambda size, salt: _uniform(F.lit(size), F.col("src"), F.col("dst"), seed, salt)
    # People who are both code for one half of their websites and own the other.
    site = F.when(a == "both", F.when(draw(2, 6) == 0, "CODES_FOR").otherwise("OWNS")).when(codes, "CODES_FOR").otherwise("OWNS")
    typed = turned.withColumn("type", F.when((a == "website") & (b == "website"), "LINKED_TO").when(b == "website", site).when(owns & b.isin("programmer", "both"), "EMPLOYS").otherwise("FRIENDS"))
    # The ranges of the edges' properties.
    extra = {
        "LINKED_TO": [draw(100, 1).alias("popularity")], "CODES_FOR": [draw(100, 2).alias("commits")], "OWNS": [((draw(1000, 3) + 1500) * 2000).alias("salary")],
        "EMPLOYS": [((draw(1000, 4) + 1500) * 10).alias("salary"), F.when(draw(2, 5) == 0, "no").otherwise("yes").alias("carShare")], "FRIENDS": [],
    }
    return PropertyGraph.of(
        spark,
        {"Website": sites, "Programmer": coders, "Owner": owners, ("Owner", "Programmer"): both},
        {t: typed.where(F.col("type") == t).select("src", "dst", *cols, F.xxhash64("src", "dst").alias("eid")) for t, cols in extra.items()},
    )
