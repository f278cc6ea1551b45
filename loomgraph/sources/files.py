"""Graphs in CSV and Parquet files, result files, and files of queries' names."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph


# ------------------------------------------------------------------------- CSV
def read_csv_graph(spark: SparkSession, folder: str, nodes: Mapping[tuple[str, ...] | str, tuple[str, str]], edges: Mapping[str, tuple[str, str]]) -> PropertyGraph:
    """``nodes``: labels -> (file, schema), the first column being the id; ``edges``:
    type -> (file, schema), the first two being source and target.  Schemas are given, so
    no pass is spent on guessing them."""

    def read(file: str, schema: str, names: list[str]) -> DataFrame:
        df = spark.read.csv(f"{folder}/{file}", header=True, schema=schema, enforceSchema=True)
        return df.withColumnsRenamed(dict(zip(df.columns, names, strict=False)))

    return PropertyGraph.of(spark, {k: read(f, s, ["id"]) for k, (f, s) in nodes.items()}, {t: read(f, s, ["src", "dst"]) for t, (f, s) in edges.items()})


def write_csv_graph(graph: PropertyGraph, folder: str) -> None:
    """A folder of CSV files for each label set and each type; arrays as JSON."""
    plain = lambda df: df.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes])
    for k, df in graph.node_frames.items():
        plain(df).write.csv(f"{folder}/nodes/{'_'.join(sorted(k)) or '_'}", header=True)
    for t, df in graph.edge_frames.items():
        first = ["src", "dst"]
        plain(df.select(*first, *[c for c in df.columns if c not in first])).write.csv(f"{folder}/edges/{t}", header=True)


# --------------------------------------------------------------------- Parquet
def save_graph(graph: PropertyGraph, folder: str, buckets: int = 0) -> None:
    """Writes a graph as Parquet: a folder for each label set and each type, and a small
    catalogue.  With ``buckets`` edges are dealt by source first, so that expansions read
    neighbours together."""
    for k, df in graph.node_frames.items():
        df.write.parquet(f"{folder}/nodes/{'_'.join(sorted(k)) or '_'}")
    for t, df in graph.edge_frames.items():
        (df.repartition(buckets, "src").sortWithinPartitions("src") if buckets else df).write.parquet(f"{folder}/edges/{t}")
    meta = {"nodes": [sorted(k) for k in graph.node_frames], "edges": list(graph.edge_frames), "ends": {t: [sorted(a), sorted(b)] for t, (a, b) in graph.ends.items()}}
    graph.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{folder}/catalogue")


def load_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    meta = json.loads(spark.read.text(f"{folder}/catalogue").first()[0])
    return PropertyGraph(
        spark,
        {frozenset(k): spark.read.parquet(f"{folder}/nodes/{'_'.join(k) or '_'}") for k in meta["nodes"]},
        {t: spark.read.parquet(f"{folder}/edges/{t}") for t in meta["edges"]},
        {t: (frozenset(a), frozenset(b)) for t, (a, b) in meta["ends"].items()},
    )


# --------------------------------------------------------------------- results
def result_lines(df: DataFrame, skip: tuple[str, ...] = ("id", "x", "label", "labels")) -> DataFrame:
    """(value): the rows as text, ``column : value`` a line, a blank line after each row;
    nulls and the columns in ``skip`` are left out.  Structs give their fields."""
    flat = []
    for f in df.schema.fields:
        inner = getattr(f.dataType, "fields", None)
        flat += [(g.name, F.col(f"`{f.name}`.`{g.name}`"), g.dataType) for g in inner] if inner else [(f.name, F.col(f"`{f.name}`"), f.dataType)]
    text = lambda c, t: F.to_json(c) if t.typeName() in ("array", "struct", "map") else c.cast("string")
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{n} : "), text(c, t))) for n, c, t in flat if n not in skip]
    return df.select(F.concat_ws("\n", *lines).alias("value"))


def write_results(df: DataFrame, path: str) -> int:
    """Writes ``result_lines`` to ``path`` and, as its own part, ``NUM RECORDS : n``;
    returns n.  Rows are counted in the files, so the query runs once."""
    spark = df.sparkSession
    result_lines(df).write.option("lineSep", "\n\n").text(path)
    n = spark.read.text(path, lineSep="\n\n").count()
    spark.createDataFrame([(f"NUM RECORDS : {n}",)], "value string").coalesce(1).write.mode("append").text(path)
    return n


def read_query_file(path: str) -> Iterator[str]:
    """Names of queries to run, one a line; lines that begin with // are left out."""
    with open(path, encoding="utf-8") as f:
        for line in f:
            if (name := line.strip()) and not name.startswith("//"):
                yield name
