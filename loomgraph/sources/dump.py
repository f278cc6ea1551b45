"""Graphs from the text of a graph shell's dump.

Statements begin with ``create`` on a line of their own and may go over several lines:

    create (_0:`Owner`:`Programmer` {`surname`:"Hall", `pets`:0})
    create (_0)-[:`OWNS` {`salary`:3000000}]->(_1)

The text is split by Spark's reader at that word, so files of any size are read in
parallel; parsing is by built-in functions.  The input is never changed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import EDGE_COLUMNS, NODE_COLUMNS, PropertyGraph, numbered

_NODE = r"^\(_(\d+)((?::`[^`]+`)*)\s*(\{.*\})?\s*\)\s*;?\s*$"
_EDGE = r"^\(_(\d+)\)-\[\w*:`([^`]+)`\s*(\{.*\})?\s*\]->\(_(\d+)\)\s*;?\s*$"
_KEY = r"([{,]\s*)`([^`]+)`\s*:"


def statements(spark: SparkSession, path: str, word: str = "create") -> DataFrame:
    """(statement): one row each, without its first word, on one line."""
    return clean(spark.read.text(path, lineSep=f"\n{word} "), word)


def clean(pieces: DataFrame, word: str) -> DataFrame:
    """Statements from the pieces (value) between the words that begin them."""
    text = pieces.select(F.regexp_replace("value", rf"^\s*{word}\s+", "").alias("s"))
    return text.select(F.trim(F.regexp_replace("s", r"\s*\r?\n\s*", " ")).alias("statement")).where("statement <> ''")


def _properties(c: Column) -> Column:
    return F.coalesce(F.from_json(F.regexp_replace(c, _KEY, '$1"$2":'), "map<string,string>"), F.create_map().cast("map<string,string>"))


def parse(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes: id, labels, props; edges: src, type, dst, props; rest: statement)."""
    s = F.col("statement")
    at = lambda p, k: F.regexp_extract(s, p, k)
    nodes = found.where(s.rlike(_NODE)).select(at(_NODE, 1).cast("long").alias("id"), F.regexp_extract_all(at(_NODE, 2), F.lit("`([^`]+)`"), 1).alias("labels"), _properties(at(_NODE, 3)).alias("props"))
    edges = found.where(s.rlike(_EDGE)).select(at(_EDGE, 1).cast("long").alias("src"), at(_EDGE, 2).alias("type"), at(_EDGE, 4).cast("long").alias("dst"), _properties(at(_EDGE, 3)).alias("props"))
    return nodes, edges, found.where(~s.rlike(_NODE) & ~s.rlike(_EDGE))


@dataclass(frozen=True)
class Kind:
    """What the values of one property fit."""

    key: str
    type: str


def infer(rows: DataFrame, group: str, overrides: dict[str, str] | None = None) -> dict[str, list[Kind]]:
    """Property types for each value of ``group``, from all values and widened as needed:
    integer, bigint, double, boolean, array<string>, else string.  One row for each group
    and key reaches the driver: the size of the schema."""
    v = F.col("v")
    flags = {
        "array<string>": F.min(v.rlike(r"^\s*\[.*\]\s*$") & F.from_json(v, "array<string>").isNotNull()),
        "int": F.min(v.rlike(r"^-?\d+$") & v.try_cast("int").isNotNull()), "bigint": F.min(v.rlike(r"^-?\d+$") & v.try_cast("bigint").isNotNull()),
        "double": F.min(v.rlike(r"^-?\d*\.?\d+([eE][+-]?\d+)?$")), "boolean": F.min(v.rlike("^(true|false)$")),
    }
    got = rows.select(F.col(group).alias("g"), F.explode("props").alias("k", "v")).where("v is not null").groupBy("g", "k").agg(*[c.alias(f"f{i}") for i, c in enumerate(flags.values())])
    out: dict[str, list[Kind]] = {}
    for r in got.collect():
        kind = (overrides or {}).get(r["k"]) or next((t for i, t in enumerate(flags) if r[f"f{i}"]), "string")
        out.setdefault(r["g"], []).append(Kind(r["k"], kind))
    return {g: sorted(ks, key=lambda k: k.key) for g, ks in out.items()}


def _columns(kinds: list[Kind]) -> list[Column]:
    value = lambda k: F.col("props")[k.key]
    return [(F.from_json(value(k), k.type) if k.type.startswith("array") else value(k).try_cast(k.type)).alias(k.key) for k in kinds]


def read_dump(spark: SparkSession, path: str, fold_case: bool = False, overrides: dict[str, str] | None = None, strict: bool = True, word: str = "create") -> PropertyGraph:
    """A graph from dump files.  ``fold_case`` lower-cases names and values alike.

    ``overrides`` gives property types that aren't to be inferred.  With ``strict`` a
    statement that is neither node nor edge is an error; otherwise it is left out."""
    found = statements(spark, path, word)
    if fold_case:
        found = found.select(F.lower("statement").alias("statement"))
    nodes, edges, rest = parse(found)
    if strict and (odd := rest.take(1)):
        raise ValueError(f"not a statement of a dump: {odd[0][0][:200]}")
    nodes = nodes.withColumn("set", F.array_join(F.array_sort("labels"), ":"))
    # Maps can't be grouped by: equal statements are counted by the text of their properties.
    edges = numbered(edges.select("src", "dst", "type", F.to_json("props").alias("text"))).withColumn("props", F.from_json("text", "map<string,string>"))
    kinds, edge_kinds = infer(nodes, "set", overrides), infer(edges, "type", overrides)
    sets = [r["set"] for r in nodes.select("set").distinct().collect()]
    types = [r["type"] for r in edges.select("type").distinct().collect()]
    return PropertyGraph(
        spark,
        {frozenset(s.split(":")) if s else frozenset(): nodes.where(F.col("set") == s).select("id", *_columns(kinds.get(s, []))) for s in sets},
        {t: edges.where(F.col("type") == t).select("eid", "src", "dst", *_columns(edge_kinds.get(t, []))) for t in types},
    )


def write_dump(graph: PropertyGraph, folder: str, word: str = "create") -> None:
    """Writes a graph with ids from 0 on as dump text; null properties are left out."""

    def props(df: DataFrame, names: list[str]) -> Column:
        value = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
        text = F.concat_ws(", ", *[F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"`{c}`:"), value(F.col(f"`{c}`")))) for c in names])
        return F.when(text != "", F.concat(F.lit(" {"), text, F.lit("}"))).otherwise("")

    lines = []
    for labels, df in graph.node_frames.items():
        tags = "".join(f":`{x}`" for x in sorted(labels))
        lines.append(df.select(F.concat(F.lit(f"{word} (_"), F.col("id").cast("string"), F.lit(tags), props(df, [c for c in df.columns if c not in NODE_COLUMNS]), F.lit(")")).alias("value")))
    for kind, df in graph.edge_frames.items():
        inner = F.concat(F.lit(f")-[:`{kind}`"), props(df, [c for c in df.columns if c not in EDGE_COLUMNS]), F.lit("]->(_"))
        lines.append(df.select(F.concat(F.lit(f"{word} (_"), F.col("src").cast("string"), inner, F.col("dst").cast("string"), F.lit(")")).alias("value")))
    reduce(lambda a, b: a.union(b), lines).write.text(folder)
