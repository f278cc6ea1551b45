"""The driver's tables as a property graph.

Ids are keys times 16 plus a tag for the label, so that they are unique over all labels
and computed by a projection.  Nothing is read before a query asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph

_TAGS = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "Turn": 7}


def ident(label: str, key: Column | str) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("long") * 16 + _TAGS[label]


def _nodes(df: DataFrame, label: str, key: str, prefix: str) -> DataFrame:
    """Columns without their table's prefix, the key among them."""
    return df.select(ident(label, key).alias("id"), *[F.col(c).alias(c.removeprefix(prefix)) for c in df.columns])


def _turn_key() -> Column:
    return F.col("conv_id") * (1 << 20) + F.col("turn")


def shop_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Region, Nation, Customer (with a balance below zero also Debtor), Supplier, Part,
    Order and Turn; edges by foreign keys, NEXT between the turns of a conversation, and
    REFERS from each part to two others of its hundred.  Regions and nations stay few."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "conversations")}
    customer = _nodes(t["customer"], "Customer", "c_custkey", "c_")
    turns = t["conversations"].where("conv_id is not null and turn is not null")
    edge = lambda df, eid, src, dst, *props: df.select(eid.alias("eid"), src.alias("src"), dst.alias("dst"), *props)
    item = [F.col(f"l_{c}").alias(c) for c in ("linenumber", "quantity", "extendedprice", "discount", "returnflag", "shipdate")]
    item_id = F.xxhash64(*t["lineitem"].columns)
    key, place = F.col("p_partkey"), F.col("p_partkey") % 100
    refers = t["part"].select(key, F.posexplode(F.array((place * 7 + 3) % 100, (place * 5 + 1) % 100)).alias("k", "to"))
    return PropertyGraph.of(
        spark,
        {
            "Region": _nodes(t["region"], "Region", "r_regionkey", "r_"), "Nation": _nodes(t["nation"], "Nation", "n_nationkey", "n_"),
            "Customer": customer.where("acctbal >= 0 or acctbal is null"), ("Customer", "Debtor"): customer.where("acctbal < 0"),
            "Supplier": _nodes(t["supplier"], "Supplier", "s_suppkey", "s_"), "Part": _nodes(t["part"], "Part", "p_partkey", "p_"),
            "Order": _nodes(t["orders"], "Order", "o_orderkey", "o_"),
            "Turn": turns.select(ident("Turn", _turn_key()).alias("id"), "conv_id", "turn", "role", "text"),
        },
        {
            "IN_REGION": edge(t["nation"], F.col("n_nationkey").cast("long"), ident("Nation", "n_nationkey"), ident("Region", "n_regionkey")),
            "IN_NATION": edge(t["customer"], F.col("c_custkey"), ident("Customer", "c_custkey"), ident("Nation", "c_nationkey")),
            "LOCATED_IN": edge(t["supplier"], F.col("s_suppkey"), ident("Supplier", "s_suppkey"), ident("Nation", "s_nationkey")),
            "PLACED": edge(t["orders"], F.col("o_orderkey"), ident("Customer", "o_custkey"), ident("Order", "o_orderkey"), F.col("o_orderdate").alias("date")),
            "CONTAINS": edge(t["lineitem"], item_id, ident("Order", "l_orderkey"), ident("Part", "l_partkey"), *item),
            "SUPPLIED_BY": edge(t["lineitem"], item_id, ident("Order", "l_orderkey"), ident("Supplier", "l_suppkey"), *item),
            "NEXT": edge(turns, _turn_key(), ident("Turn", _turn_key()), ident("Turn", _turn_key() + 1)),
            "REFERS": edge(refers, key * 2 + F.col("k"), ident("Part", "p_partkey"), ident("Part", key - place + F.col("to")), F.col("k").alias("kind")),
        },
        {"IN_REGION": ("Nation", "Region"), "IN_NATION": ("Customer", "Nation"), "LOCATED_IN": ("Supplier", "Nation"), "PLACED": ("Customer", "Order"), "CONTAINS": ("Order", "Part"), "SUPPLIED_BY": ("Order", "Supplier")},
        ("Region", "Nation", "IN_REGION"),
    )
