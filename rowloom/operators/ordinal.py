"""Walks along an ordered dimension, by ordinal and not by neighbouring row: gaps stay gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_table(dimension: DataFrame, name: str, relation: DataFrame | None = None, group: tuple[str, ...] = (), member: str | None = None) -> DataFrame:
    """(name, o) and within groups (name, o, size, g_0...): the ordinal of each label in its group; labels in no group drop out."""
    if relation is None:
        return dimension.select(name, F.col("ord").alias("o"))
    keys = [F.col(c).alias(f"g_{i}") for i, c in enumerate(group)]
    joined = dimension.join(relation.select(F.col(member).alias(name), *keys), name)
    g = [f"g_{i}" for i in range(len(group))]
    w = Window.partitionBy(*g)
    return joined.select(name, (F.row_number().over(w.orderBy("ord")) - 1).cast("bigint").alias("o"), F.count("*").over(w).alias("size"), *g)


def walk(frame: DataFrame, orders: DataFrame, name: str, lag: Column, size: Column, wrap: bool, many: bool = False) -> DataFrame:
    """Every row moves from ordinal o to o + lag (for `many`, lag is an array of steps) along `name`; what leaves the axis goes, unless it wraps."""
    keep = [c for c in frame.columns if c != name]
    g = [c for c in orders.columns if c.startswith("g_")]
    placed = frame.join(orders, name)
    step = F.explode(lag) if many else lag
    moved = placed.select(*keep, *g, F.col("o"), size.alias("__size"), step.alias("__lag"))
    target = F.col("o") + F.col("__lag")
    moved = moved.withColumn("__to", F.pmod(target, F.col("__size")) if wrap else target)
    landing = orders.select(F.col(name), F.col("o").alias("__to"), *g)
    return moved.join(landing, ["__to", *g]).select(*keep, name)
