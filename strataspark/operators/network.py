"""Fault networks, orders and small tables of elements, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relations import _cut

KINDS = ("ABUTTING", "FAULTED", "NONE")


def with_kinds(edges: DataFrame, code: Column) -> DataFrame:
    """Edges (younger, older) with what the younger does to the older, by code 0 to 2."""
    return edges.withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in KINDS]), (code + 1).cast("int")))


def roots(faults: DataFrame, edges: DataFrame) -> DataFrame:
    return faults.join(edges.select(F.col("older").alias("id")), "id", "left_anti")


def of_fault(edges: DataFrame, fault: int) -> DataFrame:
    return edges.where((F.col("younger") == fault) | (F.col("older") == fault))


def without(edges: DataFrame, fault: int) -> DataFrame:
    return edges.where((F.col("younger") != fault) & (F.col("older") != fault))


def walk(faults: DataFrame, following: DataFrame) -> DataFrame:
    """id, hops and last: where each fault gets by always going on to the next older one.

    Paths double: after round k every fault knows the one 2^k steps on, so a chain of n faults takes log n
    rounds. Raises on a cycle, where a path is longer than there are faults.
    """
    ahead = faults.join(following.select(F.col("younger").alias("id"), F.col("older").alias("to")), "id", "left").withColumn("hops", F.when(F.col("to").isNull(), 0).otherwise(1))
    state = ahead.select("id", F.coalesce("to", "id").alias("last"), F.col("hops").cast("bigint").alias("hops"))
    count, done = faults.count(), 1
    while done < count:
        state = _cut(state)
        on = state.select(F.col("id").alias("last"), F.col("last").alias("further"), F.col("hops").alias("more"))
        state = state.join(on, "last").select("id", F.col("further").alias("last"), (F.col("hops") + F.col("more")).alias("hops"))
        done *= 2
    over = F.when(F.col("hops") >= count, F.raise_error(F.concat(F.lit("a cycle at fault "), F.col("id").cast("string")))).otherwise(F.col("hops"))
    return state.select("id", over.cast("int").alias("hops"), "last")


def ranked(items: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Items with their place in a list of names (one row with an array `names`); items that it lacks come with NULL."""
    places = names.select(F.posexplode("names").alias("rank", column))
    return items.join(F.broadcast(places), column, "left").select(column, F.col("rank").cast("bigint").alias("rank"))  # one row per unit


def best_order(contacts: DataFrame, orders: DataFrame) -> DataFrame:
    """Of the orders (sorter, unit, rank) the one whose neighbours share the longest contacts; ties go to the first by name."""
    one = F.broadcast(orders.withColumnsRenamed({"unit": "unit1", "rank": "r1"}))  # a few orders of a column's units
    two = F.broadcast(orders.withColumnsRenamed({"unit": "unit2", "rank": "r2"}))
    total = contacts.join(one, "unit1").join(two, ["sorter", "unit2"]).where(F.abs(F.col("r1") - F.col("r2")) == 1).groupBy("sorter").agg(F.sum("length").cast("bigint").alias("total"))
    return total.orderBy(F.desc("total"), "sorter").limit(1)


def without_gaps(vertices: DataFrame, triangles: DataFrame, node: str = "node", value: str = "z") -> DataFrame:
    """Triangles of vertices that have a value, with vertices numbered anew in their order.

    The number of a vertex is its place among those kept: counts of whole blocks of nodes are summed in
    one small window, and places within a block in windows of one block each.
    """
    block = F.floor(F.col(node) / 65536)
    kept = vertices.where(F.col(value).isNotNull()).select(node, block.alias("block"))
    sizes = kept.groupBy("block").agg(F.count("*").alias("n"))
    before = sizes.select("block", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = kept.withColumn("place", F.row_number().over(W.partitionBy("block").orderBy(node)) - 1).join(before, "block").select(node, (F.col("before") + F.col("place")).cast("bigint").alias("new"))
    out = triangles
    for c in ("n1", "n2", "n3"):
        out = out.join(numbered.withColumnsRenamed({node: c, "new": f"{c}_"}), c)
    return out.select("triangle", *[F.col(f"{c}_").alias(c) for c in ("n1", "n2", "n3")])

