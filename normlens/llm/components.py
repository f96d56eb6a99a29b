"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlens.plans.relational import materialize


def _ranked(vertex: str) -> Column:
    """A vertex under an order that has nothing to do with the links."""
    return F.struct(F.xxhash64(vertex).alias("h"), F.col(vertex).alias("id"))


def components(links: DataFrame) -> DataFrame:
    """(v, root): for each linked vertex one vertex of its component, the same for all of them.

    ``links`` has long columns a and b in either order; repeated links and
    loops are allowed. Each round hooks every vertex to the first of its
    neighbours and itself in a hashed order (a map-side minimum), shortens the
    paths twice and contracts the links. In a hashed order descending paths are
    short, also on long chains, so few vertices but the local minima are left:
    about a third, and the rounds are their logarithm. An empty table of links
    gives an empty result.
    """
    left = materialize(links.where("a <> b").select("a", "b").distinct())
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min(_ranked("b")).alias("near"))
                           .select("v", F.least(_ranked("v"), "near")["id"].alias("p")))
        jumped = hook.alias("x").join(hook.alias("y"), F.col("x.p") == F.col("y.v")).select("x.v", "y.p")
        hook = materialize(jumped.alias("x").join(hook.alias("y"), F.col("x.p") == F.col("y.v")).select("x.v", "y.p"))
        moved = left.alias("l").join(hook.alias("h"), F.col("l.a") == F.col("h.v")).select(F.col("h.p").alias("a"), "l.b")
        moved = moved.alias("l").join(hook.alias("h"), F.col("l.b") == F.col("h.v")).select("l.a", F.col("h.p").alias("b"))
        left = materialize(moved.where("a <> b").distinct())
        if labels is None:
            labels = hook.withColumnRenamed("p", "root")
        else:
            labels = materialize(labels.alias("x").join(hook.alias("h"), F.col("x.root") == F.col("h.v"), "left")
                                 .select("x.v", F.coalesce("h.p", "x.root").alias("root")))
    return labels if labels is not None else left.selectExpr("a as v", "b as root")
