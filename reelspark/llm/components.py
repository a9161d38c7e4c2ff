"""Connected components of a graph whose edges never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import stored


def _roots(parent: DataFrame, name: str) -> DataFrame:
    """Pointer jumping over (id, up) with up <= id, until every pointer leads to a root.

    A chain of n pointers takes log2(n) steps. Many ids may point to one parent; their side of the
    join is split by the engine, the other side has a row for each id.
    """
    while True:
        above = parent.select(F.col("id").alias("up"), F.col("up").alias("top"))
        jumped = stored(
            parent.join(above, "up", "left").select("id", F.coalesce("top", "up").alias("up"), (F.col("top") < F.col("up")).alias("moved")),
            name,
        )
        parent = jumped.select("id", "up")
        if jumped.where("moved").isEmpty():
            return parent


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id in `edges` (columns a, b: long); component is the smallest id reachable.

    Each round points every id at its smallest neighbour, follows the pointers to their roots and keeps
    only the edges between different roots. The smallest id of a component is always a root. Loops and
    repeated edges are allowed; rows with a null end are ignored. No edges: no rows.
    """
    edges = stored(edges.where("a is not null and b is not null").select("a", "b").distinct(), f"{name}-edges")
    labels = None
    while True:
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("up"))
        roots = _roots(parent, f"{name}-roots")
        if labels is None:
            labels = roots
        else:
            new = roots.select(F.col("id").alias("up"), F.col("up").alias("top"))
            labels = stored(labels.join(new, "up", "left").select("id", F.coalesce("top", "up").alias("up")), f"{name}-labels")
        to_a = roots.select(F.col("id").alias("a"), F.col("up").alias("ra"))
        to_b = roots.select(F.col("id").alias("b"), F.col("up").alias("rb"))
        edges = stored(
            edges.join(to_a, "a").join(to_b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(),
            f"{name}-edges",
        )
        if edges.isEmpty():
            return labels.select("id", F.col("up").alias("component"))
