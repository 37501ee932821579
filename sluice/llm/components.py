"""Connected components of a link table, distributed: nodes hook to their least neighbour, trees are flattened, links contracted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _links(e: DataFrame) -> DataFrame:
    """The distinct links (a, b) with b < a, as a table."""
    return checkpoint(e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _follow(rows: DataFrame, column: str, up: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by its component in ``up``, if it has one there; ``moved`` says so.

    Both are tables, so the rows of a hot component can be split.
    """
    to = up.select(F.col("node").alias("_node"), F.col("component").alias("_to"))
    out = rows.join(to, F.col(column) == F.col("_node"), "left")
    return out.withColumns({column: F.coalesce("_to", column), "moved": F.col("_to").isNotNull()}).drop("_node", "_to")


def _flat(up: DataFrame) -> DataFrame:
    """(node, component): each node of a forest of (node, component) links with its root; paths halve in each step."""
    while True:
        step = checkpoint(_follow(up, "component", up))
        up = step.drop("moved")
        if step.filter("moved").isEmpty():
            return up


def below(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, component): each node of ``links`` (a, b) that reaches a smaller one, with the smallest; others are their own component.

    ``known``, an earlier result, is carried on: the answer is that for its links and these, and only components
    that these touch are worked on.  Every node takes its least neighbour, if that is smaller; the trees that this makes
    are flattened, and the links between trees are the next round's.  Each step is a table of its own.
    """
    e = _links(links.select("a", "b") if known is None else _follow(_follow(links.select("a", "b"), "a", known), "b", known))
    while not e.isEmpty():
        hooks = checkpoint(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")))
        up = _flat(hooks)
        known = up if known is None else checkpoint(_follow(known, "component", up).select("node", "component").union(up))
        if hooks.count() == e.count():  # every link was taken
            break
        e = _links(_follow(_follow(e, "a", up), "b", up))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")) if known is None else known


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of ``links`` with the smallest node it can reach.

    Nodes are of any ordered type.  Links may repeat and point either way; loops and links with a null end are
    ignored, so an empty table gives an empty result.  The number of steps grows with the logarithm of the longest chain.
    """
    found = below(links.select(F.col(a).alias("a"), F.col(b).alias("b")))
    return found.union(found.select("component", "component").distinct())
