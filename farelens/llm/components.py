"""Connected components by contraction: every node joins its smallest neighbour, groups become nodes, until no edge is left.

Before each step a batch of edges becomes one star for each of its own components, so a table of few edges takes one step: every query
that is run costs the driver a plan and its figures, however small the table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import frozen

#: Rows of a partition of the tables between steps.
ROWS = 20_000


def _above(parents: DataFrame) -> DataFrame:
    """Every node with its parent's parent."""
    step = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
    return parents.join(step, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))


def _pointed(parents: DataFrame, n: int) -> DataFrame:
    """Roots of a forest (node, parent) of ``n`` rows at most, parents smaller than nodes: parents of parents, until nothing moves."""
    while True:
        near = _above(parents)
        step = near.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = sized(
            frozen(
                near.join(step, "parent", "left").select(
                    "node", F.coalesce("above", "parent").alias("parent"), (F.col("above") < F.col("parent")).alias("moved")
                ),
                "parents",
            ),
            n,
        )
        parents = jumped.select("node", "parent")
        if jumped.filter("moved").isEmpty():
            return parents


def _stars(edges: DataFrame) -> DataFrame:
    """The components of a batch of edges as stars: (u, v), u the smallest node of v's component in the batch. Nodes: numbers or bytes."""
    binary = edges.schema["u"].dataType.simpleString() == "binary"
    kind, dtype = ("binary", "object") if binary else ("long", "int64")

    def run(batches):
        for pdf in batches:
            parent: dict[int, int] = {}

            def root(node):
                while (above := parent.setdefault(node, node)) != node:
                    parent[node] = node = parent[above]
                return node

            for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
            rows = [(top, node) for node in parent if (top := root(node)) != node]
            yield pd.DataFrame(rows, columns=["u", "v"], dtype=dtype)

    ends = [F.col(c).cast(kind).alias(c) for c in ("u", "v")]
    return edges.filter("u <> v").select(*ends).mapInPandas(run, f"u {kind}, v {kind}")


def _distinct(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges with the same components, each once and its smaller node first, and their number."""
    found = frozen(_stars(edges).distinct(), "edges")
    n = found.count()
    return sized(found, n), n


def sized(df: DataFrame, n: int | None = None) -> DataFrame:
    """A written table in as many partitions as its rows (``n``, if known) need; one that is small then takes no shuffle."""
    return df.coalesce(max(1, -(-(df.count() if n is None else n) // ROWS)))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v): component is the smallest node reachable. Edges may repeat or be loops.

    A node with any number of edges is one row after partial aggregation. Each round at least halves the groups that still touch.
    No edges give no rows.
    """
    edges, n = _distinct(edges)
    labels, nodes_most = None, 2 * n
    while n:
        # Smaller neighbours only: the pointers of a round form a forest.
        parents = edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent"))
        roots = _pointed(sized(frozen(parents, "parents"), n), n)
        if labels is None:
            nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
            labels = nodes.withColumn("component", F.col("node"))
        to = roots.select(F.col("node").alias("component"), F.col("parent").alias("root"))
        labels = sized(
            frozen(labels.join(to, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels"),
            nodes_most,
        )
        left, right = to.toDF("u", "ru"), to.toDF("v", "rv")
        moved = edges.join(left, "u", "left").join(right, "v", "left")
        moved = moved.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
        edges, n = _distinct(moved)
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
