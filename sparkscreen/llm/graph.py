"""Connected components of a table of links, by repeated contraction.

Each round every node takes its smallest neighbour (itself included) as its parent;
parents are followed to their ends by doubling, so a chain of n ascending nodes
is one round of log n steps; then links are drawn between the ends, and links within
one node vanish.  What is left after a round has half as many nodes at most.
Every step is written to the shared folder, so lineage stays short and a lost
executor costs its own tasks only; a table is dropped once the next one stands.
A node with very many links is aggregated before the shuffle, and in joins its rows
can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


class Steps:
    """Tables written one after the other; ``written`` counts them."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.written = scratch, 0

    def write(self, df: DataFrame, what: str) -> tuple[DataFrame, str]:
        self.written += 1
        name = f"{what}-{self.written}"
        return self.scratch.stage(df, name), name


def _ends(parent: DataFrame, name: str, steps: Steps) -> tuple[DataFrame, str]:
    """(node, parent) with every parent its own parent, by doubling."""
    while True:
        far = parent.select(F.col("node").alias("parent"), F.col("parent").alias("further"))
        end = F.coalesce("further", "parent")
        moved, now = steps.write(parent.select("node", "parent").join(far, "parent", "left").select("node", end.alias("parent"), (end != F.col("parent")).alias("moved")), "parents")
        steps.scratch.forget(name)
        parent, name = moved, now
        if not moved.where("moved").take(1):
            return parent.select("node", "parent"), name


def components(links: DataFrame, steps: Steps | None = None) -> DataFrame:
    """(node, component) of every node that has a link; ``links`` has columns a and b.

    The component is the smallest node reachable.  Null ends and links of a node
    to itself are left out; repeated links do no harm; no links, no rows.
    """
    spark = links.sparkSession
    steps = steps or Steps(Scratch(spark))
    edges, edges_name = steps.write(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds: list[tuple[DataFrame, str]] = []
    while edges.take(1):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent, name = steps.write(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent")), "parents")
        parent, name = _ends(parent, name, steps)
        rounds.append((parent, name))
        of = lambda c: parent.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_end"))  # noqa: B023, E731
        moved = edges.join(of("a"), "a").join(of("b"), "b").select(F.least("a_end", "b_end").alias("a"), F.greatest("a_end", "b_end").alias("b"))
        before = edges_name
        edges, edges_name = steps.write(moved.where("a <> b").distinct(), "links")
        steps.scratch.forget(before)
    steps.scratch.forget(edges_name)
    if not rounds:
        return spark.createDataFrame([], "node bigint, component bigint")
    # From the last round back: where did the node go that this one took?
    found, name = rounds[-1]
    found = found.select("node", F.col("parent").alias("component"))
    for parent, own in reversed(rounds[:-1]):
        further = found.select(F.col("node").alias("parent"), F.col("component").alias("further"))
        found, now = steps.write(parent.join(further, "parent", "left").select("node", F.coalesce("further", "parent").alias("component")), "found")
        steps.scratch.forget(name, own)
        name = now
    return found
