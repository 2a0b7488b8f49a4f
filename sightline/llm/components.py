"""Connected components: local contraction, then alternating large-star and small-star steps as DataFrame joins.

Each task first joins the edges it reads into stars, so that edges that fit one task's share need no more
than that; what several tasks found is brought together by star steps, which need few rounds on stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import materialize

MAX_ROUNDS = 60
#: Edges that one task contracts, about 16 bytes each.
EDGES_PER_TASK = 250_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A star for each component of the edges that this task reads: every node with the smallest."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = [x for x in above if top(x) != x]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"a": pa.array(part, pa.int64()), "b": pa.array([top(x) for x in part], pa.int64())})


def _turned(edges: DataFrame) -> DataFrame:
    """Each edge from its larger to its smaller end, once."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _turned(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    to_least = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _turned(to_least.union(least.select("a", F.col("m").alias("b"))))


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node with an edge is a root or has one edge, to a root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"))
    return seen.filter("up > 1 or (up = 1 and n > 1)").isEmpty()


def component_labels(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """edges: a, b (long). A row (node, root) for every node that has an edge to another; root is the component's smallest node."""
    edges = materialize(edges.filter("a <> b").select("a", "b"), "edges")
    tasks = max(1, ceil(edges.count() / edges_per_task))
    edges = materialize(edges.coalesce(tasks).mapInArrow(_contract, "a long, b long"), "stars")
    rounds = 0
    while tasks > 1 and not _is_settled(edges):
        if (rounds := rounds + 1) > MAX_ROUNDS:
            raise RuntimeError("components did not settle")
        edges = materialize(_small_star(_large_star(edges)), "edges")
    star = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return materialize(star.distinct().union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "labels")


def joined_labels(known: DataFrame, links: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """The labels (node, root) of ``known`` after further links (a, b): only roots and unlabelled nodes are looked at again."""
    of = lambda end: known.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    lifted = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    above = component_labels(lifted, edges_per_task)
    moved = known.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return materialize(moved.union(above.join(known, "node", "left_anti").select("node", "root")), "labels")
