"""Exact top-k search by inner product: distributed selection on histograms of scores.

Vectors are scaled and floored to whole numbers, so every score is exact. They are packed into blocks of a
bounded size; each task scores whole blocks of queries against whole blocks of candidates by one matrix product.
Scores are never written. A round lays each query's open range of scores over ``BINS`` bins; a pair of blocks sends
its counts from the top bin down to the one in which its own k-th best lies, as no lower bin can hold the k-th of
all; the sums say in which bin that k-th is. The next round divides that bin, until it is one score wide. The
last pass keeps what scores higher, and of what ties with the k-th score the smallest ids, as many as are still free.

Numbers: products run in single precision if no partial sum can reach 2**24, in double below 2**53, else in Python's
integers, so they are exact in each case. Queries against all rows are a product by definition; the blocks (at most
``BLOCK_CELLS`` numbers) bound what a task holds, nothing is broadcast that Spark hasn't sized, and what is
shuffled is at most k bins of each query and pair of blocks.

Defined results: a vector that is null or holds a null or non-finite component takes no part, neither does a
row without an id. Rows that share an id aren't candidates of each other; each is a query of its own and, for others, a
candidate of its own. Shorter vectors count as filled up with zeros, an empty one scores 0. Components and scores
beyond 2**62 count as 2**62. With fewer than k candidates all are returned; with none, or an empty table, no row is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import materialize

#: Rows of a block of queries and of candidates, and numbers in any block (a longer vector is a block of its own).
QUERY_ROWS, CANDIDATE_ROWS, BLOCK_CELLS = 2_048, 4_096, 1 << 20
#: Bins of a round, as a power of two; scores that a task holds at once.
BIN_BITS, TILE = 9, 1 << 21
BINS = 1 << BIN_BITS
LARGEST = (1 << 62) - 1
_BLOCK = "block long, ids binary, cells binary, wide long, norm double"


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """id, v (array of long): floor(scale * x) of each component, for the rows that take part."""
    x = F.transform(vector_col, lambda x: x.cast("double"))
    sound = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _packed(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows into blocks: ids, and the cells as a matrix in the narrowest integers that hold them, filled up with zeros."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = np.clip(lists.flatten().to_numpy(zero_copy_only=False), -LARGEST, LARGEST)
            begins = np.append(0, np.cumsum(lengths))
            at = 0
            while at < len(ids):
                widest = np.maximum(np.maximum.accumulate(lengths[at : at + most]), 1)
                n = max(1, int((widest * np.arange(1, len(widest) + 1) <= BLOCK_CELLS).sum()))
                wide = int(widest[n - 1])
                matrix = np.zeros((n, wide), np.int64)
                matrix[np.arange(wide) < lengths[at : at + n, None]] = flat[begins[at] : begins[at + n]]
                peak = int(np.abs(matrix).max())
                kind = next(t for t in (np.int16, np.int32, np.int64) if peak <= np.iinfo(t).max)
                norm = float(np.sqrt((matrix.astype(np.float64) ** 2).sum(1)).max())
                yield pa.RecordBatch.from_pylist([{"block": 0, "ids": ids[at : at + n].astype(np.int64).tobytes(), "cells": matrix.astype(kind).tobytes(), "wide": wide, "norm": norm}])
                at += n

    return pack


def _blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    tasks = max(1, ceil(vectors.count() / rows))
    packed = vectors.repartition(tasks).mapInArrow(_packed(rows), _BLOCK)
    return materialize(packed.withColumn("block", F.monotonically_increasing_id()), name)


def _matrix(ids: bytes, cells: bytes, wide: int, as_type) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, np.int64)
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(cells) // (len(names) * wide)]
    return names, np.frombuffer(cells, kind).reshape(len(names), wide).astype(as_type)


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    wide = min(queries.shape[1], candidates.shape[1])
    found = queries[:, :wide] @ candidates[:, :wide].T
    return (np.clip(found, -LARGEST, LARGEST) if found.dtype == object else found).astype(np.int64)


def _same_ids(queries: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, candidate) of pairs with the same id."""
    order = np.argsort(candidates, kind="stable")
    first, end = (np.searchsorted(candidates[order], queries, side) for side in ("left", "right"))
    i = np.repeat(np.arange(len(queries)), end - first)
    nth = np.arange(len(i)) - np.repeat(np.cumsum(end - first) - (end - first), end - first)
    return i, order[first[i] + nth]


def _standing(row: dict, bound: int, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query in a block: where its open range begins, and which place in it is sought."""
    low, sought = np.full(n, -bound), np.full(n, k)
    for x in row["standing"] or ():
        low[x["pos"]], sought[x["pos"]] = x["low"], x["sought"]
    return low, sought


def _pairs(batches: Iterator[pa.RecordBatch], bound: int, k: int) -> Iterator[tuple]:
    """Of each pair of blocks, in tiles: block, ids, scores, places of pairs with one id, ranges' beginnings, places sought."""
    exact = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
    for batch in batches:
        for row in batch.to_pylist():
            names, queries = _matrix(row["ids"], row["cells"], row["wide"], exact)
            others, candidates = _matrix(row["c_ids"], row["c_cells"], row["c_wide"], exact)
            low, sought = _standing(row, bound, k, len(names))
            step = max(1, TILE // len(names))
            for at in range(0, len(others), step):
                part = others[at : at + step]
                yield row["block"], names, part, _scores(queries, candidates[at : at + step]), _same_ids(names, part), low, sought


def _counted(bound: int, k: int, shift: int, before_shift: int | None):
    """Counts of the bins that each query's open range has, from the top to the one that holds the place sought among a tile's scores."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, names, _, scores, own, low, sought in _pairs(batches, bound, k):
            bins = (scores - low[:, None]) >> shift
            if before_shift is None:
                flat = (bins + (np.arange(len(names)) << BIN_BITS)[:, None]).ravel()
                counts = np.bincount(flat, minlength=len(names) << BIN_BITS).reshape(-1, BINS)
                np.subtract.at(counts, (own[0], bins[own]), 1)
            else:
                bins[own] = -1
                i, j = np.nonzero((bins >= 0) & (bins < 1 << before_shift - shift))
                counts = np.bincount((i << BIN_BITS) + bins[i, j], minlength=len(names) << BIN_BITS).reshape(-1, BINS)
            before = counts[:, ::-1].cumsum(1)[:, ::-1] - counts
            i, b = np.nonzero((counts > 0) & (before < sought[:, None]))
            yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(i), block), pa.int64()), "pos": pa.array(i, pa.int32()), "bin": pa.array(b, pa.int32()), "n": pa.array(counts[i, b], pa.int64())})

    return count


def _kept(bound: int, k: int):
    """What scores above each query's k-th value, and of what ties with it the smallest ids of a tile."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, names, others, scores, own, low, sought in _pairs(batches, bound, k):
            order = np.argsort(others, kind="stable")
            part = scores[:, order]
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            usable = np.ones(part.shape, bool)
            usable[own[0], place[own[1]]] = False
            i, j = np.nonzero((part >= low[:, None]) & usable)
            ties = part[i, j] == low[i]
            nth = np.zeros(len(i), np.int64)
            of = i[ties]
            nth[ties] = np.arange(len(of)) - np.searchsorted(of, of)
            keep = ~ties | (nth < sought[i])
            i, j = i[keep], j[keep]
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array(np.full(len(i), block), pa.int64()), "pos": pa.array(i, pa.int32()), "query_id": pa.array(names[i], pa.int64()), "vec_id": pa.array(others[order[j]], pa.int64()), "score": pa.array(part[i, j], pa.int64())}
            )

    return keep


def top_matches(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """vectors: id, v (array of long). query_id, rank (from 1), vec_id, score: the k best of all rows for each row of ``is_query``."""
    candidates = _blocks(vectors, CANDIDATE_ROWS, "candidates").select(F.col("ids").alias("c_ids"), F.col("cells").alias("c_cells"), F.col("wide").alias("c_wide"), F.col("norm").alias("c_norm"))
    queries = _blocks(vectors.filter(is_query), QUERY_ROWS, "queries")
    longest = candidates.agg(F.max("c_norm")).first()[0], queries.agg(F.max("norm")).first()[0]
    bound = min(LARGEST, ceil((longest[0] or 0) * (longest[1] or 0) * 1.000001) + 1)
    shift = max(0, (2 * bound).bit_length() - BIN_BITS)
    standing, before_shift = None, None
    of_query = Window.partitionBy("block", "pos")

    def scored(run, schema: str) -> DataFrame:
        """A stated set of queries against all rows, block by block."""
        asked = queries.join(standing.groupBy("block").agg(F.collect_list(F.struct("pos", "low", "sought")).alias("standing")), "block", "left") if standing else queries.withColumn("standing", F.lit(None).cast("array<struct<pos:int,low:bigint,sought:bigint>>"))
        return candidates.drop("c_norm").crossJoin(asked.drop("norm")).mapInArrow(run, schema)

    while True:
        counts = scored(_counted(bound, k, shift, before_shift), "block long, pos int, bin int, n long").groupBy("block", "pos", "bin").agg(F.sum("n").alias("n"))
        open_at = counts.join(standing, ["block", "pos"]) if standing else counts.withColumns({"low": F.lit(-bound), "sought": F.lit(k)})
        upto = F.sum("n").over(of_query.orderBy(F.col("bin").desc()))
        found = open_at.withColumn("upto", upto).filter("upto >= sought and upto - n < sought")
        place = found.select("block", "pos", (F.col("low") + F.col("bin").cast("long") * (1 << shift)).cast("long").alias("low"), (F.col("sought") - F.col("upto") + F.col("n")).cast("long").alias("sought"))
        standing = materialize(place, "standing")
        if shift == 0:
            break
        before_shift, shift = shift, max(0, shift - BIN_BITS)
    kept = scored(_kept(bound, k), "block long, pos int, query_id long, vec_id long, score long")
    rank = F.row_number().over(of_query.orderBy(F.col("score").desc(), "vec_id"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in SQL, over ``embeddings``.
ORACLE = """
WITH usable AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
cells AS (SELECT row_id, vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM usable),
products AS (
  SELECT q.row_id AS q, c.row_id AS c, sum(q.x * c.x)::BIGINT AS score FROM cells q JOIN cells c ON q.i = c.i AND q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL),
scores AS (
  SELECT q.row_id, q.vec_id AS query_id, c.vec_id, coalesce(score, 0) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id LEFT JOIN products p ON p.q = q.row_id AND p.c = c.row_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scores)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
