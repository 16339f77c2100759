"""Approximate nearest neighbours by permutations of pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ._common import cut, units

#: Rows of a block of the index, and queries that one task compares with a block.
BLOCK, QUERIES = 16384, 1024


def _usable(vectors: DataFrame) -> DataFrame:
    """(vector_id, vector) as doubles: finite, not zero, of the most common length."""
    v = vectors.select(F.col("vector_id").cast("long").alias("vector_id"), F.col("vector").cast("array<double>").alias("vector")).filter("vector_id is not null")
    fine = v.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    length = fine.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return fine.filter(F.size("vector") == (length[0]["n"] if length else 0)).dropDuplicates(["vector_id"])


def fit_pivots(vectors: DataFrame, count: int, pivots: int = 256, sample: int = 4096) -> np.ndarray:
    """At most `pivots` vectors of length 1, far from each other.

    They come from a sample of `sample` of the `count` rows (those with the smallest hashes of
    their ids; about twice as many are looked at); each next one is least like those before it.
    """
    some = F.pmod(F.xxhash64("vector_id"), F.lit(1 << 30))
    near = vectors.filter(some < int(min(1.0, 2 * sample / max(1, count)) * (1 << 30)))
    rows = near.orderBy(some, "vector_id").limit(sample).select("vector").collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r["vector"] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen, like = [0], x @ x[0]
    while len(chosen) < min(pivots, len(x)) and like.min() < 1 - 1e-9:
        chosen.append(int(like.argmin()))
        like = np.maximum(like, x @ x[chosen[-1]])
    return x[chosen]


def permutations(x: np.ndarray, pivots: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The `depth` nearest pivots of each row in order, and by pivot and row the place in that order (depth: not among them)."""
    order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :depth]
    place = np.full((len(x), len(pivots)), depth, np.uint8)
    np.put_along_axis(place, order, np.arange(depth, dtype=np.uint8)[None, :], axis=1)
    return order, np.ascontiguousarray(place.T)


def _search(pivots: np.ndarray, k: int, share: float):
    depth = max(1, len(pivots) // 2)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, columns in units(batches, ["block", "chunk"]):
            asked = columns["asked"].astype(bool)
            ids = columns["vector_id"]
            if not asked.any() or asked.all():
                continue
            x, q = np.stack(columns["vector"][~asked]), np.stack(columns["vector"][asked])
            ids, queries = ids[~asked], ids[asked]
            by_id = np.argsort(ids, kind="stable")
            ids, x = ids[by_id], x[by_id]
            order, _ = permutations(q, pivots, depth)
            _, posted = permutations(x, pivots, depth)  # the block's inverted files: per pivot the place of each row
            places, n, out = np.arange(depth, dtype=np.int16)[:, None], max(k + 1, int(np.ceil(share * len(x)))), []
            for i, query in enumerate(queries):
                footrule = np.abs(posted[order[i]] - places).sum(axis=0, dtype=np.int32)
                near = np.argsort(footrule, kind="stable")[:n]  # of equal ones, smaller ids first
                near = near[ids[near] != query]
                score = x[near] @ q[i]
                best = np.lexsort((ids[near], -score))[:k]
                out.append(pd.DataFrame({"query_id": query, "vector_id": ids[near][best], "score": score[best]}))
            yield pd.concat(out)
    return search


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = 256, share: float = 0.25) -> DataFrame:
    """(query_id, rank, vector_id, score): for each row of `queries` its `k` nearest rows of `vectors` but itself.

    The project has no records with learnt vectors, so this is general: both tables have
    vector_id and vector (array of numbers). Nearness is the inner product in double
    precision; of equal ones the smaller id comes first. If there are fewer than k
    candidates, all are returned.

    Method: permutation index. `fit_pivots` chooses pivots from a bounded sample. Every vector
    is represented by its nearest pivots in order (half of all) and posted under each of them
    with its place; the posting lists are kept per block of BLOCK rows. A query reads the
    lists of its own nearest pivots, ranks the block's rows by footrule distance (a pivot
    missing on one side counts as being after the last place) and reranks the nearest `share`
    of them by the exact measure. The stated queries meet all rows block by block, QUERIES at
    a time, so memory is bounded and only k rows per query and block are kept.

    Rows with a null id take no part, nor do vectors that are null, zero, hold a null or
    non-finite component or have another length than most. Rows with equal ids are one (any
    of them, so ids should be unique). Other columns are ignored; empty tables give no rows.
    """
    rows = cut(_usable(vectors))
    asked = cut(_usable(queries))
    count = rows.count()
    chosen = fit_pivots(rows, count, pivots)
    blocks, chunks = -(-count // BLOCK) or 1, -(-asked.count() // QUERIES) or 1
    deal = lambda n: F.pmod(F.xxhash64("vector_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("vector_id", "vector", F.lit(0).alias("asked"), deal(blocks).alias("block"), each(chunks).alias("chunk"))
    sent = asked.select("vector_id", "vector", F.lit(1).alias("asked"), each(blocks).alias("block"), deal(chunks).alias("chunk"))
    met = data.unionByName(sent).repartition("block", "chunk").sortWithinPartitions("block", "chunk")
    found = met.mapInPandas(_search(chosen, k, share), "query_id long, vector_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vector_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vector_id", "score")
