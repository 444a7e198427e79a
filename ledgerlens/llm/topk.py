"""Exact top-k search by tiled matrix products.

Candidates and queries are dealt into shards and query blocks by a hash of
their row. A cell is one query block and one shard; it is worked through in
tiles of bounded size, each a matrix product followed by a partial selection.
The lists of a query are merged as a tree, ``fan_in`` lists at a time.

The number of shards and blocks follows the number of rows, so a cell stays
the same size at any scale.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 2048
LIST = T.ArrayType(T.StructType([T.StructField("neg", T.LongType()), T.StructField("vec_id", T.LongType())]))


def usable_vectors(table: DataFrame, id_col: str, vec_col: str, *extra: str) -> DataFrame:
    """(vec_id, v array<double>, extra columns) of the rows that take part.

    Rows with a null id, a null vector, or a null or non-finite component take no part.
    """
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *extra)


def best_rows(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k highest scores of each row, ties to the smaller id, without the row's own id.

    ``ids`` is ascending. Everything at or above a row's k-th score is
    considered, so ties are never cut at random.
    """
    allowed = ids[None, :] != own[:, None]
    low = np.where(allowed, scores, scores.min() - 1)
    if low.shape[1] > k:
        bound = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
        allowed &= low >= bound[:, None]
    row, col = np.nonzero(allowed)
    score = scores[row, col]
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    first = np.searchsorted(row, np.arange(len(own)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], ids[col[keep]], score[keep]


def inner_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating matrix product while every partial sum is below 2**53, else by integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as a matrix, and their lengths (shorter rows are filled with zeros)."""
    lists = column.combine_chunks()
    lengths = np.array([len(x) for x in lists], dtype=np.int64)
    flat = lists.flatten().to_numpy()
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width), lengths
    out = np.zeros((len(lengths), width), dtype=flat.dtype)
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
    return out, lengths


def top_k_products(table: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 8192, block_rows: int = 2048, fan_in: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): highest integer products of floor(scale * x) vectors.

    Queries are the rows where ``is_query``; candidates are all rows but those
    with the query's own id. Vectors of another length than the query's are no
    candidates of it. Repeated rows are candidates each; a repeated query id is
    asked once, with the smallest of its vectors. Fewer than k
    candidates: all of them. Components beyond a 64-bit integer are cut to its range.
    """
    whole = F.transform(F.col("v"), lambda x: F.floor(x * scale).cast("long"))
    rows = usable_vectors(table, id_col, vec_col).select("vec_id", whole.alias("v"))
    queries = usable_vectors(table.where(is_query), id_col, vec_col).groupBy("vec_id").agg(F.min(whole).alias("v"))
    n_rows, n_queries = table.count(), table.where(is_query).count()
    shards, blocks = max(1, math.ceil(n_rows / shard_rows)), max(1, math.ceil(n_queries / block_rows))
    place = F.xxhash64("vec_id", "v")
    candidates = rows.withColumn("shard", F.pmod(place, F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("block", F.pmod(place, F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        """One query block against one shard."""
        got = {"query_id": [], "shard": [], "best": []}
        if left.num_rows and right.num_rows:
            right = right.sort_by([("vec_id", "ascending")])
            shard = left.column("shard")[0].as_py()
            q, q_len = matrix(left.column("v"))
            c, c_len = matrix(right.column("v"))
            own, ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            for width in np.unique(q_len):
                qs, cs = np.flatnonzero(q_len == width), np.flatnonzero(c_len == width)
                for a in range(0, len(qs), TILE) if len(cs) else ():
                    some = qs[a : a + TILE]
                    for b in range(0, len(cs), TILE):
                        tile = cs[b : b + TILE]
                        row, vec, score = best_rows(inner_products(q[some, :width], c[tile, :width]), ids[tile], own[some], k)
                        ends = np.searchsorted(row, np.arange(len(some) + 1))
                        for i in range(len(some)):
                            if ends[i + 1] > ends[i]:
                                part = slice(ends[i], ends[i + 1])
                                got["query_id"].append(int(own[some[i]]))
                                got["shard"].append(shard)
                                got["best"].append([{"neg": -int(s), "vec_id": int(v)} for s, v in zip(score[part], vec[part], strict=True)])
        best = pa.list_(pa.struct([("neg", pa.int64()), ("vec_id", pa.int64())]))
        return pa.table({"query_id": pa.array(got["query_id"], pa.int64()), "shard": pa.array(got["shard"], pa.int32()), "best": pa.array(got["best"], best)})

    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("best", LIST)])
    lists = asked.groupBy("block", "shard").cogroup(candidates.groupBy("block", "shard")).applyInArrow(cell, schema)
    return ranked(tree_merge(lists, shards, k, fan_in))


def tree_merge(lists: DataFrame, n_lists: int, k: int, fan_in: int) -> DataFrame:
    """Merge (query_id, shard, best) lists ``fan_in`` at a time until each query has one."""
    while True:
        n_lists = -(-n_lists // fan_in)
        lists = (
            lists.groupBy("query_id", F.floor(F.col("shard") / fan_in).cast("int").alias("shard"))
            .agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        )
        if n_lists <= 1:
            return lists


def ranked(lists: DataFrame) -> DataFrame:
    """(query_id, rank, vec_id, score) from one sorted list a query."""
    return lists.select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.neg")).alias("score")
    )
