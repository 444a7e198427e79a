"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of L tables hashes a vector by M Gaussian projections cut into cells of
width w. A query visits its own buckets and then the neighbouring ones, over
all tables, in order of the estimated chance that a near vector fell there:
the sum of the squared distances from the query to the cell walls it crosses.
The vectors of the visited buckets are ranked by their exact distance, and the
lists of a query are merged.

Equal vectors are indexed once with their k + 1 smallest ids, which is all a
top-k answer can use; a vector that a third of the rows share is one row. A
bucket of any size is cut into cells of bounded size that are ranked apart, so
no pair of rows is ever emitted and no group grows with the data.

M, w and the number of probes are fitted on a bounded sample of rows, with a
margin above the recall asked for; every row is indexed. Only a query whose buckets
hold fewer than k candidates is compared with the sample as well, so that it finds
k wherever there are that many.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import U64, mix64, written
from ledgerlens.llm.topk import matrix, usable_vectors

PAIR_CELLS = 1_000_000  # numbers in one block of differences


@dataclass
class PStableIndex:
    """L tables of M projections with cell width w; ``probes`` buckets are visited a query."""

    directions: np.ndarray  # (L, M, dim)
    shifts: np.ndarray  # (L, M), in cells
    width: float
    probes: int

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Positions in cells, (rows, L, M)."""
        return np.einsum("nd,lmd->nlm", x, self.directions) / self.width + self.shifts

    @staticmethod
    def keys(cells: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """64-bit bucket keys of integer cells (..., M) of the given tables."""
        out = mix64(tables.astype(U64) + U64(0x9E3779B97F4A7C15))
        for i in range(cells.shape[-1]):
            out = mix64(out ^ cells[..., i].astype(np.int64).view(U64) + U64(i + 1))
        return out.view(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table, (rows, L)."""
        return self.keys(np.floor(self.cells(x)), np.arange(len(self.directions))[None, :])

    def visits(self, position: np.ndarray, probes: int | None = None) -> np.ndarray:
        """Buckets that one query visits, best first; ``position`` (L, M) is its place in cells.

        Sets of crossed walls come from a heap in order of their score: from a
        set, the next ones swap its last wall for the following one, or add
        that one. A set with both walls of one cell is passed over.
        """
        probes = probes or self.probes
        tables, m = position.shape
        base = np.floor(position).astype(np.int64)
        inside = position - base
        walls = np.concatenate([inside**2, (1 - inside) ** 2], axis=1)  # crossing down, then up
        order = np.argsort(walls, axis=1, kind="stable")
        cost = np.take_along_axis(walls, order, axis=1)
        heap: list = [(0.0, t, ()) for t in range(tables)]
        out_table, out_cells = [], []
        while heap and len(out_table) < probes:
            score, t, walls_in = heapq.heappop(heap)
            crossed = [int(order[t, i]) for i in walls_in]
            if len({i % m for i in crossed}) == len(crossed):
                cell = base[t].copy()
                for i in crossed:
                    cell[i % m] += 1 if i >= m else -1
                out_table.append(t)
                out_cells.append(cell)
            last = walls_in[-1] if walls_in else -1
            if last + 1 < 2 * m:
                heapq.heappush(heap, (score + cost[t, last + 1], t, (*walls_in, last + 1)))
                if walls_in:
                    heapq.heappush(heap, (score - cost[t, last] + cost[t, last + 1], t, (*walls_in[:-1], last + 1)))
        return self.keys(np.array(out_cells), np.array(out_table))


def fit_index(sample: np.ndarray, k: int, recall: float, tables: int = 2, max_probes: int = 256, n_queries: int = 50, seed: int = 5) -> PStableIndex:
    """The setting with the least work that finds ``recall`` of the true neighbours within the sample.

    Work is the number of rows in the visited buckets. Neighbours in a sample
    are farther away than in the whole table, so the figure is a cautious
    one. Cells are widened until some setting reaches it.
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    queries = sample[:: max(1, len(sample) // n_queries)][:n_queries]
    d = np.sqrt(np.maximum(0, (queries**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * queries @ sample.T))
    near = np.argsort(d, axis=1, kind="stable")[:, 1 : k + 1]
    reach = float(np.median(np.take_along_axis(d, near, axis=1)[:, -1])) if near.size else 1.0
    best, best_work, width = None, math.inf, max(reach, 1e-9)
    while best is None:
        width *= 1.5
        for m in (4, 6, 8, 10, 12):
            index = PStableIndex(rng.standard_normal((tables, m, dim)), rng.random((tables, m)), width, max_probes)
            buckets = index.buckets(sample)
            keys, counts = np.unique(buckets, return_counts=True)
            found_at, seen = np.full(near.shape, max_probes), np.zeros(max_probes)
            for i, place in enumerate(index.cells(queries)):
                at = {key: j for j, key in reversed(list(enumerate(index.visits(place).tolist())))}
                for key, n in zip(keys.tolist(), counts.tolist(), strict=True):
                    if (j := at.get(key)) is not None:
                        seen[j] += n
                found_at[i] = [min(at.get(key, max_probes) for key in buckets[r].tolist()) for r in near[i]]
            share = np.array([(found_at <= j).mean() if near.size else 1.0 for j in range(max_probes)])
            if share[-1] >= recall:
                probes = int(np.argmax(share >= recall)) + 1
                work = seen[:probes].sum()
                if work < best_work:
                    index.probes = probes
                    best, best_work = index, work
    return best


def nearest_in_cells(bucket_q: np.ndarray, q: np.ndarray, bucket_c: np.ndarray, c: np.ndarray, ids: list, k: int) -> dict[int, list]:
    """For each query row, the k + 1 nearest (distance, id) over the cells it visits."""
    found: dict[int, dict] = {}
    order_q, order_c = np.argsort(bucket_q, kind="stable"), np.argsort(bucket_c, kind="stable")
    sorted_c = bucket_c[order_c]
    for key in np.unique(bucket_q):
        rows = order_q[np.searchsorted(bucket_q[order_q], key) : np.searchsorted(bucket_q[order_q], key, "right")]
        cand = order_c[np.searchsorted(sorted_c, key) : np.searchsorted(sorted_c, key, "right")]
        if not len(cand):
            continue
        step = max(1, PAIR_CELLS // (len(cand) * max(1, q.shape[1])))
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            dist = np.sqrt(np.square(q[some][:, None, :] - c[cand][None, :, :]).sum(axis=2))
            if len(cand) > k + 1:
                bound = np.partition(dist, k, axis=1)[:, k]
                near = [np.flatnonzero(row <= b) for row, b in zip(dist, bound, strict=True)]
            else:
                near = [np.arange(len(cand))] * len(some)
            for i, r in enumerate(some.tolist()):
                kept = found.setdefault(r, {})
                for j in near[i].tolist():
                    for one in ids[cand[j]]:
                        kept[one] = min(kept.get(one, math.inf), float(dist[i, j]))
                if len(kept) > 4 * (k + 1):
                    found[r] = dict(sorted(kept.items(), key=lambda x: (x[1], x[0]))[: k + 1])
    return {r: sorted((d, one) for one, d in kept.items())[: k + 1] for r, kept in found.items()}


def search(
    table: DataFrame,
    is_query: Column,
    k: int = 10,
    recall: float = 0.9,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    sample_rows: int = 2000,
    cell_rows: int = 4096,
    slot_rows: int = 20_000,
    fan_in: int = 16,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by Euclidean distance, ties to the smaller id.

    Queries are the rows where ``is_query``; a query's candidates are all rows
    with another id. Null ids, and vectors that are null, zero, empty or hold a
    null or non-finite component, take no part; nor do vectors of another
    length than the most of the sample. A repeated row counts once. An empty table
    gives no rows.
    """
    spark = table.sparkSession
    rows = usable_vectors(table.withColumn("__q", F.coalesce(is_query, F.lit(False))), id_col, vec_col, "__q")
    rows = rows.where(F.exists("v", lambda x: x != 0)).withColumn("h", F.xxhash64("v"))
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(sample_rows).select("vec_id", "v").collect()  # at most sample_rows
    dims = [len(r["v"]) for r in sample]
    dim = max(set(dims), key=dims.count) if dims else 1
    sample = [r for r in sample if len(r["v"]) == dim]
    rows = rows.where(F.size("v") == dim)
    index = fit_index(np.unique(np.array([r["v"] for r in sample]).reshape(len(sample), dim), axis=0), k, (1 + recall) / 2)
    # bounded by the sample and L * M * dim; plain values, as workers may lack this package
    shipped = spark.sparkContext.broadcast((vars(index), [r["vec_id"] for r in sample], [r["v"] for r in sample]))

    same = Window.partitionBy("h", "v").orderBy("vec_id")
    distinct = (
        rows.select("h", "v", "vec_id").distinct().withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
        .groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    asked = rows.where("__q").select("h", "v").distinct()

    def place(batches):
        index = PStableIndex(**shipped.value[0])
        for batch in batches:
            v, _ = matrix(pa.chunked_array([batch.column("v")]))
            keys = index.buckets(v).tolist() if len(v) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=["h", "v", "ids", "buckets"])

    def probe(batches):
        index = PStableIndex(**shipped.value[0])
        for batch in batches:
            v, _ = matrix(pa.chunked_array([batch.column("v")]))
            keys = [index.visits(x).tolist() for x in (index.cells(v) if len(v) else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=["h", "v", "buckets"])

    entries = distinct.mapInArrow(place, "h long, v array<double>, ids array<long>, buckets array<long>").select("h", "v", "ids", F.explode("buckets").alias("bucket"))
    probes = asked.mapInArrow(probe, "h long, v array<double>, buckets array<long>").select("h", "v", F.explode("buckets").alias("bucket"))

    # buckets of any size are cut into cells of bounded size
    sizes = (
        entries.select("bucket", F.lit(1).alias("e"), F.lit(0).alias("p")).unionByName(probes.select("bucket", F.lit(0).alias("e"), F.lit(1).alias("p")))
        .groupBy("bucket").agg(F.sum("e").alias("e"), F.sum("p").alias("p")).where("e > 0 and p > 0")
        .withColumns({"row_cells": F.ceil(F.col("e") / cell_rows).cast("int"), "query_cells": F.ceil(F.col("p") / cell_rows).cast("int")})
    )
    sizes = written(sizes.select("bucket", "row_cells", "query_cells", (F.col("e") * F.col("query_cells") + F.col("p") * F.col("row_cells")).alias("load")), "sizes")
    # the rows of both sides once they are replicated to the cells
    slots = max(1, math.ceil((sizes.agg(F.sum("load")).first()[0] or 0) / slot_rows))
    sizes = sizes.drop("load")

    def cells(side: DataFrame, own: str, other: str) -> DataFrame:
        cut = F.pmod(F.xxhash64("h", "v", F.lit(3)), F.col(own)).cast("int")
        out = side.join(sizes, "bucket").withColumn(own, cut).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        cell = F.xxhash64("bucket", "row_cells", "query_cells")
        return out.withColumn("cell", cell).withColumn("slot", F.pmod("cell", F.lit(slots)).cast("int")).drop("bucket", "row_cells", "query_cells")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        """All cells of one slot."""
        out = {"h": [], "v": [], "shard": [], "best": []}
        if left.num_rows and right.num_rows:
            q, _ = matrix(left.column("v"))
            c, _ = matrix(right.column("v"))
            # one query visits many cells: its rows are brought together by its vector
            keys, first, same_q = np.unique(q, axis=0, return_index=True, return_inverse=True)
            best: dict[int, list] = {}
            by_row = nearest_in_cells(left.column("cell").to_numpy(), q, right.column("cell").to_numpy(), c, right.column("ids").to_pylist(), k)
            for r, near in by_row.items():
                best.setdefault(int(same_q.ravel()[r]), []).extend(near)
            slot, hashes = left.column("slot")[0].as_py(), left.column("h").to_numpy()
            for i, near in best.items():
                out["h"].append(int(hashes[first[i]]))
                out["v"].append(q[first[i]])
                out["shard"].append(slot)
                out["best"].append([{"d": d, "vec_id": one} for d, one in sorted(set(near))[: k + 1]])
        best_type = pa.list_(pa.struct([("d", pa.float64()), ("vec_id", pa.int64())]))
        return pa.table({"h": pa.array(out["h"], pa.int64()), "v": pa.array(out["v"], pa.list_(pa.float64())), "shard": pa.array(out["shard"], pa.int32()), "best": pa.array(out["best"], best_type)})

    best = T.ArrayType(T.StructType([T.StructField("d", T.DoubleType()), T.StructField("vec_id", T.LongType())]))
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("shard", T.IntegerType()), T.StructField("best", best)])
    lists = cells(probes, "query_cells", "row_cells").groupBy("slot").cogroup(cells(entries, "row_cells", "query_cells").groupBy("slot")).applyInArrow(rank, schema)
    while True:  # merged as a tree, a table's copy of a candidate counting once
        slots = -(-slots // fan_in)
        merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k + 1)
        lists = lists.groupBy("h", "v", F.floor(F.col("shard") / fan_in).cast("int").alias("shard")).agg(merged.alias("best"))
        if slots <= 1:
            break
    lists = written(lists.select("h", "v", "best"), "lists")
    few = asked.join(lists, ["h", "v"], "left").where(F.coalesce(F.size("best"), F.lit(0)) < k + 1).select("h", "v")

    def compare(batches):
        _, ids, vectors = shipped.value
        c = np.array(vectors, dtype=float).reshape(len(ids), -1)
        for batch in batches:
            q, _ = matrix(pa.chunked_array([batch.column("v")]))
            near = nearest_in_cells(np.zeros(len(q)), q, np.zeros(len(c)), c, [[one] for one in ids], k)
            out = [[{"d": d, "vec_id": one} for d, one in near.get(i, [])] for i in range(len(q))]
            kind = pa.list_(pa.struct([("d", pa.float64()), ("vec_id", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=["h", "v", "best"])

    more = few.mapInArrow(compare, T.StructType([f for f in schema.fields if f.name != "shard"]))
    lists = lists.unionByName(more).groupBy("h", "v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k + 1).alias("best"))
    found = rows.where("__q").select("vec_id", "h", "v").distinct().join(lists.select("h", "v", "best"), ["h", "v"])
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("vec_id")), 1, k)
    return found.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.d").alias("score")
    )
