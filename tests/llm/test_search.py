"""Exact and approximate search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from ledgerlens.llm import ann, queries, topk

from .conftest import SF001

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("score", T.StringType()), T.StructField("rank", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", "y") for i, v in rows], VECTORS)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def products(rows, queries, k):
    out = []
    for q, qv in queries:
        scored = sorted(((-sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(qv, v, strict=True)), i) for i, v in rows if i != q and len(v) == len(qv)))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def collected(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_products_with_ties_nulls_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 2]) for i in range(120)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(300)]  # many equal vectors
    rows += [(600, None), (700, [1.0, None, 0.0, 0.0]), (800, [float("nan"), 0.0, 0.0, 0.0]), (900, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [(1000, [1.0, 2.0]), (1100, [0.0, 0.0, 0.0, 0.0])]
    good = [(i, v) for i, v in rows if i is not None and usable(v)]
    got = topk.top_k_products(frame(spark, rows), F.col("vec_id") % 100 == 0, k=5, shard_rows=50, block_rows=3, fan_in=2)
    assert collected(got) == products(good, [(i, v) for i, v in good if i % 100 == 0], 5)


def test_products_beyond_exact_doubles(spark):
    rows = [(0, [2.0**20, 1.0]), (1, [2.0**20, 3.0]), (2, [2.0**20, 2.0])]
    got = collected(topk.top_k_products(frame(spark, rows), F.col("vec_id") == 0, k=2))
    assert got == products(rows, rows[:1], 2) and got[0][3] > 2**53


def test_small_and_empty_tables(spark):
    for search in (lambda t, q: topk.top_k_products(t, q), lambda t, q: ann.search(t, q)):
        assert search(frame(spark, []), F.col("vec_id") == 0).count() == 0
        assert search(frame(spark, [(0, [1.0, 0.0])]), F.col("vec_id") == 0).count() == 0
        assert search(frame(spark, [(0, [1.0, 0.0]), (1, None)]), F.col("vec_id") == 0).count() == 0
        three = search(frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]), F.col("vec_id") == 0).collect()
        assert sorted(r.vec_id for r in three) == [1, 2]


def test_products_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    assert collected(queries.op6_exact_top_k(spark, SF001)) == products(rows, [x for x in rows if x[0] % 100 == 0], 10)


def distances(rows, queries, k):
    out = {}
    for q, qv in queries:
        near = sorted((float(np.sqrt(np.square(np.array(qv) - np.array(v)).sum())), i) for i, v in rows if i != q)
        out[q] = [(i, d) for d, i in near[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def shared(got, want, vectors):
    """Share of the true neighbours that were found; what was found is in order, and its distances are exact."""
    assert set(got) == set(want)
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (x[1], x[0])) and len(near) == len(want[q]) and q not in {i for i, _ in near}
        for i, d in near:
            assert d == pytest.approx(float(np.sqrt(np.square(np.array(vectors[q]) - np.array(vectors[i])).sum())), rel=1e-12)
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / max(1, sum(map(len, want.values())))


def test_neighbours_with_equal_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(6)]) for i in range(100)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # one vector that most rows share
    bad = [(2000, None), (2100, [0.0] * 6), (2200, [float("nan")] * 6), (2300, [None] * 6), (None, rows[0][1])]
    table = frame(spark, rows + bad + rows[:3])
    got = found(ann.search(table, (F.col("vec_id") % 100 == 0) | (F.col("vec_id") == 1003), k=4))
    want = distances(rows, [x for x in rows if x[0] % 100 == 0 or x[0] == 1003], 4)
    assert got.keys() == want.keys()
    assert shared(got, want, dict(rows)) >= 0.9


def test_neighbours_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    got, want = found(queries.op2_multiprobe_ann(spark, SF001)), distances(rows, [x for x in rows if x[0] % 100 == 0], 10)
    assert shared(got, want, dict(rows)) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_tables_alone_on_the_given_tables(spark, sf):
    """200 queries of each table: what the visited buckets hold, without the sample."""
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF001[:-5]}{sf[2:]}/embeddings.parquet").collect()]
    every = max(1, len(rows) // 200)
    got = found(ann.search(frame(spark, rows), F.col("vec_id") % every == 0, k=10))
    assert shared(got, distances(rows, [x for x in rows if x[0] % every == 0], 10), dict(rows)) >= 0.9


def test_recall_beyond_the_sample(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.3 * rng.standard_normal((3000, 16))).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    got = found(ann.search(frame(spark, rows), F.col("vec_id") % 100 == 0, k=10, sample_rows=400))
    want = distances(rows, rows[::100], 10)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_recall_of_random_directions_beyond_the_sample(spark):
    x = np.random.default_rng(7).standard_normal((8000, 64)).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x / np.linalg.norm(x, axis=1)[:, None])]
    got = found(ann.search(frame(spark, rows), F.col("vec_id") % 100 == 0, k=10, sample_rows=500))
    want = distances(rows, rows[::100], 10)
    share = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert 0.9 <= share < 1, share  # rests on the tables


def test_slots_follow_the_queries(spark, monkeypatch):
    loaded, apply = [], PandasCogroupedOps.applyInArrow

    def watch(self, func, schema):
        loaded.extend((self._gd1._df.groupBy("slot"), self._gd2._df.groupBy("slot")))
        return apply(self, func, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", watch)
    x = np.random.default_rng(8).standard_normal((300, 4)).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    got = found(ann.search(frame(spark, rows), F.lit(True), k=3, cell_rows=16, slot_rows=200))
    assert shared(got, distances(rows, rows, 3), dict(rows)) >= 0.9
    for side in loaded:
        assert max(r["count"] for r in side.count().collect()) <= 2 * 200


def test_visits_are_in_order_of_score():
    rng = np.random.default_rng(6)
    index = ann.PStableIndex(rng.standard_normal((2, 3, 4)), rng.random((2, 3)), 1.0, 40)
    place = index.cells(rng.standard_normal((1, 4)))[0]
    visited = index.visits(place, 40)
    assert len(set(visited.tolist())) == 40
    base = np.floor(place)
    inside = place - base
    scores = []
    for t in range(2):
        for step in np.ndindex(3, 3, 3):
            step = np.array(step) - 1
            cost = float((np.where(step < 0, inside[t], np.where(step > 0, 1 - inside[t], 0)) ** 2).sum())
            scores.append((cost, int(index.keys((base[t] + step)[None, :], np.array([t]))[0])))
    cost_of = {key: cost for cost, key in scores}
    got = [cost_of[k] for k in visited.tolist()]
    assert got == sorted(got) and got == pytest.approx(sorted(c for c, _ in scores)[:40])
