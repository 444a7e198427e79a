"""Near duplicates among embeddings by navigable small-world graphs.

Equal vectors are one node. Nodes are dealt by hash into shards of bounded
size; each shard's graph is built by one task and stored as a file in the
shared folder. Every block of nodes then queries every shard's graph; what a
search meets is verified by its cosine in double precision. A cell (block and
shard) gives out one count a node, and only those links that join two
components within the cell, so no pairs are listed however many copies there
are. The links are united by pointer doubling.
"""

from __future__ import annotations

from decimal import Decimal
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import shared_path, written
from ledgerlens.llm.hash_tables import put_file
from ledgerlens.llm.hnsw import Graph, units
from ledgerlens.llm.neardup import components
from ledgerlens.llm.topk import matrix

SHARD_NUMBERS = 1 << 22  # vector components in one shard: a graph of some 60 MB
LEAST_SHARD_ROWS = 256
QUERY_ROWS = 4096
HOT_SHARE = 1000  # a vector with more than 1 / HOT_SHARE of the rows is hot: there are fewer than HOT_SHARE
MOST_CELLS = 20_000  # partitions of the cells; more cells share them
SIGN = -(1 << 63)


def read_file(folder: str, name: str) -> bytes:
    """A file below a shared folder (a path or any URI that Arrow opens); a missing one raises."""
    place = urlparse(folder)
    if place.scheme in ("", "file"):
        with open(f"{place.path}/{name}", "rb") as f:
            return f.read()
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        return f.read()


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(h, key, v, dim, rows, ids) of rows (vec_id, h, v): each vector once, with its numbers of rows and of ids.

    ``key`` orders like the vector's least id. Vectors are brought together once; ids are counted on narrow rows.
    """
    ids = rows.groupBy("h", "vec_id").agg(F.count(F.lit(1)).alias("rows"))
    ids = ids.groupBy("h").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("ids"), F.min("vec_id").alias("first_id"))
    ordered = F.lpad(F.hex(F.col("first_id").bitwiseXOR(F.lit(SIGN))), 16, "0")
    one = rows.select("h", "v").dropDuplicates(["h"])
    return one.join(ids, "h").select("h", F.concat(ordered, F.substring("h", 1, 16)).alias("key"), "v", F.size("v").alias("dim"), "rows", "ids")


def first_id(key: Column) -> Column:
    """The id at the start of a node's key."""
    number = F.conv(F.substring(key, 1, 16), 16, 10).cast("decimal(20,0)")
    return (number - F.lit(Decimal(1 << 63))).cast("long")


def build_shards(nodes: DataFrame, folder: str, at_least: float, shard_numbers: int) -> DataFrame:
    """Store a graph file a shard; (dim, shard, rows, beam) of every shard. Vectors of one length share shards."""
    sizes = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    room = F.greatest(F.floor(F.lit(shard_numbers) / F.col("dim")), F.lit(LEAST_SHARD_ROWS))
    shards = written(sizes.select("dim", F.ceil(F.col("n") / room).alias("shards")), "shards")
    placed = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("h")  # hashes: an order without meaning, as the graph wants it
        dim, shard = rows.column("dim")[0].as_py(), rows.column("shard")[0].as_py()
        v, _ = matrix(rows.column("v"))
        graph = Graph.build(units(v), at_least, seed=shard)
        data = graph.dump(keys=np.array(rows.column("key").to_pylist(), dtype="S32"), ids=rows.column("ids").to_numpy())
        put_file(folder, f"{dim}-{shard}.npz", data)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "rows": pa.array([rows.num_rows], pa.int64()), "beam": pa.array([graph.beam], pa.int64())})

    return written(placed.select("dim", "shard", "h", "key", "v", "ids").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, rows long, beam long"), "graphs")


class Classes:
    """Components of the nodes of one cell, as a label a node; gives out the links that join two."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def joining(self, one: int, others: np.ndarray) -> np.ndarray:
        """Of the nodes linked with ``one``, one for each component that is joined to its own now."""
        own, label = self.label[one], self.label[others]
        if (label == own).all():
            return others[:0]
        found, first = np.unique(label, return_index=True)
        new = found != own
        self.label[np.isin(self.label, found[new])] = own
        return others[first[new]]


def search_cells(shards: DataFrame, folder: str, at_least: float, query_rows: int) -> DataFrame:
    """Rows (a, null, n): ids of the vectors linked with a in one shard; and (a, b, null): links that suffice for the components.

    Each block of nodes is asked of every shard of vectors of its length.
    """
    left = shards.select("dim", F.col("shard").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / query_rows))).alias("block"))
    cells = written(left.join(shards.select("dim", F.col("shard").alias("b")), "dim"), "cells")

    def search(batches):
        held: dict[str, tuple] = {}

        def graph(dim: int, shard: int):
            name = f"{dim}-{shard}.npz"
            if name not in held:
                while len(held) > 1:  # two graphs at a time
                    held.pop(next(iter(held)))
                held[name] = Graph.load(read_file(folder, name))
            return held[name]

        for batch in batches:
            for dim, a, b, block in zip(*(batch.column(c).to_pylist() for c in ("dim", "a", "b", "block")), strict=True):
                own, mine = graph(dim, a)
                other, theirs = graph(dim, b)
                start = block * query_rows
                asked = np.arange(start, min(start + query_rows, len(own.x)))
                # of its own shard a node is the same node on both sides
                place = asked if a == b else len(other.x) + np.arange(len(asked))
                classes, count = Classes(len(other.x) + (0 if a == b else len(asked))), np.zeros(len(asked), dtype=np.int64)
                link_a, link_b = [], []
                for some, rows, near in other.similar(own.x[asked], at_least):
                    if a == b:
                        near &= asked[some][:, None] != rows[None, :]
                    count[some] += near @ theirs["ids"][rows]
                    for i, line in zip(some[near.any(axis=1)].tolist(), near[near.any(axis=1)], strict=True):
                        joined = classes.joining(int(place[i]), rows[line])
                        link_a += [i] * len(joined)
                        link_b += joined.tolist()
                keys = mine["keys"][asked]
                linked = np.flatnonzero(count)
                names = [*keys[linked].tolist(), *keys[link_a].tolist()]
                partners = [*[None] * len(linked), *theirs["keys"][link_b].tolist()]
                counts = [*count[linked].tolist(), *[None] * len(link_a)]
                text = lambda x: pa.array([k and k.decode() for k in x], pa.string())
                yield pa.RecordBatch.from_arrays([text(names), text(partners), pa.array(counts, pa.int64())], names=["a", "b", "n"])

    parts = max(1, min(cells.count(), MOST_CELLS))
    return written(cells.repartition(parts, "dim", "a", "b", "block").mapInArrow(search, "a string, b string, n long"), "found")


def near_duplicates(table: DataFrame, at_least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", shard_numbers: int = SHARD_NUMBERS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """One row per row: (id, n_links, component_id, kept).

    Vectors are linked if their cosine is ``at_least`` or more. ``n_links``
    counts the other ids' vectors linked directly, ``component_id`` is the least
    id that links reach, itself included, and ``kept`` marks rows with that id.
    Rows without an id, and vectors that are null, empty, zero or hold a null or
    non-finite component, link with nothing: they are components of their
    own and kept. Vectors of different lengths are not linked. Repeated rows are one vector
    and are each returned; an id with several vectors has a row for each. Extra
    columns are not read. An empty table gives no rows.
    """
    v = F.col(vec_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    digest = F.concat(*[F.lpad(F.hex(F.xxhash64(v, F.lit(seed))), 16, "0") for seed in (1, 2)])
    rows = table.select(F.col(id_col).alias("vec_id"), F.when(usable, digest).alias("h"), F.when(usable, v).alias("v"))
    nodes = written(distinct_vectors(rows.where("h is not null")), "vectors")
    folder = shared_path(table.sparkSession, "hnsw")
    found = search_cells(build_shards(nodes, folder, at_least, shard_numbers), folder, at_least, query_rows)
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("links"))
    classes = components(found.where("b is not null").select("a", "b")).withColumnRenamed("text_key", "key")
    about = nodes.select("h", "key", "rows", "ids").join(counts, "key", "left").join(classes, "key", "left")
    about = written(
        about.select("h", "rows", (F.col("ids") - 1 + F.coalesce("links", F.lit(0))).alias("links"), first_id(F.coalesce("class_key", "key")).alias("least")), "classes"
    )
    # vectors that many rows share are few, whatever the table's size; the others are joined by a shuffle
    total = about.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    is_hot = F.col("rows") * HOT_SHARE > total
    hot = about.where(is_hot).select("h", F.col("links").alias("hot_links"), F.col("least").alias("hot_least"))
    narrow = rows.select("vec_id", "h").join(F.broadcast(hot), "h", "left")
    spread = F.when(F.col("hot_least").isNull() & F.col("h").isNotNull(), F.col("h")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))))
    joined = narrow.withColumn("place", spread).join(about.where(~is_hot).select(F.col("h").alias("place"), "links", "least"), "place", "left")
    least = F.coalesce("hot_least", "least", "vec_id")
    return joined.select(
        F.col("vec_id").alias(id_col), F.coalesce("hot_links", "links", F.lit(0)).cast("long").alias("n_links"), least.cast("long").alias("component_id"), F.col("vec_id").eqNullSafe(least).alias("kept")
    )
