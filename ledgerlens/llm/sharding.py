"""Sharding by proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash, get the fractional rank
(2r + 1) / (2n) there, and are put in order of it. Cutting that order into
equal runs gives shards whose mixture matches the whole.

Both orders are built without a global sort and without one source in one
task. A row's hash bucket within its source, and the bucket of its
fractional rank, each hold a bounded number of rows; ranks run within a bucket,
and the number of rows before a bucket comes from counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HASH_BITS = 40


def interleave(docs: DataFrame, n_shards: int, seed: str, id_col: str = "doc_id", source_col: str = "source", bucket_rows: int = 20_000) -> DataFrame:
    """Adds ``shard`` and ``slot`` (gapless from 0) to all rows; all other columns are kept.

    Shard sizes differ by one row at most, the first shards being the larger.
    A null source is a source of its own. Ties of the hash are broken by the id; rows with equal ids
    and equal hashes are interchangeable. Columns named shard or slot are
    replaced. An empty table gives no rows.
    """
    rows = docs.drop("shard", "slot")
    keep = rows.columns
    total = rows.count()
    buckets = max(1, math.ceil(total / bucket_rows))
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    number = F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")
    rows = (
        rows.withColumn("__source", source)
        .withColumn("__digest", digest)
        .withColumn("__bucket", F.floor(number * F.lit(buckets) / F.lit(float(1 << HASH_BITS))).cast("long"))
    )

    # rows of a source before each of its hash buckets
    counts = rows.groupBy("__source", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    in_source = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(in_source), F.lit(0))).withColumn("__size", F.sum("__n").over(Window.partitionBy("__source")))
    shuffled = Window.partitionBy("__source", "__bucket").orderBy("__digest", F.col(id_col))
    ranked = rows.join(counts.drop("__n"), ["__source", "__bucket"]).withColumn("__r", F.col("__before") + F.row_number().over(shuffled) - 1)

    # floor((2r + 1) * buckets / 2n): the bucket of the fractional rank, in whole numbers
    ranked = ranked.withColumn("__slice", F.expr(f"((2 * __r + 1) * {buckets}L) div (2 * __size)"))
    sizes = counts.select("__source", "__size").distinct()
    grid = sizes.withColumn("__slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    # of a source of n rows, floor((2nb + B - 1) / 2B) have a fractional rank below slice b of B
    before = grid.groupBy("__slice").agg(F.sum(F.expr(f"(2 * __size * __slice + {buckets - 1}L) div {2 * buckets}L")).alias("__start"))
    order = Window.partitionBy("__slice").orderBy((F.col("__r") * 2 + 1) / (F.col("__size") * 2), "__source", "__r")
    placed = ranked.join(before, "__slice").withColumn("__pos", F.col("__start") + F.row_number().over(order) - 1)

    base, extra = divmod(total, n_shards)
    edge = extra * (base + 1)
    shard = F.when(F.col("__pos") < edge, F.expr(f"__pos div {base + 1}L")).otherwise(F.expr(f"{extra} + (__pos - {edge}L) div {max(base, 1)}L"))
    start = F.expr(f"shard * {base}L + least(shard, {extra})")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("__pos") - start).cast("long")).select(*keep, "shard", "slot")


def write_shards(docs: DataFrame, path: str, n_shards: int, seed: str, **columns) -> None:
    """One folder a shard, rows in slot order within each of its files."""
    placed = interleave(docs, n_shards, seed, **columns)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
