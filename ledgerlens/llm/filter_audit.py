"""Audit of how document filters interact when they are applied in every order.

Each filter has a relation of the ids that fail it, one table in the shared
folder. What a prefix of filters leaves over depends only on which filters it
holds, so survivors are kept once for each set: level by level, a left-anti
join with the next filter's relation gives the survivors of the larger set,
and a left-semi join gives what that filter removes there, with its
redundancies and label losses. Orders are only read off the sets at the end.

Everything is a DataFrame join on narrow rows. An id relation is keyed by the
row's id and its text's digest, so no key is hot; equal rows are one row with
a count.
"""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import shared_path, written
from ledgerlens.session import local_frame

MAX_FILTERS = 7  # 5,040 orders
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on a text: A few words, B repeated words, C capitals, D marks of code or tables.

    Words are maximal runs without ASCII white space, compared as they are.
    """
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": n < 200,
        "B": F.lit(100) * distinct < F.lit(50) * n,
        "C": F.lit(100) * capitals > F.lit(3) * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


@dataclass
class Relations:
    """What an audit is computed from: narrow document rows, and the ids that fail each filter.

    ``rows``: (doc, key, part, n, good, toxic), equal rows once with their
    number ``n``. ``failing``: (filter, doc, key), stored as one table per filter.
    """

    names: list[str]
    rows: DataFrame
    failing: DataFrame


def relations(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], duplicates: str, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> Relations:
    """Store the failing-id relation of each filter, and of ``duplicates``: texts that a smaller id has too.

    ``filters`` are conditions over ``docs``; null counts as passed. A row without an id has no
    smaller id before it and fails no duplicate filter; it counts in all others. Repeated labels of one
    id count if any of them says so.
    """
    names = [*filters, duplicates]
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.select(
        F.col(id_col).alias("doc"),
        F.unhex(F.md5(text.cast("binary"))).alias("key"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in filters.items()])).alias("failed"),
    )
    # a text's digest decides what it fails, so copies of a row differ in nothing
    facts = written(facts.groupBy("doc", "key", "part", "failed").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    folder = shared_path(docs.sparkSession, "failing")
    own = facts.select("doc", "key", F.explode("failed").alias("filter"))
    first = facts.groupBy("key").agg(F.min("doc").alias("doc"))
    later = facts.where("doc is not null").join(first, ["doc", "key"], "left_anti").select("doc", "key", F.lit(duplicates).alias("filter"))
    for part in (own, later):
        part.write.mode("append").option("compression", "zstd").partitionBy("filter").parquet(folder)
    failing = docs.sparkSession.read.schema(own.schema).parquet(folder)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("doc")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    rows = facts.join(marks, "doc", "left").select("doc", "key", "part", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    return Relations(names, written(rows, "audit-labelled"), failing)


def prefix_steps(found: Relations) -> tuple[DataFrame, DataFrame]:
    """(part, done, next, removed, good_lost, toxic_lost) and (part, done, kept), for every set ``done`` of filters.

    Sets are numbers whose bit i stands for filter i. A set's survivors are reached
    once, by adding its filters in ascending order; each level's survivors are stored.
    """
    every = range(len(found.names))
    number = F.create_map(*[x for i, name in enumerate(found.names) for x in (F.lit(name), F.lit(i))])
    failing = found.failing.select(F.col("doc").alias("f_doc"), F.col("key").alias("f_key"), number[F.col("filter")].alias("f_next")).distinct()
    fails = F.col("doc").eqNullSafe(F.col("f_doc")) & (F.col("key") == F.col("f_key")) & (F.col("next") == F.col("f_next"))
    n = F.col("n")
    level = found.rows.withColumn("done", F.lit(0))
    removed, kept = [], []
    for size in range(len(found.names) + 1):
        kept.append(level.groupBy("part", "done").agg(F.sum("n").alias("kept")))
        if size == len(found.names):
            break
        steps = level.withColumn("next", F.explode(F.array_compact(F.array(*[F.when(F.col("done").bitwiseAND(1 << i) == 0, F.lit(i)) for i in every]))))
        gone = steps.join(failing, fails, "left_semi")
        removed.append(gone.groupBy("part", "done", "next").agg(F.sum("n").alias("removed"), F.sum(n * F.col("good")).alias("good_lost"), F.sum(n * F.col("toxic")).alias("toxic_lost")))
        ascending = steps.where(F.expr("shiftright(done, next)") == 0)
        left = ascending.join(failing, fails, "left_anti")
        level = written(left.withColumn("done", F.col("done").bitwiseOR(F.expr("shiftleft(1, next)"))).drop("next"), "survivors")
    return functools.reduce(DataFrame.unionByName, removed), functools.reduce(DataFrame.unionByName, kept)


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], duplicates: str, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, with what the step's filter does there.

    Columns: part, filter_order (the names joined), step (from 1), filter, kept,
    removed, redundant (failing, but removed earlier), unique_fails (failing this
    filter alone), good_lost, toxic_lost, shapley (removed, summed over all orders).
    Zeros are given too. Null texts are empty; a null part is the part of the empty
    string; repeated rows count each; rows without an id are documents that nothing
    precedes and that have no label. Extra columns of ``docs`` are not read. An
    empty table has no parts and gives no rows.
    """
    m = len(filters) + 1
    if m > MAX_FILTERS:
        raise ValueError(f"{m} filters have {math.factorial(m)} orders; at most {MAX_FILTERS} are audited")
    found = relations(docs, labels, filters, duplicates, id_col, text_col, part_col)
    removed, kept = (written(t, name) for t, name in zip(prefix_steps(found), ("removed", "kept"), strict=True))
    every = range(m)
    orders = []
    for order in itertools.permutations(every):
        done = 0
        for step, i in enumerate(order, 1):
            orders.append(("".join(found.names[j] for j in order), step, found.names[i], done, i))
            done |= 1 << i
    steps = local_frame(docs.sparkSession, orders, T.StructType([T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), T.StructField("filter", T.StringType()), T.StructField("done", T.IntegerType()), T.StructField("next", T.IntegerType())]))

    # every set with every filter outside it, zeros included
    pairs = found.rows.select("part").distinct().withColumn("done", F.explode(F.sequence(F.lit(0), F.lit(2**m - 1))))
    pairs = pairs.withColumn("next", F.explode(F.array_compact(F.array(*[F.when(F.col("done").bitwiseAND(1 << i) == 0, F.lit(i)) for i in every]))))
    pairs = pairs.withColumn("after", F.col("done").bitwiseOR(F.expr("shiftleft(1, next)")))
    counts = pairs.join(removed, ["part", "done", "next"], "left").join(kept.withColumnRenamed("done", "after"), ["part", "after"], "left")
    counts = counts.na.fill(0, ["removed", "good_lost", "toxic_lost", "kept"])
    same = Window.partitionBy("part", "next")
    earlier = F.bit_count("done")
    ways = F.factorial(earlier) * F.factorial(F.lit(m - 1) - earlier)  # orders with just these filters before
    counts = counts.withColumns(
        {
            "redundant": F.max(F.when(F.col("done") == 0, F.col("removed"))).over(same) - F.col("removed"),
            "unique_fails": F.max(F.when(earlier == m - 1, F.col("removed"))).over(same),
            "shapley": F.sum(F.col("removed") * ways).over(same),
        }
    )
    # the orders are a table of m * m! rows, whatever the documents are
    out = counts.join(F.broadcast(steps), ["done", "next"])
    return out.select("part", "filter_order", "step", "filter", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])
