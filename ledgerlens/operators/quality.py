"""Data-quality operators: blanks, missing values, duplicates, implausible rows (Q1-Q6, S3)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import checkpoint_dir, local_frame, stored


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty strings become null in every string column (one projection)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            cols.append(F.when(F.col(f.name) == "", F.lit(None).cast("string")).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _missing(f: T.StructField) -> Column:
    c = F.col(f.name)
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def null_profile(df: DataFrame) -> DataFrame:
    """Missing values per column (null, and NaN for floating columns).

    One aggregate pass computes all counts; the single result row is then
    unpivoted to ``(position, column_name, n_missing)``.
    """
    fields = df.schema.fields
    aggs = [F.count_if(_missing(f)).alias(f"c{i}") for i, f in enumerate(fields)]
    wide = df.agg(*aggs)
    pairs = F.array(
        *[F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("column_name"), F.col(f"c{i}").alias("n_missing")) for i, f in enumerate(fields)]
    )
    return wide.select(F.explode(pairs).alias("p")).select("p.*")


def _hash_ready(f: T.StructField) -> Column:
    c = F.col(f.name)
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        # -0.0 and 0.0 are equal values and must hash alike (grouping
        # normalises them; xxhash64 alone would not).
        return F.when(c == 0, F.lit(0.0).cast(f.dataType)).otherwise(c)
    return c


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None, fingerprints: tuple[Column, Column] | None = None) -> DataFrame:
    """Rows equal to an earlier row over ``columns`` (default: all), nulls equal.

    One shuffle: rows are counted by a 64-bit hash, with the least and the greatest of a
    second, independent one. Counts are added up in the tasks, so a row repeated a
    billion times costs one counter a task, and no column is shuffled. Where the second
    hash is the same for a whole group, 128 bits agree and its rows are
    equal. Groups in which it differs are collisions: some tens among 10**10 rows, and
    only they are read again and counted by all their columns. What the groups add up to is
    written, so the table is scanned once. ``fingerprints`` are the two hashes.
    Returns one row ``(n_rows, duplicate_rows)``.
    """
    cols = list(columns or df.columns)
    fields = {f.name: f for f in df.schema.fields}
    ready = [_hash_ready(fields[c]) for c in cols]
    h, second = fingerprints or (F.xxhash64(*ready), F.xxhash64(F.lit(0x9E3779B9), *ready))
    per_hash = df.select(h.alias("__h"), second.alias("__f")).groupBy("__h").agg(F.count(F.lit(1)).alias("__k"), (F.min("__f") == F.max("__f")).alias("__same"))
    collision = F.when(~F.col("__same"), F.col("__h"))
    parts = per_hash.groupBy(collision.alias("__h")).agg(F.sum("__k").alias("__k"), F.sum(F.when(F.col("__same"), F.col("__k") - 1)).alias("__d"))
    summary = stored(parts, "duplicates")  # one row, and one for each collision
    out = summary.agg(F.coalesce(F.sum("__k"), F.lit(0)).cast("long").alias("n_rows"), F.coalesce(F.sum("__d"), F.lit(0)).cast("long").alias("duplicate_rows"))
    collided = summary.where(F.col("__h").isNotNull()).select("__h")
    if collided.isEmpty():
        return out
    more = (
        df.select(h.alias("__h"), *cols).join(collided, "__h", "left_semi").groupBy(*cols).agg(F.count(F.lit(1)).alias("__c"))
        .agg(F.sum(F.col("__c") - 1).cast("long").alias("__more"))
    )
    return out.crossJoin(more).select("n_rows", (F.col("duplicate_rows") + F.col("__more")).alias("duplicate_rows"))  # one row each


# The plausibility rules of the analysis (row is implausible
# if any holds).
INVALID_RULES = {
    "bad_unit_price": "unit_price <= 0",
    "bad_quantity": "quantity <= 0",
    # NaN sorts above all numbers, but it is a missing value and not an implausible one
    "bad_discount": "discount < 0 OR (discount > 1 AND NOT isnan(discount))",
    "bad_total_price": "total_price < 0",
}


def invalid_count(df: DataFrame) -> DataFrame:
    """Implausible rows (any rule true; a null comparison counts as false)
    and one count per rule, all in one aggregate pass."""
    any_rule = " OR ".join(f"({r})" for r in INVALID_RULES.values())
    return df.agg(
        F.count_if(F.expr(any_rule)).alias("invalid_rows"),
        *[F.count_if(F.expr(r)).alias(name) for name, r in INVALID_RULES.items()],
    )


@dataclass
class QualityRun:
    """What one scan of a table gave: the report, and the table split by its rules."""

    report: DataFrame  # (position, section, name, value): one row a measure
    accepted: DataFrame
    rejected: DataFrame  # with ``failed_rules``: every rule that the row breaks


def quality_run(df: DataFrame, rules: dict[str, str] | None = None, date_col: str = "order_date", malformed_col: str | None = None) -> QualityRun:
    """Check, measure and split a table in one scan.

    The rows are written once, apart by whether they break a rule, with the names of
    those rules; missing values per column, broken rules, malformed lines (rows
    where ``malformed_col`` is set), the range of dates and the number of rows are observed
    as the rows pass. A rule that is null for a row does not reject it. The observed measures
    are one row of numbers, whatever the table's size.
    """
    rules = INVALID_RULES if rules is None else rules
    conditions = {name: F.expr(rule) for name, rule in rules.items()}
    if malformed_col:
        conditions["malformed_line"] = F.col(malformed_col).isNotNull()
    fields = [f for f in df.schema.fields if f.name != malformed_col]
    failed = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]))
    marked = df.withColumn("failed_rules", failed).withColumn("rejected", F.size("failed_rules") > 0)
    measures = [("rows", "all", F.count(F.lit(1))), ("rows", "rejected", F.count_if("rejected"))]
    measures += [("missing", f.name, F.count_if(_missing(f))) for f in fields]
    measures += [("broken_rule", name, F.count_if(c)) for name, c in conditions.items()]
    measures += [("date", "first", F.min(date_col).cast("string")), ("date", "last", F.max(date_col).cast("string"))]
    seen = Observation()
    marked = marked.observe(seen, *[m.alias(f"m{i}") for i, (_, _, m) in enumerate(measures)])
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/checked-{uuid.uuid4().hex}"
    marked.write.option("compression", "zstd").partitionBy("rejected").parquet(path)
    got = seen.get
    rows = [(i + 1, section, name, None if got[f"m{i}"] is None else str(got[f"m{i}"])) for i, (section, name, _) in enumerate(measures)]
    names = [("position", T.IntegerType()), ("section", T.StringType()), ("name", T.StringType()), ("value", T.StringType())]
    back = df.sparkSession.read.schema(marked.schema).parquet(path)
    return QualityRun(
        local_frame(df.sparkSession, rows, T.StructType([T.StructField(n, t) for n, t in names])),
        back.where("NOT rejected").select(*df.columns),
        back.where("rejected").select(*df.columns, "failed_rules"),
    )


def date_range(df: DataFrame, col: str = "order_date") -> DataFrame:
    return df.agg(F.min(col).alias("min_date"), F.max(col).alias("max_date"))


def preview(df: DataFrame, n: int = 4, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows in a stable order (all columns by default): a top-k,
    so each task keeps only ``n`` rows before the final merge."""
    keys = list(order_by or df.columns)
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in keys]).limit(n)


def schema_table(df: DataFrame) -> list[tuple[int, str, str]]:
    """Column position, name and Spark type (what a glimpse prints first)."""
    return [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]


def glimpse(df: DataFrame, n: int = 4, order_by: Sequence[str] | None = None) -> DataFrame:
    """One row per column: position, name, Spark type and the first ``n``
    values (stable order) as text, also where the table is empty. Built from the
    top-``n`` preview, so at most ``n`` values per column are ever gathered."""
    from pyspark.sql import Window

    keys = list(order_by or df.columns)
    head = preview(df, n, keys).withColumn(
        "__rn", F.row_number().over(Window.orderBy(*[F.col(c).asc_nulls_first() for c in keys]))
    )
    items = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.col("__rn").alias("rn"),
                F.coalesce(F.col(f.name).cast("string"), F.lit("NA")).alias("value"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    long = head.select(F.explode(items).alias("t")).select("t.*")
    # every column is listed, also where there are no rows
    listed = local_frame(df.sparkSession, schema_table(df), T.StructType([T.StructField("position", T.IntegerType()), T.StructField("column_name", T.StringType()), T.StructField("data_type", T.StringType())]))
    sampled = (
        long.groupBy("position")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "value"))).alias("__v"))
        .select("position", F.array_join(F.transform("__v", lambda s: s["value"]), ", ").alias("sample"))
    )
    return listed.join(sampled, "position", "left").select("position", "column_name", "data_type", F.coalesce("sample", F.lit("")).alias("sample")).orderBy("position")
