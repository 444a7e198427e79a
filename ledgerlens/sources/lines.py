"""Line-item sources: typed CSV scan (S1) and the adapter over the star-schema fixture.

A line item is one product position bought by one customer on one day.
Every operator in the library reads this shape (column names can be
remapped by the caller with ``select``/``alias``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.sources.names import clean_name_list, clean_names

CUSTOMER_TYPES = ("B2B", "B2C")

LINE_SCHEMA = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("customer_type", T.StringType()),
        T.StructField("product", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("order_date", T.DateType()),
        T.StructField("unit_price", T.DoubleType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("discount", T.DoubleType()),
        T.StructField("total_price", T.DoubleType()),
    ]
)

LINE_COLUMNS = [f.name for f in LINE_SCHEMA.fields]
NUMERIC_COLUMNS = ["discount", "quantity", "total_price", "unit_price"]

# Fixed values of the fixture adapter: market segments counted as business buyers.
B2B_SEGMENTS = ("MACHINERY", "AUTOMOBILE", "BUILDING")


def read_lines_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, header_clean: bool = True, corrupt_col: str | None = None) -> DataFrame:
    """Typed CSV scan with a header row; no schema inference pass.

    The header is read as text columns, names are cleaned to snake_case, and
    the schema (default: the library's line schema) is applied by name with
    ``try_cast``: malformed numbers and dates become null, columns may stand
    in any order, columns of the schema that the file lacks are null, and
    further columns stay as text. With ``corrupt_col``, that column holds the
    raw line of every row with more or fewer fields than the header.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False)
    raw = reader.csv(path)
    if corrupt_col:
        text = T.StructType([*[T.StructField(c, T.StringType()) for c in raw.columns], T.StructField(corrupt_col, T.StringType())])
        raw = reader.option("columnNameOfCorruptRecord", corrupt_col).schema(text).csv(path)
    if header_clean:
        raw = clean_names(raw)
    wanted = {f.name: f.dataType for f in (schema or LINE_SCHEMA).fields}
    if schema is not None and header_clean:
        wanted = dict(zip(clean_name_list(list(wanted)), wanted.values(), strict=True))
    cols = [F.col(c).try_cast(wanted[c]).alias(c) if c in wanted and not isinstance(wanted[c], T.StringType) else F.col(c) for c in raw.columns]
    missing = [F.lit(None).cast(t).alias(c) for c, t in wanted.items() if c not in raw.columns] if schema is not None else []
    return raw.select(*cols, *missing)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def customer_type_expr(segment: Column) -> Column:
    return F.when(segment.isin(*B2B_SEGMENTS), F.lit("B2B")).otherwise(F.lit("B2C"))


def lines_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items from lineitem ⋈ orders ⋈ customer ⋈ part ⋈ nation.

    Orders are first enriched with their customer's segment and nation
    (orders ≪ lineitem), then joined to the lines. Which sides are broadcast is left to Spark's file statistics and, at run time, to the
    sizes that AQE measures; above its threshold the joins are shuffle joins
    on orderkey / partkey, with AQE splitting a hot key's partition. Catalyst
    prunes every unused column down to the parquet scans.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    cust_n = cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    ord_c = orders.join(cust_n, orders.o_custkey == cust_n.c_custkey)
    joined = li.join(ord_c, li.l_orderkey == ord_c.o_orderkey).join(part, li.l_partkey == part.p_partkey)

    ctype = customer_type_expr(F.col("c_mktsegment"))
    discount = F.when(ctype == "B2B", F.col("l_discount")).otherwise(F.lit(0.0))
    return joined.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        ctype.alias("customer_type"),
        F.col("p_name").alias("product"),
        F.col("p_type").alias("category"),
        F.col("n_name").alias("region"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
        F.col("l_quantity").alias("quantity"),
        discount.alias("discount"),
        (F.col("l_extendedprice") * (F.lit(1.0) - discount)).alias("total_price"),
    )


def typed_lines(df: DataFrame) -> DataFrame:
    """Keep the two known customer types (null and other labels are in neither branch)."""
    return df.where(F.col("customer_type").isin(*CUSTOMER_TYPES))
