"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Configuration every job in the library relies on. AQE coalesces the
# shuffle partitions after each exchange and splits skewed join partitions;
# the session time zone is pinned so dates never shift.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpointed summaries are deleted once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(
    master: str | None = None,
    app: str = "ledgerlens",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or fetch) a session with the library's defaults.

    Under ``spark-submit`` (which names its gateway port in the environment)
    the master is left to it; a plain Python process defaults to ``local[*]``.
    """
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    elif not (os.environ.get("PYSPARK_GATEWAY_PORT") or os.environ.get("SPARK_REMOTE")):
        builder = builder.master("local[*]")
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared, reliable folder and
    is used as is. Only when it is missing and the master is local (tests) a
    fresh temporary folder is created and registered; on a cluster a folder
    of the driver's machine would lose the data, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a shared folder when the master is not local")
        configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and cut its lineage.

    Used for small results (model coefficients, quantile brackets) that are
    read several times; a lost executor then re-reads the files instead of
    recomputing the whole upstream plan. Never ``localCheckpoint``.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Like ``materialize`` it cuts the lineage, so that several passes and a lost
    executor read files instead of running the plan again. The table is
    columnar, and the planner knows its size: it is broadcast only where it is small.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_frame(spark: SparkSession, rows, schema) -> DataFrame:
    """A small driver-side table as a JVM ``LocalTableScan`` (Arrow path).

    ``createDataFrame`` on a Python list plans an RDD scan that needs Python
    workers in every task; going through pandas + Arrow keeps the table in
    the JVM plan. Only for tables whose row count the caller has bounded.
    """
    import pandas as pd

    names = [f.name for f in schema.fields]
    pdf = pd.DataFrame.from_records([tuple(r) for r in rows], columns=names)
    if pdf.empty:
        return spark.createDataFrame(spark.sparkContext.emptyRDD(), schema)
    return spark.createDataFrame(pdf, schema)
