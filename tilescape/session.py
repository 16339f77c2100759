"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tilescape", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for.

    Skewed joins (one cell, tile or footprint holding a large share of the rows) are
    split at run time by AQE, also where that costs an extra exchange afterwards.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # Geometry makes long generated methods; HotSpot leaves those uncompiled unless told otherwise.
        "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def by_keys(df: DataFrame) -> DataFrame:
    """`df` joined by sorting both sides on the keys, never by sending one side to every task.

    Spark plans with the compressed size of the scanned columns and takes exploded rows for as
    many as were there before, so an input of gigabytes may pass for a small one. The hint
    holds up to the next join.
    """
    return df.hint("merge")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a private one only for local masters."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    folder = tempfile.mkdtemp(prefix="run-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to a table in the shared checkpoint folder and read it back.

    A written table (unlike an RDD checkpoint) has file sizes, so the next round's joins
    are planned from what the rows really weigh.
    """
    return _written(df, None)


def cut_texts(df: DataFrame) -> DataFrame:
    """`cut` for tables of long texts, which are packed more closely."""
    return _written(df, "zstd")


def _written(df: DataFrame, compression: str | None) -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
