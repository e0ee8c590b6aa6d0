"""Session settings and the one place that cuts lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "boxlake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with AQE, skew-join splitting and UTC; cluster settings win over these."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master with nothing configured falls back to a temporary folder; on a
    cluster a machine-local folder would lose data with its executor, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-boxlake-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """``cut(df)`` without Spark's estimate of its size, for loops.

    A checkpoint keeps the estimate of the plan it was made by, and that of a join is the product of its sides: where each round
    joins what the last one left, the digits of the number multiply with every round, until it fills the driver."""
    df = cut(df)
    return DataFrame(df.sparkSession._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), df.sparkSession)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage, upon which Spark deletes shuffle files and checkpoints that nothing refers to any more.

    Else they stay on disk until the driver's heap happens to fill. For jobs of many steps that each move about as much as the input."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a join side that is shuffled and sorted, never broadcast.

    Spark judges a table by the bytes of its files and leaves out what ``explode`` adds, and takes a checkpoint for
    as small as its source: tables of millions of rows would be sent whole through the driver. For sides that
    grow with the input."""
    return df.hint("merge")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, for tables that a job writes and reads again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
