"""Incremental detection and export: work only on (sheet, parameters) that is not stored yet."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from boxlake.session import cut

UNIT = ("sheet_id", "scan_key")


def pending(requested: DataFrame, stored: DataFrame, unit: Sequence[str] = UNIT, force: bool = False) -> DataFrame:
    """Requested units without a stored result; ``force`` asks for all of them again."""
    units = requested.dropDuplicates(list(unit))
    return units if force else units.join(stored.select(*unit), list(unit), "left_anti")


def _read(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame | None:
    """All runs below a folder, or None before the first one. Run folders are no partition columns, so an id
    keeps the type and the spelling it was written with."""
    reader = spark.read.option("recursiveFileLookup", True)
    try:
        return (reader.schema(schema) if schema else reader).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def finished(spark: SparkSession, path: str, unit: Sequence[str] = UNIT, kinds: Sequence[str] | None = None) -> DataFrame:
    """The last finished run of every unit: unit, run, n_hits. A unit without hits is finished, too."""
    schema = ", ".join(f"`{u}` {k}" for u, k in zip(unit, kinds or ["string"] * len(unit))) + ", run long, n_hits long"
    done = _read(spark, f"{path}/done", schema)
    if done is None:
        return spark.createDataFrame([], schema)
    return (done.groupBy(*unit).agg(F.max(F.struct("run", "n_hits")).alias("_l"))
            .select(*unit, F.col("_l.run").alias("run"), F.col("_l.n_hits").alias("n_hits")))


def stored_units(spark: SparkSession, path: str, unit: Sequence[str] = UNIT, kinds: Sequence[str] | None = None) -> DataFrame:
    """Units already finished; reads the small table of finished units, not the hits."""
    return finished(spark, path, unit, kinds).select(*unit)


def read_store(spark: SparkSession, path: str, unit: Sequence[str] = UNIT, kinds: Sequence[str] | None = None) -> DataFrame | None:
    """Hits of the last finished run of every unit; None before the first run."""
    hits = _read(spark, f"{path}/hits")
    return hits if hits is None else hits.join(finished(spark, path, unit, kinds).select(*unit, F.col("run").alias("_run")), [*unit, "_run"]).drop("_run")


def run_pending(requested: DataFrame, path: str, detect: Callable[[DataFrame], DataFrame],
                unit: Sequence[str] = UNIT, force: bool = False, run: int | None = None) -> None:
    """Detect for pending units and append one run: its hits, then the table of units it finished.

    Hits count only once their run is in that table, so a run that broke off leaves nothing behind that is
    read, and running a unit again replaces it. A run is one folder however many units it has.
    """
    spark, run = requested.sparkSession, run or time.time_ns()
    kinds = [requested.schema[u].dataType.simpleString() for u in unit]
    todo = cut(pending(requested, stored_units(spark, path, unit, kinds), unit, force))
    if todo.isEmpty():
        return
    place = f"{path}/hits/run_{run}"
    detect(todo).withColumn("_run", F.lit(run).cast("long")).write.mode("overwrite").parquet(place)
    counts = spark.read.parquet(place).groupBy(*unit).agg(F.count("*").alias("n_hits"))
    (todo.select(*unit).join(counts, list(unit), "left")
     .select(*unit, F.lit(run).cast("long").alias("run"), F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"))
     .write.mode("overwrite").parquet(f"{path}/done/run_{run}"))


def run_stream(requests: DataFrame, path: str, checkpoint: str, detect: Callable[[DataFrame], DataFrame],
               unit: Sequence[str] = UNIT) -> StreamingQuery:
    """The same job fed by a stream of requests; each micro-batch handles what is new."""

    def batch(df: DataFrame, _: int) -> None:
        run_pending(df, path, detect, unit)

    return (requests.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(batch).start())


def skip_existing(requested: DataFrame, exported: DataFrame, force: bool = False) -> DataFrame:
    """Requests whose crops are not exported yet."""
    return requested if force else requested.join(exported.select("rid").distinct(), "rid", "left_anti")

