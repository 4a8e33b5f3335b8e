"""Settings of the running cluster that operators depend on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, at_least: int | None = None) -> DataFrame:
    """Gives CPU-heavy stages one task per core at least.

    A small compressed table arrives in one or two splits. A scan that already has more splits than
    the cluster has cores, which is any large table, is left as it is: no shuffle.
    """
    want = at_least or df.sparkSession.sparkContext.defaultParallelism * 2
    have = df.rdd.getNumPartitions()
    return df if have * 2 >= want else df.repartition(want)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only where none is named, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        named = os.path.join(tempfile.gettempdir(), "mendwell-checkpoints")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and goes on from there, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
