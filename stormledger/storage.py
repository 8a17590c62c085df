"""Tables in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; in local mode a temporary folder where none is set.

    On a cluster a folder of one machine is out of the others' sight, so there the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="stormledger-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """Rows that a join must not send whole to the driver and every executor.

    The planner takes the size of exploded or packed rows from that of the file below them, and would broadcast a hundred times what it expects. A
    hint keeps such a join sorted and dealt out by key, where AQE can still split what is hot.
    """
    return df.hint("merge")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage, survives lost executors, and gives the planner the table's true
    size, so that a later join is broadcast only if the size allows it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
