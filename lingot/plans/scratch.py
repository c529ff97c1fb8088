"""Scratch tables that cut the lineage of iterative operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names, or that the context was given.

    Where neither is set, a local master gets a new folder of its own, which goes with the driver; on a cluster that is
    an error, since executors would write to disks that the others don't see.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="lingot-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Parquet looks at the size of a page and of a row group after each row, not after a hundred: for rows of some megabytes.
LARGE_ROWS = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.block.size": 1 << 24}


def kept(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: cuts lineage, survives lost executors.

    With ``large_rows`` a page holds about one row and a row group few, so that neither writer nor reader holds a task's rows together.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
