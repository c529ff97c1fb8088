"""Rows dealt to tasks by a key before costly work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys into several parts for each core, that stay apart however small they are.

    A file is otherwise read by as few tasks as it has row groups; what is grouped or joined by the keys later need not be dealt again.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)
