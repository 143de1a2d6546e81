"""Cutting lineage through storage that every executor shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there.

    The folder is the one named by ``spark.checkpoint.dir`` in the session.  Where the
    setting is missing, a run inside one machine's driver (tests) takes a temporary
    folder; on a cluster that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def numbered(df: DataFrame, column: str, *order: str) -> DataFrame:
    """``df`` with a running number from 0 in the order of ``order``.

    Rows are range-partitioned and stored; a part's first number is the count of the rows
    before it, so no task sees more than its part.
    """
    stored = cut(df.sort(*order))
    parted = stored.select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id() % F.lit(2**33)).alias("_place"))
    first, before = [], 0
    for part, n in sorted(map(tuple, parted.groupBy("_part").count().collect())):  # one row a partition
        first.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(first, "_part int, _before bigint")
    return parted.join(F.broadcast(offsets), "_part").withColumn(column, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")
