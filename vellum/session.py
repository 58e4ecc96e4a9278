"""A session for one machine; on a cluster, use the cluster's own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local(cpus: int | str = "*", **conf: str) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8").config("spark.sql.requireAllClusterKeysForCoPartition", "false")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
