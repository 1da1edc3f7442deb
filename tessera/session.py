"""Session defaults and fixture access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at every size; partition counts are left to AQE and the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tessera", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=DEFAULTS | settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
