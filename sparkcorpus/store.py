"""Tables written between the steps of one operator, in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only where Spark runs in one process and names no shared folder, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        found = LOCAL_DEFAULT
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Steps:
    """Parquet tables of one run: each cuts the lineage, so a lost executor costs its own tasks only."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{operator}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, by: list[str] = ()) -> DataFrame:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        """Tables that no later plan reads; without names all of them."""
        jvm = self.spark._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
