"""Tables written between the steps of an operator, in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

#: Only for sessions on one machine (tests) that name no shared folder.
LOCAL_DEFAULT = "/tmp/checkpoints"
#: Rows are whole texts, so fewer of them than Spark's default go to Python at once.
BATCH, RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500
#: While a table is written: shuffle files go when it is whole, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a local one is set if Spark runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        found = LOCAL_DEFAULT
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch to RECORDS, unless the session has less."""
    if int(spark.conf.get(BATCH)) > RECORDS:
        spark.conf.set(BATCH, str(RECORDS))


class Scratch:
    """Named Parquet tables of one run of an operator.

    A table that is written here cuts the lineage: a lost executor costs its own tasks
    again, not the steps before.  `drop` deletes tables that no later plan reads.  What an operator returns may
    still read some; `clear` deletes those of all operators, once results are written.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, operator: str):
        small_batches(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{operator}-{uuid.uuid4().hex}"
        Scratch.made.append(self)

    @classmethod
    def clear(cls, first: int = 0) -> None:
        """Delete all tables of this process, from the `first`-th in `made` on.  Results that still read them are lost."""
        gone = cls.made[first:]
        del cls.made[first:]
        for x in gone:
            x.drop()

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def narrow(self, kept: DataFrame, most: int = 1_000_000) -> DataFrame:
        """A written table of a few numbers a row, to be broadcast if its rows are counted to be few; beyond
        that the join shuffles."""
        return broadcast(kept) if kept.count() <= most else kept

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
