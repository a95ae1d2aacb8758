"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, a folder of our own, but on one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            folder = held.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            folder = "file://" + tempfile.mkdtemp(prefix="paperloom-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Rows in an Arrow batch: texts are long, and a batch is held by the JVM and by Python.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_RELEASE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ``BATCH_ROWS`` (a smaller one stays), 8 MB at most."""
    if not 0 < int(spark.conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 23))


class Scratch:
    """Intermediate tables of one operator call, written once and reread.

    A written table cuts lineage, survives lost executors and is computed only
    once.  ``drop`` removes those that the operator's lazy result doesn't read;
    ``release`` removes the rest, once that result has been written.
    """

    _made: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._made.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
        """``narrow`` tables (no texts) are dealt anew first, so that many small tasks write few files."""
        df = df.hint("rebalance") if narrow else df
        held = self.spark.conf.get(_RELEASE_CONF)
        self.spark.conf.set(_RELEASE_CONF, "true")  # shuffle files go as soon as the table is written
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            self.spark.conf.set(_RELEASE_CONF, held)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names or ("",):
            _delete(self.spark, self.path(name) if name else self.root)

    @classmethod
    def mark(cls) -> int:
        """Stands for the folders made up to now."""
        return len(cls._made)

    @classmethod
    def release(cls, spark: SparkSession, since: int) -> None:
        """Removes the folders made since a mark; nothing may read them any more."""
        for root in cls._made[since:]:
            _delete(spark, root)
        del cls._made[since:]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dealt(rows: DataFrame, key: str, chunk: Column, groups: int) -> DataFrame:
    """Equal rows counted (``__n``) in chunks of at most ``chunk`` rows, numbered and each dealt to a ``__group``."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n")).withColumn("__most", chunk.cast("long"))
    cut = counted.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / F.col("__most")).cast("long"))))
    rest = F.col("__n") - F.col("__chunk") * F.col("__most")
    return cut.withColumns({"__n": F.least("__most", rest), "__group": F.pmod(F.xxhash64(key, "__chunk"), F.lit(groups))}).drop("__most")
