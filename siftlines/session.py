"""Session settings and durable reuse of intermediate tables."""

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build(app_name: str, master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder durable intermediates go to.

    A cluster names it in ``spark.checkpoint.dir``; it has to be shared by all
    executors.  Only a local session may fall back to a folder of its own, one per session.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.getCheckpointDir() is not None:
        return context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="siftlines-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def lazily(df: DataFrame) -> DataFrame:
    """The default of every ``keep``: nothing is written, a table read twice is worked out twice."""
    return df


def cached(df: DataFrame) -> DataFrame:
    """A ``keep`` that starts no job: Spark holds the table from the first action on.

    Parts on a lost executor are worked out again.  ``spark.catalog.clearCache()`` lets go of it.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


class Run:
    """Tables that several outputs share, as Parquet below one folder on shared storage.

    Its ``keep`` may be given to the audits: what they read several times is then written once and read back, with
    statistics and column pruning.  ``remove`` deletes the folder once the outputs are written.

        with session.Run(spark, "s3a://bucket/runs/today") as run:
            audit = audits.folder_audit(files, keep=run.keep)
            ...
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = f"{folder or checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"
        self.tables = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> "Run":
        return self

    def __exit__(self, *problem) -> None:
        self.remove()
