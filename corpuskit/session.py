"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on; sizes and counts stay with the cluster's own configuration.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A batch holds whole texts, so it is bounded by rows and, where the Spark version knows the setting, by bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    # Workers of unlike settings are pools of their own, and idle ones keep their memory for a minute. This one reaches
    # workers of SQL alone, so without it rows listed in the driver open a second pool on every executor.
    "spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by all executors for cut plans.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where driver and executors
    are one process, may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="corpuskit-")
    spark.sparkContext.setCheckpointDir(root)
    return scratch_root(spark)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the scratch folder."""
    return f"{scratch_root(spark)}/stages/{label}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Stage:
    """A result written to the scratch folder, with the plan that reads it back."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        """Delete the files; call only when no later plan reads them."""
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Rows of several MB: the writer looks at its buffers after every row, not after a hundred, and closes a group at 4 MB.
WIDE_ROWS = {"parquet.enable.dictionary": "false", "parquet.block.size": 1 << 22, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def write_stage(df: DataFrame, label: str, wide: bool = False, **options) -> Stage:
    """Write ``df`` to the scratch folder and read it back: lineage ends here and survives lost executors.

    ``wide`` says that single rows hold MBs; ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**(WIDE_ROWS if wide else {}), **options).parquet(path)
    return Stage(spark.read.schema(df.schema).parquet(path), path)
