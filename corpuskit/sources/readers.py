"""Reading and writing tables, JSON lines, loss logs and trial configurations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object per line; blank lines are skipped, a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def from_rows(spark: SparkSession, rows: Sequence, schema: StructType | str) -> DataFrame:
    """A small table from Python rows."""
    return spark.createDataFrame(rows, schema)


def save_table(df: DataFrame, path: str) -> None:
    """Write parquet; an existing table is an error."""
    df.write.mode("errorifexists").parquet(path)


def load_table(spark: SparkSession, path: str, keep_in_memory: bool = False) -> DataFrame:
    """Read parquet, on request kept in executor memory (and on disk beyond it)."""
    df = spark.read.parquet(path)
    return df.persist() if keep_in_memory else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of an input that comes in fewer splits than there are cores.

    An input with more splits than cores, as any large one has, is left alone and costs no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def peek(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The first row in a stated order, found without a full sort."""
    return df.orderBy(*order).limit(1)


def n_rows(df: DataFrame) -> int:
    return df.count()


@dataclass(frozen=True)
class SourceSpec:
    """Where a source lies and what to take from it."""

    name: str
    path: str
    format: str = "parquet"
    split: str | None = None
    split_column: str = "split"
    columns: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    weight: float = 1.0
    schema: str | None = None
    options: dict = field(default_factory=dict)


def read_source(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """A registered source; split filter and column choice reach the scan."""
    reader = spark.read.format(spec.format).options(**spec.options)
    if spec.schema:
        reader = reader.schema(spec.schema)
    df = reader.load(spec.path)
    if spec.split is not None:
        df = df.where(F.col(spec.split_column) == spec.split)
    if spec.columns:
        df = df.select(*spec.columns)
    return df.drop(*spec.drop)


class SourceRegistry:
    """Sources by name."""

    def __init__(self, specs: Sequence[SourceSpec] = ()):
        self._specs = {}
        for spec in specs:
            self.add(spec)

    def add(self, spec: SourceSpec) -> None:
        if spec.name in self._specs:
            raise ValueError(f"source {spec.name} is registered already")
        self._specs[spec.name] = spec

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return read_source(spark, self._specs[name])

    def weights(self) -> dict[str, float]:
        return {name: spec.weight for name, spec in self._specs.items()}


def load_loss_log(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rows ``(run, step, loss)`` from files that each hold one JSON array of numbers; the run is the file path.

    With ``lines`` a file holds many runs, each a line ``{"run": ..., "losses": [...]}``; the run is a string there too.
    """
    if lines:
        runs = read_jsonl(spark, path, "run string, losses array<double>")
    else:
        runs = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("run"), F.from_json("value", "array<double>").alias("losses")
        )
    return runs.select("run", F.posexplode("losses").alias("step", "loss"))


def load_trial_configs(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object per file, with the file path as ``run``."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.select(F.col("_metadata.file_path").alias("run"), "*")
