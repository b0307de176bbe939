"""Model registry: a table of named model versions, one partition per batch that stored some.

Regression coefficients are stored in the row, trees as text in ``model``, MLlib pipelines
by the path they were saved under; the folder is reached through Spark's file systems.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "name string, kind string, created_at bigint, intercept double, "
    "weights array<double>, path string, model string"
)


def latest_models(models: DataFrame) -> DataFrame:
    """The newest version of every name; of two made at one instant the greater row."""
    others = [c for c in models.columns if c not in ("name", "created_at")]
    newest = F.max(F.struct("created_at", *others)).alias("m")
    return models.groupBy("name").agg(newest).select(
        "name", "m.created_at", *[F.col(f"m.{c}").alias(c) for c in others]
    )


def control_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """``<x>-<kind>…`` messages -> kind (second part), path (the whole) and a running id."""
    others = [c for c in df.columns if c != value]
    return df.select(
        *others,
        F.get(F.split(F.col(value), "-"), 1).alias("kind"),
        F.col(value).alias("path"),
    )


@dataclass(frozen=True)
class Registry:
    root: str

    @property
    def table(self) -> str:
        return f"{self.root}/models"

    def append(self, models: DataFrame, batch: str | None = None) -> None:
        """Add rows; missing columns are null, the time is now where none is given.

        Rows given under a ``batch`` replace those stored under it, so a micro-batch that a
        restarted stream runs again stores nothing twice; a batch without rows replaces nothing.
        """
        if "created_at" not in models.columns:
            models = models.withColumn("created_at", F.unix_micros(F.current_timestamp()))
        spark = models.sparkSession
        empty = spark.createDataFrame([], SCHEMA)
        rows = empty.unionByName(models, allowMissingColumns=True).select(*empty.columns)
        (
            rows.withColumn("batch", F.lit(batch or uuid.uuid4().hex))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(self.table)
        )

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{SCHEMA}, batch string").parquet(self.table).drop("batch")

    def latest(self, spark: SparkSession) -> DataFrame:
        return latest_models(self.read(spark))

    def latest_named(self, spark: SparkSession, name: str):
        """One row, or None."""
        return self.latest(spark).filter(F.col("name") == name).first()

    def tree(self, spark: SparkSession, name: str) -> str:
        """The newest stored tree of this name, for ``tree_walk``."""
        row = self.latest_named(spark, name)
        if row is None or row["model"] is None:
            raise KeyError(f"no tree named {name}")
        return row["model"]

    def save_pipeline(self, spark: SparkSession, model: PipelineModel, name: str, kind: str) -> str:
        stamp = spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]
        path = f"{self.root}/artifacts/{name}-{stamp}"
        model.write().save(path)
        row = spark.createDataFrame(
            [(name, kind, stamp, path)], "name string, kind string, created_at bigint, path string"
        )
        self.append(row)
        return path

    def load_pipeline(self, spark: SparkSession, name: str) -> PipelineModel:
        row = self.latest_named(spark, name)
        if row is None:
            raise KeyError(f"no model named {name}")
        return PipelineModel.load(row["path"])
