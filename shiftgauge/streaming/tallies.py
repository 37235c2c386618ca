"""Project tallies kept up to date as files arrive.

The per-file features are stateless and the tallies are sums, so the batch code runs on a stream
unchanged; the state is one row of counts per project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shiftgauge.operators.features import file_features, project_tallies
from shiftgauge.operators.files import ScanConfig

FILE_SCHEMA = "project_id string, path string, content string"


def stream_files(spark: SparkSession, location: str, files_per_trigger: int = 1000) -> DataFrame:
    """New parquet files of a code table, as they arrive."""
    return (
        spark.readStream.schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(location)
    )


def stream_tallies(files: DataFrame, config: ScanConfig) -> DataFrame:
    return project_tallies(file_features(files, config))


def shared_checkpoint(spark: SparkSession, name: str) -> str:
    """A folder below the one that the cluster shares for checkpoints."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("spark.checkpoint.dir is not set")
    return f"{shared.rstrip('/')}/{name}"


def write_tallies(tallies: DataFrame, location: str, name: str) -> StreamingQuery:
    """Write the changed projects of each batch. A repeated batch replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{location}/batch={number}")

    return (
        tallies.writeStream.outputMode("update")
        .option("checkpointLocation", shared_checkpoint(tallies.sparkSession, name))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def latest_tallies(spark: SparkSession, location: str) -> DataFrame:
    """The newest row of every project."""
    rows = spark.read.parquet(location)
    columns = [c for c in rows.columns if c != "batch"]
    return (
        rows.groupBy("project_id")
        .agg(F.max_by(F.struct(*columns), "batch").alias("row"))
        .select("row.*")
    )
