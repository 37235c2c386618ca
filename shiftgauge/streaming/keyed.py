"""Tallies over a stream of file events, with state for every file.

The state of a (project, path) is the version seen last and what the file added. A newer version, or a deletion,
takes the old numbers back and adds the new ones; a repeated or late event changes nothing. What comes out are differences, whose
sums per project are the tallies of the files as they are now.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shiftgauge.functions import fixed_values as fixed
from shiftgauge.functions.workers import importable
from shiftgauge.operators import features
from shiftgauge.operators.files import ScanConfig
from shiftgauge.streaming.tallies import shared_checkpoint

EVENT_SCHEMA = "project_id string, path string, content string, version long, deleted boolean"


def stream_events(spark: SparkSession, location: str, files_per_trigger: int = 1000) -> DataFrame:
    """New parquet files of file events: a version that grows with every change of a path, and whether it was deleted."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(location)


def file_differences(events: DataFrame, config: ScanConfig, signatures: features.Signatures = fixed.SIGNATURES) -> DataFrame:
    """project_id and, per tally, what the events change; one row for each file that changed.

    Events without a version are the oldest; of events with one version that which adds most counts. Null content is
    an empty file. A deletion is kept in the state, so that older events that come later stay without effect.
    """
    names = list(features.tally_numbers(signatures))

    def change(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, old = state.get if state.exists else (None, [0] * len(names))
        newest, numbers = version, old
        for batch in batches:
            for found, added in zip(batch["version"].tolist(), batch["numbers"].tolist(), strict=True):
                added = [int(x) for x in added]
                # The first of its version in this batch, or a greater one, wins; the state's own version stays.
                if newest is None or found > newest or found == newest != version and added > numbers:
                    newest, numbers = found, added
        if newest != version:
            state.update((newest, numbers))
            yield pd.DataFrame({"project_id": [key[0]], "change": [[new - x for new, x in zip(numbers, old, strict=True)]]})

    lowest = F.lit(-(2**63)).cast("long")
    known = events.withColumns({
        "content": F.coalesce("content", F.lit("")), "version": F.coalesce("version", lowest), "deleted": F.coalesce("deleted", F.lit(False)),
    })
    found = features.file_features(known, config, signatures, keys=("path", "version", "deleted"))
    numbers = F.array(*[F.expr(sql).cast("long") for sql in features.tally_numbers(signatures).values()])
    none = F.array_repeat(F.lit(0).cast("long"), len(names))
    narrow = found.select("project_id", "path", "version", F.when(F.col("deleted"), none).otherwise(numbers).alias("numbers"))
    importable(events.sparkSession)
    changes = narrow.groupBy("project_id", "path").applyInPandasWithState(
        change, "project_id string, change array<long>", "version long, numbers array<long>", "append", GroupStateTimeout.NoTimeout
    )
    return changes.select("project_id", *[F.get("change", F.lit(i)).alias(name) for i, name in enumerate(names)])


def write_differences(differences: DataFrame, location: str, name: str) -> StreamingQuery:
    """Write the changes of each batch, one row per project. A repeated batch replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        sums = [F.sum(c).alias(c) for c in batch.columns if c != "project_id"]
        batch.groupBy("project_id").agg(*sums).write.mode("overwrite").parquet(f"{location}/batch={number}")

    return (
        differences.writeStream.outputMode("append")
        .option("checkpointLocation", shared_checkpoint(differences.sparkSession, name))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def current_tallies(spark: SparkSession, location: str) -> DataFrame:
    """Tallies of the projects that have files on a listing now."""
    rows = spark.read.parquet(location)
    sums = [F.sum(c).alias(c) for c in rows.columns if c not in ("project_id", "batch")]
    return rows.groupBy("project_id").agg(*sums).filter("file_count + legacy_count + template_count > 0")
