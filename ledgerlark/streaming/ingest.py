"""Structured Streaming: landed payloads to tables, and health as state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.sinks import foreach_batch


def landed_stream(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Everything that has landed since the last run, new keys only; an outside scheduler gives the cadence.

    Late rows are accepted for ever, so there is no watermark and no state but the table.
    """
    return transform(stream).writeStream.foreachBatch(foreach_batch(path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failure_counts(attempts: DataFrame, entity: str = "entity") -> DataFrame:
    """Failures in a row per entity over a stream of attempts (entity, attempt_id, status), updated by batch; one number of state per entity."""

    def update(key, batches, state):
        n = state.get[0] if state.exists else 0
        for row in pd.concat(list(batches)).sort_values("attempt_id").itertuples():
            n = 0 if row.status == "ok" else n + 1
        state.update((n,))
        yield pd.DataFrame({entity: [key[0]], "consecutive_failures": [n]})

    kind = dict(attempts.dtypes)[entity]
    return attempts.groupBy(entity).applyInPandasWithState(update, f"{entity} {kind}, consecutive_failures int", "n int", "update", "NoTimeout")
