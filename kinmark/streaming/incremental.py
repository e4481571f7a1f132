"""A group table kept up to date by a stream of strings (an addition to what a table at rest offers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.groups import SCHEMA, add_strings


def keep_counts(strings: DataFrame, folder: str, checkpoint: str, string_column: str = "string", available_now: bool = True) -> StreamingQuery:
    """Adds each micro-batch's strings to the group table in folder, in versions v0, v1, ...; labels are set anew each time.

    Batch n makes version n + 1 from version n, so a batch that is run again writes the same version again.
    """
    spark = strings.sparkSession

    def add(batch: DataFrame, n: int) -> None:
        before = spark.read.schema(SCHEMA).parquet(f"{folder}/v{n}") if n else spark.createDataFrame([], SCHEMA)
        add_strings(before, batch, string_column).write.mode("overwrite").parquet(f"{folder}/v{n + 1}")

    writer = strings.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
