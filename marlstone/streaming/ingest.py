"""CSV files that arrive in a folder, imported into a table micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marlstone.sources.csv import typed
from marlstone.table import Table


def follow_folder(table: Table, folder: str, checkpoint: str, files_per_batch: int = 100, once: bool = False) -> StreamingQuery:
    """Start the import. Keys that are there already are left out, so a batch that runs again after a failure changes nothing."""
    schema = table.manifest.schema
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    rows = table.spark.readStream.schema(text).option("header", "true").option("maxFilesPerTrigger", files_per_batch).csv(folder)

    def add(batch: DataFrame, _: int) -> None:
        table.build(typed(batch, schema))

    out = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
