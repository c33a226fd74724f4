"""Incremental ingest: new files in a landing folder, loaded micro-batch by micro-batch."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from eodscan.sources.daily import split_lines, with_headers
from eodscan.sources.tables import Tables, load_days

FILES_PER_BATCH = 64


def stream_days(
    spark: SparkSession,
    landing: str,
    tables: Tables,
    checkpoint: str,
    max_files: int = FILES_PER_BATCH,
    glob: str = "*.csv",
    bad_values: str = "reject",
) -> StreamingQuery:
    """Load everything in the landing folder that was not loaded yet, then stop.

    Later files of a loaded day are merged into it, so the tables do not depend on how many files a
    micro-batch takes; running one twice after a failure changes nothing. Rejects are kept per stream (its
    checkpoint) and micro-batch.
    """
    name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    lines = (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", glob)
        .load(landing)
        .select(F.col("_metadata.file_path").alias("source"), "value")
    )

    def load(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good, rejects = split_lines(with_headers(batch), bad_values)
            load_days(batch.sparkSession, good, tables, rejects, f"stream-{name}-{batch_id}", merge=True)
        finally:
            batch.unpersist()

    return (
        lines.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
