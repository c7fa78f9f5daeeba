"""Streaming twin of the append path (A9): landing folder -> clean -> rules -> sink.

``readStream`` picks up new CSV files in a landing folder; each
micro-batch is cleaned (B1-B4), categorised by the weighted rules
(C2/C3, per row)
and appended to a Parquet table.  Optionally duplicates on
(description, amount) are dropped within an event-time watermark, which
keeps the de-duplication state bounded.  The checkpoint lives in the
shared folder named by ``spark.checkpoint.dir`` unless one is given.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.operators import clean as C
from tallyspark.operators.rules import categorize_weighted
from tallyspark.session import ensure_checkpoint_dir

RAW_SCHEMA = "fecha string, descripcion string, monto string"


def landing_stream(spark: SparkSession, landing_dir: str, schema: str = RAW_SCHEMA,
                   sep: str = ",", dedupe_watermark: str | None = None) -> DataFrame:
    raw = (spark.readStream.schema(schema).option("header", True).option("sep", sep)
           .option("maxFilesPerTrigger", 1000).csv(landing_dir))
    df = raw.withColumn("archivo", F.col("_metadata.file_path"))
    df = C.parse_dates(C.clean_amounts(C.clean_descriptions(df)))
    df = C.drop_invalid(df)
    if dedupe_watermark:
        df = (df.withWatermark("fecha", dedupe_watermark)
                .dropDuplicatesWithinWatermark(["descripcion", "monto"]))
    return categorize_weighted(df)


def start_append(stream: DataFrame, sink_dir: str, checkpoint_dir: str | None = None,
                 available_now: bool = True) -> StreamingQuery:
    if checkpoint_dir is None:
        checkpoint_dir = os.path.join(ensure_checkpoint_dir(stream.sparkSession), "landing-stream")
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint_dir).option("path", sink_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
