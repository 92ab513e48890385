"""Rule detection and redaction over streams: the batch expressions are pure projections, so they are used unchanged.

The reference data model has no stateful streaming; counts per window are an extension with a watermark for late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import by_label, redacted
from spanforge.operators.rules import detected


def redacted_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files that arrive in ``folder``, with their spans redacted."""
    return redacted_rows(spark.readStream.text(folder).withColumnRenamed("value", "text"))


def redacted_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("spans", detected("text")).withColumn("redacted", redacted("text", "spans")).withColumn("by_label", by_label("spans"))


def counted(events: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Rows and values per type and window of ``events(ts, event_type, value)``, late rows within the watermark."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )
