"""Row-local operators over streams: cleaning and chunking of arriving documents, and counts per window with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.functions import text as T
from papyrine.operators import chunking


def chunks(docs: DataFrame, *, key: str = "doc_id", size: int = 110, overlap: int = 25) -> DataFrame:
    """Sliding chunks of cleaned documents; keeps no state, so it runs on streams as on tables."""
    return chunking.sliding(docs.withColumn("text", T.clean_generated(F.col("text"))), key=key, size=size, overlap=overlap)


def once(docs: DataFrame, *, key: str = "content_sha256", at: str = "ingested_at", delay: str = "30 days") -> DataFrame:
    """Documents whose content hasn't come within the watermark; the state is bounded by the delay."""
    return docs.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def arrivals(docs: DataFrame, *, at: str = "ingested_at", width: str = "1 day", delay: str = "30 days") -> DataFrame:
    """(day, domain, documents): arrivals per window of event time; rows later than the delay are dropped."""
    counts = docs.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), "domain").agg(F.count("*").alias("documents"))
    return counts.select(F.col("w.start").alias("day"), "domain", "documents")
