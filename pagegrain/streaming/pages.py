"""Parsing raw pages as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pagegrain.operators.layout import chunk_rows
from pagegrain.plans.parse import parsed_pages


def stream_chunks(raw: DataFrame, watermark: str | None = None, **flags: bool) -> DataFrame:
    """The chunks of a stream of raw pages. A page is parsed from its row alone, so the stream keeps no state.

    With ``watermark`` (such as "30 days") on a column ``ingested_at`` each page
    passes once within that time; the state is bounded by it.
    """
    grouped = flags.get("enable_grouping", True)
    if watermark:
        raw = raw.withWatermark("ingested_at", watermark).dropDuplicatesWithinWatermark(["doc_id", "page_number"])
    return chunk_rows(parsed_pages(raw, **flags), grouped)


def write_stream(chunks: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the chunks to Parquet files; ``checkpoint`` is a folder that all executors share."""
    writer = chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
