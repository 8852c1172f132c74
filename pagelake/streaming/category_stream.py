"""Incremental category index: dump files arriving in a folder -> category rows.

The same record cutting, parsing, filters, mask and extraction as the batch
job, run by Structured Streaming over a file source.  The work is stateless
per record (append mode); progress and exactly-once file tracking live in the
checkpoint location, which must be on shared storage (by default a sub-folder
of ``spark.checkpoint.dir``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelake.operators import pages as P
from pagelake.sources.dump import PAGE_CLOSE, records_from_chunks, split_parsed
from pagelake.session import shared_dir


def category_rows(records: DataFrame) -> DataFrame:
    """Records -> ``page_id, title, cats`` for the pages the category job keeps."""
    pages, _ = split_parsed(records)
    return P.page_categories(pages)


def stream_category_index(spark: SparkSession, source_dir: str, sink_dir: str,
                          checkpoint: str | None = None, max_files_per_trigger: int = 64,
                          available_now: bool = True) -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes what is there and stops."""
    raw = (spark.readStream.option("lineSep", PAGE_CLOSE)
                .option("maxFilesPerTrigger", max_files_per_trigger).text(source_dir))
    rows = category_rows(records_from_chunks(raw)).select(
        "page_id", "title", F.array_join("cats", "|").alias("cats"))
    writer = (rows.writeStream.format("parquet").outputMode("append")
                  .option("path", sink_dir)
                  .option("checkpointLocation", checkpoint or shared_dir(spark, "streams/category_index")))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
