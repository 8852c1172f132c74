"""Readers for XML page dumps, their indexes and side files.

A dump is read as text with ``</page>`` as the record separator, so a bz2 (or
plain) file splits across tasks and every page is exactly one record; a
literal ``</page>`` inside page text is entity-encoded and cannot cut a
record.  ``from_xml`` then parses the record with a declared schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import xml as X
from pagelake.sources.checked import Checked, split_rows

PAGE_OPEN, PAGE_CLOSE = "<page>", "</page>"


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: one complete ``<page>...</page>`` string per page.

    Text before ``<page>`` in a record (the site header, whitespace) is cut
    off; the trailing piece after the last ``</page>`` (the footer) is dropped.
    """
    return records_from_chunks(spark.read.option("lineSep", PAGE_CLOSE).text(path))


def records_from_chunks(raw: DataFrame) -> DataFrame:
    """``</page>``-separated text chunks -> whole page records (batch or streaming)."""
    body = F.substring_index(F.col("value"), PAGE_OPEN, -1)
    has_page = F.instr(F.col("value"), PAGE_OPEN) > 0
    return raw.where(has_page).select(F.concat(F.lit(PAGE_OPEN), body, F.lit(PAGE_CLOSE)).alias("record"))


def read_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Current-revision dump -> (``page_id, title, redirect_title, text``, rejects).

    Records that are malformed anywhere, hold a value of the wrong type, or
    have no id go to the reject frame, whole, instead of failing the job.
    """
    return split_parsed(page_records(spark, path))


def split_parsed(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse records; (``page_id, title, redirect_title, text``, rejects)."""
    tagged = tagged_pages(records)
    fine = F.col("reject").isNull()
    return tagged.where(fine).drop("reject", "record"), tagged.where(~fine).select("record")


def tagged_pages(records: DataFrame) -> DataFrame:
    """Parsed records beside the raw one and, in ``reject``, why it is not accepted (null: it is)."""
    recs = records.select("record", X.parse_page("record").alias("p"))
    reject = F.when(F.col(f"p.{X.CORRUPT}").isNotNull(), F.lit("malformed")).when(F.col("p.id").isNull(), F.lit("no id"))
    return recs.select(*X.flat_page("p"), reject.alias("reject"), "record")


def check_pages(spark: SparkSession, path: str) -> Checked:
    """As ``read_pages`` in one pass: both frames and their counts come from a single parse of the dump."""
    return split_rows(tagged_pages(page_records(spark, path)))


def read_records(spark: SparkSession, path: str, wanted: DataFrame | list[int]) -> DataFrame:
    """``page_id, record`` of the wanted pages from a record store, pruned before anything is parsed.

    A list becomes a pushed filter.  A table of ids (its ``page_id``) becomes a
    pushed range of its least to greatest id, which skips the other row groups
    of the sorted store, and a join.
    """
    store = spark.read.schema("page_id bigint, record string").parquet(path)
    if not isinstance(wanted, DataFrame):
        return store.where(F.col("page_id").isin([int(i) for i in wanted]))
    ids = wanted.select("page_id").where("page_id is not null").distinct()
    low, high = ids.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return store.limit(0)
    return store.where(F.col("page_id").between(low, high)).join(ids, "page_id", "left_semi")


def rfc3339_to_timestamp(c):
    """RFC 3339 text (``2024-06-01T00:00:00Z``, offsets allowed) -> timestamp; null if invalid."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
                      F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX")))


def rfc3339_epoch(c):
    """RFC 3339 text -> epoch seconds (null if invalid)."""
    return F.unix_seconds(rfc3339_to_timestamp(c))


def read_site_info(spark: SparkSession, path: str) -> DataFrame:
    """The ``<siteinfo>`` header of each dump file, trimmed (``path, site_info``)."""
    raw = spark.read.option("lineSep", PAGE_CLOSE).text(path).withColumn("path", F.input_file_name())
    head = raw.where(F.instr("value", "<siteinfo>") > 0)
    extra = [c for c in raw.columns if c not in ("value", "path")]   # discovered partition columns
    return head.select("path", *extra, site_info_text("value").alias("site_info"))


def site_info_text(first_record):
    """Header text before the first ``<page>``, trimmed of space/CR/LF/TAB."""
    c = F.col(first_record) if isinstance(first_record, str) else first_record
    return F.btrim(F.substring_index(c, PAGE_OPEN, 1), F.lit(" \r\n\t"))


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """Binary files -> ``path, length, media_type`` (classified by magic bytes)."""
    from pagelake.functions.media import media_type
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", media_type("content").alias("media_type"))
