"""Writers.  Every sink is an atomic overwrite of a folder (re-runs are idempotent)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.sources.history import History, history_lines

# Page ids per file block of a site dump.
SITE_BLOCK = 100_000
# Rows that a task of ordered lines sorts, about.
ORDERED_ROWS = 1 << 17
# Partitions to which a shuffle is dealt without sorting its input first (Spark's default); more only if the session asks for them.
DEALT = 200


def write_lines(df: DataFrame, path: str, col: str = "value", compression: str | None = None) -> None:
    """One text line per row (the column must be a string)."""
    w = df.select(F.col(col).alias("value")).write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    w.text(path)


def write_table(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Atomic overwrite of a Parquet table."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def write_page_store(pages: DataFrame, path: str, key: str = "page_id", compression: str = "zstd",
                     num_partitions: int | None = None, max_records_per_file: int = 200_000,
                     level: int = 9) -> None:
    """Page-addressable store: range-partitioned and sorted by ``key``, zstd Parquet.

    Row-group min/max statistics on the sorted key replace the byte-offset
    index: a point lookup on ``key`` is a pushed filter that skips all other
    row groups.  Unless a number of ranges is given, the session's shuffle
    setting decides and adaptive execution merges small ranges; files are
    capped at ``max_records_per_file`` rows.
    """
    ranged = pages.repartitionByRange(num_partitions, key) if num_partitions else pages.repartitionByRange(key)
    (ranged.sortWithinPartitions(key)
          .write.mode("overwrite").option("compression", compression)
          .option("parquet.compression.codec.zstd.level", level)
          .option("maxRecordsPerFile", max_records_per_file).parquet(path))


def write_record_store(records: DataFrame, path: str, **options) -> None:
    """Raw page records beside their ``page_id``, kept like the page store; records are not parsed.

    The id is the first one of the record, as the head of a page comes before
    its revisions.  A record without one is kept under a null id.
    """
    head = F.substring_index("record", "<revision", 1)
    number = F.regexp_extract(head, r"<id>\s*([0-9]+)\s*</id>", 1).try_cast("bigint")
    write_page_store(records.select(number.alias("page_id"), "record"), path, **options)


def write_history(history: History, path: str) -> None:
    write_lines(history_lines(history), path)


def write_dump(records: DataFrame, path: str, col: str = "record", compression: str | None = "bzip2") -> None:
    """Page records as a text dump (one part file per partition, bz2 by default)."""
    write_lines(records.select(F.col(col).alias("value")), path, compression=compression)


def write_site_dumps(records: DataFrame, headers: DataFrame, path: str, key: str = "source",
                     order: str = "page_id", compression: str | None = None, block: int = SITE_BLOCK) -> None:
    """Site dumps per ``key`` value: headers under ``headers``, page records under ``pages``.

    The header of a site is a file of its own, so reading it touches no page.
    The pages of a key are dealt in blocks of ``order``, so a large site is many
    tasks and files, each in order.
    """
    def write(rows: DataFrame, folder: str) -> None:
        w = rows.write.mode("overwrite").partitionBy(key)
        (w.option("compression", compression) if compression else w).text(f"{path}/{folder}")

    write(headers.select(key, F.col("header").alias("value")), "headers")
    body = records.select(key, F.col(order).cast("bigint").alias("__ord"), F.col("record").alias("value"))
    body = body.repartition(key, F.floor(F.col("__ord") / block)).sortWithinPartitions(key, "__ord")
    write(body.select(key, "value"), "pages")


def write_ordered_lines(rows: DataFrame, path: str, key: str, order: list[str], col: str = "value",
                        compression: str | None = None) -> None:
    """Text lines grouped by ``key`` and ordered by ``order`` inside each group.

    Rows are hash-partitioned on ``key`` and sorted within partitions, so a
    group's lines are contiguous and in order in one file without the group
    ever being collected (the sort spills if a group is huge).  Partitions are
    as many as the rows ask for, so what a task sorts does not grow with the
    rows, up to the larger of ``DEALT`` and the session's shuffle setting.
    """
    most = max(DEALT, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tasks = min(max(1, -(-rows.count() // ORDERED_ROWS)), most)
    ordered = rows.repartition(tasks, key).sortWithinPartitions(key, *order)
    w = ordered.select(F.col(col).alias("value")).write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    w.text(path)
