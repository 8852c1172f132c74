"""History dumps, one revision at a time.

A page of a history dump can hold millions of revisions, so the record unit is
not the page: the text is cut at ``</revision>``, and every piece holds at most
one revision, with the heads of the pages that begin before it.  Which page a
revision belongs to is a "last head seen" over pieces in file order.  A file
split is dealt in slices of ``SLICE`` pieces, each ordered by itself, whatever
the size of a split; across slices only a summary of each is ordered (its last
head, and how many revisions follow it), so neither a page that runs through
many splits nor a whole split is ever gathered anywhere.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.functions import xml as X
from pagelake.functions.text import numbered
from pagelake.schemas import PAGE_HEAD_DDL, REVISION_FIELDS_DDL
from pagelake.session import cut_lineage
from pagelake.sources.dump import PAGE_CLOSE, PAGE_OPEN, rfc3339_to_timestamp

REVISION_OPEN, REVISION_CLOSE = "<revision>", "</revision>"
# Why a revision or a page head is not accepted.
MALFORMED = "malformed"
BAD_TIME = "bad timestamp"
NO_ID = "no id"
BAD_PAGE = "bad page"       # the revision is fine, the head of its page is not
NO_PAGE = "no page"         # no head before it in its file
# Pieces of a file split that are ordered together.
SLICE = 1 << 12
# Tasks over which the slices of a split are dealt.
SPREAD = 8
# A place in a file: split, slice of the split.
_GROUP = ["file", "block", "slice"]


class History(NamedTuple):
    """``pages``: page_key, page_id, title, redirect_title, revi_count, n_rejected.
    ``revisions``: page_key, page_id, rev_pos, rev_id, timestamp, bytes.
    ``rejects``: page_id, record, reject.

    ``page_key`` is the place of the page in its file, so a page that occurs
    twice is two pages; ``rev_pos`` counts all its revisions, from 1.
    """

    pages: DataFrame
    revisions: DataFrame
    rejects: DataFrame


def read_history(spark: SparkSession, path: str) -> History:
    """Read history shards (a path or glob) into pages, revisions and rejects; one scan of the files."""
    raw = spark.read.option("lineSep", REVISION_CLOSE).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    # the rows a task sorts are a share of a split, however many files there are
    seen = cut_lineage(_with_heads(_parsed(_events(raw)), SPREAD * max(1, raw.rdd.getNumPartitions())))
    return _resolved(seen, _carried(seen))


def _events(raw: DataFrame) -> DataFrame:
    """``file, block, at, k, xml, is_page``: page heads and revisions of each piece, in order."""
    value = F.col("value")
    after = F.split(F.substring_index(value, REVISION_OPEN, 1), PAGE_OPEN, -1)
    # what follows each <page>, up to its revision or its end
    heads = F.transform(F.slice(after, 2, F.greatest(F.size(after) - 1, F.lit(0))), lambda h: F.struct(
        F.concat(F.lit(PAGE_OPEN), F.substring_index(h, PAGE_CLOSE, 1), F.lit(PAGE_CLOSE)).alias("xml"), F.lit(True).alias("is_page")))
    at = F.instr(value, REVISION_OPEN)
    body = F.concat(F.substring(value, at, F.length(value)), F.lit(REVISION_CLOSE))
    revision = F.when(at > 0, F.array(F.struct(body.alias("xml"), F.lit(False).alias("is_page")))).otherwise(F.array())
    return raw.select("file", "block", "at", numbered(F.concat(heads, revision), "k", "e")).select("file", "block", "at", "k", "e.xml", "e.is_page")


def _parsed(events: DataFrame) -> DataFrame:
    """Events with their values.  The page of a head has its place but not its file, which is that of all its rows."""
    head = X.parse_page(F.when(F.col("is_page"), F.col("xml")), PAGE_HEAD_DDL)
    rev = X.parse_page(F.when(~F.col("is_page"), F.col("xml")), REVISION_FIELDS_DDL)
    d = events.withColumn("h", head).withColumn("r", rev).withColumn("timestamp", rfc3339_to_timestamp("r.timestamp"))
    reject = (F.when(F.col(f"h.{X.CORRUPT}").isNotNull() | F.col(f"r.{X.CORRUPT}").isNotNull(), F.lit(MALFORMED))
               .when(F.col("is_page") & F.col("h.id").isNull(), F.lit(NO_ID))
               .when(~F.col("is_page") & F.col("timestamp").isNull(), F.lit(BAD_TIME)))
    d = d.withColumn("reject", reject)
    page = F.struct(
        "block", "at", "k", F.col("reject").isNotNull().alias("bad"), F.col("h.id").alias("page_id"),
        F.col("h.title").alias("title"), F.col("h.redirect._title").alias("redirect_title"))
    return d.select("file", "block", "at", "k", "is_page", F.when(F.col("is_page"), page).alias("page"), F.col("r.id").alias("rev_id"),
                    "timestamp", F.col("r.text._bytes").alias("bytes"), "reject", "xml")


def _with_heads(parsed: DataFrame, tasks: int) -> DataFrame:
    """Adds the page in force within the slice (null before its first head), and the revisions since; marks the slice's last row."""
    place = Window.partitionBy(*_GROUP).orderBy("at", "k")
    order = place.rowsBetween(Window.unboundedPreceding, 0)
    # numbers of pieces ascend through a split, as one task reads it from its begin
    d = parsed.withColumn("slice", F.floor(F.col("at") / SLICE)).repartition(tasks, *_GROUP)
    d = d.withColumn("head", F.last("page", ignorenulls=True).over(order)).withColumn("ends", F.lead("at").over(place).isNull())
    d = d.withColumn("n", F.count_if(~F.col("is_page")).over(order))
    d = d.withColumn("base", F.coalesce(F.last(F.when(F.col("is_page"), F.col("n")), ignorenulls=True).over(order), F.lit(0)))
    return d.withColumn("pos", F.col("n") - F.col("base")).drop("n", "base", "page")


def _carried(seen: DataFrame) -> DataFrame:
    """``file, block, slice, carry, before``: the page in force where a slice begins, and its revisions in earlier slices."""
    slices = seen.where("ends").select(*_GROUP, "head", F.col("pos").alias("tail"))
    earlier = Window.partitionBy("file").orderBy("block", "slice").rowsBetween(Window.unboundedPreceding, -1)
    # tails of the slices before, and of those before the last one with a head
    s = slices.withColumn("tails", F.coalesce(F.sum("tail").over(earlier), F.lit(0)))
    s = s.withColumn("done", F.coalesce(F.max(F.when(F.col("head").isNotNull(), F.col("tails"))).over(earlier), F.lit(0)))
    return s.select(*[F.col(c).alias(f"in_{c}") for c in _GROUP], F.last("head", ignorenulls=True).over(earlier).alias("carry"),
                    (F.col("tails") - F.col("done")).alias("before"))


def _resolved(seen: DataFrame, carried: DataFrame) -> History:
    here = [F.col(c) == F.col(f"in_{c}") for c in _GROUP]
    d = seen.join(carried, here, "left")
    page = F.coalesce("head", "carry")
    d = d.select("file", "is_page", "rev_id", "timestamp", "bytes", "xml", page.alias("page"),
                 (F.col("pos") + F.when(F.col("head").isNull(), F.col("before")).otherwise(F.lit(0))).alias("rev_pos"),
                 F.when(F.col("reject").isNotNull(), F.col("reject")).when(page.isNull(), F.lit(NO_PAGE))
                  .when(page["bad"], F.lit(BAD_PAGE)).alias("reject"))
    revision, fine = ~F.col("is_page"), F.col("reject").isNull()
    page_key = F.struct("file", "page.block", "page.at", "page.k").alias("page_key")
    counts = d.where(revision & F.col("page").isNotNull()).groupBy(page_key).agg(
        F.count_if(fine).alias("revi_count"), F.count_if(~fine).alias("n_rejected"))
    pages = d.where(F.col("is_page") & fine).select(page_key, "page.page_id", "page.title", "page.redirect_title")
    zero = F.lit(0).cast("bigint")
    pages = pages.join(counts, "page_key", "left").withColumns({c: F.coalesce(F.col(c), zero) for c in ("revi_count", "n_rejected")})
    revisions = d.where(revision & fine).select(page_key, "page.page_id", "rev_pos", "rev_id", "timestamp", "bytes")
    return History(pages, revisions, d.where(~fine).select("page.page_id", F.col("xml").alias("record"), "reject"))


def history_lines(history: History) -> DataFrame:
    """``page_id,epoch-bytes,epoch-bytes,...`` for pages that are no redirects and lost no revision.

    A line per page is the format; a page without revisions has its id and the comma.
    """
    pages = history.pages.where(F.col("redirect_title").isNull() & (F.col("n_rejected") == 0)).select("page_key", "page_id")
    pair: Column = F.concat_ws("-", F.unix_seconds("timestamp"), F.coalesce(F.col("bytes").cast("string"), F.lit("")))
    made = history.revisions.groupBy("page_key").agg(F.sort_array(F.collect_list(F.struct("rev_pos", pair.alias("pair")))).alias("pairs"))
    joined = F.array_join(F.transform("pairs", lambda p: p["pair"]), ",")
    return pages.join(made, "page_key", "left").select(
        F.concat(F.col("page_id").cast("string"), F.lit(","), F.coalesce(joined, F.lit(""))).alias("value"))
