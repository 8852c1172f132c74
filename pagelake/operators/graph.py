"""Category index and the category graph walk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.session import cut_lineage
from pagelake.sources.checked import Checked, split_rows

CATEGORY_PREFIX = "category:"
# --- fixed values: lower-cased namespaces that are not content pages
NON_CONTENT_PREFIX_PATTERN = "^(category|module|template|portal|help):"
# --- end of fixed values


def category_index_lines(cat_pages: DataFrame) -> DataFrame:
    """``page_id|title|cat|cat...`` text lines (a page with no category ends in ``|``)."""
    return cat_pages.select(F.concat_ws("|", F.col("page_id").cast("string"), "title",
                                        F.array_join("cats", "|")).alias("value"))


def tagged_category_index(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lower-cased lines beside the raw one and, in ``reject``, what is wrong; empty category names are dropped."""
    parts = F.split(F.lower(F.col(col)), r"\|", -1)
    parsed = lines.select(
        F.try_element_at(parts, F.lit(1)).try_cast("bigint").alias("page_id"),
        F.try_element_at(parts, F.lit(2)).alias("title"),
        F.filter(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), lambda c: c != "").alias("cats"),
        F.col(col).alias("record"))
    reject = F.when(F.col("page_id").isNull(), F.lit("bad id")).when(F.col("title").isNull(), F.lit("no title"))
    return parsed.withColumn("reject", reject)


def parse_category_index(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lower-cased lines -> (``page_id, title, cats``, rejects).

    A line without a numeric id or without a title goes to the rejects.
    """
    tagged, fine = tagged_category_index(lines, col), F.col("reject").isNull()
    return tagged.where(fine).select("page_id", "title", "cats"), tagged.where(~fine).select(F.col("record").alias("line"))


def check_category_index(lines: DataFrame, col: str = "value") -> Checked:
    """As ``parse_category_index`` in one pass, with the number of lines and of rejects."""
    return split_rows(tagged_category_index(lines, col))


def category_pages(index: DataFrame) -> DataFrame:
    """Category pages with at least one parent; ``title`` without the ``category:`` prefix."""
    return index.where(F.col("title").startswith(CATEGORY_PREFIX) & (F.size("cats") > 0)).select(
        "page_id", F.substring("title", len(CATEGORY_PREFIX) + 1, 1 << 30).alias("title"), "cats")


def content_pages(index: DataFrame) -> DataFrame:
    """Pages outside category/module/template/portal/help with at least one category."""
    return index.where(~F.col("title").rlike(NON_CONTENT_PREFIX_PATTERN) & (F.size("cats") > 0))


def parent_edges(index: DataFrame, cats: DataFrame) -> DataFrame:
    """Distinct ``(page_id, parent_id)``: a page's category names resolved to category pages.

    Hub categories make the join skewed on the name; AQE's skew-join split
    handles hot keys, and the distinct is a two-phase aggregation.
    """
    names = index.select("page_id", F.explode("cats").alias("name"))
    targets = cats.select(F.col("page_id").alias("parent_id"), F.col("title").alias("name"))
    return names.join(targets, "name").select("page_id", "parent_id").distinct()


def descendants(cats: DataFrame, root: str, max_depth: int | None = None) -> DataFrame:
    """Level-by-level walk below ``root`` over category pages.

    Level 0: category pages listing ``root`` as a parent (not filtered by what
    was seen).  Then unseen category pages with any parent in the previous
    level, until a level is empty or, if given, level ``max_depth`` is done.
    Each level is checkpointed to the shared folder, so the lineage stays flat
    and a lost executor only recomputes one level.
    Returns ``level, page_id, title``.
    """
    root = root.lower()
    spark = cats.sparkSession
    edges = cut_lineage(cats.select("page_id", "title", F.explode("cats").alias("parent")))
    level = cut_lineage(edges.where(F.col("parent") == root).select("page_id", "title").distinct())
    out = level.withColumn("level", F.lit(0).cast("bigint"))
    seen = level.select("title").unionByName(spark.createDataFrame([(root,)], "title string"))
    depth = 0
    while not level.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        frontier = level.select(F.col("title").alias("parent")).distinct()
        hit = edges.join(frontier, "parent", "left_semi").select("page_id", "title").distinct()
        level = cut_lineage(hit.join(seen, "title", "left_anti"))
        out = out.unionByName(level.withColumn("level", F.lit(depth).cast("bigint")))
        seen = seen.unionByName(level.select("title"))
    return out.select("level", "page_id", "title")


def seen_titles(levels: DataFrame, root: str) -> DataFrame:
    """The root plus every title reached (set union, deduplicated)."""
    root_df = levels.sparkSession.createDataFrame([(root.lower(),)], "title string")
    return levels.select("title").unionByName(root_df).distinct()


def unseen_categories(cats: DataFrame, seen: DataFrame) -> DataFrame:
    """Category titles never reached (set difference)."""
    return cats.select("title").distinct().join(seen, "title", "left_anti")


def level_counts(levels: DataFrame) -> DataFrame:
    """Rows per level plus the total row of the rollup, labelled level -1."""
    counts = levels.rollup("level").agg(F.count(F.lit(1)).alias("n_rows"), F.grouping("level").alias("g"))
    return counts.select(F.when(F.col("g") == 1, F.lit(-1)).otherwise(F.col("level")).cast("bigint").alias("level"),
                         "n_rows")


def pages_under(index: DataFrame, seen: DataFrame) -> DataFrame:
    """Content pages with any category in the closure."""
    names = content_pages(index).select("page_id", "title", F.explode("cats").alias("name"))
    return names.join(seen.select(F.col("title").alias("name")), "name", "left_semi").select(
        "page_id", "title").distinct()
