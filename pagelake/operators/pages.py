"""Page-level operators: filters, projections and the category job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import text as T


def not_redirect(df: DataFrame, redirect_col: str = "redirect_title") -> DataFrame:
    return df.where(F.col(redirect_col).isNull())


def has_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.where(F.col(text_col).isNotNull())


def drop_code_namespaces(df: DataFrame, title_col: str = "title") -> DataFrame:
    """Drop titles starting ``Module:`` or ``Template:`` (case-sensitive)."""
    t = F.col(title_col)
    return df.where(~t.startswith("Module:") & ~t.startswith("Template:"))


def content_for_categories(df: DataFrame) -> DataFrame:
    """The cheap filters the category job applies before any regex work."""
    return drop_code_namespaces(has_text(not_redirect(df)))


def with_categories(df: DataFrame, text_col: str = "text", out_col: str = "cats") -> DataFrame:
    """Mask markup, then extract the ordered category list per page."""
    masked = T.mask_markup(df, text_col, "__masked")
    return masked.withColumn(out_col, T.extract_categories("__masked")).drop("__masked")


def page_categories(pages: DataFrame) -> DataFrame:
    """``page_id, title, cats`` for every page the category job keeps."""
    kept = content_for_categories(pages).select("page_id", "title", "text")
    return with_categories(kept).select("page_id", "title", "cats")


def explode_categories(cat_pages: DataFrame) -> DataFrame:
    """One row per (page, position, category); positions are 1-based."""
    return cat_pages.select("page_id", T.numbered("cats", "cat_pos", "category"))


def category_list(cat_pages: DataFrame) -> DataFrame:
    """The distinct category set (partial + final hash aggregation)."""
    return explode_categories(cat_pages).select("category").distinct()


def category_counts(cat_pages: DataFrame) -> DataFrame:
    """Pages per category.

    A page's category list is short, so it is de-duplicated in place and the
    count is a single partial/final aggregation (no distinct-count shuffle).
    """
    distinct_cats = F.transform(F.array_distinct("cats"), lambda c: F.struct(c.alias("category")))
    return (cat_pages.select(F.inline(distinct_cats))
            .groupBy("category")
            .agg(F.count(F.lit(1)).alias("n_pages")))


def with_page_type(df: DataFrame, title_col: str = "title", redirect_col: str = "redirect_title",
                   out_col: str = "page_type") -> DataFrame:
    return df.withColumn(out_col, T.page_type(title_col, redirect_col))


def page_link_stats(pages: DataFrame) -> DataFrame:
    """Per page: type, link count and section count on the raw text."""
    return pages.select(
        "page_id",
        T.page_type("title", "redirect_title").alias("page_type"),
        T.count_links("text").alias("link_count"),
        T.count_sections("text").alias("sect_count"),
    )


def page_json(records: DataFrame, page_ids=None, record_col: str = "record") -> DataFrame:
    """``page_id, json`` for page records, optionally only the given page ids.

    Nulls are kept as JSON nulls.  Records that carry a ``page_id`` beside them,
    as those of a record store do, are filtered by it before they are parsed;
    others have to be parsed to know their id.
    """
    from pagelake.functions import xml as X
    if page_ids is not None and "page_id" in records.columns:
        records, page_ids = records.where(F.col("page_id").isin(list(page_ids))), None
    parsed = records.select(X.parse_page(record_col).alias("p")).select(*X.flat_page("p"))
    if page_ids is not None:
        parsed = parsed.where(F.col("page_id").isin(list(page_ids)))
    return parsed.select("page_id", F.to_json(F.struct("page_id", "title", "redirect_title", "text"),
                                              {"ignoreNullFields": "false"}).alias("json"))
