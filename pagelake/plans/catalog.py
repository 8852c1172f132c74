"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Each query reads whole driver tables (or data Spark derives from them); none
runs on made-up input.  Column names equal those of the oracle SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import media as M
from pagelake.functions import text as T
from pagelake.functions import validate as V
from pagelake.functions import xml as X
from pagelake.operators import graph as G
from pagelake.operators import index as IX
from pagelake.operators import ledger as L
from pagelake.operators import pages as P
from pagelake.operators.sampling import sample_n
from pagelake.plans import views as VW
from pagelake.plans.views import wiki_pages
from pagelake.session import cut_lineage, prepare, shared_dir
from pagelake.sources import buckets as B
from pagelake.sources import dump as D
from pagelake.sources import history as H
from pagelake.sources import sinks as S
from pagelake.sources.checked import together

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run
    return deco


def _numbered_rejects(rows: DataFrame) -> DataFrame:
    """Numbers of rejected rows as -1, which both engines hand over alike."""
    kinds = dict(rows.dtypes)
    return rows.select(*[F.coalesce(F.col(c), F.lit(-1)).cast("bigint").alias(c) if kinds[c] == "bigint" else F.col(c) for c in rows.columns])


def _cat_pages(spark, sf_dir):
    return P.page_categories(wiki_pages(spark, sf_dir))


@query("mask_markup")
def q_mask_markup(spark, sf_dir):
    return T.mask_markup(wiki_pages(spark, sf_dir), "text").select("page_id", "masked")


@query("mask_markup_html")
def q_mask_markup_html(spark, sf_dir):
    """The same union mask on real markup: raw web pages (one comment per page)."""
    pages = VW.table(spark, sf_dir, "pages")
    return pages.select("page_id", T.masked_text("html").alias("masked"))


@query("extract_categories")
def q_extract_categories(spark, sf_dir):
    return P.explode_categories(_cat_pages(spark, sf_dir))


@query("category_list")
def q_category_list(spark, sf_dir):
    return P.category_list(_cat_pages(spark, sf_dir))


@query("category_counts")
def q_category_counts(spark, sf_dir):
    return P.category_counts(_cat_pages(spark, sf_dir))


@query("count_links")
def q_count_links(spark, sf_dir):
    return wiki_pages(spark, sf_dir).select("page_id", T.count_links("text").alias("link_count"))


@query("count_sections")
def q_count_sections(spark, sf_dir):
    return wiki_pages(spark, sf_dir).select("page_id", T.count_sections("text").alias("sect_count"))


# ---------------------------------------------------------------- filters / projections

SAMPLE_SEED = "s42"
SAMPLE_N = 40
LOOKUP_PAGE_ID = 777
TRANSLATE_SRC, TRANSLATE_DST = "0123456789#", "abcdefghij-"


@query("flt_not_redirect")
def q_flt_not_redirect(spark, sf_dir):
    return P.not_redirect(wiki_pages(spark, sf_dir)).select("page_id", "title")


@query("flt_has_text")
def q_flt_has_text(spark, sf_dir):
    """Pages with a text; some of the pages have lost theirs."""
    pages = wiki_pages(spark, sf_dir).withColumn("text", F.when(F.col("page_id") % 17 != 3, F.col("text")))
    return P.has_text(pages).select("page_id", "title")


@query("flt_namespace")
def q_flt_namespace(spark, sf_dir):
    return P.drop_code_namespaces(wiki_pages(spark, sf_dir)).select("page_id", "title")


@query("prj_page_type")
def q_prj_page_type(spark, sf_dir):
    return P.with_page_type(wiki_pages(spark, sf_dir)).select("page_id", "page_type")


@query("page_link_stats")
def q_page_link_stats(spark, sf_dir):
    stats = P.page_link_stats(wiki_pages(spark, sf_dir))
    return stats.groupBy("page_type").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.sum("link_count").cast("bigint").alias("link_count"),
        F.sum("sect_count").cast("bigint").alias("sect_count"))


def _raw_category_groups(spark, sf_dir):
    wp = wiki_pages(spark, sf_dir)
    return wp.select("page_id", T.numbered(F.regexp_extract_all("text", F.lit(T.CATEGORY_PATTERN), 1), "cat_pos", "raw"))


@query("trim_ws")
def q_trim_ws(spark, sf_dir):
    return _raw_category_groups(spark, sf_dir).select("page_id", "cat_pos", T.trim_ws("raw").alias("trimmed"))


@query("collapse_spaces")
def q_collapse_spaces(spark, sf_dir):
    return _raw_category_groups(spark, sf_dir).select("page_id", "cat_pos",
                                                      T.collapse_spaces("raw").alias("collapsed"))


def _records(spark, sf_dir):
    wp = wiki_pages(spark, sf_dir)
    return wp.select("page_id", X.render_page("page_id", "title", "redirect_title", "text").alias("record"))


def _raw_records(spark, sf_dir):
    """Records whose text is *not* entity-encoded: stray tags and bare '&' break them."""
    wp = wiki_pages(spark, sf_dir)
    rec = F.concat(F.lit("<page><title>"), F.col("title"), F.lit("</title><id>"), F.col("page_id").cast("string"),
                   F.lit("</id><revision><text>"), F.col("text"), F.lit("</text></revision></page>"))
    return wp.select("page_id", rec.alias("record"))


@query("xml_validate")
def q_xml_validate(spark, sf_dir):
    return _raw_records(spark, sf_dir).select("page_id", X.xml_valid("record").alias("is_valid"))


@query("page_layout")
def q_page_layout(spark, sf_dir):
    return _records(spark, sf_dir).select(X.page_skeleton("record").alias("layout")).distinct()


@query("src_pages")
def q_src_pages(spark, sf_dir):
    """Render the pages as a bz2 XML dump, some of them broken, and read it back: accepted pages and rejects."""
    path = _scratch(spark, "pages_dump")
    record, kind = F.col("record"), F.col("page_id") % 97
    number = F.concat(F.lit("<id>"), F.col("page_id").cast("string"), F.lit("</id>"))
    # an unclosed tag, a bare ampersand, a page without an id of its own
    record = (F.when(kind == 13, F.replace(record, F.lit("</revision>"), F.lit("</revision")))
               .when(kind == 29, F.replace(record, F.lit("<ns>"), F.lit("& <ns>")))
               .when(kind == 31, F.replace(record, F.concat(F.lit("    "), number, F.lit("\n")), F.lit("    \n"))).otherwise(record))
    S.write_dump(_records(spark, sf_dir).withColumn("record", record), path)
    return _numbered_rejects(together(D.check_pages(spark, path)))


@query("page_to_json")
def q_page_to_json(spark, sf_dir):
    return P.page_json(_records(spark, sf_dir))


@query("page_json_by_id")
def q_page_json_by_id(spark, sf_dir):
    """JSON of the labelled pages: the record store is pruned by their ids, then parsed."""
    path = _scratch(spark, "record_store")
    S.write_record_store(_records(spark, sf_dir).select("record"), path)
    wanted = VW.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    return P.page_json(D.read_records(spark, path, wanted))


@query("point_lookup_page")
def q_point_lookup_page(spark, sf_dir):
    """Write the sorted page store, then look one page up: a pushed filter on row-group stats."""
    path = _scratch(spark, "page_store_lookup")
    S.write_page_store(wiki_pages(spark, sf_dir), path)
    return spark.read.parquet(path).where(F.col("page_id") == LOOKUP_PAGE_ID).select("page_id", "title", "text")


@query("random_sample_n")
def q_random_sample_n(spark, sf_dir):
    return sample_n(wiki_pages(spark, sf_dir), "page_id", SAMPLE_N, SAMPLE_SEED).select("page_id")


@query("xml_scrub")
def q_xml_scrub(spark, sf_dir):
    """Characters that XML forbids, put behind some of the texts, beside ones it allows."""
    docs = VW.table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 7 == 2, F.concat("text", F.lit("\x01a\x0b\ufffeb\t"))).otherwise(F.col("text"))
    return docs.select("doc_id", T.xml_scrub(text, "�").alias("scrubbed"))


@query("str_translate")
def q_str_translate(spark, sf_dir):
    cf = VW.customer_fields(spark, sf_dir)
    return cf.select("c_custkey", T.str_translate("c_name", TRANSLATE_SRC, TRANSLATE_DST).alias("translated"))


@query("sha256_hex")
def q_sha256_hex(spark, sf_dir):
    cf = VW.customer_fields(spark, sf_dir)
    return cf.select("c_custkey", T.sha256_hex("c_name").alias("name_sha256"))


@query("flt_account_name")
def q_flt_account_name(spark, sf_dir):
    return VW.customer_fields(spark, sf_dir).where(V.account_name_ok("username")).select("c_custkey", "username")


@query("flt_mail")
def q_flt_mail(spark, sf_dir):
    return VW.customer_fields(spark, sf_dir).where(V.mail_ok("mail")).select("c_custkey", "mail")


@query("flt_phone")
def q_flt_phone(spark, sf_dir):
    return VW.customer_fields(spark, sf_dir).where(V.phone_ok("phone")).select("c_custkey", "phone")


@query("prj_url_norm")
def q_prj_url_norm(spark, sf_dir):
    pages = VW.table(spark, sf_dir, "pages")
    hrefs = pages.select("page_id", V.url_origin("url").alias("origin"),
                         T.numbered(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1), "href_pos", "href"))
    page_urls = pages.select("page_id", F.lit(0).cast("bigint").alias("href_pos"), V.url_origin("url").alias("origin"),
                             F.col("url").alias("href"))
    # links no page holds: other schemes, spaces, bad hosts, nothing at all
    kind = F.col("page_id") % 6
    odd = pages.select("page_id", (F.lit(-1) - kind).cast("bigint").alias("href_pos"), V.url_origin("url").alias("origin"), (
        F.when(kind == 0, "javascript:void(0)").when(kind == 1, "mailto:a@b.example").when(kind == 2, "//cdn.example.org/x y")
         .when(kind == 3, "//cdn.example.org/x").when(kind == 4, "https://-bad-.example/").otherwise("")).alias("href"))
    both = hrefs.unionByName(page_urls).unionByName(odd)
    return both.select("page_id", F.col("href_pos").cast("bigint").alias("href_pos"), "href",
                       V.normalize_url("href", "origin").alias("url_norm"))


@query("src_media_type")
def q_src_media_type(spark, sf_dir):
    return VW.media_blobs(spark, sf_dir).select("doc_id", M.media_type("content").alias("media_type"))


@query("media_profile")
def q_media_profile(spark, sf_dir):
    blobs = VW.media_blobs(spark, sf_dir)
    return blobs.groupBy(M.media_type("content").alias("media_type")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.octet_length("content")).cast("bigint").alias("total_bytes"))


# ---------------------------------------------------------------- dump index, streams, chunks

PACK_LIMIT = 500_000      # bytes per greedy pack before it closes


def _checked_index(spark, sf_dir):
    """The dump index, written as a text file with some bad lines and parsed back in one pass."""
    path = _scratch(spark, "dump_index")
    S.write_lines(VW.dump_index_lines(spark, sf_dir), path)
    return IX.check_dump_index(spark.read.text(path))


def _dump_index(spark, sf_dir):
    return _checked_index(spark, sf_dir).accepted


def _ranges(spark, sf_dir):
    return IX.stream_ranges(_dump_index(spark, sf_dir), VW.dump_file_length(spark, sf_dir))


def _scratch(spark, name):
    return shared_dir(spark, f"tables/{name}-{uuid.uuid4().hex[:12]}")


@query("src_dump_index")
def q_src_dump_index(spark, sf_dir):
    return _numbered_rejects(together(_checked_index(spark, sf_dir)))


@query("line_count")
def q_line_count(spark, sf_dir):
    """Lines and rejects, counted while the index is parsed."""
    checked = _checked_index(spark, sf_dir)
    return spark.range(1).select(F.lit(checked.n_rows).cast("bigint").alias("n_lines"),
                                 F.lit(checked.n_rejects).cast("bigint").alias("n_rejects"))


@query("sort_offsets")
def q_sort_offsets(spark, sf_dir):
    return IX.distinct_offsets(_dump_index(spark, sf_dir)).orderBy("offset")


@query("stream_ranges")
def q_stream_ranges(spark, sf_dir):
    return _ranges(spark, sf_dir)


@query("grp_pages_by_stream")
def q_grp_pages_by_stream(spark, sf_dir):
    return IX.pages_by_stream(_dump_index(spark, sf_dir))


@query("stream_pack_bytes")
def q_stream_pack_bytes(spark, sf_dir):
    return IX.greedy_pack_starts(_ranges(spark, sf_dir), PACK_LIMIT)


def _page_index(spark, sf_dir):
    """The page index table: stats and title per page, and the stream that holds it."""
    pages = wiki_pages(spark, sf_dir)
    stats = P.page_link_stats(pages)
    rows = _dump_index(spark, sf_dir).select("page_id", F.col("offset").alias("stream_st"), F.col("title").alias("page_title"))
    return rows.join(stats, "page_id")


def _faulty_dump(spark, sf_dir):
    """Dump and index that disagree: pages missing on either side, wrong titles and ids, broken records.

    Both go through files: the records are read back from a dump, the index
    from its text form.
    """
    kind = F.col("page_id") % 97
    records = _records(spark, sf_dir).where(kind != 5)
    broken = F.replace(F.col("record"), F.lit("</revision>"), F.lit("</revision"))
    dump = _scratch(spark, "faulty_dump")
    S.write_dump(records.withColumn("record", F.when(kind == 13, broken).otherwise(F.col("record"))), dump)
    index = _dump_index(spark, sf_dir).where(kind != 7).select(
        "offset", F.when(kind == 11, F.col("page_id") + 1000000007).otherwise(F.col("page_id")).alias("page_id"),
        F.when(kind == 9, F.concat(F.lit("not "), F.col("title"))).otherwise(F.col("title")).alias("title"))
    lines = _scratch(spark, "faulty_index")
    S.write_lines(index.select(F.concat_ws(":", "offset", "page_id", "title").alias("value")), lines)
    rows, _ = IX.parse_dump_index(spark.read.text(lines))
    return rows, D.page_records(spark, dump)


@query("validate_index")
def q_validate_index(spark, sf_dir):
    return IX.validate_index(*_faulty_dump(spark, sf_dir))


@query("all_valid")
def q_all_valid(spark, sf_dir):
    return IX.all_valid(IX.validate_index(*_faulty_dump(spark, sf_dir)))


# ---------------------------------------------------------------- category index and graph

GRAPH_ROOT = "k0"


def _checked_categories(spark, sf_dir):
    """The lower-cased category index, read back from its text form, in which some lines have no id or no title."""
    path = _scratch(spark, "category_index_src")
    lines = G.category_index_lines(_cat_pages(spark, sf_dir))
    pages = VW.wiki_pages(spark, sf_dir).select("page_id", "title")
    broken = pages.where(F.col("page_id") % 83 < 2).select(
        F.when(F.col("page_id") % 83 == 0, F.concat(F.lit("no id|"), "title")).otherwise(F.col("page_id").cast("string")).alias("value"))
    S.write_lines(lines.unionByName(broken), path)
    return G.check_category_index(spark.read.text(path))


def _cat_index(spark, sf_dir):
    """The accepted rows of the index: parsed once, so both sides of the graph joins read a table."""
    return _checked_categories(spark, sf_dir).accepted


def _cat_graph_pages(spark, sf_dir):
    return G.category_pages(_cat_index(spark, sf_dir))


def _levels(spark, sf_dir):
    return G.descendants(_cat_graph_pages(spark, sf_dir), GRAPH_ROOT)


@query("src_category_index")
def q_src_category_index(spark, sf_dir):
    both = together(_checked_categories(spark, sf_dir))
    # the size of no list is null, not -1
    n_cats = F.when(F.col("cats").isNotNull(), F.size("cats")).cast("bigint")
    return _numbered_rejects(both.select("page_id", "title", n_cats.alias("n_cats"), F.array_join("cats", "|").alias("cats"), "reject", "record"))


@query("prj_category_pages")
def q_prj_category_pages(spark, sf_dir):
    return _cat_graph_pages(spark, sf_dir).select("page_id", "title", F.array_join("cats", "|").alias("cats"))


@query("prj_content_pages")
def q_prj_content_pages(spark, sf_dir):
    return G.content_pages(_cat_index(spark, sf_dir)).select("page_id", "title", F.array_join("cats", "|").alias("cats"))


@query("join_parent_category")
def q_join_parent_category(spark, sf_dir):
    idx = _cat_index(spark, sf_dir)
    return G.parent_edges(idx, G.category_pages(idx))


@query("category_descendants")
def q_category_descendants(spark, sf_dir):
    return _levels(spark, sf_dir)


@query("level_counts")
def q_level_counts(spark, sf_dir):
    return G.level_counts(_levels(spark, sf_dir))


@query("max_title_length")
def q_max_title_length(spark, sf_dir):
    return _cat_graph_pages(spark, sf_dir).agg(F.max(F.octet_length("title")).cast("bigint").alias("max_title_bytes"))


@query("set_union_seen")
def q_set_union_seen(spark, sf_dir):
    return G.seen_titles(_levels(spark, sf_dir), GRAPH_ROOT)


@query("set_difference_seen")
def q_set_difference_seen(spark, sf_dir):
    cats = _cat_graph_pages(spark, sf_dir)
    return G.unseen_categories(cats, G.seen_titles(G.descendants(cats, GRAPH_ROOT), GRAPH_ROOT))


@query("pages_under_category")
def q_pages_under_category(spark, sf_dir):
    idx = _cat_index(spark, sf_dir)
    seen = G.seen_titles(G.descendants(G.category_pages(idx), GRAPH_ROOT), GRAPH_ROOT)
    return G.pages_under(idx, seen)


@query("sink_category_index")
def q_sink_category_index(spark, sf_dir):
    path = _scratch(spark, "category_index")
    S.write_lines(G.category_index_lines(_cat_pages(spark, sf_dir)), path)
    return spark.read.text(path)


@query("sink_category_list")
def q_sink_category_list(spark, sf_dir):
    path = _scratch(spark, "category_list")
    S.write_lines(P.category_list(_cat_pages(spark, sf_dir)), path, col="category")
    return spark.read.text(path).withColumnRenamed("value", "category")


@query("sink_category_table")
def q_sink_category_table(spark, sf_dir):
    path = _scratch(spark, "category_table")
    # one row per category page: its id and its name (the category it defines)
    rows = G.category_pages(_cat_index(spark, sf_dir)).select("page_id", F.col("title").alias("category"))
    S.write_table(rows, path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- ledger jobs

DRAW_SEED = "draw42"


def _lt(spark, sf_dir, name):
    return VW.ledger(spark, sf_dir, name)


def _balances(spark, sf_dir):
    bal, _ = L.apply_credits(_lt(spark, sf_dir, "profiles"), _lt(spark, sf_dir, "credits"))
    return bal


def _catalog(spark, sf_dir):
    return L.catalog_history(_lt(spark, sf_dir, "catalog_log"))


def _shop(spark, sf_dir, catalog=None):
    """The shop over time; a request sees the names and statuses of its time."""
    return L.shop_history(_lt(spark, sf_dir, "shop_log"), catalog or _catalog(spark, sf_dir))


def _purchases(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    return L.run_purchases(_lt(spark, sf_dir, "purchases"), _balances(spark, sf_dir), catalog, _shop(spark, sf_dir, catalog))


def _draws(spark, sf_dir):
    return L.run_draws(_lt(spark, sf_dir, "draws"), _balances(spark, sf_dir))


def _drawn_pages(spark, sf_dir, decisions=None):
    decisions = _draws(spark, sf_dir)[0] if decisions is None else decisions
    pages = wiki_pages(spark, sf_dir).select("page_id")
    n_pages = pages.count()
    return L.draw_pages(decisions, L.rank_pages(pages, DRAW_SEED, n_pages), DRAW_SEED, n_pages)


@query("ledger_balance")
def q_ledger_balance(spark, sf_dir):
    return _balances(spark, sf_dir).select("account_id", "balance")


@query("catalog_upsert")
def q_catalog_upsert(spark, sf_dir):
    return _catalog(spark, sf_dir).items


@query("catalog_rejects")
def q_catalog_rejects(spark, sf_dir):
    return _catalog(spark, sf_dir).rejects.select("seq", "op", "item_id", "item_name", "status")


@query("shop_listing")
def q_shop_listing(spark, sf_dir):
    return _shop(spark, sf_dir).items


@query("shop_rejects")
def q_shop_rejects(spark, sf_dir):
    asked = F.coalesce(F.col("item_id").cast("string"), F.col("item_name"))
    return _shop(spark, sf_dir).rejects.select("seq", "op", asked.alias("item"), "status")


@query("join_catalog")
def q_join_catalog(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    return catalog.items.join(_shop(spark, sf_dir, catalog).items, "item_id").select("item_id", "item_name", "item_stat", "item_cost")


@query("flt_item_status")
def q_flt_item_status(spark, sf_dir):
    return _catalog(spark, sf_dir).items.where(F.col("item_stat") != L.YANKED).select("item_id", "item_name")


@query("ledger_purchase")
def q_ledger_purchase(spark, sf_dir):
    decisions, _ = _purchases(spark, sf_dir)
    return _numbered_rejects(decisions.select("request_id", "account_id", "item_id", "item_name", "item_count", "status"))


@query("ledger_purchase_balance")
def q_ledger_purchase_balance(spark, sf_dir):
    _, profiles = _purchases(spark, sf_dir)
    return profiles.select("account_id", "balance")


@query("storage_upsert")
def q_storage_upsert(spark, sf_dir):
    """The stored items as buckets of accounts; the purchases rewrite the buckets of the accounts that bought."""
    decisions, _ = _purchases(spark, sf_dir)
    storage, path = _lt(spark, sf_dir, "storage"), _scratch(spark, "storage")
    B.write_buckets(storage, path, ["account_id"])
    L.upsert_stored(spark, path, decisions, storage.schema)
    return B.read_buckets(spark, path, storage.schema)


@query("ledger_draw")
def q_ledger_draw(spark, sf_dir):
    decisions, _ = _draws(spark, sf_dir)
    return decisions.select("request_id", "account_id", "amount", "status")


@query("ledger_draw_pages")
def q_ledger_draw_pages(spark, sf_dir):
    return _drawn_pages(spark, sf_dir)


@query("insert_ignore")
def q_insert_ignore(spark, sf_dir):
    """The collections as buckets of accounts; the draws rewrite the buckets of the accounts that drew."""
    drawn = _drawn_pages(spark, sf_dir).select("account_id", "page_id")
    held, path = _lt(spark, sf_dir, "collection"), _scratch(spark, "collection")
    B.write_buckets(held, path, ["account_id"])
    L.insert_stored(spark, path, drawn, ["account_id", "page_id"], held.schema)
    return B.read_buckets(spark, path, held.schema)


@query("ledger_relation")
def q_ledger_relation(spark, sf_dir):
    rel, _ = L.run_relations(_lt(spark, sf_dir, "relation_requests"), _lt(spark, sf_dir, "accounts"))
    return rel


@query("register_batch")
def q_register_batch(spark, sf_dir):
    return L.register(_lt(spark, sf_dir, "registrations"), _lt(spark, sf_dir, "existing_local"),
                      _lt(spark, sf_dir, "existing_global"))


@query("exists_lookup")
def q_exists_lookup(spark, sf_dir):
    return L.name_lookup(_lt(spark, sf_dir, "registrations"), _lt(spark, sf_dir, "existing_local"),
                         _lt(spark, sf_dir, "existing_global"))


@query("profile_defaults")
def q_profile_defaults(spark, sf_dir):
    return L.profile_defaults(_lt(spark, sf_dir, "accounts"), _lt(spark, sf_dir, "profiles"),
                              _lt(spark, sf_dir, "intros"))


@query("join_account")
def q_join_account(spark, sf_dir):
    return L.join_account(_lt(spark, sf_dir, "accounts"), _lt(spark, sf_dir, "uni_accounts")).select(
        "account_id", "uni_id", "username", "acc_status", "mail", "uni_status")


@query("flt_account_live")
def q_flt_account_live(spark, sf_dir):
    j = L.join_account(_lt(spark, sf_dir, "accounts"), _lt(spark, sf_dir, "uni_accounts"))
    return L.live_accounts(j).select("account_id")


@query("join_user_info")
def q_join_user_info(spark, sf_dir):
    j = L.join_user_info(_lt(spark, sf_dir, "accounts"), _lt(spark, sf_dir, "uni_accounts"),
                         _lt(spark, sf_dir, "profiles"), _lt(spark, sf_dir, "intros"))
    return j.select("account_id", "username", "mail", "balance", "pull_count", "ranks", "description")


@query("user_info")
def q_user_info(spark, sf_dir):
    decisions, profiles = _draws(spark, sf_dir)
    info = L.join_user_info(_lt(spark, sf_dir, "accounts"), _lt(spark, sf_dir, "uni_accounts"), profiles,
                            _lt(spark, sf_dir, "intros"))
    drawn = _drawn_pages(spark, sf_dir, decisions).select("account_id", "page_id")
    coll = L.insert_ignore(_lt(spark, sf_dir, "collection"), drawn, ["account_id", "page_id"])
    # one row per collected page; an account without any has one row with page -1
    return info.join(coll, "account_id", "left").select("account_id", "username", "balance", "pull_count",
                                                        F.coalesce("page_id", F.lit(-1)).cast("bigint").alias("page_id"))


# ---------------------------------------------------------------- history, site info, stores


def _history(spark, sf_dir):
    """History dump shards written to the shared folder, read back revision by revision."""
    path = _scratch(spark, "history_shards")
    S.write_ordered_lines(VW.history_lines(spark, sf_dir), path, "page_id", ["ord", "ord2"])
    return H.read_history(spark, f"{path}/part-*")


@query("src_history")
def q_src_history(spark, sf_dir):
    """Accepted revisions, and the rejects with their reason."""
    h = _history(spark, sf_dir)
    rows = h.revisions.select("page_id", "rev_pos", "rev_id", F.unix_seconds("timestamp").alias("epoch"), "bytes")
    return _numbered_rejects(rows.unionByName(h.rejects.select("page_id", "reject", "record"), allowMissingColumns=True))


@query("revision_count")
def q_revision_count(spark, sf_dir):
    return _history(spark, sf_dir).pages.select("page_id", "revi_count", "n_rejected")


@query("sink_history")
def q_sink_history(spark, sf_dir):
    path = _scratch(spark, "history")
    S.write_history(_history(spark, sf_dir), path)
    return spark.read.text(path)


@query("rfc3339_epoch")
def q_rfc3339_epoch(spark, sf_dir):
    orders = VW.table(spark, sf_dir, "orders")
    txt = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return orders.select("o_orderkey", txt.alias("ts_text"), D.rfc3339_epoch(txt).alias("epoch"))


@query("src_site_info")
def q_src_site_info(spark, sf_dir):
    """One dump per source (its site header, then its pages); read each file's header back."""
    VW.register_tables(spark, sf_dir, ["documents"])
    heads = spark.sql(VW.SITE_HEADER_SQL)
    docs = VW.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "source")
    recs = _records(spark, sf_dir).join(docs, "page_id")
    path = _scratch(spark, "site_dumps")
    S.write_site_dumps(recs, heads, path)
    return D.read_site_info(spark, f"{path}/headers").select("source", "site_info")


@query("sink_page_store")
def q_sink_page_store(spark, sf_dir):
    path = _scratch(spark, "page_store")
    S.write_page_store(wiki_pages(spark, sf_dir), path)
    return spark.read.parquet(path).select("page_id", "title", "redirect_title", "text")


@query("sink_page_index_table")
def q_sink_page_index_table(spark, sf_dir):
    path = _scratch(spark, "page_index")
    counts = _history(spark, sf_dir).pages.select("page_id", "revi_count")
    rows = _page_index(spark, sf_dir).join(counts, "page_id", "left").select(
        "page_id", "stream_st", "link_count", "sect_count", F.coalesce("revi_count", F.lit(0)).cast("bigint").alias("revi_count"),
        "page_type", "page_title")
    S.write_table(rows, path)
    return spark.read.parquet(path)
