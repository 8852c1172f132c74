"""Driver tables and the views the registered queries are built on.

The same SQL text of ``WIKI_PAGES_SQL`` runs in Spark and in the DuckDB
oracle.  Other derived inputs are written twice on purpose: once with the
DataFrame API (here) and once as independent oracle SQL (``oracle.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Wiki pages derived from ``documents``: namespace prefixes, redirects, parent
# categories forming a graph, a pipe sort key, leading and double spaces, a
# masked comment and an overlapping comment/nowiki span.  In every odd hundred
# of ids the categories form one chain; every fifth hundred is a ring that no
# other category reaches.
WIKI_PAGES_SQL = """
SELECT doc_id AS page_id,
 concat(CASE doc_id % 10 WHEN 0 THEN 'Category:' WHEN 1 THEN 'Template:' WHEN 2 THEN 'Module:'
   WHEN 3 THEN 'Portal:' WHEN 4 THEN 'Help:' WHEN 5 THEN 'Wikipedia:' ELSE '' END,
   'K', CAST(doc_id AS STRING)) AS title,
 CASE WHEN doc_id % 9 = 4 THEN concat('K', CAST(doc_id - doc_id % 2 AS STRING)) END AS redirect_title,
 concat('[[Category:K', CAST(CASE
     WHEN CAST(floor(doc_id / 100) AS BIGINT) % 5 = 4 THEN
       CAST(floor(doc_id / 100) AS BIGINT) * 100 + (CAST(floor(doc_id / 10) AS BIGINT) + 9) % 10 * 10
     WHEN CAST(floor(doc_id / 100) AS BIGINT) % 2 = 1 AND CAST(floor(doc_id / 10) AS BIGINT) % 10 > 0 THEN
       CAST(floor(doc_id / 10) AS BIGINT) * 10 - 10
     ELSE CAST(floor(doc_id / 30) AS BIGINT) * 10 END AS STRING), ']] [[Category: K',
   CAST(CASE
     WHEN CAST(floor(doc_id / 100) AS BIGINT) % 5 = 4 THEN
       CAST(floor(doc_id / 100) AS BIGINT) * 100 + (CAST(floor(doc_id / 10) AS BIGINT) + 9) % 10 * 10
     WHEN CAST(floor(doc_id / 100) AS BIGINT) % 2 = 1 THEN CAST(floor(doc_id / 30) AS BIGINT) * 10
     ELSE ((CAST(floor(doc_id / 10) AS BIGINT) * 7 + 1) % 20) * 10 END AS STRING), '  |s]] ',
   CASE WHEN doc_id % 3 = 0 THEN '<!-- <nowiki> --> [[Category:KZ]] </nowiki>'
        ELSE '<!-- [[Category:KX]] -->' END,
   ' ==', lang, '== [[', source, ']] ', text) AS text
FROM documents
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=None) -> None:
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, title, redirect_title, text`` over the whole documents table."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(WIKI_PAGES_SQL)


# Account-like strings derived from ``customer``: some pass the validators,
# some break the character set, the length limit or the mail/phone shape.
CUSTOMER_FIELDS_SQL = """
SELECT c_custkey,
 CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, '#', '_')
   WHEN 2 THEN lower(replace(c_name, '#', '.'))
   ELSE concat(replace(c_name, '#', '-'), '-', c_mktsegment) END AS username,
 CASE c_custkey % 5 WHEN 0 THEN concat(lower(replace(c_name, '#', '.')), '@example.com')
   WHEN 1 THEN concat(c_name, '@example.com')
   WHEN 2 THEN concat('u', CAST(c_custkey AS STRING), '@mail.', lower(c_mktsegment))
   WHEN 3 THEN concat('u', CAST(c_custkey AS STRING), '@gm@a.com')
   ELSE concat('u.', CAST(c_custkey AS STRING), '@ex-', CAST(c_nationkey AS STRING), '.org') END AS mail,
 CASE c_custkey % 3 WHEN 0 THEN concat('+', CAST(c_custkey * 7919 AS STRING))
   WHEN 1 THEN concat('+', lpad(CAST(c_custkey AS STRING), 20, '0'))
   ELSE concat('0', CAST(c_custkey AS STRING)) END AS phone,
 c_name, c_mktsegment, c_nationkey, c_acctbal
FROM customer
"""

# Blobs with a media header (the last one is no known type) chosen by doc_id, followed by the document text.
MEDIA_HEADERS_HEX = [
    "FFD8FFE000104A46494600", "89504E470D0A1A0A", "474946383961", "4D4D002A", "01DA", "50340A", "50350A",
    "50360A", "59A66A95", "23646566696E6520", "424D", "524946460000000057454250", "762F3101",
    "00010203",
]


def customer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(CUSTOMER_FIELDS_SQL)


def media_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, content`` binary blobs derived from documents."""
    from pyspark.sql import functions as F
    docs = table(spark, sf_dir, "documents")
    header = F.element_at(F.array(*[F.lit(h) for h in MEDIA_HEADERS_HEX]), (F.col("doc_id") % len(MEDIA_HEADERS_HEX) + 1).cast("int"))
    return docs.select("doc_id", F.concat(F.unhex(header), F.encode("text", "UTF-8")).alias("content"))


# A dump index derived from documents: 100 consecutive doc ids share one
# compressed stream; a stream's byte length is the sum of its n_chars; the
# first stream starts after a 550-byte header.
DUMP_HEADER_BYTES = 550
PAGES_PER_STREAM = 100


def dump_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stream, offset, stream_bytes`` (offset = header + bytes of earlier streams)."""
    from pyspark.sql import functions as F

    from pagelake.operators.windows import running_total
    docs = table(spark, sf_dir, "documents")
    per_stream = docs.groupBy(F.floor(F.col("doc_id") / PAGES_PER_STREAM).cast("bigint").alias("stream")).agg(
        F.sum("n_chars").cast("bigint").alias("stream_bytes"))
    with_off = running_total(per_stream, ["stream"], "stream_bytes", "before", block_width=4096)
    return with_off.select("stream", (F.col("before") + DUMP_HEADER_BYTES).alias("offset"), "stream_bytes")


def dump_file_length(spark: SparkSession, sf_dir: str) -> int:
    """Byte length of the derived dump file (a single number)."""
    from pyspark.sql import functions as F
    total = table(spark, sf_dir, "documents").agg(F.sum("n_chars")).first()[0]
    return DUMP_HEADER_BYTES + int(total or 0)


def dump_index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``value`` text lines ``offset:page_id:title`` for every page."""
    from pyspark.sql import functions as F
    wp = wiki_pages(spark, sf_dir).select("page_id", "title")
    streams = dump_streams(spark, sf_dir).select("stream", "offset")
    joined = wp.join(streams, F.floor(wp.page_id / PAGES_PER_STREAM).cast("bigint") == streams.stream)
    lines = joined.select(F.concat_ws(":", "offset", "page_id", "title").alias("value"))
    # beside them, lines that break each rule: offset, id, title
    broken = (F.when(F.col("page_id") % 89 == 3, F.concat_ws(":", F.lit("x"), "page_id", "title"))
               .when(F.col("page_id") % 89 == 5, F.concat_ws(":", F.lit("550"), F.lit("K"), "page_id"))
               .when(F.col("page_id") % 89 == 7, F.concat_ws(":", F.lit("550"), "page_id")))
    return lines.unionByName(wp.select(broken.alias("value")).where("value is not null"))


# ---------------------------------------------------------------- ledger world
# Account, catalog and request tables derived from customer, part and events.
# Each SQL text runs unchanged in Spark and in the DuckDB oracle.
LEDGER_SQL = {
    # local (service) accounts
    "accounts": """
SELECT c_custkey AS account_id, c_custkey AS uni_id, lower(replace(c_name, '#', '_')) AS username,
  replace(c_name, '#', '_') AS display_name,
  CASE WHEN c_custkey % 11 = 5 THEN 'hold' ELSE 'live' END AS acc_status
FROM customer""",
    # global accounts
    "uni_accounts": """
SELECT c_custkey AS uni_id, lower(replace(c_name, '#', '_')) AS username,
  concat('u', CAST(c_custkey AS STRING), '@example.com') AS mail,
  CASE WHEN c_custkey % 13 = 6 THEN 'pending' ELSE 'live' END AS uni_status
FROM customer""",
    # customers in debt never opened a profile (their requests meet "invalid name")
    "profiles": """
SELECT c_custkey AS account_id, CAST(0 AS BIGINT) AS ranks, CAST(0 AS BIGINT) AS balance,
  CAST(0 AS BIGINT) AS pull_count
FROM customer WHERE c_acctbal >= 0""",
    "intros": """
SELECT c_custkey AS account_id, concat('intro ', lower(c_mktsegment)) AS description
FROM customer WHERE c_acctbal >= 0""",
    # balance credits: signup events
    "credits": """
SELECT event_id AS request_id, user_id AS account_id, CAST(floor(value) AS BIGINT) AS amount
FROM events WHERE event_type = 'signup'""",
    # purchase requests at some time of the catalog's log, by item id, by the first name or by a later one
    "purchases": """
SELECT e.event_id AS request_id, e.user_id AS account_id, e.event_id % 12 AS seq,
  CASE WHEN e.event_id % 4 <> 1 THEN e.event_id % (SELECT count(*) FROM part) END AS item_id,
  CASE WHEN e.event_id % 8 = 1 THEN concat(p.p_name, '#', CAST(p.p_partkey AS STRING))
    WHEN e.event_id % 8 = 5 THEN concat(p.p_brand, '#', CAST(p.p_partkey AS STRING)) END AS item_name,
  CAST(1 + e.event_id % 3 AS BIGINT) AS item_count
FROM events e LEFT JOIN part p ON p.p_partkey = e.event_id % (SELECT count(*) FROM part) WHERE e.event_type = 'purchase'""",
    # draw requests: view events draw 1..5 pages
    "draws": """
SELECT event_id AS request_id, user_id AS account_id, CASE WHEN event_id % 40 = 0 THEN CAST(1000000 AS BIGINT)
  ELSE CAST(1 + event_id % 5 AS BIGINT) END AS amount
FROM events WHERE event_type = 'view'""",
    # pages already collected before the draws
    "collection": """
SELECT DISTINCT user_id AS account_id, (event_id * 13) % (SELECT count(*) FROM documents) AS page_id
FROM events WHERE event_type = 'click'""",
    # items already stored before the purchases
    "storage": """
SELECT user_id AS account_id, event_id % (SELECT count(*) FROM part) AS item_id, CAST(count(*) AS BIGINT) AS item_count
FROM events WHERE event_type = 'error' GROUP BY 1, 2""",
    # relation requests: error events ask another (sometimes unknown) account
    "relation_requests": """
SELECT e.event_id AS request_id, a.username AS src_name,
  coalesce(b.username, concat('ghost_', CAST((e.user_id * 31 + e.event_id) % ((SELECT count(*) FROM customer) + 50) AS STRING))) AS dst_name
FROM events e JOIN (SELECT c_custkey, lower(replace(c_name, '#', '_')) AS username FROM customer) a ON a.c_custkey = e.user_id
LEFT JOIN (SELECT c_custkey, lower(replace(c_name, '#', '_')) AS username FROM customer) b
  ON b.c_custkey = (e.user_id * 31 + e.event_id) % ((SELECT count(*) FROM customer) + 50)
WHERE e.event_type = 'error'""",
    # catalog change log: adds, a second add of promo items under a taken name,
    # yanks (size a multiple of 7), renames of the largest parts; then renames to the
    # first name of the next part (held, or free since), back to the own first name
    # (free, or taken since), of an unknown item and to the own name, and adds under first names
    "catalog_log": """
SELECT CAST(0 AS BIGINT) AS seq, 'add' AS op, p_partkey AS item_id, concat(p_name, '#', CAST(p_partkey AS STRING)) AS item_name,
  'live' AS item_stat FROM part
UNION ALL
SELECT CAST(1 AS BIGINT), 'add', p_partkey + 1000000, concat(p_name, '#', CAST(p_partkey AS STRING)), 'live'
FROM part WHERE p_type = 'PROMO' AND p_size <= 5
UNION ALL
SELECT CAST(2 AS BIGINT), 'status', p_partkey, CAST(NULL AS STRING), 'yanked' FROM part WHERE p_size % 7 = 0
UNION ALL
SELECT CAST(3 AS BIGINT), 'rename', p_partkey, concat(p_brand, '#', CAST(p_partkey AS STRING)), CAST(NULL AS STRING)
FROM part WHERE p_size > 45
UNION ALL
SELECT CAST(4 AS BIGINT), 'rename', a.p_partkey, concat(b.p_name, '#', CAST(b.p_partkey AS STRING)), CAST(NULL AS STRING)
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_size IN (44, 45)
UNION ALL
SELECT CAST(5 AS BIGINT), 'rename', p_partkey, concat(p_name, '#', CAST(p_partkey AS STRING)), CAST(NULL AS STRING)
FROM part WHERE p_size > 47
UNION ALL
SELECT CAST(6 AS BIGINT), 'rename', p_partkey + 5000000, concat('lost#', CAST(p_partkey AS STRING)), CAST(NULL AS STRING)
FROM part WHERE p_size = 50
UNION ALL
SELECT CAST(7 AS BIGINT), 'rename', p_partkey, concat(p_name, '#', CAST(p_partkey AS STRING)), CAST(NULL AS STRING)
FROM part WHERE p_size = 10
UNION ALL
SELECT CAST(8 AS BIGINT), 'add', p_partkey + 2000000, concat(p_name, '#', CAST(p_partkey AS STRING)), 'live'
FROM part WHERE p_size IN (46, 49)""",
    # shop requests: list every item at its size as cost; unlist size-1 parts by id and
    # size-2 parts by name; list some again later (yanked by then, or listed already), and
    # names and ids that do not exist; unlist and list by names that changed hands
    "shop_log": """
SELECT CAST(0 AS BIGINT) AS seq, 'list' AS op, p_partkey AS item_id, CAST(NULL AS STRING) AS item_name,
  CAST(p_size AS BIGINT) AS item_cost FROM part
UNION ALL
SELECT CAST(1 AS BIGINT), 'unlist', p_partkey, CAST(NULL AS STRING), CAST(NULL AS BIGINT) FROM part WHERE p_size = 1
UNION ALL
SELECT CAST(1 AS BIGINT), 'unlist', CAST(NULL AS BIGINT), concat(p_name, '#', CAST(p_partkey AS STRING)), CAST(NULL AS BIGINT)
FROM part WHERE p_size = 2
UNION ALL
SELECT CAST(5 AS BIGINT), 'list', p_partkey, CAST(NULL AS STRING), CAST(p_size + 1 AS BIGINT) FROM part WHERE p_size % 5 < 2
UNION ALL
SELECT CAST(6 AS BIGINT), 'list', CAST(NULL AS BIGINT), concat('no such part ', CAST(p_partkey AS STRING)), CAST(1 AS BIGINT)
FROM part WHERE p_size = 3
UNION ALL
SELECT CAST(6 AS BIGINT), 'list', p_partkey + 5000000, CAST(NULL AS STRING), CAST(1 AS BIGINT) FROM part WHERE p_size = 4
UNION ALL
SELECT CAST(4 AS BIGINT), 'unlist', CAST(NULL AS BIGINT), concat(p_brand, '#', CAST(p_partkey AS STRING)), CAST(NULL AS BIGINT)
FROM part WHERE p_size IN (46, 47)
UNION ALL
SELECT CAST(7 AS BIGINT), 'unlist', CAST(NULL AS BIGINT), concat(p_name, '#', CAST(p_partkey AS STRING)), CAST(NULL AS BIGINT)
FROM part WHERE p_size = 46
UNION ALL
SELECT CAST(9 AS BIGINT), 'list', CAST(NULL AS BIGINT), concat(p_name, '#', CAST(p_partkey AS STRING)), CAST(99 AS BIGINT)
FROM part WHERE p_size = 46""",
    # registration requests from customer-derived fields, and some that ask for the name of
    # one before them, in capitals or with accents
    "registrations": """
SELECT c_custkey AS req_id, lower(CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, '#', '_')
   WHEN 2 THEN replace(c_name, '#', '.') ELSE concat(replace(c_name, '#', '-'), '-', c_mktsegment) END) AS username,
  replace(c_name, '#', '_') AS display_name,
  CASE c_custkey % 5 WHEN 1 THEN concat(c_name, '@example.com') WHEN 3 THEN concat('u', CAST(c_custkey AS STRING), '@gm@a.com')
    ELSE concat('u', CAST(c_custkey AS STRING), '@example.com') END AS mail,
  CASE WHEN c_custkey % 2 = 0 THEN concat('+', CAST(c_custkey * 7919 AS STRING)) END AS phone
FROM customer
UNION ALL
SELECT c_custkey + 1000000, CASE WHEN c_custkey % 4 < 2 THEN upper(replace(c_name, '#', '_')) ELSE lower(replace(c_name, '#', '_')) END, 'again',
  concat('v', CAST(c_custkey AS STRING), '@example.com'), CAST(NULL AS STRING)
FROM customer WHERE c_custkey % 6 = 1
UNION ALL
SELECT c_custkey + 2000000, replace(replace(c_name, '#', '_'), 'u', 'ú'), 'accent', concat('w', CAST(c_custkey AS STRING), '@example.com'), CAST(NULL AS STRING)
FROM customer WHERE c_custkey % 6 = 2""",
    # accounts that already exist locally / globally before the registrations
    # building-segment customers already have a local account; all but households a global one
    "existing_local": "SELECT lower(replace(c_name, '#', '_')) AS username FROM customer WHERE c_mktsegment = 'BUILDING'",
    "existing_global": """SELECT c_custkey AS uni_id, lower(replace(c_name, '#', '_')) AS username FROM customer
WHERE c_mktsegment <> 'HOUSEHOLD'""",
}
LEDGER_TABLES = {
    "accounts": ["customer"], "uni_accounts": ["customer"], "profiles": ["customer"], "intros": ["customer"],
    "credits": ["events"], "purchases": ["events", "part"], "draws": ["events"],
    "collection": ["events", "documents"], "storage": ["events", "part"],
    "relation_requests": ["events", "customer"], "catalog_log": ["part"], "shop_log": ["part"],
    "registrations": ["customer"], "existing_local": ["customer"], "existing_global": ["customer"],
}


def ledger(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived ledger table, over the whole driver tables it reads."""
    register_tables(spark, sf_dir, LEDGER_TABLES[name])
    return spark.sql(LEDGER_SQL[name])


# ---------------------------------------------------------------- history dump derived from orders
# page = customer, revision = order (timestamp = order date, bytes = floor(total price)),
# ordered by date then order key; pages with o_custkey % 9 = 4 are redirects.
# Customers without orders are pages without revisions.  Some revisions have a
# bad timestamp or a stray tag, and some pages have no id.
def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, ord, value``: the history dump as ordered text pieces.

    Each page is an opening line (ord -1), one line per revision in
    (date, order key) order, and a closing line (ord +inf).  Written in
    ``(page_id, ord)`` order they form one ``<page>`` record per customer
    without ever collecting a customer's orders into one row.
    """
    from pyspark.sql import functions as F
    orders = table(spark, sf_dir, "orders")
    ts_fmt = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    key = F.col("o_orderkey")
    time = F.when(key % 101 == 7, F.lit("no time")).otherwise(F.date_format("o_orderdate", ts_fmt))
    # order within a page: date (epoch seconds) then order key, packed into one sortable pair
    rev = orders.select(
        F.col("o_custkey").alias("page_id"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ord"), key.alias("ord2"),
        F.concat(F.lit("<revision><id>"), key.cast("string"), F.lit("</id><timestamp>"), time, F.lit("</timestamp>"),
                 F.when(key % 103 == 5, F.lit("<b>")).otherwise(F.lit("")), F.lit('<text bytes="'),
                 F.floor("o_totalprice").cast("bigint").cast("string"), F.lit('" /></revision>')).alias("value"))
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"))
    redirect = F.when(F.col("page_id") % 9 == 4, F.concat(F.lit('<redirect title="K'), F.col("page_id").cast("string"),
                                                         F.lit('" />')))
    number = F.when(F.col("page_id") % 211 == 3, F.lit("")).otherwise(
        F.concat(F.lit("<id>"), F.col("page_id").cast("string"), F.lit("</id>")))
    head = pages.select("page_id", F.lit(-(1 << 62)).alias("ord"), F.lit(0).cast("bigint").alias("ord2"), F.concat(
        F.lit("<page><title>K"), F.col("page_id").cast("string"), F.lit("</title><ns>0</ns>"), number,
        F.coalesce(redirect, F.lit(""))).alias("value"))
    tail = pages.select("page_id", F.lit(1 << 62).alias("ord"), F.lit(0).cast("bigint").alias("ord2"),
                        F.lit("</page>").alias("value"))
    return head.unionByName(rev).unionByName(tail)


SITE_HEADER_SQL = """
SELECT d.source,
  concat('<mediawiki xml:lang="', d.lang, '">', chr(10), '  <siteinfo>', chr(10), '    <sitename>', d.source,
         '</sitename>', chr(10), '    <dbname>', d.source, 'wiki</dbname>', chr(10), '  </siteinfo>', chr(10)) AS header,
  d.doc_id AS first_doc
FROM documents d JOIN (SELECT source, min(doc_id) AS first_doc FROM documents GROUP BY source) f
  ON f.source = d.source AND f.first_doc = d.doc_id
"""
