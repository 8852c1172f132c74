"""Batch ledger jobs over request tables.

The reference runs these as single-row transactions.  Here each job takes a
whole request table and the current state tables and returns new state plus a
status per request, keeping the reference's acceptance rules and their order.

The one inherently sequential rule (a rejected request must not consume
balance, so acceptance depends on every earlier decision of the same account)
is evaluated for all accounts in parallel by halving what is left.  With
``2^j <= rest < 2^(j+1)``, costs below ``2^j`` are small.  Until the first
event every small request is accepted and every large one rejected.  The event
is the earlier of the first large cost that still fits and the first small one
that brings the rest below ``2^j``; both are accepted, and either way the rest
loses its top bit.  So the rounds are at most the bit length of the largest
balance, plus one.  A round is a prefix sum of the small costs and the first
event per account: windows over accounts of a bounded number of requests, and
for larger ones block-wise sums, an aggregation and a join, so that no such
account is folded in one task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.operators.sampling import sample_key
from pagelake.operators.windows import as_of, last_seen, one_block, running_total
from pagelake.session import cut_lineage
from pagelake.sources.buckets import BUCKETS, update_buckets

# --- fixed values: result codes of the reference's actions
OK = "ok"
INVALID_NAME = "invalid name"
INVALID_ID = "invalid id"
BAD_STATUS = "bad status"
INSUFFICIENT = "insufficient balance"
PENDING = "pending"
YANKED = "yanked"
LIVE = "live"
# --- end of fixed values
ACCOUNT_EXISTS = "account exists"     # the local account name is taken
INVALID_COUNT = "invalid count"       # ours: the reference accepted negative counts
NAME_EXISTS = "name exists"           # unique item name
DUPLICATE = "duplicate"               # unique pair / same request twice
INVALID = "invalid"                   # a registration field failed validation

NAME_COLLATION = "UNICODE_CI_AI"
REQUEST_BLOCK = 1 << 16               # request-id block for per-account prefix sums
HOT_REQUESTS = 1 << 16                # an account with more requests than this is split into blocks
CATALOG_SEQ_BLOCK = 1 << 16           # change-log sequence block for per-name and per-item lookups
SHOP_SEQ_BLOCK = 1 << 16              # change-log sequence block for an item's listings and unlistings
DRAW_BLOCK = 4096                     # rank numbers exploded from one row
DRAW_ROUNDS = 4                       # rounds of the permutation behind a draw
DRAW_WALKS = 128                      # turns through it for a place beyond the last page
DRAW_PRIME = (1 << 31) - 1            # its mix works modulo this; halves of 31 bits hold any number of pages
DRAW_FACTOR = 48271


# ---------------------------------------------------------------- balances
def apply_credits(profiles: DataFrame, credits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New balance = old + sum of credits; credits for unknown accounts are rejected."""
    sums = credits.groupBy("account_id").agg(F.sum("amount").alias("credit"))
    out = profiles.join(sums, "account_id", "left").withColumn(
        "balance", (F.col("balance") + F.coalesce("credit", F.lit(0))).cast("bigint")).drop("credit")
    rejects = credits.join(profiles.select("account_id"), "account_id", "left_anti").select(
        "request_id", "account_id", F.lit(INVALID_NAME).alias("status"))
    return out, rejects


# ---------------------------------------------------------------- ordered fold
def _halving_round(pending: DataFrame, hot: bool) -> DataFrame:
    """One round over ``account_id, request_id, cost, __rest`` and carried columns.

    Adds ``__small`` and, from the account's event, ``__event`` (its request)
    and ``__left`` (the rest after it); both are null without an event.  A
    ``hot`` round sums in blocks and joins the events; else an account is one
    window group.
    """
    rest, cost = F.col("__rest"), F.col("cost")
    top = F.when(rest > 0, F.expr("shiftleft(1L, length(bin(__rest)) - 1)")).otherwise(F.lit(0).cast("bigint"))
    d = pending.withColumn("__top", top).withColumn("__small", cost < F.col("__top"))
    d = d.withColumn("__add", F.when(F.col("__small"), cost).otherwise(F.lit(0).cast("bigint")))
    account = Window.partitionBy("account_id")
    if hot:
        d = running_total(d, ["request_id"], "__add", "__before", REQUEST_BLOCK, partition_cols=["account_id"])
    else:
        before = F.sum("__add").over(account.orderBy("request_id").rowsBetween(Window.unboundedPreceding, -1))
        d = d.withColumn("__before", F.coalesce(before, F.lit(0)).cast("bigint"))
    left = rest - F.col("__before") - cost
    event = (rest > 0) & F.when(F.col("__small"), left < F.col("__top")).otherwise(left >= 0)
    if hot:
        events = d.where(event).groupBy("account_id").agg(F.min_by(F.struct("request_id", left.alias("left")), "request_id").alias("__e"))
        d = d.join(events, "account_id", "left")
    else:
        d = d.withColumn("__e", F.min(F.when(event, F.struct("request_id", left.alias("left")))).over(account))
    return d.withColumn("__event", F.col("__e.request_id")).withColumn("__left", F.col("__e.left")).drop("__top", "__add", "__before", "__e")


def ordered_fold(requests: DataFrame, balances: DataFrame) -> DataFrame:
    """Accept requests per account in ``request_id`` order while the balance covers them.

    ``requests``: ``account_id, request_id, cost`` and any other columns, which
    are carried along (all checks other than the balance already passed; costs
    are not negative).  ``balances``: ``account_id, balance``.  Returns the
    request rows with ``ok``.

    An account of at most ``HOT_REQUESTS`` open requests is one group of a
    window; the requests of larger ones are summed block by block.
    """
    columns = requests.columns
    asked = requests.join(balances.select("account_id", F.col("balance").alias("__rest")), "account_id")
    # most accounts can pay for everything they ask: one aggregation settles them
    totals = requests.groupBy("account_id").agg(F.sum(F.col("cost").cast("decimal(38,0)")).alias("__total"), F.count(F.lit(1)).alias("__n"))
    asked = cut_lineage(asked.join(totals, "account_id"))
    covered, is_hot = F.col("__total") <= F.col("__rest"), F.col("__n") > HOT_REQUESTS
    decided = [asked.where(covered).select(*columns, F.lit(True).alias("ok"))]
    open_ = asked.where(~covered)
    for hot, pending in ((False, open_.where(~is_hot)), (True, open_.where(is_hot))):
        pending = pending.select(*columns, "__rest")
        while not pending.isEmpty():
            d = cut_lineage(_halving_round(pending, hot))
            done = F.col("__event").isNull() | (F.col("request_id") <= F.col("__event"))
            # nothing left: only what costs nothing is accepted
            ok = (F.when(F.col("__rest") <= 0, F.col("cost") <= F.col("__rest"))
                   .otherwise(F.col("__small") | F.coalesce(F.col("request_id") == F.col("__event"), F.lit(False))))
            decided.append(d.where(done).select(*columns, ok.alias("ok")))
            pending = d.where(~done).select(*columns, F.col("__left").alias("__rest"))
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out


def settle(profiles: DataFrame, decided: DataFrame) -> DataFrame:
    """Balances after deducting accepted costs."""
    spent = decided.where("ok").groupBy("account_id").agg(F.sum("cost").alias("spent"))
    return profiles.join(spent, "account_id", "left").withColumn(
        "balance", (F.col("balance") - F.coalesce("spent", F.lit(0))).cast("bigint")).drop("spent")


# ---------------------------------------------------------------- catalog and shop
_LOG_ORDER = ["seq", "item_id", "op", "item_name"]


def _claims(log: DataFrame) -> DataFrame:
    """Adds and renames; a null name is no name, a null id no item."""
    return log.where(F.col("op").isin("add", "rename") & F.col("item_name").isNotNull() & F.col("item_id").isNotNull()).select(*_LOG_ORDER, "item_stat")


def _settled_claims(claims: DataFrame) -> DataFrame:
    """``claims`` with ``ok`` and ``known`` (the item exists then), as a loop over the log in order would decide them.

    ``lone`` marks the only claim of an item, an add that nobody contests.

    A claim succeeds if the name is free then: its last holder has left it, by
    a later claim that succeeded.  Claims on names that one item alone ever
    claims succeed whenever the item exists.  The others are decided in rounds:
    every round takes the decisions so far, looks up the last holder of each
    name and the last name of each holder as of every claim, and decides anew.
    A decision depends on earlier claims only, so after each round at least
    those that depend on settled ones are settled, and when a round changes
    nothing all are what the loop gives.  Rounds are as many as the longest
    chain of claims that decide each other, not as there are claims.  A claim
    that the log repeats is decided like the first, and a round keeps it once.
    """
    # two names of one number only go through the rounds, which compare the names
    claims = claims.withColumn("__name", F.xxhash64("item_name"))
    contested = claims.groupBy("__name").agg(F.min("item_id").alias("a"), F.max("item_id").alias("b")).where("a <> b")
    # few of the names: as a table its size is known before the join, and the claims need not be shuffled for it
    contested = cut_lineage(contested.select("__name"))
    # distinct again, as the planner then knows that the join adds no rows and that the items are few
    contested = contested.distinct().select("__name", F.lit(True).alias("contested"))
    claims = claims.join(contested, "__name", "left").withColumn("contested", F.col("contested").isNotNull())
    is_add = F.col("op") == "add"
    items = claims.groupBy("item_id").agg((F.max("contested") | (F.count_if(is_add) > 1)).alias("open"),
                                          F.min(F.when(is_add, F.col("seq"))).alias("born"), F.count(F.lit(1)).alias("n"))
    # most items have one claim, their add: there is nothing to tell it
    items = items.where(F.col("open") | (F.col("n") > 1) | F.col("born").isNull())
    lone, open_ = F.col("n").isNull(), F.coalesce("open", F.lit(False))
    # an add comes before the renames of its time
    exists = lone | F.coalesce(F.col("seq") >= F.col("born"), F.lit(False))
    # undecided claims start as accepted ones
    marked = cut_lineage(claims.join(items, "item_id", "left").select(
        *_LOG_ORDER, "item_stat", "contested", open_.alias("open"), lone.alias("lone"), *[(open_ | exists).alias(c) for c in ("ok", "known")]))
    sure, pending = marked.where(~F.col("open")), cut_lineage(marked.where("open").drop("open", "lone"))
    single = one_block([pending], "seq", CATALOG_SEQ_BLOCK)
    while not pending.isEmpty():
        pending = cut_lineage(_decided_again(pending, single))
        if pending.where("changed").isEmpty():
            break
    columns = [*_LOG_ORDER, "item_stat", "ok", "known"]
    return sure.select(*columns, "lone").unionByName(pending.select(*columns, F.lit(False).alias("lone")))


def _decided_again(claims: DataFrame, single: bool = False) -> DataFrame:
    """One round: each claim decided from the present decisions on the claims before it."""
    placed = claims.select(*_LOG_ORDER, "item_stat", "contested", "ok", "known")
    # only a contested name has a holder other than the item that claims it
    rivals = placed.where("contested")
    took = rivals.where("ok").select("item_name", "seq", "item_id", "op", F.col("item_id").alias("holder"))
    asked = as_of(rivals, "item_name", ["seq", "item_id", "op"], {"holder": took}, CATALOG_SEQ_BLOCK, inclusive=False, single=single)
    # what the item itself, and the last holder of the name, are called then
    names = placed.where("ok").select(F.col("item_id").alias("who"), *_LOG_ORDER, F.col("item_name").alias("called"))
    own = placed.withColumn("who", F.col("item_id")).withColumn("own", F.lit(True))
    other = asked.where("holder <> item_id").withColumnRenamed("holder", "who").withColumn("own", F.lit(False))
    called = as_of(own.unionByName(other), "who", _LOG_ORDER, {"called": names}, CATALOG_SEQ_BLOCK, inclusive=False, single=single)
    # flags, which a hash aggregation holds
    d = called.groupBy(*_LOG_ORDER, "item_stat", "contested", F.col("ok").alias("was")).agg(
        F.max(F.col("own") & F.col("called").isNotNull()).alias("known"),
        F.max(~F.col("own") & F.coalesce(F.col("called") == F.col("item_name"), F.lit(False))).alias("taken"))
    ok = ~F.col("taken") & F.when(F.col("op") == "add", ~F.col("known")).otherwise(F.col("known"))
    return d.select(*_LOG_ORDER, "item_stat", "contested", ok.alias("ok"), "known", (ok != F.col("was")).alias("changed"))


class Catalog(NamedTuple):
    """``items``: item_id, item_name, item_stat.  ``rejects``: seq, op, item_id, item_name, status.

    In time, ``names`` (item_id, item_name, item_stat, seq, ...) are the accepted
    claims, an add with its status, and ``stats`` (the same columns) the accepted
    changes of a status.
    """

    items: DataFrame
    rejects: DataFrame
    names: DataFrame
    stats: DataFrame


def catalog_history(log: DataFrame) -> Catalog:
    """Adds, renames and status changes in ``(seq, item_id, op, item_name)`` order.

    A name belongs to one item at a time: adds and renames to a held name are
    rejected, a rename frees the old name.  Winners and latest values come from
    aggregations and block-wise passes, so a hot item or name is not a hot task.
    """
    log = cut_lineage(log)
    claims = _settled_claims(_claims(log))
    named = claims.where("ok")
    names = named.select(*_LOG_ORDER, "item_stat")
    # a status comes after the claims of its time
    born = names.groupBy("item_id").agg(F.min("seq").alias("born"))
    told = log.where(F.col("op") == "status").join(born, "item_id", "left")
    told = cut_lineage(told.select(*_LOG_ORDER, "item_stat", F.coalesce(F.col("seq") >= F.col("born"), F.lit(False)).alias("exists")))
    stats = told.where("exists").select(*_LOG_ORDER, "item_stat")
    place = F.struct("seq", "op", "item_name")
    # only items with more than an add have a last name or status to look for; a status comes after the add
    last = named.where(~F.col("lone")).groupBy("item_id").agg(
        F.max_by("item_name", place).alias("item_name"), F.max_by("item_stat", F.when(F.col("op") == "add", place)).alias("item_stat"))
    told_last = stats.groupBy("item_id").agg(F.max_by(F.struct("item_stat"), place).alias("told"))
    items = named.where("lone").select("item_id", "item_name", "item_stat").unionByName(last).join(told_last, "item_id", "left")
    items = items.select("item_id", "item_name", F.when(F.col("told").isNull(), F.col("item_stat")).otherwise(F.col("told.item_stat")).alias("item_stat"))
    refused = claims.where(~F.col("ok")).select("seq", "op", "item_id", "item_name", F.when(
        (F.col("op") == "rename") & ~F.col("known"), F.lit(INVALID_ID)).when((F.col("op") == "add") & F.col("known"), F.lit(DUPLICATE))
        .otherwise(F.lit(NAME_EXISTS)).alias("status")).distinct()
    lost = told.where(~F.col("exists")).select("seq", "op", "item_id", "item_name", F.lit(INVALID_ID).alias("status"))
    return Catalog(items, refused.unionByName(lost), names, stats)


def apply_catalog(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(catalog(item_id, item_name, item_stat), rejects(seq, op, item_id, item_name, status))`` at the end of the log."""
    made = catalog_history(log)
    return made.items, made.rejects


def _at_start(catalog: DataFrame) -> Catalog:
    """A catalog without a history: its names and statuses hold from the beginning."""
    first = [F.lit(-(1 << 62)).alias("seq"), "item_id", F.lit("add").alias("op"), "item_name"]
    names = catalog.select(*first, "item_stat")
    return Catalog(catalog, catalog.limit(0), names, names.limit(0))


def resolve_items(requests: DataFrame, catalog: Catalog, events: dict[str, DataFrame] | None = None) -> DataFrame:
    """Requests (``seq, item_id, item_name``) with ``rid`` and ``item_stat`` as of their ``seq``; null: no such item then.

    A name stands for the item that holds it at that time: the last one to take
    it, unless that item has another name by then.  Values of ``events`` (by
    ``who``, an item, ``seq`` and a ``tie`` of operation and name) are looked up
    in the same pass.
    """
    took = catalog.names.select("seq", F.col("item_name").alias("asked_name"), F.struct("item_id", "op").alias("tie"), F.col("item_id").alias("named_id"))
    told = catalog.names.unionByName(catalog.stats).select(
        F.col("item_id").alias("who"), "seq", F.struct("op", "item_name").alias("tie"),
        F.when(F.col("op") != "status", F.struct(F.col("item_name").alias("v"))).alias("called"),
        F.when(F.col("op") != "rename", F.struct(F.col("item_stat").alias("v"))).alias("now_stat"))
    more = events or {}
    single = one_block([requests, catalog.names, catalog.stats, *more.values()], "seq", CATALOG_SEQ_BLOCK)
    r = requests.withColumn("asked_name", F.when(F.col("item_id").isNull(), F.col("item_name")))
    by_name = F.col("asked_name").isNotNull()
    # most names are never asked for; a name with the number of one that is asked for passes too and meets no request
    number = F.xxhash64("asked_name").alias("__name")
    wanted = cut_lineage(r.where(by_name).select(number).distinct())
    took = took.select("*", number).join(wanted, "__name", "left_semi").drop("__name")
    named = as_of(r.where(by_name), "asked_name", ["seq"], {"named_id": took}, CATALOG_SEQ_BLOCK, single=single)
    r = r.where(~by_name).unionByName(named, allowMissingColumns=True).withColumn("who", F.coalesce("item_id", "named_id"))
    r = as_of(r, "who", ["seq"], {("called", "now_stat"): told, **more}, CATALOG_SEQ_BLOCK, single=single)
    there = F.col("called").isNotNull() & (F.col("item_id").isNotNull() | (F.col("called") == F.col("asked_name")))
    return r.select(*requests.columns, *[F.when(there, F.col(c)).alias(out) for c, out in
                                         (("who", "rid"), ("now_stat", "item_stat"), *((c, c) for c in more))])


class Shop(NamedTuple):
    """``items``: item_id, item_cost at the end.  ``rejects``: seq, op, item_id, item_name, status.

    ``offers`` (item_id, seq, op, item_cost) are the changes in time, at one time a
    listing first; a null cost ends an offer.
    """

    items: DataFrame
    rejects: DataFrame
    offers: DataFrame


def shop_history(log: DataFrame, catalog: Catalog) -> Shop:
    """List items at a cost unless missing or yanked; unlist by id or by name; names and statuses as of the request.

    The status check applies to every listing (the reference skipped it for
    numeric ids).  The shop holds an item once: a listing of a listed item is
    a duplicate, and the first cost stays.
    """
    resolved = resolve_items(cut_lineage(log), catalog)
    missing = F.col("rid").isNull()
    status = (F.when(missing & F.col("item_id").isNull(), F.lit(INVALID_NAME))
               .when(missing, F.lit(INVALID_ID))
               .when((F.col("op") == "list") & (F.col("item_stat") == YANKED), F.lit(BAD_STATUS))
               .otherwise(F.lit(OK)))
    checked = cut_lineage(resolved.withColumn("status", status))
    accepted = checked.where(F.col("status") == OK).withColumn(
        "op_rank", F.when(F.col("op") == "list", F.lit(0)).otherwise(F.lit(1)))   # same seq: list, then unlist
    # each listing or unlisting beside its predecessor on the same item
    known = cut_lineage(last_seen(accepted, ["rid"], ["seq", "op_rank", "item_cost"], {"prev_rank": "op_rank"}, SHOP_SEQ_BLOCK, inclusive=False,
                                  single=one_block([checked], "seq", SHOP_SEQ_BLOCK)))
    again = (F.col("op") == "list") & F.coalesce(F.col("prev_rank") == 0, F.lit(False))
    offers = known.where(~again).select(F.col("rid").alias("item_id"), "seq", "op", F.when(F.col("op") == "list", F.col("item_cost")).alias("item_cost"))
    # times and costs are numbers, which a hash aggregation holds
    listed, ended = F.when(F.col("op") == "list", F.col("seq")), F.when(F.col("op") != "list", F.col("seq"))
    items = offers.groupBy("item_id").agg(F.max_by("item_cost", listed).alias("item_cost"), F.max(listed).alias("listed"), F.max(ended).alias("ended"))
    items = items.where(F.col("item_cost").isNotNull() & (F.col("ended").isNull() | (F.col("listed") > F.col("ended")))).select("item_id", "item_cost")
    rejects = checked.where(F.col("status") != OK).select("seq", "op", "item_id", "item_name", "status").unionByName(
        known.where(again).select("seq", "op", "item_id", "item_name", F.lit(DUPLICATE).alias("status")))
    return Shop(items, rejects, offers)


def apply_shop(log: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``shop_history`` against a catalog that does not change; returns (shop, rejects)."""
    made = shop_history(log, _at_start(catalog))
    return made.items, made.rejects


# ---------------------------------------------------------------- purchases and draws
def purchase_checks(requests: DataFrame, profiles: DataFrame, catalog: Catalog, shop: Shop) -> DataFrame:
    """Balance-independent checks in the reference's order; ``status`` null = still open.

    An item is asked for by id or, without one, by name; ``seq`` is the time in
    the catalog's and the shop's logs that a request sees.
    """
    tie = F.struct("op", F.lit(None).cast("string").alias("item_name")).alias("tie")
    offers = shop.offers.select(F.col("item_id").alias("who"), "seq", tie, "item_cost")
    r = resolve_items(requests, catalog, {"item_cost": offers})
    r = r.join(profiles.select("account_id", F.lit(True).alias("has_profile")), "account_id", "left")
    missing = F.col("rid").isNull() | F.col("item_cost").isNull()
    status = (F.when(F.col("has_profile").isNull(), F.lit(INVALID_NAME))
               .when(missing & F.col("item_id").isNull(), F.lit(INVALID_NAME))
               .when(missing, F.lit(INVALID_ID))
               .when(F.col("item_stat") == YANKED, F.lit(BAD_STATUS))
               .when(F.col("item_count") <= 0, F.lit(INVALID_COUNT)))
    return r.select("request_id", "account_id", F.coalesce("item_id", "rid").alias("item_id"), "item_name", "item_count",
                    (F.col("item_cost") * F.col("item_count")).cast("bigint").alias("cost"), status.alias("status"))


def run_purchases(requests: DataFrame, profiles: DataFrame, catalog: Catalog | DataFrame, shop: Shop | DataFrame):
    """Returns ``(decisions(request_id, account_id, item_id, item_name, item_count, cost, status), new profiles)``.

    ``item_id`` of a purchase by name is the item that had the name.  A plain
    catalog or shop frame holds at all times; requests may then lack ``seq`` and ``item_name``.
    """
    if isinstance(catalog, DataFrame):
        catalog = _at_start(catalog)
    if isinstance(shop, DataFrame):
        shop = Shop(shop, shop.limit(0), shop.select("item_id", F.lit(-(1 << 62)).alias("seq"), F.lit("list").alias("op"), "item_cost"))
    for name, kind in (("seq", "bigint"), ("item_name", "string")):
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(0 if name == "seq" else None).cast(kind))
    profiles, requests = cut_lineage(profiles), cut_lineage(requests)
    checked = cut_lineage(purchase_checks(requests, profiles, catalog, shop))
    # only what the fold reads goes through its rounds; the rest of a request is joined back once
    open_ = checked.where(F.col("status").isNull())
    folded = ordered_fold(open_.select("account_id", "request_id", "cost"), profiles)
    decided = open_.drop("status").join(folded.drop("cost"), ["account_id", "request_id"])
    settled = decided.withColumn("status", F.when(F.col("ok"), F.lit(OK)).otherwise(F.lit(INSUFFICIENT)))
    decisions = checked.where(F.col("status").isNotNull()).unionByName(settled.drop("ok"))
    return decisions, settle(profiles, folded)


def upsert_storage(storage: DataFrame, decisions: DataFrame) -> DataFrame:
    """``item_count = item_count + n`` on (account, item); new pairs are inserted."""
    bought = decisions.where(F.col("status") == OK).select("account_id", "item_id", "item_count")
    return storage.select("account_id", "item_id", "item_count").unionByName(bought).groupBy(
        "account_id", "item_id").agg(F.sum("item_count").cast("bigint").alias("item_count"))


def upsert_stored(spark: SparkSession, path: str, decisions: DataFrame, schema, buckets: int = BUCKETS) -> list[int]:
    """``upsert_storage`` on a bucketed state table, of which only the buckets of buying accounts are rewritten."""
    bought = decisions.where(F.col("status") == OK).select("account_id", "item_id", "item_count")

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return upsert_storage(old, new.withColumn("status", F.lit(OK))).select(*schema.names)

    return update_buckets(spark, path, bought, ["account_id"], merge, schema, buckets)


def insert_stored(spark: SparkSession, path: str, new: DataFrame, keys: list[str], schema, buckets: int = BUCKETS) -> list[int]:
    """``insert_ignore`` on a state table bucketed by its first key."""
    return update_buckets(spark, path, new.select(*keys), keys[:1], lambda old, more: insert_ignore(old, more, keys), schema, buckets)


def run_draws(requests: DataFrame, profiles: DataFrame):
    """``amount > balance`` -> insufficient; else deduct.  Returns ``(decisions, new profiles)``.

    ``pull_count`` grows by the amount drawn (the reference never updated it).
    """
    profiles = cut_lineage(profiles)
    r = requests.join(profiles.select("account_id", F.lit(True).alias("has_profile")), "account_id", "left")
    status = (F.when(F.col("has_profile").isNull(), F.lit(INVALID_NAME))
               .when(F.col("amount") <= 0, F.lit(INVALID_COUNT)))
    checked = cut_lineage(r.select("request_id", "account_id", "amount", status.alias("status")))
    open_ = checked.where(F.col("status").isNull())
    decided = ordered_fold(open_.drop("status").withColumn("cost", F.col("amount").cast("bigint")), profiles)
    settled = decided.select("request_id", "account_id", "amount",
                             F.when(F.col("ok"), F.lit(OK)).otherwise(F.lit(INSUFFICIENT)).alias("status"))
    decisions = checked.where(F.col("status").isNotNull()).unionByName(settled)
    pulled = decided.where("ok").groupBy("account_id").agg(F.sum("cost").alias("pulled"))
    new_profiles = settle(profiles, decided).join(pulled, "account_id", "left").withColumn(
        "pull_count", (F.col("pull_count") + F.coalesce("pulled", F.lit(0))).cast("bigint")).drop("pulled")
    return decisions, new_profiles


def _hash60(c):
    """Non-negative 60-bit integer from the first 15 hex digits of an md5."""
    return F.conv(F.substring(c, 1, 15), 16, 10).cast("bigint")


def rank_pages(pages: DataFrame, seed: str, n_pages: int) -> DataFrame:
    """``page_id, rank``: 0-based position in the seeded pseudo-random page order.

    Ranks come from a block-wise running count over the 60-bit hash (no
    single-partition window); blocks hold about 4096 pages each.
    """
    from pagelake.operators.windows import as_of, running_total
    keyed = pages.select("page_id", _hash60(sample_key(seed, "page_id")).alias("hkey"), F.lit(1).alias("one"))
    n_blocks = max(1, -(-n_pages // 4096))
    width = -(-(1 << 60) // n_blocks)
    return running_total(keyed, ["hkey", "page_id"], "one", "rank", width).select("page_id", "rank")


def shuffled(k: Column, keys: list[Column], n: int) -> Column:
    """The place of number ``k`` (0 to n-1) in a permutation of 0 to n-1 that ``keys`` choose.

    A small Feistel network over the fewest bits that hold ``n`` numbers: each
    round changes one half by a mix of the other, which can always be undone,
    so different numbers go to different places.  A place of ``n`` or more is
    put through again until it is below ``n``; less than half of the places are
    beyond, and one still is after ``DRAW_WALKS`` turns with probability 2**-128.
    """
    bits = (n - 1).bit_length()
    low = bits - bits // 2
    high_mask, low_mask = F.lit((1 << bits // 2) - 1).cast("bigint"), F.lit((1 << low) - 1).cast("bigint")

    def mix(half: Column, key: Column) -> Column:
        x = (half + key) % DRAW_PRIME
        return ((x * x) % DRAW_PRIME * DRAW_FACTOR) % DRAW_PRIME

    def network(x: Column) -> Column:
        high, rest = F.shiftright(x, low), x.bitwiseAND(low_mask)
        for i, key in enumerate(keys):
            if i % 2 == 0:
                high = high.bitwiseXOR(mix(rest, key).bitwiseAND(high_mask))
            else:
                rest = rest.bitwiseXOR(mix(high, key).bitwiseAND(low_mask))
        return F.shiftleft(high, low).bitwiseOR(rest)

    turns = F.sequence(F.lit(1), F.lit(DRAW_WALKS))
    return F.aggregate(turns, network(k), lambda x, _: F.when(x < n, x).otherwise(network(x)))


def draw_pages(decisions: DataFrame, ranked: DataFrame, seed: str, n_pages: int) -> DataFrame:
    """Pages for each accepted draw: the first ``amount`` places of a permutation of its own.

    Pages of a request are distinct, and requests are independent of each other.
    Each request explodes into its own numbers (at most all pages), in blocks
    and then within blocks, and meets the ranked pages in an equi-join.
    """
    if n_pages <= 0:   # nothing to draw from (and no modulo by zero)
        return decisions.sparkSession.createDataFrame([], "request_id bigint, account_id bigint, page_id bigint")
    ok = decisions.where(F.col("status") == OK)
    names = [f"key{i}" for i in range(DRAW_ROUNDS)]
    keys = [F.pmod(_hash60(sample_key(seed, F.lit(f"k{i}"), "request_id")), F.lit(DRAW_PRIME)).alias(c) for i, c in enumerate(names)]
    zero, last = F.lit(0).cast("bigint"), (F.least(F.col("amount"), F.lit(n_pages)) - 1).cast("bigint")
    blocks = ok.select("request_id", "account_id", *keys, last.alias("last"),
                       F.explode(F.sequence(zero, F.floor(last / DRAW_BLOCK))).alias("block"))
    low = F.col("block") * DRAW_BLOCK
    ks = F.sequence(low, F.least(F.col("last"), low + DRAW_BLOCK - 1))
    want = blocks.select("request_id", "account_id", *names, F.explode(ks).alias("k")).select(
        "request_id", "account_id", shuffled(F.col("k"), [F.col(c) for c in names], n_pages).alias("rank"))
    return want.join(ranked, "rank").select("request_id", "account_id", "page_id")


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert only the keys not present yet (and each new key once)."""
    fresh = new.select(*keys).dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return existing.select(*keys).unionByName(fresh)


# ---------------------------------------------------------------- relations and accounts
def run_relations(requests: DataFrame, accounts: DataFrame, existing: DataFrame | None = None):
    """Resolve both names; store ``(min, max)``, ``src_0 = src < dst``, ``pending``; pairs are unique.

    The earliest request of a pair wins (an aggregation, not a window).
    Returns ``(relations(id0, id1, src_0, status, request_id), rejects(request_id, status))``.
    """
    names = accounts.select("username", "account_id")
    r = (requests.join(names.select(F.col("username").alias("src_name"), F.col("account_id").alias("src_id")),
                       "src_name", "left")
                 .join(names.select(F.col("username").alias("dst_name"), F.col("account_id").alias("dst_id")),
                       "dst_name", "left"))
    bad = r.where(F.col("src_id").isNull() | F.col("dst_id").isNull()).select(
        "request_id", F.lit(INVALID_NAME).alias("status"))
    good = r.where(F.col("src_id").isNotNull() & F.col("dst_id").isNotNull()).select(
        "request_id", F.least("src_id", "dst_id").alias("id0"), F.greatest("src_id", "dst_id").alias("id1"),
        (F.col("src_id") < F.col("dst_id")).alias("src_0"))
    if existing is not None:
        dup_old = good.join(existing.select("id0", "id1"), ["id0", "id1"], "left_semi")
        good = good.join(existing.select("id0", "id1"), ["id0", "id1"], "left_anti")
    first = good.groupBy("id0", "id1").agg(F.min("request_id").alias("request_id"))
    rel = good.join(first, ["id0", "id1", "request_id"]).select(
        "id0", "id1", "src_0", F.lit(PENDING).alias("status"), "request_id")
    dups = good.join(first.select("request_id"), "request_id", "left_anti").select(
        "request_id", F.lit(DUPLICATE).alias("status"))
    rejects = bad.unionByName(dups)
    if existing is not None:
        rejects = rejects.unionByName(dup_old.select("request_id", F.lit(DUPLICATE).alias("status")))
    return rel, rejects


def join_account(accounts: DataFrame, uni: DataFrame) -> DataFrame:
    return accounts.join(uni.drop("username"), "uni_id", "inner")


def live_accounts(joined: DataFrame) -> DataFrame:
    """Both the local and the global status must be ``live``."""
    return joined.where((F.col("acc_status") == LIVE) & (F.col("uni_status") == LIVE))


def join_user_info(accounts: DataFrame, uni: DataFrame, profiles: DataFrame, intros: DataFrame) -> DataFrame:
    """Account, global account, profile and intro, all joined on the local account id."""
    return (join_account(accounts, uni)
            .join(profiles, "account_id", "inner")
            .join(intros, "account_id", "inner"))


def profile_defaults(accounts: DataFrame, profiles: DataFrame, intros: DataFrame) -> DataFrame:
    """Zeroed profile and empty intro for every account lacking one; existing rows kept."""
    missing = accounts.select("account_id").join(profiles.select("account_id"), "account_id", "left_anti")
    new = missing.select("account_id", F.lit(0).cast("bigint").alias("ranks"), F.lit(0).cast("bigint").alias("balance"),
                         F.lit(0).cast("bigint").alias("pull_count"), F.lit(True).alias("created"))
    full = profiles.select("account_id", "ranks", "balance", "pull_count", F.lit(False).alias("created")).unionByName(new)
    no_intro = accounts.select("account_id").join(intros.select("account_id"), "account_id", "left_anti")
    intro_all = intros.select("account_id", "description").unionByName(
        no_intro.select("account_id", F.lit("").alias("description")))
    return full.join(intro_all, "account_id", "left")


def _name_key() -> Column:
    """Account names are the same whatever their case and accents; joins and groups on this key stay hash-based."""
    return F.collate("username", NAME_COLLATION).alias("__key")


def register(requests: DataFrame, existing_local: DataFrame, existing_global: DataFrame) -> DataFrame:
    """Validate fields, reject taken names, reuse a global account with the same name.

    Same-batch duplicates: the lowest id among the valid requests for a free name wins.
    Returns ``req_id, username, status, uni_reused``.
    """
    from pagelake.functions import validate as V
    valid = (V.account_name_ok("username") & V.account_name_ok("display_name", V.DISPLAY_NAME_MAX)
             & V.mail_ok("mail") & (F.col("phone").isNull() | V.phone_ok("phone")))
    # a name may stand in the state more than once; a request must not multiply
    taken = existing_local.select(_name_key()).distinct().withColumn("taken", F.lit(True))
    glob = existing_global.select(_name_key()).distinct().withColumn("uni_reused", F.lit(True))
    r = requests.withColumn("__valid", valid).withColumn("__key", _name_key()).join(taken, "__key", "left").join(glob, "__key", "left")
    # same-batch duplicates: the earliest *valid* request for a free name wins
    first = r.where(F.col("__valid") & F.col("taken").isNull()).groupBy("__key").agg(
        F.min("req_id").alias("first_req"))
    r = r.join(first, "__key", "left")
    status = (F.when(~F.col("__valid"), F.lit(INVALID))
               .when(F.col("taken").isNotNull(), F.lit(ACCOUNT_EXISTS))
               .when(F.col("req_id") != F.col("first_req"), F.lit(DUPLICATE))
               .otherwise(F.lit(OK)))
    return r.select("req_id", "username", status.alias("status"),
                    (F.coalesce("uni_reused", F.lit(False)) & (status == OK)).alias("uni_reused"))


def name_lookup(requests: DataFrame, existing_local: DataFrame, existing_global: DataFrame) -> DataFrame:
    """Is each requested name taken locally / known globally (semi joins, as flags)?"""
    asked = requests.select("req_id", _name_key())
    local = asked.join(existing_local.select(_name_key()), "__key", "left_semi").select("req_id", F.lit(True).alias("local_taken"))
    glob = asked.join(existing_global.select(_name_key()), "__key", "left_semi").select("req_id", F.lit(True).alias("global_known"))
    return requests.select("req_id", "username").join(local, "req_id", "left").join(glob, "req_id", "left").select(
        "req_id", "username", F.coalesce("local_taken", F.lit(False)).alias("local_taken"),
        F.coalesce("global_known", F.lit(False)).alias("global_known"))
