import random

import pytest
from pyspark.sql import functions as F

from pagelake.operators import ledger as L
from pyref import purchase_fold


def _profiles(spark, rows):
    return spark.createDataFrame(rows, "account_id long, ranks long, balance long, pull_count long")


def test_fold_matches_sequential_loop(spark):
    rnd = random.Random(3)
    reqs, bal = [], {}
    rid = 0
    for acc in range(40):
        bal[acc] = rnd.choice([0, 5, 50, 200, 1000])
        for _ in range(rnd.randint(0, 60)):
            rid += rnd.randint(1, 3)
            reqs.append((acc, rid, rnd.choice([1, 2, 3, 7, 10, 25, 60, 150])))
    # one hot account holding a third of all requests, spread over many id blocks
    for _ in range(len(reqs) // 2):
        rid += rnd.randint(1, 90000)
        reqs.append((99, rid, rnd.choice([1, 2, 5, 9])))
    bal[99] = 500
    r = spark.createDataFrame(reqs, "account_id long, request_id long, cost long")
    b = spark.createDataFrame(list(bal.items()), "account_id long, balance long")
    got = {x.request_id: x.ok for x in L.ordered_fold(r, b).collect()}
    assert len(got) == len(reqs)
    for acc in bal:
        mine = sorted((q for q in reqs if q[0] == acc), key=lambda q: q[1])
        ok, _ = purchase_fold(bal[acc], [q[2] for q in mine])
        assert [got[q[1]] for q in mine] == ok, acc


def test_fold_of_alternating_costs_and_a_dominant_account(spark):
    """Small costs between nearly full ones, one account with 90% of all requests, zero costs, ids shared by accounts."""
    rnd = random.Random(11)
    reqs = [(1, i, 1 if i % 2 else 999) for i in range(1, 1200)]
    reqs += [(2, i, rnd.choice([0, 0, 3, 70])) for i in range(1, 60)] + [(3, i, 2 ** 40) for i in range(1, 5)]
    bal = {1: 1000, 2: 500, 3: 2 ** 41 + 5, 4: 7}
    r = spark.createDataFrame([(*q, f"n{q[0]}-{q[1]}") for q in reqs], "account_id long, request_id long, cost long, note string")
    b = spark.createDataFrame(list(bal.items()), "account_id long, balance long")
    rows = L.ordered_fold(r, b).collect()
    assert len(rows) == len(reqs) and all(x.note == f"n{x.account_id}-{x.request_id}" for x in rows)
    got = {(x.account_id, x.request_id): x.ok for x in rows}
    for acc in bal:
        mine = sorted((q for q in reqs if q[0] == acc), key=lambda q: q[1])
        ok, _ = purchase_fold(bal[acc], [q[2] for q in mine])
        assert [got[q[:2]] for q in mine] == ok, acc


def test_fold_of_cold_and_hot_accounts_is_the_same(spark, monkeypatch):
    """Accounts above the bound go block by block, the others as window groups; both as the loop, and no copy of the input is made."""
    rnd = random.Random(5)
    reqs = [(acc, rnd.randint(0, 10 ** 6) * 10 + acc, rnd.choice([0, 1, 3, 8, 30, 120])) for acc in range(8) for _ in range(5 * 2 ** acc)]
    reqs = list({(a, q): (a, q, c) for a, q, c in reqs}.values())
    bal = {acc: rnd.choice([0, 40, 300, 1500]) for acc in range(8)}
    r = spark.createDataFrame(reqs, "account_id long, request_id long, cost long")
    b = spark.createDataFrame(list(bal.items()), "account_id long, balance long")
    want = {}
    for acc in bal:
        mine = sorted((q for q in reqs if q[0] == acc), key=lambda q: q[1])
        want.update(zip([q[1] for q in mine], purchase_fold(bal[acc], [q[2] for q in mine])[0], strict=True))
    for bound in (1 << 16, 100, 0):
        monkeypatch.setattr(L, "HOT_REQUESTS", bound)
        rows = L.ordered_fold(r, b).collect()
        assert len(rows) == len(reqs) and {x.request_id: x.ok for x in rows} == want, bound


def test_a_round_of_small_accounts_shuffles_once(spark):
    pending = spark.createDataFrame([(1, 1, 5, 9)], "account_id long, request_id long, cost long, __rest long")
    plan = L._halving_round(pending, False)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_scripted_scenario(spark):
    """Items it0..it2 (it2 yanked), one account: +200, draw 40, buy 4 x it0 (5) and 5 x it1 (6), it2 refused."""
    log = spark.createDataFrame([(0, "add", 1, "it0", "live"), (0, "add", 2, "it1", "live"),
                                 (0, "add", 3, "it2", "yanked")],
                                "seq long, op string, item_id long, item_name string, item_stat string")
    catalog, _ = L.apply_catalog(log)
    shop_log = spark.createDataFrame([(0, "list", 1, None, 5), (1, "list", None, "it1", 6), (2, "list", None, "it2", 7)],
                                     "seq long, op string, item_id long, item_name string, item_cost long")
    shop, shop_rejects = L.apply_shop(shop_log, catalog)
    assert sorted((r.item_id, r.item_cost) for r in shop.collect()) == [(1, 5), (2, 6)]
    assert [r.status for r in shop_rejects.collect()] == [L.BAD_STATUS]

    profiles = _profiles(spark, [(7, 0, 0, 0)])
    credits = spark.createDataFrame([(1, 7, 200), (2, 8, 5)], "request_id long, account_id long, amount long")
    profiles, rejects = L.apply_credits(profiles, credits)
    assert [r.status for r in rejects.collect()] == [L.INVALID_NAME]
    draws = spark.createDataFrame([(3, 7, 40)], "request_id long, account_id long, amount long")
    _, profiles = L.run_draws(draws, profiles)
    buys = spark.createDataFrame([(4, 7, 1, 4), (5, 7, 2, 5), (6, 7, 3, 10), (7, 7, 2, -1)],
                                 "request_id long, account_id long, item_id long, item_count long")
    # it2 was never listed (yanked) -> invalid id; negative count refused
    decisions, profiles = L.run_purchases(buys, profiles, catalog, shop)
    st = {r.request_id: r.status for r in decisions.collect()}
    assert st == {4: L.OK, 5: L.OK, 6: L.INVALID_ID, 7: L.INVALID_COUNT}
    p = profiles.first()
    assert p.balance == 110 and p.pull_count == 40


def test_purchase_rules_order(spark):
    catalog = spark.createDataFrame([(1, "a", "live"), (2, "b", "yanked"), (3, "c", "live")],
                                    "item_id long, item_name string, item_stat string")
    shop = spark.createDataFrame([(1, 10), (2, 10)], "item_id long, item_cost long")
    profiles = _profiles(spark, [(1, 0, 30, 0)])
    reqs = spark.createDataFrame([(1, 1, 1, 2), (2, 1, 1, 2), (3, 1, 1, 1), (4, 9, 1, 1), (5, 1, 3, 1),
                                  (6, 1, 2, 1), (7, 1, 1, 1)],
                                 "request_id long, account_id long, item_id long, item_count long")
    decisions, after = L.run_purchases(reqs, profiles, catalog, shop)
    st = {r.request_id: r.status for r in decisions.collect()}
    # cost equal to balance is accepted; a rejected request does not consume balance
    assert st == {1: L.OK, 2: L.INSUFFICIENT, 3: L.OK, 4: L.INVALID_NAME, 5: L.INVALID_ID, 6: L.BAD_STATUS, 7: L.INSUFFICIENT}
    assert after.first().balance == 0


def test_catalog_and_relations(spark):
    log = spark.createDataFrame([(0, "add", 1, "x", "live"), (1, "add", 2, "x", "live"), (2, "rename", 1, "y", None),
                                 (3, "status", 1, None, "yanked"), (4, "status", 5, None, "live")],
                                "seq long, op string, item_id long, item_name string, item_stat string")
    cat, rej = L.apply_catalog(log)
    assert [tuple(r) for r in cat.collect()] == [(1, "y", "yanked")]
    assert sorted(r.status for r in rej.collect()) == [L.INVALID_ID, L.NAME_EXISTS]
    accounts = spark.createDataFrame([(1, "a"), (2, "b")], "account_id long, username string")
    reqs = spark.createDataFrame([(10, "b", "a"), (11, "a", "b"), (12, "a", "zz")],
                                 "request_id long, src_name string, dst_name string")
    rel, rj = L.run_relations(reqs, accounts)
    assert [tuple(r) for r in rel.collect()] == [(1, 2, False, L.PENDING, 10)]
    assert sorted((r.request_id, r.status) for r in rj.collect()) == [(11, L.DUPLICATE), (12, L.INVALID_NAME)]


def test_registration(spark):
    reqs = spark.createDataFrame([(1, "bc0", "石の猫", "ha@gmia.com", None), (2, "ab8", "cat", "ha@gm@a.com", None),
                                  (3, "ab8", "cat", "ha@gmia.com", None), (4, "0oic", "wha", "ha@gmia.com", "+12"),
                                  (5, "0oic", "wha", "ha@gmia.com", None), (6, "taken", "t", "t@ex.com", None)],
                                 "req_id long, username string, display_name string, mail string, phone string")
    local = spark.createDataFrame([("taken",)], "username string")
    glob = spark.createDataFrame([(9, "0oic")], "uni_id long, username string")
    got = {r.req_id: (r.status, r.uni_reused) for r in L.register(reqs, local, glob).collect()}
    assert got == {1: (L.INVALID, False), 2: (L.INVALID, False), 3: (L.OK, False), 4: (L.OK, True),
                   5: (L.DUPLICATE, False), 6: (L.ACCOUNT_EXISTS, False)}


def test_draw_pages_exact_and_distinct(spark):
    pages = spark.createDataFrame([(i,) for i in range(0, 500, 5)], "page_id long")
    ranked = L.rank_pages(pages, "s", 100)
    ranks = sorted(r["rank"] for r in ranked.collect())
    assert ranks == list(range(100))
    dec = spark.createDataFrame([(1, 7, 3, L.OK), (2, 7, 250, L.OK), (3, 8, 4, L.INSUFFICIENT)],
                                "request_id long, account_id long, amount long, status string")
    got = L.draw_pages(dec, ranked, "s", 100).collect()
    per = {}
    for r in got:
        per.setdefault(r.request_id, set()).add(r.page_id)
    assert len(per[1]) == 3 and len(per[2]) == 100 and 3 not in per


def test_draws_that_start_together_part_at_once(spark):
    n = 1000
    ranked = spark.range(n).select(F.col("id").alias("page_id"), F.col("id").alias("rank"))
    dec = spark.createDataFrame([(i, 1, 20, L.OK) for i in range(400)] + [(400, 1, 9000, L.OK)],
                                "request_id long, account_id long, amount long, status string")
    per = {}
    for r in L.draw_pages(dec, ranked, "s", n).collect():
        per.setdefault(r.request_id, []).append(r.page_id)
    assert all(len(set(p)) == len(p) == (20 if i < 400 else n) for i, p in per.items())
    shared = [len(set(per[i]) & set(per[j])) for i in range(0, 60) for j in range(i + 1, 60)]
    assert sum(shared) / len(shared) < 1.5           # 0.4 for independent draws


def test_shuffled_numbers_are_permutations(spark):
    for n in (1, 2, 3, 5, 64, 65, 1000):
        rows = [(r, k, *(random.Random(r * 10 + i).randrange(L.DRAW_PRIME) for i in range(4))) for r in range(30) for k in range(n)]
        df = spark.createDataFrame(rows, "r long, k long, a long, b long, c long, d long")
        got = df.select("r", "k", L.shuffled(F.col("k"), [F.col(x) for x in "abcd"], n).alias("p")).collect()
        per = {}
        for r in got:
            per.setdefault(r.r, {})[r.k] = r.p
        assert all(sorted(p.values()) == list(range(n)) for p in per.values())
        if n == 1000:  # no two are shifts of each other
            steps = {r: [(p[k + 1] - p[k]) % n for k in range(20)] for r, p in per.items()}
            assert len({tuple(x) for x in steps.values()}) == 30 and all(len(set(x)) > 15 for x in steps.values())


def test_a_listing_sees_the_status_of_its_time(spark):
    catalog = spark.createDataFrame([(1, "a", "live"), (2, "b", "yanked")], "item_id long, item_name string, item_stat string")
    changes = spark.createDataFrame([(3, 1, "yanked"), (6, 1, "live"), (4, 2, "live")], "seq long, item_id long, item_stat string")
    log = spark.createDataFrame([(1, "list", 1, None, 5), (2, "unlist", 1, None, None), (4, "list", 1, None, 6), (7, "list", None, "a", 7),
                                 (1, "list", 2, None, 1), (5, "list", None, "b", 2)],
                                "seq long, op string, item_id long, item_name string, item_cost long")
    history = L._at_start(catalog)
    moved = changes.select("seq", "item_id", F.lit("status").alias("op"), F.lit(None).cast("string").alias("item_name"), "item_stat")
    shop, rejects, _ = L.shop_history(log, history._replace(stats=history.stats.unionByName(moved)))
    assert sorted(map(tuple, shop.collect())) == [(1, 7), (2, 2)]
    assert sorted((r.seq, r.status) for r in rejects.collect()) == [(1, L.BAD_STATUS), (4, L.BAD_STATUS)]


def test_names_are_the_same_whatever_their_case_and_accents(spark):
    reqs = spark.createDataFrame([(1, "Ann", "Ann", "ann@example.com", None), (2, "ANN", "x", "x@example.com", None),
                                  (3, "Bob", "b", "b@example.com", None), (4, "bób", "b", "b@example.com", None)],
                                 "req_id long, username string, display_name string, mail string, phone string")
    local, known = spark.createDataFrame([("bOB",)], "username string"), spark.createDataFrame([("ánn",)], "username string")
    made = L.register(reqs, local, known)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "collationkey" in plan
    assert {r.req_id: (r.status, r.uni_reused) for r in made.collect()} == {
        1: (L.OK, True), 2: (L.DUPLICATE, False), 3: (L.ACCOUNT_EXISTS, False), 4: (L.INVALID, False)}
    assert {r.req_id: (r.local_taken, r.global_known) for r in L.name_lookup(reqs, local, known).collect()} == {
        1: (False, True), 2: (False, True), 3: (True, False), 4: (True, False)}


def test_repeated_state_names_do_not_multiply_requests(spark):
    reqs = spark.createDataFrame([(1, "ann", "Ann", "ann@example.com", None)],
                                 "req_id long, username string, display_name string, mail string, phone string")
    names = spark.createDataFrame([("ann",), ("ann",)], "username string")
    assert L.register(reqs, names, names).count() == 1


def test_shop_holds_an_item_once(spark):
    catalog = spark.createDataFrame([(1, "a", "live"), (2, "b", "live")], "item_id long, item_name string, item_stat string")
    log = spark.createDataFrame([(0, "list", 1, None, 5), (1, "list", 1, None, 9), (2, "unlist", None, "a", None),
                                 (3, "list", 1, None, 7), (0, "list", 2, None, 3), (1, "unlist", 2, None, None),
                                 (4, "unlist", None, "nope", None)],
                                "seq long, op string, item_id long, item_name string, item_cost long")
    shop, rejects = L.apply_shop(log, catalog)
    assert [tuple(r) for r in shop.collect()] == [(1, 7)]
    assert sorted((r.seq, r.status) for r in rejects.collect()) == [(1, L.DUPLICATE), (4, L.INVALID_NAME)]


LOG = "seq long, op string, item_id long, item_name string, item_stat string"
ASKED = "seq long, op string, item_id long, item_name string, item_cost long"


def catalog_loop(log):
    """The log as single transactions, in order; returns the state after each seq, and the rejects."""
    name_of, stat_of, states, rejects = {}, {}, {}, []
    for seq, op, item, name, stat in sorted(log, key=lambda x: (x[0], x[2], x[1], x[3] or "")):
        held = {n: i for i, n in name_of.items()}
        if op == "add":
            bad = L.DUPLICATE if item in name_of else L.NAME_EXISTS if name in held else None
            if not bad:
                name_of[item], stat_of[item] = name, stat
        else:
            bad = L.INVALID_ID if item not in name_of else None
            if not bad and op == "rename":
                bad = L.NAME_EXISTS if held.get(name, item) != item else None
                if not bad:
                    name_of[item] = name
            elif not bad:
                stat_of[item] = stat
        if bad:
            rejects.append((seq, op, item, name, bad))
        states[seq] = (dict(name_of), dict(stat_of))
    return states, rejects


def state_at(states, seq):
    past = [s for s in states if s <= seq]
    return states[max(past)] if past else ({}, {})


def random_log(rnd, n, items, names, seqs):
    log = set()
    for _ in range(n):
        op = rnd.choice(["add", "add", "rename", "rename", "rename", "status"])
        log.add((rnd.randrange(seqs), op, rnd.randrange(items), None if op == "status" else f"n{rnd.randrange(names)}",
                 rnd.choice(["live", "yanked"]) if op != "rename" else None))
    # one statement per item, operation and time
    return list({(x[0], x[1], x[2], x[3] if x[1] != "status" else None): x for x in log}.values())


@pytest.mark.parametrize("seed, n, items, names, seqs", [(1, 40, 6, 4, 12), (3, 200, 30, 150, 300_000), (4, 80, 3, 30, 90)])
def test_names_over_time_match_a_loop(spark, seed, n, items, names, seqs):
    log = random_log(random.Random(seed), n, items, names, seqs)
    states, rejects = catalog_loop(log)
    made = L.catalog_history(spark.createDataFrame(log, LOG).repartition(3))
    name_of, stat_of = states[max(states)]
    assert {r.item_id: (r.item_name, r.item_stat) for r in made.items.collect()} == {i: (n, stat_of[i]) for i, n in name_of.items()}
    assert sorted((tuple(r) for r in made.rejects.collect()), key=repr) == sorted(rejects, key=repr)
    # requests by name and by id see the catalog of their time
    rnd = random.Random(seed + 50)
    asked = [(rnd.randrange(seqs), rnd.randrange(items + 2), None) if rnd.random() < 0.4 else (rnd.randrange(seqs), None, f"n{rnd.randrange(names + 2)}")
             for _ in range(120)]
    got = L.resolve_items(spark.createDataFrame(asked, "seq long, item_id long, item_name string"), made).collect()
    want = []
    for seq, item, name in asked:
        then, stats = state_at(states, seq)
        rid = item if name is None else next((i for i, held in then.items() if held == name), None)
        rid = rid if rid in then else None
        want.append((seq, item, name, rid, stats.get(rid)))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_shop_and_purchases_by_name_match_a_loop(spark):
    rnd = random.Random(21)
    log = random_log(rnd, 70, 10, 12, 30)
    states, _ = catalog_loop(log)
    shop_log = list({(rnd.randrange(30), rnd.choice(["list", "list", "unlist"]), *((i, None) if rnd.random() < 0.5 else (None, f"n{i}")))
                     for i in (rnd.randrange(11) for _ in range(90))})
    # one request per item and time: the order of others is not given
    seen, unique = set(), []
    for seq, op, item, name in shop_log:
        then = state_at(states, seq)[0]
        rid = item if name is None else next((i for i, held in then.items() if held == name), ("no", name))
        if (seq, rid) not in seen:
            seen.add((seq, rid))
            unique.append((seq, op, item, name, rnd.randint(1, 20) if op == "list" else None))
    cost_of, offers, rejects = {}, {}, []
    for seq, op, item, name, cost in sorted(unique, key=lambda x: x[0]):
        then, stats = state_at(states, seq)
        rid = item if name is None else next((i for i, held in then.items() if held == name), None)
        if rid not in then:
            rejects.append((seq, op, item, name, L.INVALID_ID if name is None else L.INVALID_NAME))
        elif op == "unlist":
            cost_of.pop(rid, None)
        elif stats[rid] == "yanked":
            rejects.append((seq, op, item, name, L.BAD_STATUS))
        elif rid in cost_of:
            rejects.append((seq, op, item, name, L.DUPLICATE))
        else:
            cost_of[rid] = cost
        offers[seq] = dict(cost_of)
    catalog = L.catalog_history(spark.createDataFrame(log, LOG))
    shop = L.shop_history(spark.createDataFrame(unique, ASKED), catalog)
    assert {r.item_id: r.item_cost for r in shop.items.collect()} == cost_of
    assert sorted((tuple(r) for r in shop.rejects.collect()), key=repr) == sorted(rejects, key=repr)

    profiles = [(a, 0, rnd.randint(0, 300), 0) for a in range(5)]
    asked = [(i, rnd.randrange(6), rnd.randrange(30), *((rnd.randrange(11), None) if rnd.random() < 0.5 else (None, f"n{rnd.randrange(10)}")),
              rnd.randint(0, 6)) for i in range(200)]
    got, after = L.run_purchases(spark.createDataFrame(asked, "request_id long, account_id long, seq long, item_id long, item_name string, item_count long"),
                                 _profiles(spark, profiles), catalog, shop)
    left, want = {a: b for a, _, b, _ in profiles}, {}
    for request, account, seq, item, name, count in asked:
        then, stats = state_at(states, seq)
        rid = item if name is None else next((i for i, held in then.items() if held == name), None)
        past = [s for s in offers if s <= seq]
        cost = offers[max(past)].get(rid) if past and rid in then else None
        if account not in left:
            want[request] = L.INVALID_NAME
        elif cost is None:
            want[request] = L.INVALID_ID if name is None else L.INVALID_NAME
        elif stats[rid] == "yanked":
            want[request] = L.BAD_STATUS
        elif count <= 0:
            want[request] = L.INVALID_COUNT
        elif cost * count > left[account]:
            want[request] = L.INSUFFICIENT
        else:
            left[account] -= cost * count
            want[request] = L.OK
    assert {r.request_id: r.status for r in got.collect()} == want
    assert {r.account_id: r.balance for r in after.collect()} == left


def test_a_round_of_claims_writes_nothing_between_and_looks_up_contested_names_alone(spark, monkeypatch):
    claims = spark.createDataFrame([(0, 1, "add", "a", "live", True, True, True), (1, 2, "add", "a", "live", True, True, True),
                                    (2, 1, "rename", "b", None, False, True, True), (3, 2, "add", "a", "live", True, True, True)],
                                   "seq long, item_id long, op string, item_name string, item_stat string, contested boolean, ok boolean, known boolean")
    asked = []
    passes = L.as_of
    monkeypatch.setattr(L, "as_of", lambda r, *a, **k: (asked.append(r.count()), passes(r, *a, **k))[1])
    again = L._decided_again(claims, single=True)
    assert asked[0] == 3
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "parquet" not in plan.lower()
    assert {(r.seq, r.ok, r.known) for r in again.collect()} == {(0, True, False), (1, False, False), (2, True, True), (3, False, True)}


def test_a_listing_and_its_end_at_one_time_need_no_aggregation(spark):
    catalog = L._at_start(spark.createDataFrame([(1, "a", "live"), (2, "b", "live")], "item_id long, item_name string, item_stat string"))
    log = spark.createDataFrame([(1, "list", 1, None, 5), (1, "unlist", 1, None, None), (1, "list", 2, None, 3), (4, "unlist", None, "b", None), (4, "list", 1, None, 7)], ASKED)
    shop = L.shop_history(log, catalog)
    assert "Aggregate" not in shop.offers._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, shop.items.collect())) == [(1, 7)]
    assert "SortAggregate" not in shop.items._jdf.queryExecution().executedPlan().toString()
    asked = spark.createDataFrame([(1, 9, 1, 1, None, 1), (2, 9, 1, 2, None, 1), (3, 9, 4, 2, None, 1), (4, 9, 5, 1, None, 1)],
                                  "request_id long, account_id long, seq long, item_id long, item_name string, item_count long")
    got, after = L.run_purchases(asked, _profiles(spark, [(9, 0, 100, 0)]), catalog, shop)
    assert {r.request_id: r.status for r in got.collect()} == {1: L.INVALID_ID, 2: L.OK, 3: L.INVALID_ID, 4: L.OK}
    assert [r.balance for r in after.collect()] == [90]


@pytest.mark.parametrize("collide", [False, True])
def test_repeated_claims_and_names_of_one_number_match_a_loop(spark, monkeypatch, collide):
    """Claims are not made distinct first, and items with an add alone are not aggregated again."""
    log = random_log(random.Random(9), 60, 12, 9, 25) + [(3, "add", 100 + i, f"alone{i}", "live") for i in range(5)] + [(7, "status", 101, None, "yanked")]
    states, rejects = catalog_loop(log)
    rows = spark.createDataFrame(log + log[::2] + log[:20], LOG).repartition(3)
    assert "Aggregate" not in L._claims(rows)._jdf.queryExecution().executedPlan().toString()
    if collide:   # every name is taken for a contested one
        monkeypatch.setattr(L.F, "xxhash64", lambda *c: L.F.lit(0).cast("bigint"))
    lone = {r.item_id for r in L._settled_claims(L._claims(rows)).where("lone").collect()}
    assert lone <= set(range(100, 105)) and (lone == set()) == collide
    made = L.catalog_history(rows)
    name_of, stat_of = states[max(states)]
    assert sorted(map(tuple, made.items.collect())) == sorted((i, n, stat_of[i]) for i, n in name_of.items())
    once = {tuple(r) for r in made.rejects.collect()}
    # a repeat is refused for the same reason; no claim that succeeded is refused
    assert once == set(rejects)
    # items are added at 3; listed before, listed twice, and ended at the time of a listing
    listed = spark.createDataFrame([(1, "list", 103, None, 4), (4, "list", 103, None, 6), (5, "list", 103, None, 8), (4, "list", 104, None, 5),
                                    (6, "list", 100, None, 2), (6, "unlist", 100, None, None)], ASKED)
    shop = L.shop_history(listed, made)
    assert sorted(map(tuple, shop.items.collect())) == [(103, 6), (104, 5)]
    assert "decimal" not in shop.items._jdf.queryExecution().executedPlan().toString()


def test_few_contested_and_asked_names_do_not_shuffle_all_claims(spark, monkeypatch):
    """The tables of these names are small, however large the log is that they come from."""
    many = 20000
    log = [(0, "add", i, f"name {i * 7919 % many}", "live") for i in range(many)]
    log += [(1, "add", many, "name 0", "live"), (2, "rename", 0, "free", None), (3, "rename", 1, "name 0", None)]
    rows = spark.createDataFrame(log, LOG).repartition(3)
    plans, cut, passes = {}, L.cut_lineage, L.as_of

    def seen(name, frame):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()

    monkeypatch.setattr(L, "cut_lineage", lambda d: (seen("claims", d) if "lone" in d.columns else None, cut(d))[1])
    monkeypatch.setattr(L, "as_of", lambda r, key, at, events, *a, **k: (
        seen("names", events["named_id"]) if "named_id" in events else None, passes(r, key, at, events, *a, **k))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000b")
    try:
        made = L.catalog_history(rows)
        asked = spark.createDataFrame([(0, None, "name 0"), (3, None, "name 0"), (3, None, "free"), (2, None, "nobody"), (0, 5, None)],
                                      "seq long, item_id long, item_name string")
        got = {(r.seq, r.item_id, r.item_name): r.rid for r in L.resolve_items(asked, made).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [__name" in plans["claims"] and "SortMergeJoin [__name" not in plans["claims"]
    assert "BroadcastHashJoin [__name" in plans["names"] and "SortMergeJoin" not in plans["names"]
    assert got == {(0, None, "name 0"): 0, (3, None, "name 0"): 1, (3, None, "free"): 0, (2, None, "nobody"): None, (0, 5, None): 5}
    assert {tuple(r) for r in made.rejects.collect()} == {(1, "add", many, "name 0", L.NAME_EXISTS)}
    assert made.items.count() == many
