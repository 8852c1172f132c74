import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
JOIN_HEAVY = ["join_parent_category", "pages_under_category", "validate_index",
              "stream_pack_bytes", "ledger_purchase", "ledger_draw_pages", "ledger_relation", "register_batch",
              "user_info", "src_site_info", "category_counts"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop_joins(spark):
    q = E.queries()
    for name in JOIN_HEAVY:
        plan = _plan(q[name](spark, SF))
        assert "CartesianProduct" not in plan, name
        assert "NestedLoopJoin" not in plan, name


def test_flagship_scan_is_pruned_and_single_aggregation(spark):
    plan = _plan(E.queries()["category_counts"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan
    assert plan.count("hashpartitioning(") == 1          # one aggregation shuffle
