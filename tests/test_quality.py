"""Data-quality jobs detect violations (the fixtures are clean, so rows are made here)."""

import datetime as dt
from decimal import Decimal

from auric.operators import orders as K
from auric.operators import quality as V
from auric.operators import reports as A
from auric.sources.schemas import TABLES


def test_domain_rules_flag_values_and_let_null_pass(spark):
    users = spark.createDataFrame([(1, "verified", 2), (2, "approved", 5), (3, None, None)],
                                  "user_id long, kyc_status string, kyc_level int")
    r = {(x.rule, x.row_key, x.value) for x in
         V.check_domain(users, "users", ["user_id"], {"kyc_status": V.DOMAIN_RULES["users"]["kyc_status"],
                                                      "kyc_level": (0, 3)}).collect()}
    assert r == {("kyc_status in domain", "2", "approved"), ("kyc_level between 0 and 3", "2", "5")}


def test_not_null_length_unique_foreign_key(spark):
    t = spark.createDataFrame([(1, None, "x" * 21), (2, "ORG", "+91")], "tenant_id long, org string, phone string")
    assert [x.row_key for x in V.check_not_null(t, "tenants", ["tenant_id"], ["org"]).collect()] == ["1"]
    assert [x.row_key for x in V.check_length(t, "tenants", ["tenant_id"], {"phone": 20}).collect()] == ["1"]
    d = spark.createDataFrame([(1, 1), (1, 1), (1, None), (1, None), (2, 1)], "a long, b long")
    assert [(x.a, x.b, x.n) for x in V.check_unique(d, ["a", "b"]).collect()] == [(1, 1, 2)]  # NULLs never collide
    child = spark.createDataFrame([(1,), (9,), (None,)], "order_id long")
    parent = spark.createDataFrame([(1,)], "order_id long")
    assert [x.order_id for x in V.check_foreign_key(child, parent, "order_id", "order_id").collect()] == [9]


def test_total_value_check(spark):
    tx = spark.createDataFrame([(1, 1, Decimal("2.5"), Decimal("10.00"), Decimal("25.00")),
                                (2, 1, Decimal("2.5"), Decimal("10.00"), Decimal("25.01"))],
                               "tenant_id long, user_id long, quantity decimal(20,8), price decimal(15,2), "
                               "total_value decimal(15,2)")
    bad = V.check_total_value(tx).collect()
    assert len(bad) == 1 and bad[0].expected_total_value == Decimal("25.00")


def test_cascade_is_transitive(spark):
    """tenant 2 goes with all it owns; user 11 of tenant 1 goes with their order and its payment."""
    df = spark.createDataFrame
    tables = {"tenants": df([(1,), (2,)], "tenant_id long"),
              "users": df([(1, 10), (1, 11), (2, 20), (None, 30)], "tenant_id long, user_id long"),
              "transactions": df([(10, 100), (11, 101), (20, 102), (30, 103)], "user_id long, order_id long"),
              "payments": df([(100, 1), (101, 2), (102, 3), (None, 4)], "order_id long, pay_id long")}
    links = {"tenants": [], "users": [("tenants", ["tenant_id"], ["tenant_id"])],
             "transactions": [("users", ["user_id"], ["user_id"])],
             "payments": [("transactions", ["order_id"], ["order_id"])]}
    gone = {"tenants": df([(2,)], "tenant_id long"), "users": df([(11,)], "user_id long")}
    out = V.cascade_delete(tables, gone, links)
    assert [r.user_id for r in out["users"].filter("NOT is_gone").orderBy("user_id").collect()] == [10, 30]
    assert [r.order_id for r in out["transactions"].filter("is_gone").orderBy("order_id").collect()] == [101, 102]
    assert [r.pay_id for r in out["payments"].filter("NOT is_gone").orderBy("pay_id").collect()] == [1, 4]
    counts = {r.table_name: (r.kept, r.removed) for r in V.cascade_summary(out).collect()}
    assert counts == {"tenants": (1, 1), "users": (2, 2), "transactions": (2, 2), "payments": (2, 2)}


def test_approximate_distinct_option(spark, fx_small):
    exact = {(r.tenant_id, r.entity_type, r.action, r.day): r.distinct_users
             for r in A.audit_activity(fx_small.audit_logs).collect()}
    approx = {(r.tenant_id, r.entity_type, r.action, r.day): r.distinct_users
              for r in A.audit_activity(fx_small.audit_logs, approximate=True).collect()}
    assert exact.keys() == approx.keys()
    assert all(abs(exact[k] - approx[k]) <= max(1, 0.1 * exact[k]) for k in exact)


def test_missing_docs_per_user_arrays_are_bounded(spark):
    users = spark.createDataFrame([(1, 1), (1, 2)], "tenant_id long, user_id long")
    recs = spark.createDataFrame([(1, 1, "PAN", "verified", dt.datetime(2000, 1, 1), dt.datetime(2003, 1, 1))],
                                 "tenant_id long, user_id long, document_type string, verification_status string, "
                                 "verified_at timestamp_ntz, expires_at timestamp_ntz")
    m = K.missing_docs_per_user(K.mandatory_docs(users, recs, "2001-06-15"))
    got = {r.user_id: r.missing for r in m.collect()}
    assert got == {1: ["AADHAAR"], 2: ["AADHAAR", "PAN"]}


def small_tables(spark):
    df = spark.createDataFrame
    return {
        "tenants": df([(1, "A"), (2, "A"), (3, None), (None, "B")], "id long, organization_id string"),
        "users": df([(10, 1, "a@x"), (11, 1, "a@x"), (12, 9, None), (13, None, "a@x")], "id long, tenant_id long, email string"),
        "transactions": df([(1, 10, "GOLD")] * 50 + [(1, 99, "MUD"), (7, None, "GOLD")], "tenant_id long, user_id long, asset_type string"),
        "asset_types": df([("GOLD",)], "code string"),
    }


def test_all_references_in_one_pass(spark):
    tables = small_tables(spark)
    got = {(r.table_name, r.rule): (r.checked, r.violations) for r in V.reference_counts(tables).collect()}
    assert got == {("users", "tenant_id -> tenants.id"): (3, 1), ("transactions", "tenant_id -> tenants.id"): (52, 1),
                   ("transactions", "user_id -> users.id"): (51, 1), ("transactions", "asset_type -> asset_types.code"): (52, 1)}
    orphans = {(r.table_name, r.rule.split()[0], r.row_key, r.rows) for r in V.orphan_keys(tables).collect()}
    assert orphans == {("users", "tenant_id", "9", 1), ("transactions", "tenant_id", "7", 1),
                       ("transactions", "user_id", "99", 1), ("transactions", "asset_type", "MUD", 1)}


def test_references_scan_each_table_once_and_shuffle_once(spark, fx_small):
    tables = {n: fx_small.raw(f) for n, f in (("users", "customer"), ("tenants", "nation"))}
    tables = {"users": tables["users"].selectExpr("c_custkey AS id", "CAST(c_nationkey AS BIGINT) AS tenant_id"),
              "tenants": tables["tenants"].selectExpr("CAST(n_nationkey AS BIGINT) AS id")}
    plan = V.reference_keys(tables)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_unique_keys_with_nulls_and_repeats(spark):
    got = {(r.table_name, r.rule): (r.checked, r.violations) for r in V.unique_key_counts(small_tables(spark)).collect()}
    # A key with a NULL part never collides; every row beyond the first of its key does.
    assert got == {("tenants", "unique (organization_id)"): (3, 1), ("users", "unique (tenant_id, email)"): (2, 1),
                   ("asset_types", "unique (code)"): (1, 0)}


def test_rules_of_empty_tables_are_listed_with_zeros(spark):
    empty = {n: t.limit(0) for n, t in small_tables(spark).items()}
    for counts in (V.reference_counts(empty), V.unique_key_counts(empty), V.column_rule_counts(empty)):
        rows = counts.collect()
        assert rows and all((r.checked, r.violations) == (0, 0) for r in rows)


def test_fixtures_cover_every_unique_key_and_all_references_they_have(fx_small):
    from auric.plans.queries_constraints import stored_tables
    from auric.plans.registry import load_all
    from auric.sources.schemas import TABLES
    load_all()
    tables = stored_tables(fx_small)
    assert set(tables) == set(TABLES)
    assert all(set(k) <= set(tables[n].columns) for n, t in TABLES.items() for k in t.unique)
    missing = {(n, c) for n, t in TABLES.items() for c in t.references if c not in tables[n].columns}
    assert missing == {("aml_alerts", "tenant_id"), ("aml_alerts", "transaction_id"), ("user_notifications", "tenant_id")}


def test_unique_keys_are_dealt_before_they_are_counted(spark):
    df = spark.range(1000).selectExpr("id % 900 AS a", "CAST(NULL AS STRING) AS b", "id % 7 AS c")
    plan = V.check_unique(df, ["a"])._jdf.queryExecution().executedPlan().toString()
    dealt = plan.index("Exchange hashpartitioning(a")
    assert "HashAggregate" not in plan[dealt:] and f", {V.KEY_TASKS})" in plan[dealt:]
    assert {tuple(r) for r in V.check_unique(df, ["a"]).collect()} == {(k, 2) for k in range(100)}
    assert V.check_unique(df, ["a", "b"]).count() == 0


def test_a_parent_with_many_references_has_narrow_rows(spark):
    children = [n for n, t in TABLES.items() if t.references.get("tenant_id", ("",))[0] == "tenants"]
    assert len(children) > 2 * V.LANE
    tables = {n: spark.createDataFrame([(1,), (1,), (90 + i,), (None,)], "tenant_id long") for i, n in enumerate(children)}
    tables["tenants"] = spark.createDataFrame([(1,), (2,)], "id long")
    keys, _ = V.reference_keys(tables)
    assert keys._jdf.queryExecution().executedPlan().toString().count("partial_count(") == V.LANE
    got = {r.table_name: (r.checked, r.violations) for r in V.reference_counts(tables).collect()}
    assert got == {n: (3, 1) for n in children}
    assert {(r.table_name, r.row_key, r["rows"]) for r in V.orphan_keys(tables).collect()} == {
        (n, str(90 + i), 1) for i, n in enumerate(children)}
