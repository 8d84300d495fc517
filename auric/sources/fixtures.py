"""Fixture adapter: the platform's logical tables derived from the TPC-H-like
parquet fixtures (see FIXTURES.md §2).

Each logical table is defined exactly once here. Everything is lazy: the
adapter only composes scans, joins and projections, so Catalyst prunes
columns and pushes filters down to the parquet readers of whatever a query
actually uses.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import dims

QTY = "decimal(20,8)"
MONEY = "decimal(15,2)"

# Total order of ledger rows; (order_id, line_no) alone is not unique.
TX_ORDER = ["created_at", "order_id", "line_no", "partkey", "suppkey", "ext", "quantity",
            "transaction_type"]
TX_KEY = ["tenant_id", "user_id", "asset_type"]


def _case(col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == F.lit(k), F.lit(v)) if expr is None
                else expr.when(col == F.lit(k), F.lit(v)))
    return expr.otherwise(F.lit(default))


def asset_of(col: Column) -> Column:
    """p_type family → metal."""
    return (F.when(col.isin("MEDIUM", "STANDARD"), "GOLD")
            .when(col.isin("ECONOMY", "SMALL"), "SILVER")
            .when(col.isin("PROMO", "LARGE"), "PLATINUM"))


def asset_by_mod3(col: Column) -> Column:
    m = F.pmod(col, F.lit(3))
    return F.when(m == 0, "GOLD").when(m == 1, "SILVER").otherwise("PLATINUM")


PRIORITY_METHOD = {"1-URGENT": "UPI", "2-HIGH": "CARD", "3-MEDIUM": "NET_BANKING",
                   "4-NOT SPECIFIED": "WALLET"}
ORDER_STATUS = {"F": "completed", "O": "pending", "P": "processing"}
TIERS = {0: "lite", 1: "pro", 2: "startup", 3: "growth", 4: "enterprise"}


# Broken rows: table -> (key, {column: (every n-th key, the broken value)}). The
# values read the same in Spark SQL and in the oracle's SQL.
FAULTS = {
    "tenants": ("tenant_id", {"tier": (11, "'basic'"), "status": (13, "'closed'"), "company_name": (7, "NULL"),
                              "organization_id": (9, "concat(organization_id, repeat('x', 60))")}),
    "users": ("user_id", {"kyc_level": (41, "7"), "role": (43, "'owner'"), "kyc_status": (47, "'unknown'"),
                          "email": (37, "NULL"), "first_name": (31, "concat(first_name, repeat('x', 100))")}),
    "tx": ("order_id", {"status": (53, "'lost'"), "quantity": (73, "NULL"), "total_value": (79, "total_value + 1"),
                        "user_id": (83, "-user_id"), "asset_type": (97, "'DIAMOND'")}),
    "kyc_records": ("record_id", {"verification_status": (59, "'approved'"), "document_type": (101, "'VOTER_ID'")}),
    "vault_inventory": ("lot_order_id", {"status": (61, "'melted'"), "purity": (29, "NULL"),
                                         "provider_code": (67, "'NOWHERE'")}),
    "aml_alerts": ("id", {"status": (67, "'closed'"), "user_id": (89, "-user_id")}),
    "payments": ("order_id", {"status": (71, "'bounced'"), "amount": (97, "NULL"), "payment_method": (103, "'BARTER'")}),
    "audit_logs": ("id", {"user_id": (107, "-user_id"), "action": (109, "repeat('a', 60)")}),
    "notifications": ("id", {"user_id": (113, "-user_id"), "category": (127, "repeat('c', 60)")}),
    "transaction_history": ("id", {"new_status": (131, "repeat('s', 30)")}),
    "api_credentials": ("id", {"api_key": (17, "repeat('k', 300)"), "status": (19, "'lost'"), "tenant_id": (23, "-1 - tenant_id")}),
    "notification_templates": ("tenant_id", {"template_type": (5, "'fax'"), "template_code": (12, "NULL")}),
}

# Stored table -> (logical table, {logical column: stored column}). Seed rows have their code as id.
STORED = {
    "tenants": ("tenants", {"tenant_id": "id"}), "api_credentials": ("api_credentials", {}),
    "users": ("users", {"user_id": "id"}), "transactions": ("tx", {"order_id": "id"}),
    "transaction_history": ("transaction_history", {}),
    "payment_transactions": ("payments", {"order_id": "transaction_id", "payment_method": "payment_method_id"}),
    "kyc_records": ("kyc_records", {"record_id": "id"}), "aml_alerts": ("aml_alerts", {}),
    "vault_inventory": ("vault_inventory", {"provider_code": "provider_id"}), "audit_logs": ("audit_logs", {}),
    "user_notifications": ("notifications", {}), "notification_templates": ("notification_templates", {}),
}
# Rows that are stored twice, for the unique keys (the condition reads the same in both SQLs).
REPEATED = {
    "tenants": "id % 8 = 0", "api_credentials": "id % 7 = 0", "users": "id % 53 = 0", "asset_types": "code = 'SILVER'",
    "transaction_types": "code <> 'BUY'", "kyc_document_types": "code = 'PAN'", "vault_providers": "code = 'SAFEGOLD'",
    "daily_metrics": "tenant_id % 6 = 1",
}


class Fixtures:
    """Lazy logical tables over one fixture directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ------------------------------------------------------------------ tenants
    @cached_property
    def tenants(self) -> DataFrame:
        n = self.raw("nation")
        k = F.col("n_nationkey")
        ks = k.cast("string")
        color = lambda mult: F.concat(F.lit("#00"), F.lpad((k * mult).cast("string"), 4, "0"))
        tokens = (F.when(F.pmod(k, F.lit(3)) == 0, F.lit('["GOLD","SILVER","PLATINUM"]'))
                  .when(F.pmod(k, F.lit(3)) == 1, F.lit('["GOLD","SILVER"]'))
                  .otherwise(F.lit('["GOLD"]')))
        methods = (F.when(F.pmod(k, F.lit(2)) == 0, F.lit('["UPI","CARD","NET_BANKING"]'))
                   .otherwise(F.lit('["UPI","WALLET"]')))
        full = F.concat(
            F.lit('{"primaryColor":"'), color(7), F.lit('","secondaryColor":"'), color(13),
            F.lit('","accentColor":"#BF953F","companyName":"'), F.col("n_name"),
            F.lit(' Gold","logoUrl":"/assets/'), ks, F.lit('-logo.png","features":{"tokens":'),
            tokens, F.lit(',"paymentMethods":'), methods,
            F.lit(',"kycLevels":[1,2,3],"maxDailyLimit":50000,"supportedLanguages":["en","hi"]}}'))
        short = F.concat(
            F.lit('{"primaryColor":"'), color(7), F.lit('","secondaryColor":"'), color(13),
            F.lit('","logo":"'), ks, F.lit('-logo.png","domain":"t'), ks,
            F.lit('.tokens.example"}'))
        brand = (F.when(F.pmod(k, F.lit(4)) == 0, F.lit(None).cast("string"))
                 .when(F.pmod(k, F.lit(4)) == 2, short).otherwise(full))
        b = lambda c: F.when(c, F.lit("true")).otherwise(F.lit("false"))
        features_enabled = F.concat(
            F.lit('{"api_access":'), b(F.col("n_regionkey") != 0),
            F.lit(',"advanced_analytics":'), b(F.col("n_regionkey") >= 2),
            F.lit(',"custom_branding":'), b(F.pmod(k, F.lit(2)) == 0), F.lit("}"))
        return n.select(
            k.cast("bigint").alias("tenant_id"),
            F.concat(F.lit("ORG_"), ks).alias("organization_id"),
            F.col("n_name").alias("company_name"),
            F.concat(F.lit("Contact "), F.col("n_name")).alias("contact_person"),
            F.concat(F.lower(F.col("n_name")), F.lit("@tenant.example")).alias("email"),
            F.when(F.pmod(k, F.lit(5)) == 4, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("+91-90000000"), F.lpad(ks, 2, "0"))).alias("phone"),
            _case(F.col("n_regionkey"), TIERS).alias("tier"),
            F.when(F.pmod(k, F.lit(7)) == 3, F.lit("suspended")).otherwise(F.lit("active")).alias("status"),
            brand.alias("brand_config"),
            features_enabled.alias("features_enabled"),
            (F.lit("2000-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=k)).alias("created_at"),
        )

    # -------------------------------------------------------------------- users
    @cached_property
    def users(self) -> DataFrame:
        c = self.raw("customer")
        verified = F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD", "MACHINERY")
        return c.select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_nationkey").cast("bigint").alias("tenant_id"),
            F.concat(F.lower(F.col("c_name")), F.lit("@x.in")).alias("email"),
            F.split_part(F.col("c_name"), F.lit("#"), F.lit(1)).alias("first_name"),
            F.when(F.col("c_mktsegment") == "FURNITURE", F.lit(None).cast("string"))
             .otherwise(F.split_part(F.col("c_name"), F.lit("#"), F.lit(2))).alias("last_name"),
            F.when(verified, "verified").when(F.col("c_mktsegment") == "FURNITURE", "pending")
             .when(F.col("c_mktsegment") == "AUTOMOBILE", "rejected").alias("kyc_status"),
            F.when(verified, 1 + F.pmod(F.col("c_custkey"), F.lit(3))).otherwise(0).cast("int").alias("kyc_level"),
            F.lit("user").alias("role"),
            (F.lit("2001-10-01").cast("timestamp_ntz")
             + F.make_dt_interval(days=F.pmod(F.col("c_custkey"), F.lit(30)).cast("int"))).alias("created_at"),
        )

    @cached_property
    def api_credentials(self) -> DataFrame:
        s, k = self.raw("supplier"), F.col("s_suppkey")
        return s.select(
            k.cast("bigint").alias("id"), F.col("s_nationkey").cast("bigint").alias("tenant_id"),
            F.concat(F.lit("ak_"), F.lpad(k.cast("string"), 8, "0")).alias("api_key"),
            F.concat(F.lit("as_"), F.sha2(k.cast("string"), 256)).alias("api_secret"),
            F.when(F.pmod(k, F.lit(3)) == 0, "active").when(F.pmod(k, F.lit(3)) == 1, "suspended")
             .otherwise("expired").alias("status"))

    def users_with_login(self) -> DataFrame:
        """users + last_login_at = latest ledger row of the user."""
        last = self.tx.groupBy("user_id").agg(F.max("created_at").alias("last_login_at"))
        return self.users.join(last, "user_id", "left")

    # ----------------------------------------------------------------------- tx
    @cached_property
    def tx(self) -> DataFrame:
        li = self.raw("lineitem")
        o = self.raw("orders")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        p = self.raw("part").select("p_partkey", "p_type", "p_retailprice")
        # Orders meet their customers first: the many lines are shuffled for orders and parts only.
        j = (li.join(o.join(c, o.o_custkey == c.c_custkey), li.l_orderkey == o.o_orderkey)
               .join(p, li.l_partkey == p.p_partkey))
        rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
        quantity = F.col("l_quantity").cast(QTY)
        price = F.col("p_retailprice").cast(MONEY)
        return j.select(
            F.col("c_nationkey").cast("bigint").alias("tenant_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.when(rf.isin("N", "A"), "BUY").when((rf == "R") & (ls == "F"), "SELL")
             .when((rf == "R") & (ls == "O"), "REDEEM").alias("transaction_type"),
            asset_of(F.col("p_type")).alias("asset_type"),
            quantity.alias("quantity"),
            price.alias("price"),
            (quantity * price).cast(MONEY).alias("total_value"),
            _case(F.col("o_orderpriority"), PRIORITY_METHOD).alias("payment_method"),
            _case(F.col("o_orderstatus"), ORDER_STATUS).alias("status"),
            F.col("l_shipdate").alias("created_at"),
            F.col("l_partkey").alias("partkey"),
            F.col("l_suppkey").alias("suppkey"),
            F.col("l_extendedprice").alias("ext"),
            ls.alias("linestatus"),
        )

    # ----------------------------------------------------------------- payments
    @cached_property
    def payments(self) -> DataFrame:
        o = self.raw("orders").filter(F.pmod(F.col("o_orderkey"), F.lit(10)) != 0)
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        totals = self.tx.groupBy("order_id").agg(F.sum("total_value").alias("ledger_total"))
        # Every thirteenth order has a failed attempt besides its payment.
        attempts = F.when(F.pmod(F.col("o_orderkey"), F.lit(13)) == 0, F.array(F.lit(False), F.lit(True))).otherwise(
            F.array(F.lit(False)))
        j = (o.join(c, o.o_custkey == c.c_custkey)
              .join(totals, o.o_orderkey == totals.order_id, "left")
              .withColumn("retried", F.explode(attempts)))
        base = F.coalesce(F.col("ledger_total"), F.lit(100).cast(MONEY))
        bump = F.when(F.pmod(F.col("o_orderkey"), F.lit(17)) == 0, F.lit(1).cast(MONEY)).otherwise(F.lit(0).cast(MONEY))
        return j.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("c_nationkey").cast("bigint").alias("tenant_id"),
            F.col("o_custkey").alias("user_id"),
            _case(F.col("o_orderpriority"), PRIORITY_METHOD).alias("payment_method"),
            (base + bump).cast(MONEY).alias("amount"),
            F.when(F.col("retried"), "failed")
             .when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed")
             .when(F.col("o_orderstatus") == "P", "pending").alias("status"),
            F.when(~F.col("retried") & (F.pmod(F.col("o_orderkey"), F.lit(23)) == 0), F.lit(5).cast(MONEY))
             .otherwise(F.lit(0).cast(MONEY)).alias("refund_amount"),
            F.col("o_orderdate").alias("created_at"),
        )

    # -------------------------------------------------------------- kyc records
    @cached_property
    def kyc_records(self) -> DataFrame:
        o = self.raw("orders")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        m = F.pmod(F.col("o_orderkey"), F.lit(4))
        return o.join(c, o.o_custkey == c.c_custkey).select(
            F.col("o_orderkey").alias("record_id"),
            F.col("c_nationkey").cast("bigint").alias("tenant_id"),
            F.col("o_custkey").alias("user_id"),
            F.when(m == 0, "AADHAAR").when(m == 1, "PAN").when(m == 2, "PASSPORT")
             .otherwise("DRIVING_LICENSE").alias("document_type"),
            F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "rejected")
             .otherwise("pending").alias("verification_status"),
            F.col("o_orderdate").alias("verified_at"),
            (F.col("o_orderdate") + F.make_ym_interval(years=F.lit(3))).alias("expires_at"),
        )

    # ---------------------------------------------------------- vault inventory
    @cached_property
    def vault_inventory(self) -> DataFrame:
        t = self.tx.filter(F.col("linestatus") == "O")
        m = F.pmod(F.col("suppkey"), F.lit(3))
        purity = (F.when(F.col("asset_type") == "GOLD", F.lit("0.9999"))
                  .when(F.col("asset_type") == "SILVER", F.lit("0.9990"))
                  .otherwise(F.lit("0.9995"))).cast("decimal(5,4)")
        return t.select(
            F.col("order_id").alias("lot_order_id"), F.col("line_no").alias("lot_line_no"),
            F.col("partkey").alias("lot_partkey"), F.col("suppkey").alias("lot_suppkey"),
            "tenant_id",
            F.when(m == 0, "MMTC_PAMP").when(m == 1, "SAFEGOLD").otherwise("AUGMONT").alias("provider_code"),
            "asset_type",
            F.col("quantity").cast("decimal(10,4)").alias("weight_grams"),
            purity.alias("purity"),
            (F.col("quantity") * F.lit("0.6").cast("decimal(2,1)")).cast(QTY).alias("tokenized_amount"),
            (F.col("quantity") * F.lit("0.4").cast("decimal(2,1)")).cast(QTY).alias("available_amount"),
            F.col("total_value").alias("insurance_value"),
            F.lit("stored").alias("status"),
        )

    # ------------------------------------------------------ event-based tables
    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events")

    def _events_k(self) -> Column:
        return F.get_json_object(F.col("props"), "$.k").cast("int")

    @cached_property
    def transaction_history(self) -> DataFrame:
        status = _case(F.col("event_type"), {"view": "pending", "click": "processing",
                                             "purchase": "completed", "error": "failed",
                                             "signup": "cancelled"})
        return self.events.select(F.col("event_id").alias("id"),
                                  F.col("user_id").alias("transaction_id"),
                                  status.alias("new_status"), F.col("ts").alias("changed_at"))

    @cached_property
    def audit_logs(self) -> DataFrame:
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        e = self.events.join(c, self.events.user_id == c.c_custkey)
        entity = (F.when(F.col("event_type") == "signup", "USER")
                  .when(F.col("event_type") == "purchase", "TRANSACTION").otherwise("SESSION"))
        return e.select(
            F.col("event_id").alias("id"),
            F.col("c_nationkey").cast("bigint").alias("tenant_id"),
            "user_id",
            entity.alias("entity_type"),
            F.col("event_type").alias("action"),
            F.lag("props").over(w).alias("old_values"),
            F.col("props").alias("new_values"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def notifications(self) -> DataFrame:
        return self.events.select(F.col("event_id").alias("id"), "user_id",
                                  F.col("event_type").alias("category"),
                                  (F.pmod(self._events_k(), F.lit(2)) == 0).alias("is_read"),
                                  F.col("ts").alias("created_at"))

    @cached_property
    def aml_alerts(self) -> DataFrame:
        k = self._events_k()
        atype = _case(F.col("event_type"), {"error": "SUSPICIOUS_PATTERN", "purchase": "HIGH_AMOUNT",
                                            "signup": "PEP_MATCH", "view": "KYC_LIMIT",
                                            "click": "DAILY_LIMIT"})
        resolved = F.pmod(k, F.lit(2)) == 0
        return self.events.select(
            F.col("event_id").alias("id"), "user_id", atype.alias("alert_type"),
            F.when(resolved, "resolved").when(F.pmod(k, F.lit(3)) == 0, "investigating")
             .otherwise("open").alias("status"),
            F.col("ts").alias("created_at"),
            F.when(resolved, F.col("ts") + F.make_dt_interval(hours=k)).alias("resolved_at"),
        )

    @cached_property
    def web_events(self) -> DataFrame:
        # Every third click is one on a call to action of the pricing page.
        step = F.when((F.col("event_type") == "click") & (F.pmod(self._events_k(), F.lit(3)) == 0), "cta").otherwise(
            _case(F.col("event_type"), {"view": "landing", "click": "pricing", "signup": "form", "purchase": "paid"}))
        return (self.events.filter(F.col("event_type") != "error")
                .select("event_id", "user_id", step.alias("step"), "ts"))

    @cached_property
    def requests(self) -> DataFrame:
        return self.events.select(F.col("user_id").alias("client"), "ts", "event_id")

    @cached_property
    def ticks(self) -> DataFrame:
        return (self.events.filter(F.col("event_type") == "view")
                .select(asset_by_mod3(F.col("user_id")).alias("asset_type"), "ts",
                        F.col("value").cast(MONEY).alias("price"), "event_id"))

    @cached_property
    def trades(self) -> DataFrame:
        return (self.events.filter(F.col("event_type") == "purchase")
                .select(asset_by_mod3(F.col("user_id")).alias("asset_type"), "ts", "event_id",
                        "user_id"))

    @cached_property
    def watchlist(self) -> DataFrame:
        return self.raw("customer").filter(F.col("c_acctbal") < -900).select(F.col("c_name").alias("name"))

    @cached_property
    def price_thresholds(self) -> DataFrame:
        """Per-user price alerts: every user watches one metal."""
        c = self.raw("customer")
        return c.select(F.col("c_custkey").alias("user_id"),
                        asset_by_mod3(F.col("c_custkey")).alias("asset_type"),
                        (F.lit(100) + F.pmod(F.col("c_custkey"), F.lit(10)) * 30).cast(MONEY).alias("threshold"))

    @cached_property
    def notification_templates(self) -> DataFrame:
        code, name, subject, content, kind = dims.WELCOME_TEMPLATE
        return self.tenants.select(
            "tenant_id",
            F.lit(code).alias("template_code"),
            F.lit(name).alias("template_name"),
            F.lit(subject).alias("subject"),
            F.lit(content).alias("content"),
            F.lit(kind).alias("template_type"),
            (F.pmod(F.col("tenant_id"), F.lit(6)) != 0).alias("is_active"),
        )

    @cached_property
    def registrations(self) -> DataFrame:
        """Incoming sign-ups: most repeat an existing customer's email."""
        o = self.raw("orders")
        c = self.raw("customer").select("c_custkey", "c_nationkey", "c_name")
        new = F.pmod(F.col("o_orderkey"), F.lit(5)) == 0
        return o.join(c, o.o_custkey == c.c_custkey).select(
            F.col("o_orderkey").alias("registration_id"),
            F.col("c_nationkey").cast("bigint").alias("tenant_id"),
            F.when(new, F.concat(F.lit("new_"), F.col("o_orderkey").cast("string"), F.lit("@x.in")))
             .otherwise(F.concat(F.lower(F.col("c_name")), F.lit("@x.in"))).alias("email"),
            F.split_part(F.col("c_name"), F.lit("#"), F.lit(1)).alias("first_name"),
            F.col("o_orderdate").alias("created_at"),
        )

    # ------------------------------------------------------- rows that break rules
    def faulty(self, name: str) -> DataFrame:
        """A logical table in which every so-many-th row breaks a rule of the
        quality checks, by a rule on its key (FAULTS)."""
        df = getattr(self, name)
        key, faults = FAULTS[name]
        return df.withColumns({c: F.when(F.pmod(F.col(key), F.lit(n)) == 0, F.expr(bad)).otherwise(F.col(c))
                               .cast(df.schema[c].dataType) for c, (n, bad) in faults.items()})

    def stored(self, name: str) -> DataFrame:
        """A stored table under its own column names, with the broken rows in it."""
        if name in STORED:
            logical, columns = STORED[name]
            return self.faulty(logical).withColumnsRenamed(columns)
        if name == "payment_methods":
            return dims.payment_methods(self.tenants).withColumn("id", F.col("code"))
        return self.dims()[name].withColumn("id", F.col("code"))

    # --------------------------------------------------------------- dimensions
    def dims(self) -> dict[str, DataFrame]:
        return dims.seed_dims(self.spark)
