"""Ledgers derived from the driver's tables: whole tables, no row is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersieve import fixed_values as fv
from ledgersieve.config import RoundTier, ScreenConfig
from ledgersieve.functions import scalars as s
from ledgersieve.operators.reconcile import GL

# The event amounts stay below 600 and nearly follow the first-digit law, and no user
# posts at odd hours twice as often as the others: finer thresholds let every screen
# contribute.
EVENT_CONFIG = ScreenConfig(
    benford_tolerance=0.005,
    round_tiers=(
        RoundTier(100, "Extremely round (multiple of 100)", 20),
        RoundTier(50, "Very round (multiple of 50)", 15),
        RoundTier(10, "Highly round (multiple of 10)", 10),
        RoundTier(5, "Moderately round (multiple of 5)", 5),
    ),
    concentration_ratio=1.1,
)
LINE_CONFIG = ScreenConfig(
    round_tiers=(
        RoundTier(50, "Extremely round (multiple of 50)", 20),
        RoundTier(25, "Very round (multiple of 25)", 15),
        RoundTier(20, "Highly round (multiple of 20)", 10),
        RoundTier(10, "Moderately round (multiple of 10)", 5),
    ),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as postings: real hours, skewed amounts, and users who are also counterparties."""
    number = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("EV-"), F.col("event_id").cast("string")).alias("transaction_id"),
        F.col("ts").alias("date"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("account"),
        F.col("props").alias("description"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("user"),
        F.concat(F.lit("USER  "), (number * number * 7).cast("string")).alias("counterparty"),
    )


def order_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a general ledger without counterparties; fifty customers post them."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("transaction_id"),
        F.col("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("account"),
        F.col("o_orderstatus").alias("description"),
        F.format_string("Customer#%09d", F.col("o_orderkey") % 50).alias("user"),
        F.col("o_custkey").alias("customer_key"),
    )


def order_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings with the name of the customer as counterparty."""
    names = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_key"), F.col("c_name").alias("counterparty"))
    return order_postings(spark, sf_dir).join(names, "customer_key", "left").drop("customer_key")


def line_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as payments to suppliers; few distinct amounts, hence many repeats."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", *(F.col(c).cast("string") for c in
                           ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
                    ).alias("transaction_id"),
        F.col("l_shipdate").alias("date"),
        F.col("l_quantity").alias("amount"),
        F.col("l_returnflag").alias("account"),
        F.col("l_linestatus").alias("description"),
        F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("counterparty"),
    )


def repeated_line_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines under ids that repeat, over years, some without account or counterparty."""
    number = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), number.cast("string"))
        .alias("transaction_id"),
        F.col("l_shipdate").alias("date"),
        F.col("l_quantity").alias("amount"),
        F.when(number != 7, F.col("l_returnflag")).alias("account"),
        F.col("l_linestatus").alias("description"),
        F.concat(F.lit("Supplier "), (F.col("l_suppkey") % 40).cast("string")).alias("user"),
        F.when(number != 6, F.concat(F.lit("SUPPLIER  "), (F.col("l_partkey") % 97).cast("string")))
        .alias("counterparty"),
    )


def page_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as entries: posted by a site, the counterparty is the host as written."""
    host = F.regexp_extract("url", "//([^/]+)/", 1)
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("transaction_id"),
        F.length("html").cast("double").alias("amount"),
        F.regexp_extract("url", "//[^/]+/([a-z]+)/", 1).alias("account"),
        F.col("url").alias("description"),
        F.regexp_replace(host, r"^(www|m|blog)\.", "").alias("user"),
        host.alias("counterparty"),
    )


# --- Loans --------------------------------------------------------------------

def _loan(key: str) -> Column:
    return F.concat(F.lit("LN"), F.col(key).cast("string"))


def loan_gl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as disbursements, returned lines as repayments, other lines as fees."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    paid_out = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.concat(F.lit("D"), F.col("o_orderkey").cast("string")).alias("transaction_id"),
        F.col("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("amount"),
        F.lit(fv.DISBURSEMENT_ACCOUNT).alias("account"),
        F.col("o_orderstatus").alias("description"),
        F.col("c_name").alias("counterparty"),
        _loan("o_orderkey").alias("loan_id"),
    )
    paid_back = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.lit("R"), F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("transaction_id"),
        F.col("l_shipdate").alias("date"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
        F.when(F.col("l_returnflag") == "R", fv.REPAYMENT_ACCOUNT).otherwise("Loan Fee")
        .alias("account"),
        F.col("l_linestatus").alias("description"),
        F.lit(None).cast("string").alias("counterparty"),
        _loan("l_orderkey").alias("loan_id"),
    )
    return paid_out.unionByName(paid_back)


def loan_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule that departs from the ledger by order priority, plus customers' own
    accounts, which the ledger does not know."""
    lines = table(spark, sf_dir, "lineitem")
    returned = (
        lines.filter(F.col("l_returnflag") == "R")
        .groupBy("l_orderkey")
        .agg(s.total(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("repaid"))
    )
    priority = F.col("o_orderpriority")
    share = (
        F.when(priority == "2-HIGH", 0.99).when(priority == "3-MEDIUM", 0.9)
        .when(priority == "4-NOT SPECIFIED", 0.5).otherwise(1.0)
    )
    # Urgent orders are in the schedule under an id the ledger does not know
    prefix = F.when(priority == "1-URGENT", "XL").otherwise("LN")
    listed = table(spark, sf_dir, "orders").join(
        returned, F.col("o_orderkey") == F.col("l_orderkey"), "left"
    ).select(
        F.concat(prefix, F.col("o_orderkey").cast("string")).alias("loan_id"),
        F.concat(F.lit("Borrower "), F.col("o_custkey").cast("string")).alias("borrower"),
        priority.alias("product"),
        s.rint_to((F.col("o_totalprice") - F.coalesce("repaid", F.lit(0.0))) * share, 2)
        .alias("schedule_outstanding_balance"),
    )
    own = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("CU"), F.col("c_custkey").cast("string")).alias("loan_id"),
        F.col("c_name").alias("borrower"),
        F.col("c_mktsegment").alias("product"),
        F.col("c_acctbal").alias("schedule_outstanding_balance"),
    )
    return listed.unionByName(own)


# --- Raw text -----------------------------------------------------------------

def messy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a client would send them: odd headers, everything text, some of it broken."""
    priority = F.col("o_orderpriority")
    cents = F.format_string("%.2f", "o_totalprice")
    amount = (
        F.when(priority == "1-URGENT", F.concat(F.lit("TZS "), cents, F.lit("/=")))
        .when((priority == "2-HIGH") & (F.col("o_orderstatus") == "P"), "garbage")
        .when(priority == "3-MEDIUM", F.concat(F.lit("  "), cents))
        .when(priority == "5-LOW", F.concat(
            F.lit("$"), F.substring(cents, 1, 1), F.lit(","), F.substring(cents, 2, 30)))
        .otherwise(cents)
    )
    date = (
        F.when((priority == "3-MEDIUM") & (F.col("o_orderstatus") == "F"), "not-a-date")
        .when(priority == "5-LOW", F.date_format("o_orderdate", "dd/MM/yyyy HH:mm"))
        .when(priority == "4-NOT SPECIFIED", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("T"), F.floor(F.col("o_orderkey") / 2).cast("string")).alias("Txn_ID"),
        date.alias(" Transaction Date"),
        amount.alias("Txn_Amount"),
        priority.alias("GL Account"),
        F.when(F.col("o_orderstatus") == "O", "N/A").otherwise(F.col("o_orderstatus"))
        .alias("Narration"),
        F.col("o_custkey").cast("string").alias("Vendor"),
        F.lit("x").alias("Branch code"),
    )


MESSY_DATE_FORMATS = ("dd/MM/yyyy HH:mm",)
