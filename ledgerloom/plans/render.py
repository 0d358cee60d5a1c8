"""Bills rendered as text from the order tables, so that extraction can be compared with relational truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import MONEY


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def amount(c: Column) -> Column:
    """1234.5 as 1,234.50; negative amounts in parentheses."""
    text = F.format_number(F.abs(c).cast(MONEY), 2)
    return F.when(c < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


#: Lines with an amount among the charges that are none.
NOISE = (
    "Late Fee 3.00", "Monthly Charges 9.00", "Security Code 1.00", "Balance Due 5.00", "Thank you for your business 6.00", "Late adjustment 2.00", "Total 5.00",
    "Subtotal: $3.00", "Other things 4.00", "12/31/2024 5.00", "(555)123-4567 9.00", "Payment by card 8.00", "Equipment Charges 7.00", "ab 1.00", "no amount here",
    "Taxes, Fees 2.00", "Total Due 4.00", "Message Center 1.00", "Circuit ID: none 5.00",
)


def bills(spark: SparkSession, sf_dir: str, credits: bool = False, circuits: bool = False, repeats: bool = False, number: bool = True, noise: bool = False) -> DataFrame:
    """Rows (doc_id, carrier_id, text): one text bill per order, items in order of description and price.

    credits: returned items are credits, CR or in parentheses. circuits: a circuit line before each supplier's items.
    repeats: the first item is printed twice. number: whether the invoice number is printed. noise: after every item
    stands a line that is no charge.
    """
    orders, customer, part = (read(spark, sf_dir, t) for t in ("orders", "customer", "part"))
    price = F.col("l_extendedprice").cast(MONEY)
    items = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    items = items.select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("p_name"),
        F.when((F.col("l_returnflag") == "R") & F.lit(credits), -price).otherwise(price).alias("price"),
        F.col("l_suppkey"),
        (price * F.col("l_tax").cast("decimal(4,2)")).alias("tax"),
        F.col("l_linestatus"),
    )
    shown = F.when((F.col("price") < 0) & (F.col("l_linestatus") == "O"), F.concat(F.format_number(-F.col("price"), 2), F.lit(" CR"))).otherwise(amount(F.col("price")))
    row = F.concat(F.col("p_name"), F.lit("  $"), shown)
    row = F.when((F.col("price") < 0), F.concat(F.col("p_name"), F.lit("  "), shown)).otherwise(row)
    if circuits:
        row = F.concat(F.lit("Circuit ID: CKT."), F.col("l_suppkey").cast("string"), F.lit("\n"), row)
    if noise:
        other = F.element_at(F.array(*[F.lit(x) for x in NOISE]), F.pmod(F.hash("p_name", "price"), F.lit(len(NOISE))) + F.lit(1))
        row = F.concat(row, F.lit("\n"), other)
    # items are dealt by bill while they are narrow, so that texts need no shuffle; a given number of partitions spreads the
    # bills, as extraction is heavy for its bytes and adaptive execution would put them into one task
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = items.repartition(n, "doc_id").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("p_name", "price", row.alias("row")))).alias("rows"),
        F.sum("price").alias("subtotal"),
        F.round(F.sum("tax"), 2).alias("tax"),
    )
    rows = F.transform("rows", lambda r: r["row"])
    if repeats:
        rows = F.concat(F.slice(rows, 1, 1), rows)
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("doc_id"))
    day = lambda c: F.date_format(c, "MM/dd/yyyy")
    account = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    balance, due = F.abs(F.col("c_acctbal").cast(MONEY)), F.col("subtotal") + F.col("tax")
    parts = [
        F.concat(F.lit("Example Telecom\tservices\r\n")),
        F.concat(F.lit("Invoice Number: INV-"), F.col("o_orderkey").cast("string")) if number else F.lit("Your bill"),
        F.concat(F.lit("Account Number: "), F.substring(account, 1, 3), F.lit("-"), F.substring(account, 4, 3), F.lit("-"), F.substring(account, 7, 3)),
        F.concat(F.lit("Invoice Date:   "), day("o_orderdate")),
        F.concat(F.lit("Due Date: "), day(F.date_add("o_orderdate", 21))),
        F.concat(F.lit("Charges for service from "), day("o_orderdate"), F.lit(" through "), day(F.date_add("o_orderdate", 30))),
        F.concat(F.lit("Previous Balance $"), amount(balance)),
        F.concat(F.lit("Payments Received - $"), amount(balance)),
        F.lit("\n\nRecurring Charges"),
        F.array_join(rows, "\n"),
        F.concat(F.lit("Subtotal "), F.when(F.col("subtotal") < 0, F.lit("-")).otherwise(F.lit("")), F.format_number(F.abs("subtotal"), 2)),
        F.concat(F.lit("Taxes, Fees & Surcharges $"), F.format_number(F.col("tax"), 2)),
        F.concat(F.lit("TOTAL DUE: "), F.when(due < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), F.format_number(F.abs(due), 2)),
    ]
    return joined.select("doc_id", F.col("c_nationkey").alias("carrier_id"), F.concat_ws("\n", *parts).alias("text"))


#: One line for each way in which a field may be written: {n} a number, {a} an account, {d} a date, {l} a date in words,
#: {m} an amount. The order is that of the fields; nothing here is a pattern.
VARIANTS: dict[str, list[str]] = {
    "invoice_number": ["Invoice Number: {n}", "Invoice # {n}", "Invoice No. {n}", "Invoice: {n}", "Bill Number: {n}", "Invoice Number {n}", "invoice number : {n}"],
    "carrier_account": ["Account Number: {a}", "Account #: {a}", "Account No. {a}", "Account Number {a}", "Account: {a}", "Master Account Number {a}", "Account\n{a}"],
    "invoice_date": [
        "Invoice Date: {d}", "Issue Date: {l}", "Bill Date: {d}", "Statement Date: {d}", "Bill Date {l}", "Invoice Date {d}", "INVOICE DATE\n{d}", "Bill At A Glance {d}", "Invoice Date : {d}",
    ],
    "invoice_due_dtm": [
        "Due Date: {d}", "Payment Due: {d}", "Due Date: {l}", "Payment Due Date: {d}", "Pay by: {d}", "Due on {d}", "due by {l}", "Due by {d}", "Total Amount Due by {l}", "Payment Due\n{d}",
        "Payment Due now\n{d}", "DUE DATE\n{d}", "DUE DATE {d}",
    ],
    "invoice_st_dtm": ["for service from {d}", "Billing Period: {d}", "Service From: {d}", "activity from {l}", "Statement Period: {l}", "Bill period\n{l}"],
    "invoice_end_dtm": ["through {d}", "Service To: {d}", "thru {l}", "Bill period\nMay 1, 1990 - {l}", "Billing period: May 1 - {l}"],
    "beg_bal": [
        "Previous Statement Balance ${m}", "Previous Balance {m}", "Prior Balance {m}", "Beginning Balance {m}", "Your last bill ${m}", "Previous bill {m}", "Last Statement Balance {m}",
        "BALANCE FROM LAST BILLING {m}", "PREVIOUS BALANCE DUE {m}", "your last bill of ${m}", "Previous Bill Payment/Adj New\n${m} 1.00", "Balance from last bill {m}",
    ],
    "payment": [
        "Previous Bill Payment/Adj New\n$1.00 ${m}CR", "Payment/Adj Current\n${m}", "PAYMENT(S) RECEIVED\nby mail {m}", "Payment/Adj\n${m}", "Payments -{m}", "Payment Received ${m}",
        "Payment, by card, ${m}", "Payments Received by mail -{m}", "Payments Applied {m}", "paying your last bill of ${m}", "Payment - Thank You -${m}", "Total Payments -${m}",
    ],
    "prev_adj": ["Adjustments {m}", "Adjustment ${m}", "Credits ${m}", "Credit {m}"],
    "curr_adj": ["Current Adjustments {m}", "Current Adjustment ${m}"],
    "curr_chg": [
        "Subtotal {m}", "Sub-total {m}", "Sub total ${m}", "Current Charges Subtotal {m}", "Total Current Charges ${m}", "This month's charges are {m}", "Total Current Charges due by 01/02 {m}",
        "New Charges {m}", "Monthly Charges ${m}", "Total Charges {m}", "CURRENT BILLING AMOUNT {m}", "Current Charges - Due on 01/02 ${m}", "Current Billing Total Due\n$1.00 2.00CR ${m}",
    ],
    "curr_tax": ["Taxes, Fees & Surcharges {m}", "Taxes Fees and Surcharges ${m}", "Total Taxes {m}", "Taxes and Fees {m}", "Government Fees & Taxes {m}", "Taxes & Surcharges ${m}"],
    "end_bal": [
        "TOTAL DUE: ${m}", "AMOUNT DUE {m}", "Current Charges: ${m}", "Remaining Balance {m}", "BALANCE DUE ${m}", "Total Amount Due ${m}", "Please Pay this amount ${m}", "Pay Total {m}",
        "TOTAL DUE\n{m}", "Total Due: by mail ${m}",
    ],
}


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, field, text): for every order a text with one field, written in the next of all ways."""
    ways = [(f, t) for f, texts in VARIANTS.items() for t in texts]
    way = F.element_at(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(t).alias("t")) for f, t in ways]), (F.col("o_orderkey") % len(ways)).cast("int") + 1)
    text = way["t"]
    for mark, value in (
        ("{n}", F.concat(F.lit("N-"), F.col("o_orderkey").cast("string"))),
        ("{a}", F.concat(F.lit("12-"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"))),
        ("{d}", F.date_format("o_orderdate", "MM/dd/yyyy")),
        ("{l}", F.date_format("o_orderdate", "MMMM d, yyyy")),
        ("{m}", F.format_number(F.col("o_totalprice").cast(MONEY), 2)),
    ):
        text = F.replace(text, F.lit(mark), value)
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), way["f"].alias("field"), F.concat(F.lit("Example Telecom\n"), text, F.lit("\nend")).alias("text"))
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
