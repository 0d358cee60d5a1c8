"""Queries on rendered bills: extraction against relational truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import charges as C
from ledgerloom.operators import reconcile as R
from ledgerloom.operators import summary as M
from ledgerloom.plans.render import VARIANTS, bills, read, variants

#: Items and totals straight from the tables.
ITEMS = """
items AS (SELECT l_orderkey AS doc_id, p_name, l_suppkey, l_returnflag, l_extendedprice::DECIMAL(18,2) AS price,
                 l_extendedprice::DECIMAL(18,2) * l_tax::DECIMAL(4,2) AS tax
          FROM lineitem JOIN part ON l_partkey = p_partkey),
truth AS (SELECT o_orderkey AS doc_id, o_orderdate::DATE AS day, c_custkey, c_nationkey, abs(c_acctbal::DECIMAL(18,2)) AS bal,
                 subtotal, tax FROM orders JOIN customer ON o_custkey = c_custkey
          JOIN (SELECT doc_id, sum(price)::DECIMAL(18,2) AS subtotal, round(sum(tax), 2)::DECIMAL(18,2) AS tax FROM items GROUP BY doc_id) t
          ON o_orderkey = t.doc_id)
"""
KEYS = """SELECT DISTINCT doc_id, p_name, price FROM items"""


def bill_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.typed(M.summary_text(bills(spark, sf_dir)))


SUMMARY_SQL = f"""WITH {ITEMS}
SELECT doc_id, 'INV-' || doc_id AS invoice_number,
       substr(lpad(c_custkey::VARCHAR, 9, '0'), 1, 3) || '-' || substr(lpad(c_custkey::VARCHAR, 9, '0'), 4, 3) || '-' || substr(lpad(c_custkey::VARCHAR, 9, '0'), 7, 3) AS carrier_account,
       day AS invoice_date, day AS invoice_st_dtm, (day + 30)::DATE AS invoice_end_dtm, (day + 21)::DATE AS invoice_due_dtm,
       bal AS beg_bal, bal AS payment, NULL::DECIMAL(18,2) AS prev_adj, NULL::DECIMAL(18,2) AS curr_adj,
       subtotal AS curr_chg, tax AS curr_tax, (subtotal + tax)::DECIMAL(18,2) AS end_bal
FROM truth"""


def _charges(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return C.parse(bills(spark, sf_dir, **kw))


def bill_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _charges(spark, sf_dir, repeats=True).select("doc_id", "charge_desc", "amount")


def bill_charges_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _charges(spark, sf_dir, credits=True).select("doc_id", "charge_desc", "amount")


def bill_charges_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _charges(spark, sf_dir, noise=True).select("doc_id", "charge_desc", "amount")


def bill_summary_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way of writing every field: the field's typed value as text."""
    given = variants(spark, sf_dir)
    typed = M.typed(M.summary_text(given, keep=("doc_id", "field")), keep=("doc_id", "field"))
    value = F.element_at(F.create_map(*[x for f in S.SUMMARY_FIELDS for x in (F.lit(f), F.col(f).cast("string"))]), F.col("field"))
    return typed.select("doc_id", "field", value.alias("value"))


def _variants_sql() -> str:
    ways = [(f, S.SUMMARY_FIELDS[f]) for f, texts in VARIANTS.items() for _ in texts]
    rows = ", ".join(f"({i}, '{f}', '{k}')" for i, (f, k) in enumerate(ways))
    return f"""SELECT o_orderkey AS doc_id, field, CASE kind WHEN 'decimal' THEN o_totalprice::DECIMAL(18,2)::VARCHAR WHEN 'date' THEN o_orderdate::DATE::VARCHAR
ELSE CASE WHEN field = 'invoice_number' THEN 'N-' || o_orderkey ELSE '12-' || lpad(o_custkey::VARCHAR, 8, '0') END END AS value
FROM orders JOIN (VALUES {rows}) v(i, field, kind) ON o_orderkey % {len(ways)} = i"""


def charge_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.charge_totals(_charges(spark, sf_dir))


def circuit_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _charges(spark, sf_dir, circuits=True).select("doc_id", "charge_desc", "amount", "line")


def charge_group_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.group_charges(_charges(spark, sf_dir, circuits=True).withColumn("location", F.col("line")), "location").select("doc_id", "group_name", "n", "subtotal")


def charge_group_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.group_charges(_charges(spark, sf_dir), "line")


def charge_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.charge_rollup(_charges(spark, sf_dir, circuits=True).withColumns({"location": F.col("line"), "line": F.lit("all")}))


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = bills(spark, sf_dir)
    return R.reconcile(M.typed(M.summary_text(text)), R.charge_totals(C.parse(text)))


RECONCILE_SQL = f"""WITH {ITEMS},
d AS (SELECT doc_id, (SELECT NULL) AS x, subtotal, tax FROM truth),
kept AS (SELECT doc_id, sum(price)::DECIMAL(18,2) AS total FROM ({KEYS}) GROUP BY doc_id),
v AS (SELECT d.doc_id, total, (subtotal + tax)::DECIMAL(18,2) AS expected, abs(total - (subtotal + tax))::DECIMAL(18,2) AS difference FROM d JOIN kept USING (doc_id))
SELECT doc_id, total, expected, difference,
       CASE WHEN total = 0 AND expected = 0 THEN 'hidden' WHEN difference <= 0.02 THEN 'ok' WHEN expected <= 0 OR difference * 100 > 20 * expected THEN 'danger' ELSE 'warning' END AS level,
       CASE WHEN total < expected THEN 'less' WHEN total > expected THEN 'more' ELSE 'equal' END AS way
FROM v"""


def synthetic_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.synthetic_number(M.summary_text(bills(spark, sf_dir, number=False))).select("doc_id", "invoice_number")


def bill_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.review(M.summary_text(bills(spark, sf_dir))).select("doc_id", "invoice_number", "invoice_date", "curr_chg", "prev_adj", "end_bal")


def gap_fill_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed fields of bills without numbers, gaps filled from a second source."""
    parsed = M.summary_text(bills(spark, sf_dir, number=False))
    second = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.struct(F.lit("invoice_number").alias("field"), F.concat(F.lit("ALT-"), F.col("o_orderkey").cast("string")).alias("value")),
        F.struct(F.lit("carrier_account").alias("field"), F.lit("never").alias("value")), F.struct(F.lit("unknown_field").alias("field"), F.lit("x").alias("value")))).alias("p")
    ).select("doc_id", "p.field", "p.value", F.lit("second").alias("source"), F.lit(2).alias("priority"))
    merged = M.merge_fields(M.long_form(parsed, "parsed", 1), second)
    return merged.where(F.col("field").isin("invoice_number", "carrier_account")).select("doc_id", "field", "value", "source")


_ACCT = "substr(lpad(c_custkey::VARCHAR, 9, '0'), 1, 3) || '-' || substr(lpad(c_custkey::VARCHAR, 9, '0'), 4, 3) || '-' || substr(lpad(c_custkey::VARCHAR, 9, '0'), 7, 3)"

QUERIES = {
    "bill_summary": bill_summary,
    "bill_charges": bill_charges,
    "bill_charges_credits": bill_charges_credits,
    "bill_charges_noise": bill_charges_noise,
    "bill_summary_variants": bill_summary_variants,
    "charge_totals": charge_totals,
    "circuit_association": circuit_association,
    "charge_group_line": charge_group_line,
    "charge_group_location": charge_group_location,
    "charge_rollup": charge_rollup,
    "reconciliation": reconciliation,
    "synthetic_number": synthetic_number,
    "bill_review": bill_review,
    "gap_fill_merge": gap_fill_merge,
}

#: Circuits: charges of equal description and price are one; the nth of a description lies at its nth line.
_AT = f"""WITH {ITEMS},
ln AS (SELECT doc_id, p_name, price, 'CKT.' || l_suppkey AS ckt, 'Circuit ID: CKT.' || l_suppkey || chr(10) || p_name AS printed FROM items JOIN truth USING (doc_id)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, p_name ORDER BY price, printed) AS n FROM ln),
kept AS (SELECT doc_id, p_name, price, row_number() OVER (PARTITION BY doc_id, p_name ORDER BY price) AS n FROM (SELECT DISTINCT doc_id, p_name, price FROM ln)),
located AS (SELECT k.doc_id, k.p_name, k.price, l.ckt FROM kept k JOIN numbered l ON l.doc_id = k.doc_id AND l.p_name = k.p_name AND l.n = k.n)"""
_BILLED = "SELECT i.* FROM items i JOIN truth USING (doc_id)"
ORACLE_SQL = {
    "bill_summary": SUMMARY_SQL,
    "bill_charges": f"WITH {ITEMS} SELECT DISTINCT doc_id, p_name AS charge_desc, price AS amount FROM ({_BILLED})",
    "bill_charges_noise": f"WITH {ITEMS} SELECT DISTINCT doc_id, p_name AS charge_desc, price AS amount FROM ({_BILLED})",
    "bill_summary_variants": _variants_sql(),
    "bill_charges_credits": f"WITH {ITEMS} SELECT DISTINCT doc_id, p_name AS charge_desc, (CASE WHEN l_returnflag = 'R' THEN -price ELSE price END)::DECIMAL(18,2) AS amount FROM ({_BILLED})",
    "charge_totals": f"WITH {ITEMS} SELECT doc_id, count(*) AS n_charges, sum(price)::DECIMAL(18,2) AS total FROM (SELECT DISTINCT doc_id, p_name, price FROM ({_BILLED})) GROUP BY doc_id",
    "circuit_association": f"{_AT} SELECT doc_id, p_name AS charge_desc, price AS amount, ckt AS line FROM located",
    "charge_group_line": f"WITH {ITEMS} SELECT doc_id, '(No Line)' AS group_name, count(*) AS n, sum(price)::DECIMAL(18,2) AS subtotal, 1 AS group_order FROM (SELECT DISTINCT doc_id, p_name, price FROM ({_BILLED})) GROUP BY doc_id",
    "charge_group_location": f"{_AT} SELECT doc_id, ckt AS group_name, count(*) AS n, sum(price)::DECIMAL(18,2) AS subtotal FROM located GROUP BY doc_id, ckt",
    "charge_rollup": f"{_AT} SELECT line, location, count(*) AS n, sum(price)::DECIMAL(18,2) AS subtotal, grouping(line, location)::INTEGER AS level FROM (SELECT 'all' AS line, ckt AS location, price FROM located) GROUP BY ROLLUP (line, location)",
    "reconciliation": RECONCILE_SQL,
    "synthetic_number": f"WITH {ITEMS} SELECT doc_id, lpad(c_custkey::VARCHAR, 9, '0') || 'X' || strftime(day, '%m%d%Y') AS invoice_number FROM truth",
    "bill_review": f"WITH {ITEMS} SELECT doc_id, 'INV-' || doc_id AS invoice_number, strftime(day, '%Y-%m-%d') AS invoice_date, subtotal::VARCHAR AS curr_chg, '0.00' AS prev_adj, (subtotal + tax)::DECIMAL(18,2)::VARCHAR AS end_bal FROM truth",
    "gap_fill_merge": f"""WITH {ITEMS} SELECT doc_id, 'carrier_account' AS field, {_ACCT} AS value, 'parsed' AS source FROM truth
UNION ALL SELECT o_orderkey, 'invoice_number', 'ALT-' || o_orderkey, 'second' FROM orders
UNION ALL SELECT o_orderkey, 'carrier_account', 'never', 'second' FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM truth)""",
}
