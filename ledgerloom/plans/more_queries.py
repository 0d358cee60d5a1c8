"""Queries on whole bills, listings, learning from feedback, layout, training sets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import bills as B
from ledgerloom.operators import layout, lookups, reconcile, rules, training
from ledgerloom.operators import feedback as FB
from ledgerloom.operators import summary as M
from ledgerloom.operators.text import normalised, pages_text
from ledgerloom.plans.bill_queries import ITEMS
from ledgerloom.plans.render import bills, read
from ledgerloom.plans.rule_queries import _W, _W_CHARGES, wireless_bills
from ledgerloom.sources import tables


def _rules(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, rules.SCHEMA)


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills of both layouts; those by line have negative ids."""
    wireless = wireless_bills(spark, sf_dir).withColumn("doc_id", -F.col("doc_id") - 1)
    return bills(spark, sf_dir, number=False).unionByName(wireless.select("doc_id", "carrier_id", "text"))


def parse_bill_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both layouts through the whole order, with made up numbers, an outside total and confirmed dates for some."""
    docs = _both(spark, sf_dir)
    given = docs.where("doc_id < 0").select("doc_id", F.lit("invoice_due_dtm").alias("field"), F.lit("01/31/2024").alias("value"))
    augment = lambda d: d.select("doc_id", F.lit("curr_adj").alias("field"), F.lit("0.50").alias("value"))
    out = M.typed(B.parse_bills(docs, augment=augment, confirmed=given).summary)
    return out.select("doc_id", "invoice_number", "invoice_due_dtm", "curr_adj", "curr_chg", "curr_tax", "end_bal")


PARSE_SUMMARY_SQL = f"""WITH {ITEMS}
SELECT doc_id, lpad(c_custkey::VARCHAR, 9, '0') || 'X' || strftime(day, '%m%d%Y') AS invoice_number, (day + 21)::DATE AS invoice_due_dtm, 0.5::DECIMAL(18,2) AS curr_adj,
  subtotal AS curr_chg, tax AS curr_tax, (subtotal + tax)::DECIMAL(18,2) AS end_bal FROM truth
UNION ALL SELECT -doc_id - 1, CASE WHEN bool_or(q > 25) THEN '1' END, DATE '2024-01-31', 0.5, 7.25, 2.5, 12.25 FROM ({_W}) GROUP BY doc_id"""


def parse_bill_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges of both layouts after skip rules: one drops descriptions, one cleans them."""
    table = _rules(spark, [(i + 1, c, "charge", p, "skip", "t_charge", None, 1, True, 1, 0) for i, (c, p) in enumerate([(1, "^Cloud storage$"), (1, "promo$"), (2, "^blue ")])])
    return B.parse_bills(_both(spark, sf_dir), table).charges.select("doc_id", "charge_desc", "amount", "line")


PARSE_CHARGES_SQL = f"""WITH {ITEMS},
g AS (SELECT DISTINCT i.doc_id, c_nationkey AS c, p_name, price FROM items i JOIN truth t USING (doc_id)),
k AS (SELECT doc_id, CASE WHEN c = 2 AND starts_with(p_name, 'blue ') THEN substr(p_name, 6) ELSE p_name END AS d, price, c FROM g)
SELECT DISTINCT doc_id, d AS charge_desc, price AS amount, NULL::VARCHAR AS line FROM k
UNION ALL SELECT -doc_id - 1, charge_desc, amount, line FROM ({_W_CHARGES}) WHERE charge_desc NOT IN ('Cloud storage', '$10 Off promo')
UNION ALL SELECT DISTINCT -doc_id - 1, 'Account credit', (-4)::DECIMAL(18,2), NULL FROM ({_W})"""


def vendor_plugins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plugin of one carrier drops its cheap charges and marks its numbers."""
    B.clear_plugins()
    B.register(B.Plugin(lambda c: c == 3, lambda b: B.Bill(b.summary.withColumn("invoice_number", F.concat(F.lit("P-"), "invoice_number")), b.charges.where("amount >= 50000"))))
    try:
        bill = B.parse(bills(spark, sf_dir))
    finally:
        B.clear_plugins()
    n = bill.charges.groupBy("doc_id").agg(F.count("*").alias("n"))
    return bill.summary.join(n, "doc_id", "left").select("doc_id", "invoice_number", F.coalesce("n", F.lit(0)).alias("n"))


PLUGIN_SQL = f"""WITH {ITEMS}, g AS (SELECT DISTINCT doc_id, p_name, price FROM items)
SELECT t.doc_id, CASE WHEN c_nationkey = 3 THEN 'P-' ELSE '' END || 'INV-' || t.doc_id AS invoice_number, count(*) FILTER (WHERE c_nationkey <> 3 OR price >= 50000) AS n
FROM truth t JOIN g USING (doc_id) GROUP BY ALL"""


def short_field_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps filled from the short rule set: the total goes to the amount due, or to the current charges."""
    o = read(spark, sf_dir, "orders")
    value = F.col("o_totalprice").cast(S.MONEY).cast("string")
    blank = lambda p, v: F.when(F.left("o_orderpriority", F.lit(1)).isin(*p), F.lit(" ")).otherwise(v)
    s = o.select(F.col("o_orderkey").alias("doc_id"), blank("12", F.lit("own")).alias("invoice_number"), F.lit(None).cast("string").alias("invoice_date"), blank("23", F.lit("1.00")).alias("end_bal"), blank("34", F.lit("2.00")).alias("curr_chg"))
    found = o.select(F.col("o_orderkey").alias("doc_id"), F.lit("N").alias("invoice_no"), F.lit("01/02/2024").alias("date"), value.alias("total"))
    return B.short_fields(s, found)


SHORT_FILL_SQL = """SELECT o_orderkey AS doc_id, CASE WHEN p IN ('1', '2') THEN 'N' ELSE 'own' END AS invoice_number, '01/02/2024' AS invoice_date,
CASE WHEN p IN ('2', '3') THEN t ELSE '1.00' END AS end_bal, CASE WHEN p = '4' THEN t WHEN p = '3' THEN ' ' ELSE '2.00' END AS curr_chg
FROM (SELECT *, left(o_orderpriority, 1) AS p, o_totalprice::DECIMAL(18,2)::VARCHAR AS t FROM orders)"""


def list_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of urgent orders from one source, of orders without them from the other."""
    li = read(spark, sf_dir, "lineitem")
    mine = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.lit("own").alias("source"))
    other = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.lit("other").alias("source"))
    return B.filled_lists(mine, other)


LIST_FILL_SQL = """SELECT l_orderkey AS doc_id, l_linenumber AS pos, CASE WHEN r THEN 'own' ELSE 'other' END AS source
FROM (SELECT *, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS r FROM lineitem) WHERE NOT r OR l_returnflag = 'R'"""


def page_splitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents whose turns are pages."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.concat(F.coalesce("text", F.lit("")), F.lit("\r\n \nend")).alias("text"))
    return pages_text(c)


def customer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.by_name(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "c_custkey")


def invoice_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 30).cast("int").alias("carrier_id"), F.col("o_custkey").alias("customer_id"))
    carriers = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("carrier_id"), F.col("n_name").alias("carrier_name"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"))
    return lookups.with_parties(o, carriers, customers).select("doc_id", "carrier_name", "customer_name")


def invoices_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", F.col("text")).when(F.col("lang") == "de", F.lit("")).alias("text"))
    return lookups.with_text(d).select("doc_id")


def invoice_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.col("o_orderdate").cast("date")
    rows = o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("invoice_number"), F.col("c_name").alias("carrier_name"), F.col("o_custkey").alias("carrier_account"), day.alias("invoice_date"), F.date_add(day, 21).alias("invoice_due_dtm"), F.col("o_totalprice").cast(S.MONEY).alias("end_bal"), "o_orderstatus")
    return lookups.invoice_list(rows)


def unprocessed_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus") == "F").alias("is_processed"))
    return lookups.unprocessed(o).select("id")


def newest_line_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest labelled lines."""
    return lookups.newest_first(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))).limit(10).select("id")


def target_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).cast("int").alias("carrier_id"), F.when(F.col("p_size") % 2 == 0, "t_charge").otherwise("t_invoice").alias("target_table"))
    batch = spark.createDataFrame([(1, "t_charge"), (1, "t_charge"), (2, "t_invoice")], "carrier_id int, target_table string")
    return lookups.rules_of_targets(p, batch).select("id")


def target_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.target_tables(read(spark, sf_dir, "part").select(F.when(F.col("p_size") > 10, "t_charge").otherwise("t_invoice").alias("target_table")))


def visible_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    rows = e.select((F.col("event_id") % 97).alias("doc_id"), F.upper("event_type").alias("charge_desc"), F.when(F.col("event_type") == "view", F.lit("free")).otherwise(F.round(F.abs("value"), 2).cast(S.MONEY).cast("string")).alias("amount"))
    return lookups.visible_total(rows, "i")


VISIBLE_SQL = """SELECT event_id % 97 AS doc_id, count(*) AS n, sum(CASE WHEN event_type = 'view' THEN 0 ELSE round(abs(value), 2)::DECIMAL(18,2) END)::DECIMAL(18,2) AS total
FROM events WHERE contains(event_type, 'i') GROUP BY 1"""


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback on every order: a corrected total, text to remove, a confirmed number, or nothing of use."""
    o, key = read(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    p = F.left("o_orderpriority", F.lit(1))
    total = F.concat(key, F.lit(".25"))
    text = (
        F.when(p == "1", F.concat(F.lit("Hello there. The total due should be $"), total, F.lit(".")))
        .when(p == "2", F.lit("Please remove gizmo fee, it is wrong."))
        .when(p == "3", F.lit("The invoice number is wrong"))
        .when(p == "4", F.lit("Nice work"))
    )
    doc = F.concat(F.lit("Example\nOur Ref: N-"), key, F.lit("\nGrand Amount $"), total, F.lit("\n"))
    fields = lambda v: F.to_json(F.create_map(F.lit("invoice_number"), v))
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).cast("int").alias("carrier_id"), text.alias("feedback_text"), doc.alias("pdf_text"), fields(F.lit("x")).alias("original_fields_json"),
        fields(F.concat(F.lit("N-"), key)).alias("confirmed_fields_json"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "F").alias("is_processed"),
    )


def feedback_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.from_feedback(_feedback(spark, sf_dir)).drop("carrier_id")


_LEARNED = r"""SELECT o_orderkey AS feedback_id, 'end_bal' AS field_name, 'Grand\s+Amount\s*\$?\s*(-?[\d,]+\.\d{2})' AS regex_pattern, 'decimal' AS field_type, 't_invoice' AS target_table, o_orderstatus FROM orders WHERE o_orderpriority[1] = '1'
UNION ALL SELECT o_orderkey, 'charge_skip_pattern', 'gizmo\s+fee', 'skip', 't_charge', o_orderstatus FROM orders WHERE o_orderpriority[1] = '2'
UNION ALL SELECT o_orderkey, 'invoice_number', 'Our\s+Ref:\s*\$?\s*(\S+)', 'string', 't_invoice', o_orderstatus FROM orders WHERE o_orderpriority[1] = '3'"""


def feedback_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop over unprocessed feedback, a model's replies for what says nothing: processed and rules."""
    reply = F.lit('Sure: ```json\n[{"fieldName": "invoice_number", "regexPattern": "Ref: (\\\\S+)"}, {"fieldName": "x", "regexPattern": "(("}, {"fieldName": "x", "regexPattern": "no group"}]\n```')
    model = lambda f: f.select("id", "carrier_id", "pdf_text", reply.alias("reply"))
    given = _feedback(spark, sf_dir)
    learned = rules.learn(given, spark.createDataFrame([], rules.SCHEMA), model)[1]
    return lookups.tallies(given.where("not is_processed"), learned)


def mark_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _feedback(spark, sf_dir)
    return rules.mark_processed(given, given.where("carrier_id = 3").select("id")).select("id", "is_processed")


def rule_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with a good pattern, one that does not match, one that does not compile: the good one stays."""
    given = _feedback(spark, sf_dir)
    reply = F.lit('[{"fieldName": "a", "regexPattern": "Ref: N-(\\\\d+)", "fieldType": "string"}, {"fieldName": "b", "regexPattern": "Nowhere (x)"}, {"fieldName": "c", "regexPattern": "("}]')
    return rules.from_reply(given.select("id", "carrier_id", "pdf_text", reply.alias("reply"))).drop("carrier_id")


def newest_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest feedback of a bill's account and date, of the carrier's newest 800."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("carrier_id"), F.col("o_custkey").cast("string").alias("a"), F.col("o_orderdate").alias("created_at"))
    given = o.select("id", "carrier_id", "created_at", F.to_json(F.create_map(F.lit("carrier_account"), F.col("a"), F.lit("invoice_date"), F.lit("2024-01-02"))).alias("confirmed_fields_json"))
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("carrier_id"), F.col("c_custkey").cast("string").alias("carrier_account"), F.lit("1/2/2024").alias("invoice_date"))
    return FB.newest_confirmed(asked, given).select("doc_id", F.col("feedback_id").cast("long").alias("feedback_id"))


def field_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("The Account No is off", "tax looks odd", "billing period end", "nothing", "Previous balance vs due date")])
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", FB.field_of(F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int"))).alias("field"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select((i % 20).alias("doc_id"), (i % 3).alias("page"), (i % 7).alias("block"), (i % 11).alias("line"), i.alias("word"), F.col("event_type").alias("text"), (i * 37 % 1000).alias("x"), (i % 11 * 20).alias("y"), F.lit(30).alias("w"), F.lit(10).alias("h"), (F.col("value") - 20).alias("conf"))


def layout_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of confidence to lines to sections: words, text length and hull of each section."""
    found = layout.sections(layout.lines_by_block(layout.kept_words(_words(spark, sf_dir), 0)))
    return found.select("doc_id", "page", "block", "n_lines", F.length("text").alias("n_chars"), "x0", "y0", "x1", "y1")


SECTIONS_SQL = """WITH w AS (SELECT event_id % 20 AS doc_id, event_id % 3 AS page, event_id % 7 AS block, event_id % 11 AS line, event_type AS text, event_id * 37 % 1000 AS x, event_id % 11 * 20 AS y, value - 20 AS conf FROM events)
SELECT doc_id, page, block, count(DISTINCT line) AS n_lines, (sum(length(text) + 1) - 1)::INTEGER AS n_chars, min(x) AS x0, min(y) AS y0, max(x) + 30 AS x1, max(y) + 10 AS y1 FROM w WHERE conf < 0 OR conf >= 0 GROUP BY ALL"""


def box_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _words(spark, sf_dir)
    boxes = w.select("word", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"), F.when(F.col("page") == 2, 0).otherwise(800).alias("width_px"), F.lit(200).alias("height_px"))
    rows = layout.normalised_boxes(boxes)
    return rows.select("word", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


BOX_SQL = """SELECT event_id AS word, round(CASE WHEN event_id % 3 = 2 THEN 0.0 ELSE least(event_id * 37 % 1000 / 0.8, 1000) END::DOUBLE, 4) AS x0, round(least(event_id % 11 * 20 * 5.0, 1000)::DOUBLE, 4) AS y0,
round(CASE WHEN event_id % 3 = 2 THEN 0.0 ELSE least((event_id * 37 % 1000 + 30) / 0.8, 1000) END::DOUBLE, 4) AS x1, round(least((event_id % 11 * 20 + 10) * 5.0, 1000)::DOUBLE, 4) AS y1 FROM events"""


def page_layout_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as JSON, read back: how many words, lines and sections it names."""
    w = _words(spark, sf_dir)
    rows = layout.lines_by_block(w)
    pages = w.select("doc_id", "page").distinct().withColumns({"width_px": F.lit(1000), "height_px": F.lit(200)})
    text = tables.page_json(w, rows, layout.sections(rows), pages)
    x = F.from_json("json", "page_index long, words array<struct<text string>>, lines array<struct<text string>>, sections array<struct<block_num long>>")
    return text.select("doc_id", "page", x.alias("x")).select("doc_id", F.col("x.page_index").alias("page"), F.size("x.words").alias("n_words"), F.size("x.lines").alias("n_lines"), F.size("x.sections").alias("n_sections"))


PAGE_JSON_SQL = """SELECT event_id % 20 AS doc_id, event_id % 3 AS page, count(*)::INTEGER AS n_words, count(DISTINCT (event_id % 7, event_id % 11))::INTEGER AS n_lines, count(DISTINCT event_id % 7)::INTEGER AS n_sections FROM events GROUP BY 1, 2"""


def weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of bills labelled from corrections; the last label's span, up to three times its value, covers them all."""
    words = F.array(F.lit("Invoice"), F.concat(F.lit("N-"), F.col("o_orderkey").cast("string")), F.lit("of"), F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit("Example"), F.lit("Telecom"), F.lit("Inc"))
    fields = F.create_map(F.lit("invoice_number"), words[1], F.lit("Invoice_Date"), words[3], F.lit("carrier_name"), F.lit("example  telecom"), F.lit("end_bal"), F.lit(" "))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), words.alias("words"), fields.alias("corrected_fields"))
    return training.weak_labels(rows).select("doc_id", F.array_join("labels", " ").alias("labels"))


def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(normalised("text"), 256).alias("digest"))


NORMALISE_SQL = r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(13), chr(10)), '[\t\p{Zs}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents"""


def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in every way of writing: as money, with CR and parentheses as credit, and cleaned."""
    v = F.abs(F.col("c_acctbal").cast(S.MONEY))
    text = F.format_number(v, 2)
    forms = F.array(text, F.concat(F.lit("$"), text), F.concat(F.lit("-$"), text), F.concat(F.lit("("), text, F.lit(")")), F.concat(text, F.lit(" CR")), F.lit("n/a"))
    raw = F.element_at(forms, (F.col("c_custkey") % 6 + 1).cast("int"))
    c = read(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))
    return c.select("c_custkey", S.money("raw").cast(S.MONEY).alias("plain"), S.signed_money("raw").cast(S.MONEY).alias("credit"), S.clean_money("raw").alias("cleaned"))


MONEY_SQL = """SELECT c_custkey, CASE k WHEN 2 THEN -v WHEN 5 THEN NULL ELSE v END AS plain, CASE WHEN k IN (2, 3, 4) THEN -v WHEN k = 5 THEN 0 ELSE v END::DECIMAL(18,2) AS credit,
CASE k WHEN 2 THEN (-v)::VARCHAR WHEN 5 THEN 'n/a' ELSE v::VARCHAR END AS cleaned FROM (SELECT c_custkey, c_custkey % 6 AS k, abs(c_acctbal::DECIMAL(18,2)) AS v FROM customer)"""


def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(*[F.date_format("o_orderdate", f) for f in ("MM/dd/yyyy", "M/d/yyyy", "yyyy-MM-dd", "MM-dd-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MM/dd/yy")], F.lit("soon"))
    raw = F.element_at(forms, (F.col("o_orderkey") % 8 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", S.date(raw).alias("day"), S.version_stamp(F.col("o_orderdate")).alias("stamp"))


def vendor_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.operators import basic

    head = F.element_at(F.array(*[F.lit(x) for x in ("Invoice 5", "12/31 total", "Tel: 555", "ab", "www.example.org", "3M Telecom", "Date Telecom Inc")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", basic.first_meaningful_line(F.concat(head, F.lit("\n  "), F.col("p_name"), F.lit("  \nmore"))).alias("vendor"))


def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of bills by line: the sections and how many rows each has."""
    docs = wireless_bills(spark, sf_dir)
    bill = B.parse_bills(docs)
    report = tables.report_tsv(bill.summary, {"CHARGES": bill.charges, "USAGE": bill.usages, "INVENTORY": bill.inventory}, text_column="text")
    rows = report.select("doc_id", F.split("report", "\n").alias("r"))
    at = lambda name: F.array_position("r", name)
    return rows.select("doc_id", (at("CHARGES") - at("SUMMARY") - 1).alias("n_fields"), (at("USAGE") - at("CHARGES") - 1).alias("n_charges"), (at("INVENTORY") - at("USAGE") - 1).alias("n_usages"), (at("TEXT") - at("INVENTORY") - 1).alias("n_plans"))


REPORT_SQL = f"""SELECT doc_id, 13::BIGINT AS n_fields, sum(4 + even::INTEGER * 0 + CASE WHEN even THEN 0 ELSE 1 END + (q > 25)::INTEGER)::BIGINT + 1 AS n_charges, (count(*) * 4)::BIGINT AS n_usages, count(*) AS n_plans FROM ({_W}) GROUP BY doc_id"""


def predict_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that are known, nearly known, or left to a model."""
    b = read(spark, sf_dir, "benchmark")
    asked = b.select(F.col("item_id").alias("doc_id"), F.lit(0).alias("pos"), F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit(" !!"))).otherwise(F.concat(F.lit("unheard of "), F.reverse("text"))).alias("line"))
    known = b.select("text", F.lit("Summary").alias("label"), F.lit(1).alias("created_at"))
    model = lambda rows: rows.select("doc_id", "pos", F.lit("Ignore").alias("label"), F.lit(0.4).alias("confidence"))
    return training.predict_lines(asked, known, model).select("doc_id", "label", F.round("confidence", 3).alias("confidence"), "source")


def accuracy_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction accuracy over fields, descriptions and amounts together."""
    e = read(spark, sf_dir, "events")
    d = (F.col("event_id") % 50).alias("doc_id")
    fields = e.select(d, F.lit("field").alias("kind"), F.col("event_type").alias("detected"), F.when(F.col("event_type") == "click", F.lit("x")).otherwise(F.col("event_type")).alias("confirmed"))
    amounts = e.select(d, F.lit("amount").alias("kind"), F.format_number(F.col("value"), 2).alias("detected"), F.concat(F.lit("$ "), F.format_number(F.col("value"), 2)).alias("confirmed"))
    return reconcile.accuracy(fields.unionByName(amounts))


ACCURACY_SQL = """SELECT *, CASE WHEN percent >= 80 THEN 'high' WHEN percent >= 50 THEN 'medium' ELSE 'low' END AS band FROM (SELECT event_id % 50 AS doc_id, count(*) * 2 AS detected, sum(1 + (event_type <> 'click')::INTEGER)::BIGINT AS unchanged,
(sum(1 + (event_type <> 'click')::INTEGER) * 100 // (count(*) * 2))::INTEGER AS percent FROM events GROUP BY 1)"""

QUERIES = {
    f.__name__: f
    for f in (
        parse_bill_summary, parse_bill_charges, vendor_plugins, short_field_fill, list_fill, page_splitter, customer_lookup, invoice_parties, invoices_with_text, invoice_list, unprocessed_feedback,
        newest_line_feedback, target_rules, target_tables, visible_total, feedback_rules, feedback_tallies, mark_processed, rule_verify, newest_feedback, field_mentions, layout_sections,
        box_normalise, page_layout_json, weak_labels, normalise_text, money_parse, date_parse, vendor_first_line, full_report, predict_lines, accuracy_by_kind,
    )
}

ORACLE_SQL = {
    "parse_bill_summary": PARSE_SUMMARY_SQL,
    "parse_bill_charges": PARSE_CHARGES_SQL,
    "vendor_plugins": PLUGIN_SQL,
    "short_field_fill": SHORT_FILL_SQL,
    "list_fill": LIST_FILL_SQL,
    "page_splitter": r"""SELECT conv_id AS doc_id, string_agg(p, chr(10) ORDER BY turn) AS text FROM (SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_replace(s, '\r+$', '')), lambda s: trim(s) <> ''), chr(10)) AS b,
CASE WHEN b = '' THEN '' ELSE b || chr(10) END || 'end' || chr(10) AS p FROM conversations) GROUP BY 1""",
    "customer_lookup": "SELECT c_custkey, c_name FROM customer",
    "invoice_parties": "SELECT o_orderkey AS doc_id, n_name AS carrier_name, c_name AS customer_name FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 30 LEFT JOIN customer ON c_custkey = o_custkey",
    "invoices_with_text": "SELECT doc_id FROM documents WHERE lang = 'en' AND text <> ''",
    "invoice_list": "SELECT o_orderkey AS doc_id, 'INV-' || o_orderkey AS invoice_number, c_name AS carrier_name, o_custkey AS carrier_account, o_orderdate::DATE AS invoice_date, (o_orderdate::DATE + 21)::DATE AS invoice_due_dtm, o_totalprice::DECIMAL(18,2) AS end_bal FROM orders JOIN customer ON o_custkey = c_custkey",
    "unprocessed_feedback": "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'",
    "newest_line_feedback": "SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10",
    "target_rules": "SELECT p_partkey AS id FROM part WHERE (p_size % 5 = 1 AND p_size % 2 = 0) OR (p_size % 5 = 2 AND p_size % 2 = 1)",
    "target_tables": "SELECT DISTINCT CASE WHEN p_size > 10 THEN 't_charge' ELSE 't_invoice' END AS target_table FROM part",
    "visible_total": VISIBLE_SQL,
    "feedback_rules": f"SELECT * EXCLUDE (o_orderstatus) FROM ({_LEARNED})",
    "feedback_tallies": "SELECT count(*) AS processed, count(*) AS rules_generated FROM orders WHERE o_orderstatus <> 'F'",
    "mark_processed": "SELECT o_orderkey AS id, o_orderstatus = 'F' OR o_custkey % 7 = 3 AS is_processed FROM orders",
    "rule_verify": r"SELECT o_orderkey AS feedback_id, 'a' AS field_name, 'Ref: N-(\d+)' AS regex_pattern, 'string' AS field_type, 't_invoice' AS target_table, 50 AS sort_order FROM orders",
    "newest_feedback": "SELECT o_custkey AS doc_id, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS feedback_id FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 800) JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "field_mentions": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'carrier_account' WHEN 1 THEN 'curr_tax' WHEN 2 THEN 'invoice_end_dtm' WHEN 4 THEN 'beg_bal' END AS field FROM part",
    "layout_sections": SECTIONS_SQL,
    "box_normalise": BOX_SQL,
    "page_layout_json": PAGE_JSON_SQL,
    "weak_labels": "SELECT o_orderkey AS doc_id, 'VENDOR VENDOR VENDOR VENDOR VENDOR VENDOR VENDOR' AS labels FROM orders",
    "normalise_text": NORMALISE_SQL,
    "money_parse": MONEY_SQL,
    "date_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 8 <> 7 THEN o_orderdate::DATE END AS day, strftime(o_orderdate, '%Y%m%d%H%M%S') AS stamp FROM orders",
    "vendor_first_line": "SELECT p_partkey, CASE p_partkey % 7 WHEN 5 THEN '3M Telecom' WHEN 6 THEN 'Date Telecom Inc' ELSE p_name END AS vendor FROM part",
    "full_report": REPORT_SQL,
    "predict_lines": "SELECT item_id AS doc_id, CASE WHEN item_id % 2 = 0 THEN 'Summary' ELSE 'Ignore' END AS label, CASE WHEN item_id % 2 = 0 THEN 1.0 ELSE 0.4 END::DOUBLE AS confidence, CASE WHEN item_id % 2 = 0 THEN 'feedback' ELSE 'model' END AS source FROM benchmark",
    "accuracy_by_kind": ACCURACY_SQL,
}
