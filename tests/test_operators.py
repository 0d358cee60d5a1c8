"""Extraction cases that rendered bills do not hold, sources, sinks and streams."""

from pyspark.sql import functions as F

from ledgerloom.operators import basic, charges, feedback, rules, summary, training, wireless
from ledgerloom.operators.text import normalised
from ledgerloom.sources import tables
from ledgerloom.streaming import jobs


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_normalised(spark):
    out = docs(spark, "\r\n a\t b \r\nc\n\n\n\n d ", None).select(normalised("text").alias("t")).collect()
    assert [r["t"] for r in out] == ["a b\n\nc\n\nd", ""]


def test_summary_of_empty_texts(spark):
    rows = summary.typed(summary.summary_text(docs(spark, "", None, "nothing here"))).collect()
    assert all(v is None for r in rows for k, v in r.asDict().items() if k != "doc_id")


def test_account_gives_way(spark):
    rows = summary.summary_text(docs(spark, "Account Number: 1\nx\nAccount: 123-456\ny", "Account #: (99) 88.\nz")).orderBy("doc_id").collect()
    assert [r["carrier_account"] for r in rows] == ["123-456", "99)88"]


def parsed(spark, text):
    return [(r["charge_desc"], str(r["amount"]), r["line"]) for r in charges.parse(docs(spark, text)).orderBy("pos").collect()]


def test_charges(spark):
    text = (
        "Fee 1.00\nOne Time Charges\nSetup fee 2 @ 5.00 $10.00\n(555)123-4567\nNo line 1.00\nSUMMARY FOR (555)123-4567\nLine fee .50\nCredit 3.00 CR\n(555)123-4567 TOTAL 9.99\nRefund (2.00)\n"
        "MONTHLY USAGE FOR TELEPHONE (555)765-4321\nUse 4.00\nMONTHLY USAGE FOR TELEPHONE (555)999-9999\nMore 4.50\nPayment 5.00\nSubtotal 1.00\nLate Fee 2.00\nMonthly Charges 3.00\nOther things 4.00"
    )
    assert parsed(spark, text) == [
        ("Setup fee", "10.00", None), ("No line", "1.00", None), ("Line fee", "0.50", "(555)123-4567"), ("Credit", "-3.00", "(555)123-4567"), ("Refund", "-2.00", None),
        ("Use", "4.00", "(555)765-4321"), ("More", "4.50", "(555)765-4321"),
    ]


def test_charges_that_only_look_like_others(spark):
    text = "Recurring Charges\nAccount Maintenance Fee 4.00\nCustomer Premise Equipment 5.00\nInvoice Delivery Fee 1.00\nCall Forwarding 2.50\nRemaining Device Plan 9.00"
    assert [d for d, _, _ in parsed(spark, text)] == ["Account Maintenance Fee", "Customer Premise Equipment", "Invoice Delivery Fee", "Call Forwarding", "Remaining Device Plan"]


def test_circuits_reach_the_charge_before_and_those_after(spark):
    assert parsed(spark, "Recurring Charges\nPort A 1.00\nPort B 2.00\nCircuit ID: X1\nPort C 3.00") == [("Port A", "1.00", None), ("Port B", "2.00", "X1"), ("Port C", "3.00", "X1")]


def test_summary_probes(spark):
    """Expected values by hand."""
    cases = [
        ("PAYMENT(S) RECEIVED 100.00", "payment", "100.00"), ("Payments -50.00", "payment", "50.00"), ("Payment - Thank You -$50.00", "payment", "50.00"), ("Invoice Number : A1", "invoice_number", "A1"),
        ("Due Date : 01/02/2024", "invoice_due_dtm", "01/02/2024"), ("Invoice Date : 1-2-2024", "invoice_date", "1-2-2024"), ("Taxes, Fees and Surcharges 4.00", "curr_tax", "4.00"),
        ("Credits 5.00\nAdjustments 3.00", "prev_adj", "3.00"), ("PREVIOUS BALANCE DUE 7.00", "end_bal", None), ("BALANCE DUE $9.00 CR", "end_bal", "9.00"), ("TOTAL DUE -$5.00", "end_bal", "-5.00"),
        ("Previous Balance: 5.00", "beg_bal", None),
    ]
    rows = summary.summary_text(docs(spark, *[t for t, _, _ in cases])).orderBy("doc_id").collect()
    assert [r[f] for r, (_, f, _) in zip(rows, cases, strict=True)] == [v for _, _, v in cases]


def test_literal_words_are_in_every_match():
    assert summary.literal(r"Invoice\s*Number\s*:\s*(\S+)") == "invoice" and summary.literal(r"Taxes?\s+&\s+Fees?\s+(\d)") in ("taxe", "fee")
    assert summary.literal(r"(?:through|thru|to)\s+(\d+)") is None


def test_validity(spark):
    texts = ["Visit www.x.com", "Plan fee", "", "Printed on 1/1", "Please note. This is it! Yes", None, "Thanksgiving plan", "Approx. fee for svc.", "*Roaming plan", "See-through fee", "What?! no"]
    rows = docs(spark, *texts).select("doc_id", charges.invalid("text").alias("i"), charges.ambiguous("text").alias("a")).orderBy("doc_id").collect()
    assert [r["i"] for r in rows] == [True, False, True, True, False, True, False, False, False, False, False]
    assert [r["a"] for r in rows] == [False, False, False, False, True, False, False, False, False, False, True]
    assert charges.valid_patterns(["a(", "b", "(c)"], 1) == ["(c)"]


def test_hybrid_merge(spark):
    """Rows (model value, confidence, rule value, confidence) and by hand (value, confidence, source)."""
    cases = [
        (("5", 0.70, "5", 0.70), ("5", 0.75, "HYBRID")), (("5", 0.90, "5", 0.70), ("5", 0.95, "ML")), (("5", 0.52, "5", 0.50), ("5", 0.57, "ML")), (("5", 0.70, "6", 0.70), ("5", 0.70, "ML")),
        (("5", 0.40, None, 0.0), ("5", 0.20, "ML")), (("5", 0.40, "6", 0.70), ("6", 0.70, "RULE")), ((None, 0.0, None, 0.0), ("", 0.0, "RULE")), (("5", 0.99, "5", 0.99), ("5", 1.0, "HYBRID")),
        (("5", 0.60, "6", 0.70), ("6", 0.70, "RULE")), ((None, 0.9, "6", 0.0), ("6", 0.74, "RULE")),
    ]
    rows = spark.createDataFrame([(i, "total", *given) for i, (given, _) in enumerate(cases)], "doc_id int, field string, ml_value string, ml_conf double, rule_value string, rule_conf double")
    assert [(r["value"], r["confidence"], r["source"]) for r in basic.merge(rows).orderBy("doc_id").collect()] == [want for _, want in cases]


def test_wireless_sections(spark):
    text = "Charges by line details\nAnn\n555-010-0001\nOther Charges and Credits\nLonely\n$5.00\nEquipment Charges\nPhone (1 of 2)\nPaid 1\n-$7.00\nTotal Current Charges $9.00\nStray item $9.00"
    found = wireless.blocks(docs(spark, text))
    assert [(r["charge_desc"], str(r["amount"])) for r in wireless.charges(found).collect()] == [("Phone", "-7.00")]
    assert wireless.inventory(found).first()["plan_name"] is None and wireless.blocks(docs(spark, "", None)).count() == 0


def test_weak_labels():
    words = ["Total", "of", "12.50", "now"]
    assert training.span_labels(words, {"TOTAL": "12.50"}) == ["TOTAL", "TOTAL", "TOTAL", "TOTAL"]
    assert training.span_labels(["x" * 30, "12.50", "y" * 30], {"TOTAL": "12.50"}) == ["O", "TOTAL", "TOTAL"]
    assert training.span_labels(["a", "b"], {"TOTAL": "zzz"}) == ["O", "O"]


def test_contexts_keep_hits_far_enough_from_the_last_kept_one(spark):
    d = docs(spark, "x" * 5 + "1,234.50" + " 1234.50" + "y" * 40)
    truth = spark.createDataFrame([(0, "total", "1,234.50")], "doc_id int, field string, value string")
    assert [r["at"] for r in training.contexts(d, truth).orderBy("at").collect()] == [6]


def test_retraining_is_refused_while_one_runs():
    inner = []
    r = training.Retrainer(lambda: inner.append(r.retrain()) or "model")
    assert r.retrain() and inner == [False] and r.model == "model"


def test_token_dataset(spark):
    rows = spark.createDataFrame([(i, ["a"], ["O"]) for i in range(40)] + [(99, ["a", "b"], ["O"])], "doc_id int, words array<string>, labels array<string>")
    train, held = training.token_dataset(rows)
    assert train.count() + held.count() == 40 and training.token_dataset(rows.limit(3)) is None


def test_best_and_last_rule(spark):
    d = docs(spark, "A: one\nB: two").withColumn("carrier_id", F.lit(1))
    table = spark.createDataFrame(
        [(1, 1, "invoice_number", r"A: (\S+)", "string", "t_invoice", None, 1, True, 5, 0), (2, 1, "invoice_number", r"B: (\S+)", "string", "t_invoice", None, 1, True, 1, 0)], rules.SCHEMA
    )
    assert rules.overlay(d, table).first()["value"] == "one"
    assert rules.overlay(d, table, best_wins=False).first()["value"] == "two"


def test_feedback(spark):
    f = spark.createDataFrame([(1, "Hi. The current adjustment should be 5.00. Remove promo text, please")], "id int, t string")
    assert [r["sentence"] for r in feedback.sentences(f, "id", "t").collect()][0].startswith("The current")
    assert f.select(feedback.field_of(F.lit("current adjustment")).alias("x"), feedback.field_of(F.lit("current adjustment"), longest=False).alias("y")).first() == ("curr_adj", "prev_adj")


def test_vendor_overlay(spark):
    basic.register_overlay("Example", {"total": [r"Zu zahlen (\S+)"]})
    assert basic.extract(docs(spark, "Invoice\n12 x\nAcme Ltd\nZu zahlen 5.00"), vendor="example").first().asDict() == {
        "doc_id": 0, "invoice_no": None, "date": None, "total": "5.00", "vendor": "12 x",
    }


def test_candidates_and_model(spark):
    kinds = {r["kind"] for r in training.candidates(docs(spark, "On 1/2/2024 pay 12.50 for 123456 or 123-45")).collect()}
    assert kinds == {"date", "amount", "number", "hyphenated"}
    few = spark.createDataFrame([("a", "x")], "context string, label string")
    assert training.text_model(few) is None
    many = spark.createDataFrame([(f"pay total {i}", "money") for i in range(40)] + [(f"see page {i}", "none") for i in range(40)], "context string, label string")
    assert training.text_model(many)[1] > 0.9


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Text,Label\n"Total, due",summary\nFee 1.00,CHARGES\nbad line\nx,Unknown\n')
    rows = {(r["text"], r["label"]) for r in tables.labelled_lines(spark, str(tmp_path / "a.csv")).collect()}
    assert rows == {("Total, due", "Summary"), ("Fee 1.00", "Charges")}
    (tmp_path / "e.json").write_text("[]")
    assert tables.feedback(spark, str(tmp_path / "e.json")).count() == 0
    tables.write_labelled(spark.createDataFrame([("a,b", "Summary")], "text string, label string"), str(tmp_path / "out"))
    assert [r["text"] for r in tables.labelled_lines(spark, str(tmp_path / "out")).collect()] == ["a,b"]


def test_files_and_tiers(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"x" * 60)
    (tmp_path / "b.pdf").write_bytes(b"y")
    files = tables.files(spark, str(tmp_path))
    assert {r["file_name"]: r["kind"] for r in files.collect()} == {"a.PNG": "image", "b.pdf": "pdf"}
    out = tables.extracted(files, [lambda b, k: None, lambda b, k: b.decode()])
    assert {r["file_name"]: len(r["text"]) for r in out.collect()} == {"a.PNG": 60, "b.pdf": 1}
    assert tables.not_cached(files, out.where("file_name = 'b.pdf'")).count() == 1


def test_saved_batches(spark, tmp_path):
    invoices = spark.createDataFrame([(1, 7, "9-9")], "doc_id int, carrier_id int, carrier_account string")
    fees = spark.createDataFrame([(1, "fee")], "doc_id int, charge_desc string")
    tables.save_invoice_tables(invoices, {"charges": fees}, str(tmp_path), "b1")
    assert tables.read_invoice_table(spark, str(tmp_path), "charges").first()["account_number"] == "9-9"
    orphan = spark.createDataFrame([(1, "fee"), (2, "orphan")], "doc_id int, charge_desc string")
    tables.save_invoice_tables(invoices, {"charges": orphan}, str(tmp_path), "b1")
    rows = tables.read_invoice_table(spark, str(tmp_path), "charges").collect()
    assert sorted((r["charge_desc"], r["account_number"]) for r in rows) == [("fee", "9-9"), ("orphan", None)]


def test_lines_and_texts_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([("Total Due!", "Charges", "Summary")], "raw_text string, predicted_label string, corrected_label string")
    tables.append_lines(rows, str(tmp_path / "l"))
    tables.append_lines(rows, str(tmp_path / "l"))
    assert [r["normalized_text"] for r in spark.read.parquet(str(tmp_path / "l")).collect()] == ["total due"] * 2
    texts = spark.createDataFrame([("d1", "t")], "digest string, text string")
    tables.save_texts(texts, str(tmp_path / "c"), "eng")
    cache = spark.read.parquet(str(tmp_path / "c"))
    assert tables.not_cached(texts, cache, "eng").count() == 0 and tables.not_cached(texts, cache, "deu").count() == 1


def test_streams_of_labels_lookups_and_bills(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Text,Label\nTotal due,Summary\nFee 1.00,CHARGES\n")
    jobs.append_stream(jobs.labelled_stream(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "k1")).awaitTermination(60)
    assert spark.read.schema("text string, label string").json(str(tmp_path / "log")).count() == 2

    def all_of(stream, name):
        q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    lines = spark.createDataFrame([(1, 0, "TOTAL due!"), (1, 1, "else")], "doc_id int, pos int, line string")
    lines.write.parquet(str(tmp_path / "lines"))
    known = spark.createDataFrame([("total due", "Charges", 1), ("Total  due", "Summary", 2)], "text string, label string, created_at int")
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "lines"))
    want = sorted(tuple(r) for r in jobs.lookup_stream(lines, known).collect())
    assert sorted(tuple(r) for r in all_of(jobs.lookup_stream(stream, known), "looked").collect()) == want and want[0][-1] == "Summary"
    b = spark.createDataFrame([("A", 1, 5), ("A", 1, 6), ("B", 1, 7), ("C", 2, 8)], "invoice_number string, carrier_id int, s int").selectExpr("*", "timestamp_seconds(s) as ts")
    b.write.parquet(str(tmp_path / "bills"))
    fresh = jobs.new_bills(spark.readStream.schema(b.schema).parquet(str(tmp_path / "bills")), b.where("invoice_number = 'C'"))
    assert sorted(r["invoice_number"] for r in all_of(fresh, "fresh").collect()) == ["A", "B"]


def test_stream_equals_batch(spark, tmp_path):
    d = docs(spark, "Invoice Number: A1\nDue Date: 01/02/2024", "Invoice Number: B2")
    d.write.parquet(str(tmp_path / "in"))
    stream = jobs.parse_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("parsed").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("parsed").collect()) == sorted(jobs.parse_stream(d).collect())
    calls = []
    q = jobs.on_new_rows(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), calls.append, 2, str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert calls == [2]


def shuffled(df):
    """How often a plan shuffles rows by key, and its windows, each of which sorts them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Window [")


def test_wireless_lines_are_neither_shuffled_nor_sorted(spark):
    """bills are dealt once while narrow; the only window drops repeats of what was found."""
    from ledgerloom.plans import catalog

    for name in ("wireless_usage", "wireless_inventory", "wireless_charges"):
        exchanges, windows = shuffled(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert exchanges <= 1 and windows <= 1, name


def test_equipment_titles_repeated_go_on_with_what_waits(spark):
    text = "Charges by line details\n555-010-0001\nEquipment Charges\nPhone case\nEquipment Charges\n$5.00\nSurcharges\nEquipment Charges\n$6.00\nHeadset x\nOther item $1.00\n$7.00"
    rows = wireless.charges(wireless.blocks(docs(spark, text))).orderBy("pos").collect()
    assert [(r["charge_desc"], str(r["amount"])) for r in rows] == [("Phone case", "5.00"), ("Other item", "1.00")]


def test_literal_phrases_span_collapsed_space(spark):
    """a pattern whose words do not stand together is not tried."""
    assert summary.literal(r"TOTAL\s+DUE\s*:?\s*(\d+)") == "total due" and summary.literal(r"This\s+month'?s\s+charges\s+(\d)") == "this month"
    rows = summary.summary_text(docs(spark, "TOTAL\n\nDUE: $5.00", "the total is due: 5.00")).orderBy("doc_id").collect()
    assert [r["end_bal"] for r in rows] == ["5.00", None]


def test_plugins_in_order_without_looking_bills_up_again(spark):
    """bills are dealt by plugin and by layout before they are read, so that no join takes them apart."""
    from ledgerloom.operators import bills as B

    text = "Invoice Number: A1\nRecurring Charges\nService one  $5.00\nService two  $9.00"
    given = spark.createDataFrame([(i, i, text) for i in range(4)] + [(4, None, text)], "doc_id int, carrier_id int, text string")
    mark = lambda m: lambda b: B.Bill(b.summary.withColumn("invoice_number", F.concat("invoice_number", F.lit(m))), b.charges.where("amount > 5"))
    B.clear_plugins()
    assert "Join" not in B.parse_bills(given).summary._jdf.queryExecution().executedPlan().toString()
    B.register(B.Plugin(lambda c: c == 1, mark("x")))
    B.register(B.Plugin(lambda c: c.isin(1, 2), mark("y")))
    try:
        bill, whole = B.parse(given.where("carrier_id is null or carrier_id <> 1")), B.parse(given)
        first = B.parse_bills(given)
    finally:
        B.clear_plugins()
    assert {r["doc_id"]: r["invoice_number"] for r in whole.summary.collect()} == {0: "A1", 1: "A1xy", 2: "A1y", 3: "A1", 4: "A1"}
    assert {r["doc_id"]: r["count"] for r in whole.charges.groupBy("doc_id").count().collect()} == {0: 2, 1: 1, 2: 1, 3: 2, 4: 2}
    assert {r["doc_id"]: r["invoice_number"] for r in first.summary.collect()} == {0: "A1", 1: "A1xy", 2: "A1y", 3: "A1", 4: "A1"}
    assert first.charges.count() == 8 and bill.charges.count() == 7
