"""Hand-derived results for single documents and fields."""

import pytest
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions import scores
from paperloom.functions.checks import is_amount, is_date
from paperloom.functions.text import confidence_band, ml_preprocess, normalize_name, normalize_text
from paperloom.operators import classify as C
from paperloom.operators import evaluate, layout, locate, ml, suggest, tables, terms, totals, validate
from paperloom.operators import samples as S
from paperloom.sources import intake


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(df):
    return df.collect()[0]


def test_classify_receipt(spark):
    r = one(C.with_indicators(C.classify(docs(spark, "RECEIPT\nTotal: $5.00\nThank you"))))
    assert (r.doc_type, r.confidence_level) == ("receipt", "Very High")
    assert r.confidence == pytest.approx(0.95)
    assert r.keyword_score == pytest.approx(2.1) and r.structural_score == 2.0
    assert r.primary_indicators == ["receipt", "cash"]
    assert r.secondary_indicators == ["change", "store", "thank you"] and r.context_matches == []


def test_classify_empty(spark):
    r = one(C.classify(docs(spark, "")))
    assert (r.doc_type, r.confidence, r.confidence_level) == ("unknown", 0.0, "Very Low")


def test_tie_goes_to_first_declared(spark):
    # only the keyword shared by invoice and bill patterns
    r = one(C.with_candidates(docs(spark, "x billing y")))
    by = {c.doc_type: c.score for c in r.candidates if c}
    assert set(rules.ALWAYS_SCORED) <= set(by)


def test_header_footer_split(spark):
    five, six = "a\nb\nc\nd\ntotal", "total\nb\nc\nd\ne\nf"
    rows = C.layer_scores(docs(spark, five, six)).orderBy("doc_id").collect()
    assert rows[0].st_receipt == 0.5 and rows[1].st_receipt == 0.0


def test_table_gap_threshold(spark):
    rows = C.layer_scores(docs(spark, "\t" * 10 + "x", "\t" * 11 + "x")).orderBy("doc_id").collect()
    assert [r.st_invoice for r in rows] == [0.0, 1.0]


def test_field_confidence(spark):
    r = one(spark.range(1).select(
        scores.field_confidence(F.lit(.85), F.lit(.9), F.lit(True), F.lit(1.0)).alias("a"),
        scores.overall_confidence(F.lit(.8), F.lit(.95), F.lit(.6)).alias("b")))
    assert r.a == pytest.approx(0.8983893068537415) and r.b == pytest.approx(0.8075)


def test_totals_scan(spark):
    d = docs(spark, "Subtotal: $100.00\nTax: $10.00\nTotal: $110.00")
    got = [(r.value, r.context) for r in totals.scan_totals(d).orderBy("ord").collect()]
    assert got == [(100, "amount"), (10, "amount"), (110, "amount"), (100, "total"), (110, "total"),
                   (100, "total"), (10, "amount")]
    fields = {r.name: r.value for r in totals.totals_fields(totals.scan_totals(d)).collect()}
    assert fields == {"Amount": "$10.00", "Total Amount": "$100.00"}
    lines = layout.segment_lines(d).orderBy("line_idx").collect()
    assert [(r.element_type, r.y, r.w) for r in lines] == [
        ("financial", 0.0, 136.0), ("financial", 25.0, 88.0), ("financial", 50.0, 112.0)]


@pytest.mark.parametrize("text,expected", [("$1234.56", 123.0), ("1234.56 $", 234.56), ("$1,234.50", 1234.5)])
def test_money_patterns(spark, text, expected):
    assert one(totals.scan_totals(docs(spark, text))).value == expected


def response(spark, *texts):
    return S.valid_samples(S.parse_samples(spark.createDataFrame(
        [(0, i + 1, t) for i, t in enumerate(texts)], "doc_id long, sample_no int, response string")))


def field_json(value, conf, name="Total"):
    return '{"fields":[{"name":"%s","value":"%s","confidence":%s}]}' % (name, value, conf)


def test_consensus(spark):
    v = response(spark, field_json("110.00", .9), field_json("110", .6), field_json("110.00 ", .6))
    r = one(S.field_consensus(S.sample_fields(v)))
    assert r.value == "110.00" and r.confidence == pytest.approx(0.7)


def test_vote_first_seen_wins(spark):
    two = response(spark, '{"doc_type":"receipt"}', '{"doc_type":"invoice"}')
    assert one(S.vote_doc_type(two)).doc_type == "receipt"
    none = response(spark, '{"doc_type":', '[{"doc_type":"x"}]')
    assert one(S.vote_doc_type(none)).doc_type == "unknown"


def test_sample_statuses(spark):
    raw = spark.createDataFrame(
        [(0, i, t) for i, t in enumerate(['{"a":1}', 'x {"doc_type":"bill"} y', "no braces", '{"a":', '{"a":{}', "[1]", '"s"', "null"])],
        "doc_id long, sample_no int, response string")
    got = [r.status for r in S.parse_samples(raw).orderBy("sample_no").collect()]
    # a cut response without any closing brace holds no {...} and counts as empty
    assert got == ["ok", "recovered", "empty", "empty", "dropped", "dropped", "dropped", "dropped"]


def test_strict_json(spark):
    v = response(spark, "{'doc_type':'bill'}", '{"fields":[]} {"fields":[]}', 'see {"fields":[]} and {"fields":[]}.',
                 '{"overall_confidence":null}', '{"overall_confidence":0.5}', '{"qa":{"notes":"overall_confidence"}}')
    assert [r.valid for r in v.orderBy("sample_no").collect()] == [False, False, False, False, True, True]


def test_invalid_fields_drop_the_sample(spark):
    v = response(spark, '{"fields":[{"value":"1"}]}', field_json("1", '"high"'), field_json("1", '"0.9"'),
                 '{"fields":[{"name":"a","value":null,"confidence":1.7}]}', '{"fields":[{"name":"a"}]}')
    rows = v.orderBy("sample_no").collect()
    assert [r.valid for r in rows] == [False, False, True, True, False]
    assert rows[3].fields[0].value == "None" and rows[3].fields[0].confidence == 1.0


def fields(spark, *pairs):
    return spark.createDataFrame([(0, n, v, 0.9, i) for i, (n, v) in enumerate(pairs)],
                                 "doc_id long, name string, value string, confidence double, ord long")


def test_validation(spark):
    base = [("Invoice Date", "2024-01-15"), ("Amount Due", "110.00"), ("Subtotal", "100.00"),
            ("Tax Amount", "10.00"), ("Invoice Number", "A1")]
    f = fields(spark, *base)
    valid = {r.name: r.valid for r in validate.validate_fields(f).collect()}
    assert valid == {"Invoice Date": True, "Amount Due": False, "Subtotal": True, "Tax Amount": True, "Invoice Number": False}
    s = one(validate.validation_summary(f))
    assert s.pass_rate == pytest.approx(0.6) and s.totals_match == "passed"
    zero = fields(spark, *[(n, "0.00" if n == "Tax Amount" else v) for n, v in base])
    assert one(validate.totals_match(zero)).totals_match is None


def test_value_checks(spark):
    amounts = {"1,234.50": True, "1234": True, "-12.50": True, "12.5": False, "$5": False}
    dates = {"2024-01-15": True, "1/2/24": True, "x 1-2-2024 y": True, "20240101": True, "2024-W01-1": True,
             "2024-01-01T10:00": True, "March 3": False, "2024": False}
    for fn, table in ((is_amount, amounts), (is_date, dates)):
        df = spark.createDataFrame([(k,) for k in table], "v string")
        assert {r.v: r.ok for r in df.select("v", fn(F.col("v")).alias("ok")).collect()} == table


def test_evaluation(spark):
    pred = fields(spark, ("A", "1"), ("B", "2"))
    truth = fields(spark, ("A", "1"), ("B", "3"), ("C", "4"))
    out = evaluate.eval_fields(pred, truth)
    m = one(evaluate.eval_metrics(out))
    assert (m.tp, m.fp, m.fn) == (1, 1, 2)
    assert m.f1 == pytest.approx(0.4) and m.precision == 0.5
    assert {r.norm_name: r.outcome for r in out.collect()} == {"a": "match", "b": "mismatch", "c": "missing"}


def test_suggestions(spark):
    df = spark.createDataFrame([("invoice", None), ("invoice", " PO Number , Due Date,"), ("unknown", None), ("bill", " , ")],
                               "doc_type string, user_fields string")
    rows = [r.suggested for r in suggest.suggest_fields(df).collect()]
    assert rows[0] == rules.TEMPLATES["invoice"][:10]
    assert rows[1][:2] == ["PO Number", "Due Date"] and len(rows[1]) == 13
    assert rows[2] == [] and rows[3] == rules.TEMPLATES["bill"]


def test_size_gates(spark):
    df = spark.createDataFrame([(75000,), (75001,), (2097153,)], "size_bytes long")
    assert [r.gate for r in intake.size_gate(df).collect()] == ["direct", "too_many_tokens", "too_large"]


def test_grid(spark):
    df = spark.createDataFrame([(0, 0.0, 50.0, 0.9, 100, 45)],
                               "doc_id long, x double, y double, confidence double, image_width int, image_height int")
    r = one(layout.confidence_grid(df))
    assert (r.y_idx, r.x_idx) == (1, 0)
    images = spark.createDataFrame([(0, 100, 45), (1, 40, 20)], "doc_id long, image_width int, image_height int")
    assert layout.confidence_grid(df, images).groupBy("doc_id").count().orderBy("doc_id").collect() == [(0, 10), (1, 2)]


def test_text_functions(spark):
    r = one(spark.createDataFrame([("  Día  12 €5\tX_1 12.50 ",)], "t string").select(
        normalize_text(F.col("t")).alias("n"), ml_preprocess(F.col("t")).alias("m"),
        normalize_name(F.lit(" Invoice \n Number ")).alias("k")))
    assert r.n == "día 12  5 x_1 12.50" and r.k == "invoice number"
    assert r.m == "día NUMBER NUMBER x_1 NUMBER.NUMBER"


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (0.9, 0.7, 0.5, 0.3, 0.29)], "c double")
    assert [r.b for r in df.select(confidence_band(F.col("c")).alias("b")).collect()] == [
        "Very High", "High", "Medium", "Low", "Very Low"]


def test_source_lines_against_brute_force(spark):
    text = "Header\n\n  Total: 110.00  \nİstanbul total: 110.00\nvalue\nlast"
    values = ["110.00", " Value ", "header", "", "missing", "110.00  \nİs", "last", "İstanbul"]
    f = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "doc_id long, n int, value string")
    got = {r.n: r.line_idx for r in locate.locate_sources(f, docs(spark, text)).collect()}
    for i, v in enumerate(values):
        target = v.strip().lower()
        want = next((j for j, line in enumerate(text.split("\n"))
                     if target and line.strip() and target in line.strip().lower()), None)
        assert got[i] == want, v


def test_tables_round_trip(spark):
    text = "x\nItem\tQty\nA\t1\nB\t2\n\nfree text\nonly one  gap\nend"
    found = tables.detect_tables(docs(spark, text))
    t = one(found)
    assert (t.rows, t.cols, t.table_type, t.has_header) == (3, 2, "line_items", True)
    rebuilt = tables.rebuild_tables(found.select("doc_id", "table_idx", "rows", "cols"), tables.detected_cells(found))
    assert [(r.kind, r["values"]) for r in rebuilt.orderBy(F.desc("kind"), "row_no").collect()] == [
        ("header", ["Item", "Qty"]), ("data", ["A", "1"]), ("data", ["B", "2"])]


def test_pages_give_one_row_per_document(spark):
    pages = [(0, p, " \n") for p in range(1001)] + [(1, 0, ""), (1, 1500, "late text"), (2, 0, "a"), (2, 1, "b")]
    got = {r.doc_id: r for r in intake.assemble_pages(spark.createDataFrame(pages, "doc_id long, page long, text string")).collect()}
    assert (got[0].n_pages, got[0].basic_text, got[0].status) == (1001, None, "blank")
    assert (got[1].n_pages, got[1].basic_text, got[1].status) == (2, "--- Page 1501 ---\nlate text", "text")
    assert got[2].joined_text == "a" + rules.PAGE_BREAK + "b"


def test_detection_is_linear_in_the_lines(spark):
    import time
    text = "\n".join(f"a{i}\tb\nplain" for i in range(10_000)) + "\nx\ty\nz\tw"
    start = time.time()
    assert one(tables.detect_tables(docs(spark, text))).rows == 2
    assert time.time() - start < 20


def test_large_amounts_and_no_break_spaces(spark):
    got = {r.name: r.value for r in totals.totals_fields(totals.scan_totals(docs(
        spark, "paid $1,000,000,000,000,000,000.00\nTotal:\u00a0100.00\n7.50\u00a0$"))).collect()}
    assert got["Total Amount"] == "$100.00" and len(got) == 2
    huge = "9," * 0 + "$" + ",".join(["999"] * 14) + ".00"
    assert totals.totals_fields(totals.scan_totals(docs(spark, huge))).count() == 1


def test_wide_and_long_tables(spark):
    found = tables.detect_tables(docs(spark, "\n".join(f"r{i}\tv" for i in range(22_000))))
    assert tables.detected_cells(found).agg(F.countDistinct("cell_ord")).first()[0] == 44_000


def test_null_values_are_values(spark):
    pred, truth = fields(spark, ("A", None), ("B", None), ("C", "x")), fields(spark, ("A", "x"), ("B", None), ("D", None))
    got = {r.norm_name: r.outcome for r in evaluate.eval_fields(pred, truth).collect()}
    assert got == {"a": "mismatch", "b": "match", "c": "spurious", "d": "missing"}


def test_blank_request_is_none(spark):
    df = spark.createDataFrame([("invoice", "   ")], "doc_type string, user_fields string")
    assert one(suggest.suggest_fields(df)).suggested == rules.TEMPLATES["invoice"][:10]


def test_no_label_without_training_rows_is_predicted(spark):
    train = rules.cold_start_df(spark).filter("label < 2")
    model = ml.nb_model(train, terms.Space.of(terms.tfidf_vocab(train)), [0, 5, 1])
    none = ml.nb_predict(docs(spark, "The patient visit", "", "total total tax"), model).collect()
    assert all(r.label in (0, 1) and r.probs[1] == 0.0 for r in none)
