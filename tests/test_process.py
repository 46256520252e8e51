"""The composed process and its parts: votes and hints, merges in the row, sparse tables, keyword index, batches, sinks."""

import json
import random
import string

import pytest
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.text import strip
from paperloom.operators import classify as C
from paperloom.operators import evaluate, locate, merge, report, tables, validate
from paperloom.operators import samples as S
from paperloom.plans import process
from paperloom.plans.queries import QUERIES
from paperloom.sources import sinks
from paperloom.sources.corpus import MARKS, UNMARK, _drop, _joined_up, _unmarked, corpus_sql
from paperloom.streaming import batch_stream


# ---- votes and hints ---------------------------------------------------------------


def test_samples_without_a_type_vote_for_the_hint(spark):
    def raw(*types):
        return [json.dumps({"fields": [], **({"doc_type": t} if t else {})}) for t in types]
    rows = {0: raw(None, "receipt", "receipt"), 1: raw("receipt", None, "invoice"), 2: raw(None, "invoice", "receipt"), 3: ["no json [", "{", "["], 4: raw("receipt", "invoice", None)}
    data = [(d, n, r) for d, rs in rows.items() for n, r in enumerate(rs, 1)]
    df = spark.createDataFrame(data, "doc_id long, sample_no int, response string")
    votes = S.type_votes(S.valid_samples(S.parse_samples(df), F.lit(None).cast("string")))
    got = {r.doc_id: tuple(r.v) for r in votes.select("doc_id", S.voted_type(F.col("votes"), F.lit("invoice")).alias("v")).collect()}
    assert {k: got[k] for k in (0, 1, 2, 4)} == {0: ("receipt", 2), 1: ("invoice", 2), 2: ("invoice", 2), 4: ("invoice", 2)}


def test_votes_and_consensus_come_from_one_pass(spark):
    def raw(t, *fields):
        return json.dumps({"fields": [dict(zip(("name", "value", "confidence"), f)) for f in fields], **({"doc_type": t} if t else {})})
    rows = {0: [raw("bill", ("Total", " 5 ", 0.5), ("total ", "5", 1)), raw(None, ("Total", "6", 2)), raw("bill")], 1: ["no json", "{", ""],
            2: [raw(" bill ", ("A", None), ("A", "x"), ("B", "y"))], None: [raw("bill", ("A", "1")), raw("receipt", ("A", "2"))]}
    data = [(d, n, r) for d, rs in rows.items() for n, r in enumerate(rs, 1)] + [(0, 1, rows[0][0])]
    df = spark.createDataFrame(data, "doc_id long, sample_no int, response string")
    samples = S.valid_samples(S.parse_samples(df), F.lit(None).cast("string"))
    both = S.consensus_and_votes(samples).cache()
    fields = both.select("doc_id", F.explode("fields").alias("f")).select("doc_id", "f.*")
    agreed = S.field_consensus(S.sample_fields(samples))
    assert sorted(map(repr, fields.select(agreed.columns).collect())) == sorted(map(repr, agreed.collect())) and agreed.count() > 2
    votes = S.type_votes(samples).filter("n_samples > 0").select("doc_id", F.sort_array("votes").alias("votes"), "n_samples")
    assert sorted(map(repr, both.select("doc_id", F.sort_array("votes").alias("votes"), "n_samples").collect())) == sorted(map(repr, votes.collect()))
    both.unpersist()
    docs = spark.createDataFrame([(0, "x", "image/png")], "doc_id long, text string, mime string")
    plan = process.scored_fields(docs, df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(StructField(doc_type") == 1


def test_fields_without_a_key_are_told_from_null_ones(spark):
    fields = ['{"name":"a","value":null}', '{"name":"a"}', '{"name":"a","value":"1","confidence":null}', '{"name":"a","value":"1"}', '{"value":"1"}',
              '{"name":"a","value":"1","confidence":"1.5"}', '{"name":"a","value":"1","confidence":"high"}', "null"]
    valid = [True, False, False, True, False, True, False, False]
    answers = [f'{before}{{"fields":[{f}]}}{after}' for f in fields for before, after in (("", ""), (" \n", "\u00a0"), ("so: ", " done"))]
    raw = spark.createDataFrame([(n, 1, a) for n, a in enumerate(answers)], "doc_id long, sample_no int, response string")
    got = {r.doc_id: r for r in S.valid_samples(S.parse_samples(raw)).collect()}
    assert [got[n].valid for n in range(len(answers))] == [v for v in valid for _ in range(3)]
    assert [got[n].status for n in range(3)] == ["ok", "ok", "recovered"] and got[0].fields[0].value == "None" and got[15].fields[0].confidence == 1.0


def test_process_without_samples_or_recogniser(spark):
    docs = spark.createDataFrame([(0, "INVOICE\nTotal: $5.00", "application/pdf"), (1, "INVOICE\nTotal: $5.00", "text/csv"), (2, None, None), (3, "", "image/png")], "doc_id long, text string, mime string")
    answer = json.dumps({"fields": [{"name": "Total", "value": "$5.00", "confidence": 0.8}]})
    raw = spark.createDataFrame([(0, 1, answer), (1, 1, answer)], "doc_id long, sample_no int, response string")
    rows = {r.doc_id: r for r in process.process_documents(docs, raw).collect()}
    assert len(rows) == 4 and rows[0].doc_type == rows[0].output_type != "unknown"
    assert (rows[0].n_located, rows[1].n_located) == (1, 0)
    assert rows[2].doc_type == rows[3].doc_type == "unknown" and rows[2].n_samples == 0 and rows[2].pass_rate == 0


# ---- merges in the row ----------------------------------------------------------------


def test_merge_in_row_equals_the_merge_of_tables(spark):
    rng = random.Random(4)
    names = ["a", "b", "c", "", "é"]
    docs, flat = [], {n: [] for n in merge.PRECEDENCE}
    for d in range(60):
        row = {n: [(rng.choice(names), rng.choice(["x", "y", None, ""])) for _ in range(rng.randint(0, 6))] for n in merge.PRECEDENCE}
        docs.append((d, *[row[n] for n in merge.PRECEDENCE]))
        for n in merge.PRECEDENCE:
            flat[n] += [(d, a, v, i) for i, (a, v) in enumerate(row[n]) if v is not None]
    pair = "array<struct<name:string,value:string>>"
    df = spark.createDataFrame(docs, f"doc_id long, base {pair}, `table` {pair}, totals {pair}, line {pair}")
    got = sorted(tuple(r) for r in merge.merge_in_row(df, **{n: F.col(f"`{n}`") for n in merge.PRECEDENCE}).collect())
    want = sorted(tuple(r) for r in merge.merge_fields(**{n: spark.createDataFrame(flat[n], "doc_id long, name string, value string, ord long") for n in flat}).collect())
    assert got == want and len(got) > 100


def test_many_fields_of_one_document_merge_in_its_row(spark):
    n = 100_000
    df = spark.range(1).select(F.lit(1).alias("doc_id"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        F.concat(F.lit("f"), (i % (n // 2)).cast("string")).alias("name"), i.cast("string").alias("value"))).alias("p"))
    out = merge.merge_in_row(df, base=F.col("p"))
    assert out.agg(F.count("*"), F.min(F.col("value").cast("int"))).first()[:] == (n // 2, n // 2)


# ---- sparse tables --------------------------------------------------------------------


def answers(spark, *bodies):
    return tables.parse_tables(spark.createDataFrame([(i, json.dumps({"tables": b}) if not isinstance(b, str) else b) for i, b in enumerate(bodies)], "doc_id long, json string"))


def test_a_stated_size_costs_nothing(spark):
    huge = {"columns": 2_000_000_000, "rows": 2_000_000_000, "headers": ["A", " "], "data": [["1", "2"], [], ["3"]]}
    grids = tables.sparse_tables(answers(spark, [huge], [{"rows": 2, "columns": 1, "headers": ["A", "cut"], "data": [["1", "cut"], ["cut"]]}], [{"rows": 0, "columns": 5, "data": [["x"]]}], "no json"))
    rows = sorted((r.doc_id, r.kind, r.row_no, r.rows, r.cols, [tuple(c) for c in r.cells]) for r in tables.sparse_rows(grids).collect())
    n = 2_000_000_000
    assert rows == [(0, "data", 1, n, n, [(0, "1"), (1, "2")]), (0, "data", 3, n, n, [(0, "3")]), (0, "header", 0, n, n, [(0, "A"), (1, " ")]),
                    (1, "data", 1, 2, 1, [(0, "1")]), (1, "header", 0, 2, 1, [(0, "A")])]
    dense = sorted((r.doc_id, r.kind, r.row_no, r["values"]) for r in tables.dense_rows(grids).collect())
    assert dense == [(1, "data", 1, ["1"]), (1, "header", 0, ["A"])]


def test_dense_rows_equal_the_rebuilt_cells(spark):
    rng = random.Random(7)
    bodies = []
    for _ in range(40):
        cell = lambda: rng.choice(["a", "", " ", "Total 5", None])
        t = {"data": [[cell() for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(0, 4))]}
        if rng.random() < 0.7:
            t["headers"] = [cell() for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.6:
            t |= {"rows": rng.randint(0, 5), "columns": rng.randint(0, 5)}
        bodies.append([t])
    t = answers(spark, *bodies)
    got = sorted((r.doc_id, r.table_idx, r.kind, r.row_no, r["values"]) for r in tables.dense_rows(tables.sparse_tables(t)).collect())
    want = sorted((r.doc_id, r.table_idx, r.kind, r.row_no, r["values"]) for r in tables.rebuild_tables(t, tables.explode_cells(t)).collect())
    assert got == want and got


def test_no_table_is_left_out_for_its_stated_size(spark):
    """Rows and cells of a huge table add up to its stated size; spelled out they equal the dense ones."""
    n = 2_000_000_000
    bodies = [[{"rows": n, "columns": n, "headers": ["A", " "], "data": [["1", "2"], [], ["3"]]}], [{"rows": n, "columns": 1, "data": []}], [{"rows": 1, "columns": n, "headers": ["H"], "data": [["x"]]}],
              [{"rows": 4, "columns": 3, "headers": ["", ""], "data": [[], ["a", None], ["b"]]}], [{"rows": 2, "columns": 2, "headers": ["A"], "data": [["1", "2"]]}]]
    grids = tables.sparse_tables(answers(spark, *bodies))
    got = sorted((r.doc_id, r.kind, r.row_no, r["values"], r.n_rows, r.n_cols) for r in tables.table_rows(grids).collect())
    assert got[:8] == [(0, "data", 1, ["1", "2"], 1, n), (0, "data", 2, [], 1, n), (0, "data", 3, ["3"], 1, n), (0, "data", 4, [], n - 4, n), (0, "header", 0, ["A", " "], 1, n),
                       (1, "data", 0, [], n, 1), (2, "data", 0, ["H"], 1, n), (2, "header", 0, ["H"], 1, n)]
    spelled = [(d, k, first + i, v + [""] * (c - len(v))) for d, k, first, v, m, c in
               (tuple(r) for r in tables.table_rows(grids.filter("doc_id > 2"), 0).select("doc_id", "kind", "row_no", "values", "n_rows", "n_cols").collect()) for i in range(m)]
    assert sorted(spelled) == sorted((r.doc_id, r.kind, r.row_no, r["values"]) for r in tables.dense_rows(grids).collect()) and len(spelled) == 6


# ---- keyword index -------------------------------------------------------------------


def test_keyword_index_equals_a_search_of_every_keyword(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", None, "a", "É é"]
    keywords = sorted({word() for _ in range(400)} | {"a b", "é", "ab cd", "", "zzzz", " "})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    norm = {r.doc_id: r.norm for r in C.with_normalized(docs).collect()}
    got = sorted(tuple(r) for r in C.keyword_hits(docs, spark.createDataFrame([(k,) for k in keywords], "keyword string")).collect())
    assert got == sorted((i, k) for i, t in norm.items() if t for k in keywords if k and k in t)
    assert C.keyword_hits(docs, spark.createDataFrame([], "keyword string")).count() == 0


def test_many_rules_give_few_candidates(spark, sf_dir):
    """20,000 keywords: what an index gram lets through is a small multiple of what is found, and texts aren't copied."""
    rng = random.Random(5)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = [r.w for r in docs.select(F.explode(F.split("text", " ")).alias("w")).filter("length(w) > 5").distinct().orderBy("w").limit(3000).collect()]
    keywords = {w.lower() for w in found} | {"".join(rng.choice(string.ascii_lowercase) for _ in range(8)) for _ in range(17_000)}
    table = spark.createDataFrame([("invoice", i, [k], 1.0, None) for i, k in enumerate(sorted(keywords))], "doc_type string, pattern_id int, keywords array<string>, weight double, position string")
    hits = C.keyword_hits(docs, table.select(F.explode("keywords").alias("keyword")))
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(norm") == 1
    n_hits = hits.count()
    norm = C.with_normalized(docs)
    keyed = table.select(F.explode("keywords").alias("keyword")).withColumn("gram", F.explode(F.array_distinct(C._grams(F.col("keyword"), C.GRAM))))
    grams = norm.select("doc_id", F.explode(F.array_distinct(C._grams(F.col("norm"), C.GRAM))).alias("gram"))
    df = grams.groupBy("gram").count()
    rarest = keyed.join(df, "gram").groupBy("keyword").agg(F.min("count").alias("n"), F.count("*").alias("present"))
    whole = rarest.join(table.select(F.explode("keywords").alias("keyword")).withColumn("grams", F.size(F.array_distinct(C._grams(F.col("keyword"), C.GRAM)))), "keyword").filter("present = grams")
    candidates = whole.agg(F.sum("n")).first()[0]
    assert n_hits > 3000 and candidates < 12 * n_hits, (n_hits, candidates)
    scores = C.keyword_scores_by_rules(docs, table).agg(F.sum("score")).first()[0]
    assert scores == pytest.approx(n_hits)


# ---- batches, sinks, reports ------------------------------------------------------------


def test_batches_set_failures_apart_and_survive_a_restart(spark, tmp_path):
    schema = "doc_id long, mime string, size_bytes long, text string"
    good = [(1, "application/pdf", 5, "INVOICE total"), (2, "image/png", 0, "RECEIPT")]
    bad = {3: (None, 5, "x"), 4: ("image/png", None, "x"), 5: ("image/png", -1, "x"), 6: ("image/png", 5, None), 7: ("image/png", 5, " \n")}
    source, out = str(tmp_path / "in"), {k: str(tmp_path / k) for k in ("results", "quarantine", "checkpoint")}
    seen = []

    def run():
        work = lambda g: (seen.append(g.count()), C.classify(g).select("doc_id", "doc_type"))[1]
        batch_stream.start_batches(spark.readStream.schema(schema).parquet(source), work, **out).awaitTermination()
        return {k: sorted(r.doc_id for r in spark.read.parquet(out[k]).collect()) for k in ("results", "quarantine")}

    spark.createDataFrame(good[:1] + [(i, *v) for i, v in bad.items()], schema).coalesce(1).write.parquet(source)
    assert run() == {"results": [1], "quarantine": [3, 4, 5, 6, 7]}
    spark.createDataFrame(good[1:], schema).coalesce(1).write.mode("append").parquet(source)
    assert run() == {"results": [1, 2], "quarantine": [3, 4, 5, 6, 7]} == run() and seen == [1, 1]
    errors = {r.doc_id: r.error for r in spark.read.parquet(out["quarantine"]).collect()}
    assert errors == {3: "missing type", 4: "unreadable size", 5: "unreadable size", 6: "no text", 7: "empty document"}


def test_running_one_type_again_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "records")
    df = spark.createDataFrame([(1, "invoice", "{}"), (2, "receipt", "{}"), (3, "invoice", "{}")], "doc_id long, doc_type string, record string")
    read = lambda: sorted((r.doc_type, r.value) for r in spark.read.text(path).collect())
    sinks.write_records(df, path)
    first = read()
    again = df.filter("doc_type = 'invoice'").withColumn("record", F.lit('{"v":2}'))
    for _ in range(2):
        sinks.write_records(again, path)
        assert read() == [("invoice", '{"doc_id":1,"record":{"v":2}}'), ("invoice", '{"doc_id":3,"record":{"v":2}}'), first[2]]


def test_fields_that_cannot_be_judged_fail_with_rate_0(spark):
    rows = [(1, "a", None, 1.0, 1, 0), (1, "b", None, 1.0, 2, 0), (2, "a", True, 1.0, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, norm_name string, valid boolean, num double, ord long, n_low int")
    got = {r.doc_id: r for r in validate.summarize_names(df).collect()}
    assert (got[1].pass_rate, got[1].failed_rules, got[1].status) == (0.0, ["validation_error"], "validation_error")
    assert (got[2].pass_rate, got[2].failed_rules, got[2].status) == (1.0, [], "ok")


def test_report_counts_a_document_once_and_null_names_are_not_totals(spark):
    classed = spark.createDataFrame([(1, "invoice", 0.9, "high"), (2, None, 0.5, "low"), (3, "invoice", 0.7, "high")], "doc_id long, doc_type string, confidence double, confidence_level string")
    qa = spark.createDataFrame([(1, "failed", "r1"), (1, "failed", "r2"), (1, "passed", "r3"), (3, "failed", "r1")], "doc_id long, outcome string, rule string")
    rows = {(r.grouping_id, r.doc_type, r.confidence_level, r.failed_rule): (r.n_docs, r.mean_confidence) for r in report.corpus_report(classed, qa).collect()}
    assert rows[7, None, None, None] == (3, pytest.approx(0.7)) and rows[3, None, None, None] == (1, 0.5) and rows[3, "invoice", None, None] == (2, pytest.approx(0.8))
    assert rows[6, None, None, "r1"] == (2, pytest.approx(0.8)) and rows[6, None, None, "none"] == (1, 0.5) and rows[6, None, None, "r2"] == (1, 0.9)
    outcomes = spark.createDataFrame([(1, None, "match"), (1, "a", "missing")], "doc_id long, norm_name string, outcome string")
    by = {(r.level, r.norm_name): (r.tp, r.fn) for r in evaluate.eval_by_field(outcomes).collect()}
    assert by == {("corpus", None): (1, 1), ("field", None): (1, 0), ("field", "a"): (0, 1)}


def test_records_carry_the_voted_type(spark, sf_dir):
    voted = {r.doc_id: r.doc_type for r in QUERIES["process_file"](spark, sf_dir).collect()}
    records = QUERIES["export_json"](spark, sf_dir).collect()
    assert {r.doc_id: r.doc_type for r in records} == voted and all(json.loads(r.record)["doc_type"] == r.doc_type for r in records[:200])
    assert any(t == "receipt" for t in voted.values()) and set(voted.values()) <= set(rules.OUTPUT_TYPES.values()) | set(rules.DOC_TYPES) | {"unknown", "prescription"}


def test_a_document_with_very_many_fields_is_searched_once(spark):
    """100,000 values in one document: the first line that holds each, as a search of every value finds it."""
    rng = random.Random(6)
    lines = [" ".join(rng.choice(["Alpha", "beta", "É", "x1", "", "Total:"]) + str(rng.randint(0, 30_000)) for _ in range(6)) for _ in range(3_000)]
    text = "\n".join(lines)
    low = text.lower()
    values = [f" {rng.choice(['alpha', 'BETA', 'é', 'X1', 'none'])}{i % 40_000} " for i in range(99_996)] + ["", "\n", "a\nb", None]
    rows = [(1, i, v) for i, v in enumerate(values)] + [(2, 0, "lost"), (3, 0, "b")]
    fields = spark.createDataFrame(rows, "doc_id long, n int, value string").repartition(5)
    docs = spark.createDataFrame([(1, text), (2, None), (3, "a\nB\nb")], "doc_id long, text string")
    got = {(r.doc_id, r.n): r for r in locate.locate_sources(fields, docs).collect()}
    assert len(got) == len(rows) and got[2, 0].line_idx is None and (got[3, 0].line_idx, got[3, 0].bbox) == (1, [0.0, 25.0, 8.0, 45.0])
    for i in [*range(0, 99_996, 37), *range(99_996, 100_000)]:
        target = (values[i] or "").strip().lower()
        at = low.find(target) if target and "\n" not in (values[i] or "") else -1
        line = low.count("\n", 0, at) if at >= 0 else None
        r = got[1, i]
        assert r.line_idx == line and r.source_confidence == (0.5 if line is None else 0.9)
        assert line is None or r.bbox == [0.0, 25.0 * line, 8.0 * len(lines[line]), 25.0 * line + 20]


def test_rule_words_are_found_in_one_pass(spark):
    """The words of all rules, however they lie in one another, are those that a search for each would find; a text is
    gone through once and not once for each word."""
    words = list(C.rule_words())
    texts = ["", "billing address bill to", "xbillx ybilling", "due dat due date", "interestate internet", "total amount due", "eurtaxmgml",
             *words, " ".join(words), "".join(words), *[w[:-1] for w in words], *[a[:-1] + b for a, b in zip(words, words[1:])]]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, norm string")
    found = C.with_rule_words(docs).select("doc_id", "norm", F.array(*[C._hits([w]) for w in words]).alias("hits"), C._hits(words).alias("n"))
    for r in found.collect():
        expected = [None if r.norm is None else int(w in r.norm) for w in words]
        assert r.hits == expected and r.n == (None if r.norm is None else sum(expected)), r.norm
    plan = C.classify(docs.withColumnRenamed("norm", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(norm" not in plan and plan.count("regexp_extract_all(norm") == 1


def test_strip_trims_only_what_has_white_space_at_an_end(spark):
    values = ["", " ", "a", " a", "a\u3000", "\x85a b\x0b", "a b", "\n\t", "é ", "\u2028é\u00a0é", "𝄞", " 𝄞", None]
    rows = spark.createDataFrame(list(enumerate(values)), "i long, v string").select("v", strip(F.col("v")).alias("s"))
    assert [r.s for r in rows.collect()] == [None if v is None else v.strip() for v in values]
    assert "CASE WHEN" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_rendering_reads_no_format(spark):
    """Concatenated templates give the text that printf gives, also for keys below zero, which have no type, and none."""
    orders = spark.sql("SELECT CASE WHEN id < 0 AND id % 50 = 0 THEN NULL ELSE id END AS o_orderkey, id % 3 AS o_custkey, DATE'2020-01-31' AS o_orderdate, 1234.5D AS o_totalprice FROM range(-150, 150)")
    customer = spark.sql("SELECT id AS c_custkey, 0L AS c_nationkey, \"it's 5% %s\" AS c_name, 'SEG' AS c_mktsegment FROM range(3)")
    nation = spark.sql("SELECT 0L AS n_nationkey, 'PERU' AS n_name")
    items = spark.sql("SELECT id AS l_orderkey, 100.25D + id AS l_extendedprice FROM range(-150, 150) WHERE id % 4 > 0")
    tables = {"orders": orders, "customer": customer, "nation": nation, "lineitem": items}
    sql = corpus_sql(["text", "truth_text", "tables_json", "response_1", "response_2", "response_3"], *(f"<<{t}>>" for t in tables))
    joined = _joined_up(sql)
    assert "printf(" in sql and "printf(" not in joined

    def render(select):
        select = select.replace("{", "{{").replace("}", "}}")
        for t in tables:
            select = select.replace(f"<<{t}>>", "{" + t + "}")
        return sorted(map(repr, spark.sql(select, **tables).collect()))
    assert render(joined) == render(sql)


def test_marks_are_cut_out_without_a_lookup_for_each_character(spark):
    whole, first, last = MARKS[0] + "a" + MARKS[1] + "b" + MARKS[2] + "c", MARKS[0], UNMARK[-1]
    texts = [whole, "", None, "plain", first, first + first, whole + MARKS[1] + "again", last + "é" + last + "z", MARKS[2] + "late" + MARKS[1]]
    df = spark.createDataFrame([(n, x, j) for n, x in enumerate(texts) for j in (0, 1, 2, 9, None)], "n int, x string, j int")
    old = f"concat_ws('/', translate(x, '{UNMARK}', ''), {_drop('x', 'j')}, split_part(x, '{last}', 2), split_part(x, '{last}', 1))"
    new = _unmarked(old)
    assert "translate" not in new and "split_part" not in new
    assert all(r.old == r.new for r in df.select(F.expr(old).alias("old"), F.expr(new).alias("new")).collect())
    sql = _unmarked(_joined_up(corpus_sql(["text", "truth_text", "response_1", "response_2", "response_3"])))
    assert "translate" not in sql and sql.count("split_part") == 1  # the nested one, for a third of the third responses


def test_the_search_for_rule_words_has_only_short_choices(spark):
    pattern, depth, width = C._longest(list(C.rule_words())), 0, {}
    for ch in pattern:
        if ch == "(":
            depth += 1
            width[depth] = 1
        elif ch == ")":
            depth -= 1
        elif ch == "|":
            width[depth] += 1
            assert width[depth] <= 2 * C.FEW
    docs = spark.createDataFrame([(0, "subtotal amount due date"), (1, "a bill total"), (2, "xylem"), (3, "")], "doc_id long, norm string")
    for r in C.with_rule_words(docs).collect():
        want = C._masks([w for w in C.rule_words() if w in r.norm])
        assert [r[c] for c in C._mask_columns()] == want
