"""Business-document corpus rendered from the order tables.

One document per order: type-specific title, labelled lines, an optional small
table and a footer, with controlled damage (missing and repeated fields, odd
amount and date formats, blank lines, empty documents).  The same SELECT runs
unchanged on any ANSI SQL engine, so tests can render the identical corpus
elsewhere.  Next to the text it renders what a hosted extractor would send
back: three JSON responses per document and one table response.

The work is one shuffle of pre-aggregated line items on the order key; every
text is built by scalar expressions in the row.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import work_dir
from paperloom.sources.tables import read_table

NL = "chr(10)"
SLOTS = 10
# Private-use characters that mark the start of each field in a template.
MARKS = "".join(chr(0xE000 + j) for j in range(21))
# More of them open and close stretches that damage may cut out.
TAGS = {name: (chr(0xE020 + 2 * i), chr(0xE021 + 2 * i)) for i, name in enumerate(("value", "name", "opt"))}
UNMARK = MARKS + "".join(a + b for a, b in TAGS.values())


def _cat(*parts: str) -> str:
    """NULL-propagating concatenation (the same on every engine)."""
    return "(" + " || ".join(parts) + ")"


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _two(x: str) -> str:
    return f"lpad({_s(x)}, 2, '0')"


def _lit(text: str) -> str:
    """SQL string literal; line feeds and tabs become function calls."""
    quoted = "'" + text.replace("'", "''") + "'"
    return quoted.replace("\n", f"' || {NL} || '").replace("\t", "' || chr(9) || '")


def _plain(c: str) -> str:
    """Cents as 1234.50."""
    return _cat(_s(f"CAST(({c} - {c} % 100) / 100 AS BIGINT)"), "'.'", _two(f"{c} % 100"))


def _grouped(c: str) -> str:
    """Cents as 1,234.50 (below one billion)."""
    i = f"CAST(({c} - {c} % 100) / 100 AS BIGINT)"
    k = f"CAST(({i} - {i} % 1000) / 1000 AS BIGINT)"
    m = f"CAST(({i} - {i} % 1000000) / 1000000 AS BIGINT)"
    low, mid_part = f"lpad({_s(f'{i} % 1000')}, 3, '0')", f"lpad({_s(f'{k} % 1000')}, 3, '0')"
    cents = _cat("'.'", _two(f"{c} % 100"))
    return (f"CASE WHEN {i} >= 1000000 THEN {_cat(_s(m), _lit(','), mid_part, _lit(','), low, cents)} "
            f"WHEN {i} >= 1000 THEN {_cat(_s(k), _lit(','), low, cents)} "
            f"ELSE {_cat(_s(i), cents)} END")


def _money(c: str) -> str:
    """Cents in the document's own style; style 3 prints a single decimal."""
    tenth = _cat(_s(f"CAST(({c} - {c} % 100) / 100 AS BIGINT)"), "'.'",
                 _s(f"CAST(({c} % 100 - {c} % 10) / 10 AS BIGINT)"))
    return (f"CASE d % 6 WHEN 1 THEN {c}_plain WHEN 2 THEN {_cat(_lit('$'), f'{c}_grouped')} "
            f"WHEN 3 THEN {tenth} WHEN 5 THEN {_cat(f'{c}_grouped', _lit(' USD'))} ELSE {c}_grouped END")


def _us_date(t: str) -> str:
    return _cat(_two(f"month({t})"), "'/'", _two(f"day({t})"), "'/'", _s(f"year({t})"))


def _date(t: str) -> str:
    """Date in the document's own style; one style is no date at all."""
    y, m, d = f"year({t})", f"month({t})", f"day({t})"
    iso = _cat(_s(y), "'-'", _two(m), "'-'", _two(d))
    return (f"CASE WHEN d % 37 = 0 THEN {_cat(_s(y), _two(m), _two(d))} "
            f"WHEN d % 37 = 1 THEN {_cat(iso, _lit('T10:00'))} "
            f"WHEN d % 4 = 1 THEN {iso} "
            f"WHEN d % 4 = 2 THEN {_cat(_s(m), _lit('-'), _s(d), _lit('-'), _two(f'{y} % 100'))} "
            f"WHEN d % 8 = 3 THEN {_cat(_lit('day '), _s(d), _lit(' of month '), _s(m))} "
            f"ELSE {_us_date(t)} END")


# What each @token@ of a template stands for.
TOKENS = {
    "id": "ds", "cust": "cust", "nation": "nation", "seg": "seg", "lines": "count_s",
    "sub": "sub_c_printed", "tax": "tax_c_printed", "tot": "tot_c_printed",
    "sub!": "sub_c_plain", "tax!": "tax_c_plain", "tot!": "tot_c_plain",
    "od": "od_printed", "later": "later_printed", "past": "past_printed",
    "od!": "od_known", "later!": "later_known", "past!": "past_known",
    "invoice": "CASE WHEN d % 21 = 0 THEN 'A1' ELSE 'INV-' || ds END",
    "pay": "CASE WHEN d % 2 = 0 THEN 'Credit Card' ELSE 'Cash' END",
    "account": "CASE WHEN d % 15 = 5 THEN '12' ELSE '40' || lpad(ds, 8, '0') END",
    "route": "lpad(ds, 9, '1')",
    "period": "CAST(month(od) AS STRING) || ' of ' || CAST(year(od) AS STRING)",
    "service": "CASE d % 3 WHEN 0 THEN 'Electricity' WHEN 1 THEN 'Water' ELSE 'Gas' END",
    "finding": "CASE d % 3 WHEN 0 THEN 'seasonal allergy' WHEN 1 THEN 'sprained ankle' ELSE 'hypertension' END",
    "drug": "CASE WHEN d % 2 = 0 THEN 'Ibuprofen 200 mg tablet' ELSE 'none' END",
    "small": "CAST(d % 4 + 1 AS STRING)",
    "medium": "CAST(d % 70 AS STRING)",
    "ruling": "CASE WHEN d % 2 = 0 THEN 'pending' ELSE 'dismissed' END",
}
_NEEDS_ITEMS = ("@sub@", "@tax@", "@tot@", "@lines@")

# label, template of the printed value (known values use the "!" tokens)
FIELDS = {
    "invoice": [("Invoice Number", "@invoice@"), ("Invoice Date", "@od@"), ("Due Date", "@later@"),
                ("Vendor Name", "@nation@ Trading"), ("Bill To", "@cust@"), ("Subtotal", "@sub@"),
                ("Tax Amount", "@tax@"), ("Total Amount", "@tot@"), ("Payment Terms", "Net 30"),
                ("Quantity", "@lines@")],
    "receipt": [("Store Name", "@seg@ Store"), ("Transaction Date", "@od@"),
                ("Transaction Number", "T@id@"), ("Subtotal", "@sub@"), ("Tax", "@tax@"),
                ("Total Amount", "@tot@"), ("Payment Method", "@pay@"), ("Cashier ID", "C@medium@"),
                ("Change Given", "0.00")],
    "contract": [("Contract Number", "K-@id@"), ("Effective Date", "@od@"),
                 ("Expiration Date", "@later@"), ("Party 1", "@cust@"), ("Party 2", "@nation@ Holdings"),
                 ("Contract Value", "@tot@"), ("Terms", "renewed yearly unless ended in writing"),
                 ("Signature Date", "@od@"), ("Witness", "Officer @medium@")],
    "bill": [("Account Number", "@account@"), ("Billing Period", "@period@"), ("Due Date", "@later@"),
             ("Amount Due", "@tot@"), ("Previous Balance", "@tax@"), ("Current Charges", "@sub@"),
             ("Service Address", "@medium@ Main Street, @nation@"), ("Usage Amount", "@lines@1 kWh"),
             ("Service Type", "@service@")],
    "medical": [("Patient Name", "@cust@"), ("Date of Birth", "@past@"), ("Doctor Name", "Dr. @nation@"),
                ("Visit Date", "@od@"), ("Diagnosis", "@finding@"), ("Medications", "@drug@"),
                ("Dosage", "@small@ per day"), ("Insurance Information", "Plan @seg@"),
                ("Medical Record Number", "MR@id@"), ("Balance", "@tot@")],
    "financial": [("Account Number", "@account@"), ("Statement Date", "@od@"),
                  ("Account Holder", "@cust@"), ("Balance", "@tot@"),
                  ("Transactions", "@lines@ deposit and withdrawal items"),
                  ("Interest Rate", "@small@.5%"), ("Fees", "@tax@"), ("Bank Name", "@nation@ Bank"),
                  ("Routing Number", "@route@")],
    "legal": [("Case Number", "CV-@id@"), ("Court Name", "@nation@ District Court"),
              ("Plaintiff", "@cust@"), ("Defendant", "@seg@ Partners"), ("Attorney", "Counsel @medium@"),
              ("Filing Date", "@od@"), ("Hearing Date", "@later@"), ("Judgment", "@ruling@"),
              ("Legal Citations", "statute 12, code 44")],
}
TYPE_NAMES = list(FIELDS)

_TITLES = {
    "invoice": ("INVOICE", "Please arrange payment due on receipt"),
    "receipt": ("STORE RECEIPT", "Thank you, visit again"),
    "contract": ("SERVICE AGREEMENT", "The contractor and the client accept this obligation and liability, executed by signature"),
    "bill": ("UTILITY BILL", "Monthly charges for your service"),
    "medical": ("PATIENT VISIT SUMMARY", "Vital signs: blood pressure 120 mmHg, temperature 37 °C at the clinic"),
    "financial": ("ACCOUNT STATEMENT", "Transfer fee and interest charge apply to this bank account"),
    "legal": ("NOTICE OF MOTION", "Whereas the court has jurisdiction, counsel hereby requests discovery"),
}

_GOODS = ["Description|Quantity|Amount", "Goods|@lines@|@sub!@", "Freight due 01/02/2020|1|0.00",
          "Total amount|@lines@0|@tot!@"]
_RATES = ["Code|Rate|Zone", "Z9|@small@%|@nation@"]


def _known(template: str) -> str:
    for t in ("sub", "tax", "tot", "od", "later", "past"):
        template = template.replace(f"@{t}@", f"@{t}!@")
    return template


def _printf(template: str) -> str:
    """One printf call for a template with @token@ placeholders."""
    tokens = re.findall(r"@([a-z]+!?)@", template)
    fmt = re.sub(r"@[a-z]+!?@", "%s", template.replace("%", "%%"))
    args = "".join(f", {_token_column(t)}" for t in tokens)
    return f"printf({_lit(fmt)}{args})"


def _token_column(token: str) -> str:
    return "tk_" + token.replace("!", "_known")


def _marked(t: str, items: bool, render) -> str:
    """Concatenate the rendered fields of a type, a mark before each and one at the end."""
    out = []
    for j in range(SLOTS):
        piece = ""
        if j < len(FIELDS[t]):
            label, printed = FIELDS[t][j]
            if items or not any(tok in printed for tok in _NEEDS_ITEMS):
                piece = render(j, label, printed)
        out.append(MARKS[j] + piece)
    return "".join(out) + MARKS[SLOTS]


def _choose(render) -> str:
    """CASE over type and presence of line items, one printf per branch."""
    templates = [render(t, True) for t in TYPE_NAMES] + [render(t, False) for t in TYPE_NAMES]
    return f"CASE variant {' '.join(f'WHEN {i} THEN {_printf(x)}' for i, x in enumerate(templates))} END"


def _drop(expr: str, j: str) -> str:
    """Cut the j-th marked field out of a template (nothing when j is beyond the last)."""
    start, end = f"substring({_lit(MARKS)}, CAST({j} AS INT) + 1, 1)", f"substring({_lit(MARKS)}, CAST({j} AS INT) + 2, 1)"
    return _cat(f"split_part({expr}, {start}, 1)", f"split_part({expr}, {end}, 2)")


def _by_type(values: list[str]) -> str:
    return f"CASE CAST(d % 7 AS INT) {' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(values))} END"


def _lines(rows: list[str], sep: str) -> str:
    return "\n".join(r.replace("|", sep) for r in rows) + "\n"


# Optional pieces of a document, and the varying parts of responses.
PIECES = {
    "type": _by_type([_lit(t) for t in TYPE_NAMES]),
    "title": "CASE WHEN d % 12 = 7 THEN 'page 1' WHEN d % 21 = 18 THEN 'PRESCRIPTION' ELSE "
             + _by_type([_lit(_TITLES[t][0]) for t in TYPE_NAMES]) + " END",
    "foot": "CASE WHEN d % 12 = 7 THEN 'end' ELSE "
            + _by_type([_lit(_TITLES[t][1]) for t in TYPE_NAMES]) + " END",
    "blank": f"CASE WHEN d % 4 = 1 THEN {NL} ELSE '' END",
    "accent": "CASE WHEN d % 8 = 5 THEN " + _lit("Café crème à Genève 12.50$\n") + " ELSE '' END",
    "note": "CASE WHEN d % 9 = 4 THEN " + _lit("  indented note   with   spaces \n") + " ELSE '' END",
    "copy": "CASE WHEN d % 14 = 6 THEN " + _lit("COPY\n") + " WHEN d % 14 = 8 THEN "
            + _lit("CUSTOMER COPY\n") + " ELSE '' END",
    "confa": "CASE WHEN d % 23 = 6 THEN '\"0.9\"' WHEN d % 29 = 7 THEN '1.7' WHEN d % 29 = 8 THEN '-0.4' ELSE '0.86' END",
    "confb": "CASE WHEN d % 37 = 9 THEN '\"high\"' ELSE '0.56' END",
    "zeroa": "CASE WHEN d % 16 = 1 THEN '0.0' ELSE '0.80' END",
    "zerob": "CASE WHEN d % 16 = 1 THEN '0.0' ELSE '0.68' END",
    "typeb": "CASE WHEN d % 5 = 0 THEN 'unknown' ELSE tk_type END",
    "typec": "CASE WHEN d % 15 = 0 THEN 'receipt' ELSE tk_type END",
    "kind": "CASE d % 4 WHEN 0 THEN ',\"type\":\"line_items\"' WHEN 1 THEN ',\"type\":\"summary\"' ELSE '' END",
    "dims": "CASE WHEN d % 70 = 13 THEN ',\"rows\":3,\"columns\":2000000000' WHEN d % 70 = 24 THEN ',\"rows\":2000000000,\"columns\":3' "
            "WHEN d % 5 = 0 THEN '' WHEN d % 5 = 1 THEN ',\"rows\":3,\"columns\":3' "
            "WHEN d % 5 = 2 THEN ',\"rows\":0,\"columns\":3' ELSE ',\"rows\":4,\"columns\":3' END",
    "headers": "CASE WHEN d % 4 = 1 THEN '' WHEN d % 4 = 2 THEN ',\"headers\":[\"\",\" \",\"\"]' "
               "ELSE ',\"headers\":[\"Item\",\"Qty\",\"Amount\"]' END",
}
# Pieces that are templates themselves.
FILLED = {
    "again": "CASE WHEN d % 10 = 3 THEN " + _printf("Due Date: @later!@\n") + " ELSE '' END",
    "table": ("CASE WHEN n_lines IS NULL THEN '' WHEN d % 5 = 0 THEN " + _printf(_lines(_GOODS, "\t"))
              + " WHEN d % 5 = 1 THEN "
              + _printf(_lines(_GOODS, "  ") + "Rates in force\n" + _lines(_RATES, "   "))
              + " WHEN d % 10 = 2 THEN " + _printf(_lines(_RATES, "   ")) + " ELSE '' END"),
    "pos": "CASE WHEN d % 3 = 0 THEN '' ELSE "
           + _printf(',"position":{"x":@small@,"y":@medium@,"width":200,"height":80}') + " END",
    "last": "CASE WHEN d % 6 = 1 THEN '[\"Total\"]' WHEN d % 6 = 2 THEN '[\"Total 12\",\"2\",\"3\",\"extra\"]' "
            "ELSE " + _printf('["Total","","Total amount $@tot!@"]') + " END",
    "second": "CASE WHEN d % 2 = 0 THEN "
              + _printf(',{"table_id":2,"type":"data","headers":["K","V"],"data":[["order","@id@"]]}') + " ELSE '' END",
}


def _text() -> str:
    def render(t, items):
        def line(j, label, printed):
            return f"{label}: {printed}\n" + {1: "@blank@", 3: "@accent@"}.get(j, "")
        return f"@title@\n{_marked(t, items, line)}@table@@note@@again@@copy@@foot@"
    return _choose(render)


def _response(n: int) -> str:
    def tag(name, text):
        return TAGS[name][0] + text + TAGS[name][1]

    def render(t, items):
        def entry(j, label, printed):
            value = printed if n == 1 else _known(printed)
            value = f" {value} " if n == 3 and j == 1 else value
            conf = {(1, 1): "@confa@", (3, 2): "@confb@", (1, 2): "@zeroa@", (2, 2): "@zerob@"}.get(
                (n, j), f"{0.92 - 0.06 * (j % 5) - 0.12 * (n - 1):.2f}")
            name = f'"name":" {label.lower()}  ",' if (n, j) == (3, 0) else f'"name":"{label}",'
            name = tag("name", name) if (n, j) == (2, 3) else name
            val = f'"value":"{value}"'
            val = tag("value", val) if n < 3 and j == 4 else val
            src = f',"source":{{"page":1,"bbox":[0,{25 * j},100,{25 * j + 20}]}}' if n == 1 else ""
            return f'{{{name}{val},"confidence":{conf}{src}}},'
        passed = '["totals_match","dates_ordered"]' if n == 2 else '["totals_match"]'
        failed = "[]" if n == 2 else '["currency_known"]'
        head = f'"doc_type":"@type{["", "b", "c"][n - 1]}@",'
        tail = (f',"overall_confidence":{0.9 - 0.15 * n:.2f},'
                f'"qa":{{"passed_rules":{passed},"failed_rules":{failed},"notes":""}}')
        if n == 3:
            head, tail = tag("opt", head), tag("opt", tail)
        return f'{{{head}"fields":[{_marked(t, items, entry)}]{tail}}}'
    return _choose(render)


def _response_steps(n: int) -> list[str]:
    """Damage applied to the response, one expression after the other on column x."""
    def cut(name, condition, instead=""):
        start, end = (_lit(c) for c in TAGS[name])
        gone = _cat(f"split_part(x, {start}, 1)", _lit(instead), f"split_part(x, {end}, 2)")
        return f"CASE WHEN {condition} AND split_part(x, {start}, 2) <> '' THEN {gone} ELSE x END"

    steps = []
    if n == 1:
        steps.append(cut("value", "d % 43 = 11", '"value":null'))
    if n == 2:
        steps.append(cut("name", "d % 31 = 8"))
        steps.append(cut("value", "d % 47 = 12", '"note":"no value"'))
    if n == 3:
        start, end = (_lit(c) for c in TAGS["opt"])
        bare = _cat(f"split_part(x, {start}, 1)", f"split_part(split_part(x, {end}, 2), {start}, 1)", "chr(125)")
        steps.append(f"CASE WHEN d % 3 = 0 THEN {bare} ELSE x END")
    steps.append(f"replace(translate(x, {_lit(UNMARK)}, ''), ',]', ']')")
    cut60 = "substring(x, 1, 60)"
    extra = {
        1: f"WHEN d % 14 = 3 THEN {_cat(_lit('Here is the result: '), 'x', _lit(' Done.'))} "
           f"WHEN d % 53 = 13 THEN {_cat(_lit('['), 'x', _lit(']'))} ",
        2: f"WHEN d % 17 = 4 THEN {cut60} ",
        3: "WHEN d % 19 = 5 THEN 'I could not read the document.' ",
    }[n]
    steps.append(f"CASE WHEN d % 41 = 10 THEN {cut60} {extra}ELSE x END")
    return steps


# One table answer per document; some lack headers or keys, some have ragged or out-of-range rows.
_TABLES = ('{"tables":[{"table_id":1@kind@@pos@@dims@@headers@,"data":[["Goods","@lines@","@sub!@"],'
           '["Tax due 03/04/2021","1","@tax!@"],@last@]}@second@]}')


# ---- the nested SELECT -----------------------------------------------------------

BASE_SQL = """
SELECT o_orderkey AS d, CAST(o_orderkey AS STRING) AS ds, o_orderdate AS od,
       o_orderdate + INTERVAL 30 DAY AS later, o_orderdate - INTERVAL 9000 DAY AS past,
       c_name AS cust, n_name AS nation, c_mktsegment AS seg,
       li.n_lines AS n_lines, coalesce(CAST(li.n_lines AS STRING), '0') AS count_s,
       li.sub_c AS sub_c, li.tax_c AS tax_c,
       CASE WHEN o_orderkey % 11 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT)
            ELSE li.sub_c + li.tax_c END AS tot_c
FROM {orders}
JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey
LEFT JOIN (
  SELECT l_orderkey, n_lines, sub_c,
         CASE WHEN l_orderkey % 13 = 0 THEN CAST(0 AS BIGINT)
              ELSE CAST((sub_c * 8 - (sub_c * 8) % 100) / 100 AS BIGINT) END AS tax_c
  FROM (
    SELECT l_orderkey, count(*) AS n_lines,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2))) * 100 AS BIGINT) AS sub_c
    FROM {lineitem} GROUP BY l_orderkey
  ) AS per_order
) AS li ON li.l_orderkey = o_orderkey
"""


_MIME = ("CASE WHEN d % 5 = 0 THEN 'image/png' WHEN d % 5 = 3 THEN 'image/jpeg' "
         "WHEN d % 10 = 4 THEN 'text/csv' ELSE 'application/pdf' END")
_SIZE = ("CAST(CASE WHEN d % 20 = 1 THEN 75000 WHEN d % 20 = 2 THEN 75001 WHEN d % 20 = 3 THEN 2097152 "
         "WHEN d % 20 = 4 THEN 2097153 ELSE coalesce(tot_c, d) % 4000000 END AS BIGINT)")


def _columns() -> dict[str, list[str]]:
    """Per output column the expressions to apply in turn; each sees the previous one as x."""
    known = _choose(lambda t, items: _marked(
        t, items, lambda j, label, printed: f"{label}={_known(printed)}\n"))
    unmark = f"translate(x, {_lit(UNMARK)}, '')"
    out = {
        "true_type": ["tk_type"],
        "label": ["CAST(d % 7 AS INT)"],
        "mime": [_MIME],
        # what a batch is told about its files, what pages yield, and how an order states type and prices
        "sent_mime": [f"CASE WHEN d % 61 = 0 THEN CAST(NULL AS STRING) ELSE {_MIME} END"],
        "sent_size": [f"CASE WHEN d % 67 = 0 THEN CAST(NULL AS BIGINT) WHEN d % 71 = 3 THEN CAST(-1 AS BIGINT) ELSE {_SIZE} END"],
        "received": ["d % 73 <> 5"],
        "readable": ["d % 8 <> 0"],
        "rasterised": ["d % 3 <> 0"],
        "stated_type": ["CASE WHEN d % 10 = 9 THEN 'academic' ELSE tk_type END"],
        "price_kind": ["CASE WHEN d % 3 = 0 THEN 'net' ELSE 'list' END"],
        "size_bytes": [_SIZE],
        "text": [_text(), _drop("x", "d % 9"), unmark,
                 f"CASE WHEN d % 97 = 0 THEN '' WHEN d % 83 = 2 THEN {_cat(NL, _lit('  '), NL, NL)} "
                 f"WHEN d % 89 = 1 THEN {_cat(_lit('NOTE'), NL, _lit('see order '), 'ds')} ELSE x END"],
        "truth_text": [known, _drop("x", "(20 - d * 3 % 20) % 20"), unmark],
        "user_fields": ["CASE d % 6 WHEN 0 THEN ' PO Number , Due Date,' WHEN 1 THEN 'Total Amount,Total Amount, Notes' "
                        "WHEN 2 THEN ' , ' WHEN 3 THEN 'a,b,c,d,e,f,g,h' ELSE CAST(NULL AS STRING) END"],
        "tables_json": [_printf(_TABLES),
                        "CASE WHEN d % 20 = 19 THEN 'no tables found' WHEN d % 22 = 7 THEN substring(x, 1, 40) "
                        "WHEN d % 6 = 0 THEN '```json ' || x || ' ```' ELSE x END"],
        "image_width": ["CAST(CASE WHEN d % 30 = 0 THEN 15 ELSE 100 + d % 300 END AS INT)"],
        "image_height": ["CAST(CASE WHEN d % 30 = 1 THEN 10 ELSE 45 + d % 400 END AS INT)"],
    }
    for n in (1, 2, 3):
        gone = "(9 - d % 9) % 9" if n == 1 else f"(d + {n}) % 8"
        out[f"response_{n}"] = [_response(n), _drop("x", gone)] + _response_steps(n)
    return out


def corpus_sql(columns: list[str], orders="orders", customer="customer",
               nation="nation", lineitem="lineitem") -> str:
    """SELECT rendering the asked-for corpus columns (doc_id always included).

    Nested SELECTs name every intermediate value once, so that each step works
    on a short column instead of repeating the expression below it.
    """
    base = BASE_SQL
    for name, value in (("orders", orders), ("customer", customer), ("nation", nation), ("lineitem", lineitem)):
        base = base.replace("{" + name + "}", value)
    money, dates = ("sub_c", "tax_c", "tot_c"), ("od", "later", "past")
    formatted = [f"{_plain(c)} AS {c}_plain, {_grouped(c)} AS {c}_grouped" for c in money]
    formatted += [f"{_date(t)} AS {t}_printed, {_us_date(t)} AS {t}_known" for t in dates]
    printed = [f"{_money(c)} AS {c}_printed" for c in money]
    variant = "CAST(d % 7 + CASE WHEN n_lines IS NULL THEN 7 ELSE 0 END AS INT) AS variant"
    tokens = [f"coalesce({v}, '') AS {_token_column(k)}" for k, v in TOKENS.items()]
    plain = [f"{v} AS {_token_column(k)}" for k, v in PIECES.items() if "tk_" not in v]
    nested = [f"{v} AS {_token_column(k)}" for k, v in PIECES.items() if "tk_" in v]
    filled = [f"{v} AS {_token_column(k)}" for k, v in FILLED.items()]
    sql = f"SELECT *, {', '.join(formatted)} FROM ({base}) AS b0"
    sql = f"SELECT *, {', '.join(printed)} FROM ({sql}) AS b1"
    sql = f"SELECT *, {variant}, {', '.join(tokens + plain)} FROM ({sql}) AS b2"
    sql = f"SELECT *, {', '.join(nested + filled)} FROM ({sql}) AS b3"
    all_columns = _columns()
    steps = {c: all_columns[c] for c in columns}
    depth = max(len(v) for v in steps.values())
    for level in range(depth):
        new = []
        for c, exprs in steps.items():
            if level < len(exprs):
                new.append(f"{_rename(exprs[level], c, level)} AS {c}_{level}")
        sql = f"SELECT *, {', '.join(new)} FROM ({sql}) AS s{level}"
    wanted = ", ".join(["d AS doc_id"] + [f"{c}_{len(steps[c]) - 1} AS {c}" for c in columns])
    return f"SELECT {wanted} FROM ({sql}) AS done"


def _rename(expr: str, column: str, level: int) -> str:
    """Bind x, the previous step of the same column."""
    return re.sub(r"\bx\b(?=[,) ]|$)", f"{column}_{level - 1}", expr) if level else expr


def _joined_up(sql: str) -> str:
    """The same SELECT with each printf of text as one concat: no format is read anew for every row.  Tokens are never
    NULL, pieces only where the type is, which printf writes as null."""
    literal = r"'(?:[^']|'')*'|chr\(\d+\)"

    def never_null(token: str) -> str:
        return f"coalesce({token}, 'null')" if token.removeprefix("tk_") in PIECES else token

    def concat(call: re.Match) -> str:
        text = "".join(chr(int(x[4:-1])) if x.startswith("chr") else x[1:-1].replace("''", "'") for x in re.findall(literal, call[1]))
        tokens, pieces = iter(call[2].split(", ")[1:]), []
        for piece in re.split("(%s|%%)", text):
            pieces += [never_null(next(tokens))] if piece == "%s" else [_lit("%" if piece == "%%" else piece)] if piece else []
        return f"concat({', '.join(pieces)})"
    return re.sub(rf"printf\(((?:{literal})(?: \|\| (?:{literal}))*)((?:, tk_\w+)*)\)", concat, sql)


def _unmarked(sql: str) -> str:
    """The same SELECT with marks taken out by one search for a range of characters, where translate looks every character
    of a text up, and with a text cut at a mark's first place instead of split at all of them."""
    ranges = "".join(f"{low}-{high}" for low, high in ((MARKS[0], MARKS[-1]), (min(UNMARK[len(MARKS):]), max(UNMARK))))
    sql = re.sub(rf"translate\((\w+), {_lit(UNMARK)}, ''\)", rf"regexp_replace(\1, '[{ranges}]', '')", sql)
    mark = rf"'[{UNMARK}]'|substring\('{MARKS}', CAST\((?:[^()]|\([^()]*\))*\) \+ \d, 1\)"

    def before(call: re.Match) -> str:
        return f"substring_index({call[1]}, {call[2]}, 1)"

    def after(call: re.Match) -> str:
        rest = f"substring({call[1]}, instr({call[1]}, {call[2]}) + 1)"
        return f"CASE WHEN contains({call[1]}, {call[2]}) THEN substring_index({rest}, {call[2]}, 1) ELSE '' END"
    sql = re.sub(rf"split_part\((\w+), ({mark}), 1\)", before, sql)
    return re.sub(rf"split_part\((\w+), ({mark}), 2\)", after, sql)


def corpus(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The rendered corpus with the asked-for columns."""
    tables = {t: read_table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "lineitem")}
    # order rows are small; the texts rendered from them are not, and stay where they are made
    tables["orders"] = tables["orders"].repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    sql = _unmarked(_joined_up(corpus_sql(list(columns), *(f"<<{t}>>" for t in tables)))).replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = sql.replace(f"<<{t}>>", "{" + t + "}")
    return spark.sql(sql, **tables)


ALL_COLUMNS = ["true_type", "label", "mime", "size_bytes", "sent_mime", "sent_size", "received", "readable", "rasterised", "stated_type", "price_kind", "text", "truth_text", "user_fields", "response_1",
               "response_2", "response_3", "tables_json", "image_width", "image_height"]
_written: dict[tuple[str, str], dict[tuple[str, ...], str]] = {}


def corpus_path(spark: SparkSession, sf_dir: str, *columns: str) -> str:
    """Folder of a stored table with at least these corpus columns, for all documents.

    A table is written once per application, source and set of columns to the cluster's shared work folder; one that
    holds them already is used again.  Columns that nobody asks for are neither rendered nor written."""
    wanted = tuple(c for c in ALL_COLUMNS if c in columns)
    stored = _written.setdefault((spark.sparkContext.applicationId, sf_dir), {})
    for held, path in stored.items():
        if set(wanted) <= set(held):
            return path
    path = f"{work_dir(spark)}/corpus-{uuid.uuid4().hex}"
    corpus(spark, sf_dir, *wanted).write.parquet(path)
    stored[wanted] = path
    return path


def corpus_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The stored corpus; queries read only the columns they need."""
    return spark.read.parquet(corpus_path(spark, sf_dir, *columns)).select("doc_id", *columns)


def samples_raw(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Raw extractor responses, one row per (document, sample)."""
    df = corpus_table(spark, sf_dir, "response_1", "response_2", "response_3", *extra)
    return df.select("doc_id", *extra, F.posexplode(
        F.array("response_1", "response_2", "response_3")).alias("pos0", "response")).select(
        "doc_id", *extra, (F.col("pos0") + 1).alias("sample_no"), "response")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth as a long table: doc_id, pos, name, value."""
    df = corpus_table(spark, sf_dir, "truth_text")
    pair = F.posexplode(F.filter(F.split("truth_text", "\n"), lambda x: x != "")).alias("pos", "pair")
    return df.select("doc_id", pair).select(
        "doc_id", "pos",
        F.substring_index("pair", "=", 1).alias("name"),
        F.expr("substring(pair, instr(pair, '=') + 1)").alias("value"))
