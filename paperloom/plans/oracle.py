"""The registered queries once more, as SQL for a second engine.

Only the corpus rendering and the fixed rule values are shared with the Spark
side; every computation is written again, in set-oriented SQL over long tables.
"""

from __future__ import annotations

from paperloom import rules
from paperloom.functions.text import ASCII_FROM, ASCII_TO
from paperloom.operators.suggest import ANY_FIELDS, request_parts
from paperloom.operators.totals import money_pattern
from paperloom.sources.corpus import corpus_sql

WS = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPECIAL = r"[^\p{L}\p{N}_\s\-.,:;()$%#]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x):
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x):
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def norm_text(x):
    return f"trim(regexp_replace({collapse(f'lower({x})')}, '{SPECIAL}', ' ', 'g'), ' ')"


def norm_name(x):
    return f"lower({collapse(strip(x))})"


def preprocess(x):
    base = f"regexp_replace({collapse(f'lower({x})')}, '{SPECIAL}', ' ', 'g')"
    parts = rf"regexp_extract_all({base}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')"
    swapped = rf"array_to_string(list_transform({parts}, lambda w: CASE WHEN regexp_full_match(w, '\p{{Nd}}+') THEN 'NUMBER' ELSE w END), '')"
    return f"array_to_string(list_filter(string_split_regex({swapped}, ' +'), lambda w: length(w) > 2), ' ')"


def money(x):
    return f"('$' || CAST(CAST({x} AS DECIMAL(38,2)) AS VARCHAR))"


def num(x):
    s = strip(f"replace({x}, ',', '')")
    return (rf"(CASE WHEN regexp_matches({s}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') "
            rf"OR regexp_matches({s}, '(?i)^[+-]?(nan|inf|infinity)$') THEN TRY_CAST({s} AS DOUBLE) END)")


def values(rows) -> str:
    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, str):
            return lit(v)
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        if isinstance(v, list):
            return "[" + ", ".join(one(x) for x in v) + "]::VARCHAR[]"
        return str(v)
    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


def band(c):
    return "CASE " + " ".join(f"WHEN {c} >= {b} THEN '{n}'" for b, n in rules.BANDS) + f" ELSE '{rules.LOWEST_BAND}' END"


def any_of(x, words):
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def docs(*cols):
    return [("docs", corpus_sql(list(cols)))]


def build(ctes, final) -> str:
    seen, parts = set(), []
    for name, sql in ctes:
        if name not in seen:
            seen.add(name)
            parts.append(f"{name} AS MATERIALIZED ({sql})")
    return f"WITH {', '.join(parts)} {final}" if parts else final


# ---- classification --------------------------------------------------------------

_pid: dict[str, int] = {}
_RULE_ROWS = []
for _t, _w, _p, _k in rules.KEYWORD_RULES:
    _pid[_t] = _pid.get(_t, 0) + 1
    _RULE_ROWS.append((_t, _pid[_t], float(_w), rules.POSITION_FACTOR if _p else 1.0, _k))


def layers(source="docs"):
    st = []
    for t, head, foot, table, number, date in rules.STRUCTURE_RULES:
        terms = [f"CASE WHEN contains(header, '{w}') THEN 1 ELSE 0 END" for w in head]
        terms += [f"CASE WHEN contains(footer, '{w}') THEN 0.5 ELSE 0 END" for w in foot]
        terms.append(f"CASE WHEN regexp_matches(text, '(?i){number}') THEN 1 ELSE 0 END")
        terms.append(f"CASE WHEN regexp_matches(text, '(?i){date}') THEN 0.5 ELSE 0 END")
        if table:
            terms.append("CASE WHEN length(text) - length(replace(text, chr(9), '')) + len(regexp_extract_all(text, ' {2,}')) > 10 THEN 1 ELSE 0 END")
        st.append(f"SELECT doc_id, '{t}' AS doc_type, CAST({' + '.join(terms)} AS DOUBLE) AS score FROM edges")
    ctx_rows = [(t, n, p, s, float(w)) for t, n, p, s, w in rules.CONTEXT_RULES]
    return [
        ("norm", f"SELECT doc_id, text, {norm_text('text')} AS norm FROM {source}"),
        ("kw", f"""SELECT doc_id, doc_type, sum(part ORDER BY pattern_id) AS score FROM (
            SELECT doc_id, doc_type, pattern_id, weight * (CAST(hits AS DOUBLE) / CAST(len(keywords) AS DOUBLE)) * boost AS part
            FROM (SELECT *, len(list_filter(keywords, lambda k: contains(norm, k))) AS hits
                  FROM norm, (VALUES {values(_RULE_ROWS)}) r(doc_type, pattern_id, weight, boost, keywords))
            WHERE hits > 0) GROUP BY doc_id, doc_type"""),
        ("edges", """SELECT doc_id, text, lower(array_to_string(list_slice(l, 1, 5), ' ')) AS header,
            lower(array_to_string(list_slice(l, greatest(len(l) - 4, 1), len(l)), ' ')) AS footer
            FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM norm)"""),
        ("st", " UNION ALL ".join(st)),
        ("cx", f"""SELECT doc_id, doc_type, sum(CASE WHEN a > 0 AND b > 0 THEN weight * (CAST(a + b AS DOUBLE) / CAST(n AS DOUBLE)) ELSE 0 END ORDER BY i) AS score
            FROM (SELECT doc_id, doc_type, weight, i, len(p) + len(s) AS n,
                    len(list_filter(p, lambda k: contains(norm, k))) AS a,
                    len(list_filter(s, lambda k: regexp_matches(norm, '(?i)' || k))) AS b
                  FROM norm, (VALUES {values([(i,) + r for i, r in enumerate(ctx_rows)])}) r(i, doc_type, name, p, s, weight))
            GROUP BY doc_id, doc_type"""),
    ]


_ORDS = values([(t, i) for t, i in rules.TYPE_ORD.items()])


def classified(source="docs"):
    always = values([(t,) for t in rules.ALWAYS_SCORED])
    return layers(source) + [
        ("scores", f"""SELECT c.doc_id, c.doc_type, o.ord, coalesce(kw.score, 0) AS kw, coalesce(st.score, 0) AS st, coalesce(cx.score, 0) AS cx,
            round(CAST(0.5 AS DOUBLE) * (coalesce(kw.score, 0) / greatest(coalesce(m.top, 1), 1))
              + CAST(0.3 AS DOUBLE) * least(coalesce(st.score, 0) / 4, 1) + CAST(0.2 AS DOUBLE) * least(coalesce(cx.score, 0) / 6, 1), 12) AS score
            FROM (SELECT doc_id, doc_type FROM norm, (VALUES {always}) a(doc_type) UNION SELECT doc_id, doc_type FROM kw) c
            JOIN (VALUES {_ORDS}) o(doc_type, ord) ON o.doc_type = c.doc_type
            LEFT JOIN kw ON kw.doc_id = c.doc_id AND kw.doc_type = c.doc_type
            LEFT JOIN st ON st.doc_id = c.doc_id AND st.doc_type = c.doc_type
            LEFT JOIN cx ON cx.doc_id = c.doc_id AND cx.doc_type = c.doc_type
            LEFT JOIN (SELECT doc_id, max(score) AS top FROM kw GROUP BY doc_id) m ON m.doc_id = c.doc_id"""),
        ("ranked", "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS rn FROM scores"),
        ("classified", f"""SELECT doc_id, CASE WHEN confidence < 0.1 THEN 'unknown' ELSE doc_type END AS doc_type, confidence,
            CASE WHEN confidence < 0.1 THEN 0 ELSE kw END AS keyword_score, CASE WHEN confidence < 0.1 THEN 0 ELSE st END AS structural_score,
            CASE WHEN confidence < 0.1 THEN 0 ELSE cx END AS context_score, {band('confidence')} AS confidence_level
            FROM (SELECT a.doc_id, a.doc_type, a.kw, a.st, a.cx,
                    round(least(least(a.score, 1) + least((a.score - b.score) * CAST(0.5 AS DOUBLE), CAST(0.3 AS DOUBLE)), 1), 12) AS confidence
                  FROM ranked a JOIN ranked b ON a.doc_id = b.doc_id AND a.rn = 1 AND b.rn = 2)"""),
    ]


_CLASSIFIED_COLS = ("SELECT doc_id, doc_type, round(confidence, 9) AS confidence, CAST(round(keyword_score, 9) AS DOUBLE) AS keyword_score, "
                    "CAST(round(structural_score, 9) AS DOUBLE) AS structural_score, CAST(round(context_score, 9) AS DOUBLE) AS context_score, confidence_level FROM classified")


# ---- lines -----------------------------------------------------------------------

_SPLIT = "SELECT *, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_idx FROM {src}"


def kind(raw, s):
    return (f"CASE WHEN regexp_full_match({s}, '([A-Z]|{WS})+') AND length({s}) > 3 THEN 'header' "
            f"WHEN {any_of(f'lower({s})', rules.FINANCIAL_WORDS)} THEN 'financial' "
            f"WHEN regexp_matches({raw}, {lit(rules.CURRENCY_PATTERN)}) THEN 'currency' "
            f"WHEN regexp_matches({raw}, {lit(rules.SHORT_DATE_PATTERN)}) THEN 'date' ELSE 'text' END")


def lines(source="docs", mime=True):
    conf = "CASE WHEN mime LIKE 'image/%' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END" if mime else "CAST(0.95 AS DOUBLE)"
    return [
        ("split_lines", f"SELECT * EXCLUDE (text), {strip('raw')} AS line FROM ({_SPLIT.format(src=source)})"),
        ("lines", f"""SELECT *, CAST(0 AS DOUBLE) AS x, CAST(line_idx * 25 AS DOUBLE) AS y, CAST(length(raw) * 8 AS DOUBLE) AS w,
            CAST(20 AS DOUBLE) AS h, {conf} AS confidence, {kind('raw', 'line')} AS element_type FROM split_lines WHERE line <> ''"""),
    ]


def detected():
    sep = r"\t| {2,}"
    return lines(mime=False) + [
        ("runs", f"""SELECT *, line_idx - row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) AS run
            FROM lines WHERE regexp_matches(line, '{sep}')"""),
        ("tabs", """SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS table_idx FROM (
            SELECT doc_id, run, count(*) AS n, min(line_idx) AS start, max(length(raw)) AS chars FROM runs GROUP BY doc_id, run HAVING count(*) >= 2)"""),
        ("trows", f"""SELECT t.doc_id, t.table_idx, t.n, t.start, t.chars, r.line_idx - t.start AS row,
            list_transform(string_split_regex(r.line, '{sep}'), lambda c: {strip('c')}) AS cells
            FROM tabs t JOIN runs r ON r.doc_id = t.doc_id AND r.run = t.run"""),
        ("found", f"""SELECT doc_id, table_idx, n, start, chars, max(len(cells)) AS cols,
            lower(max(CASE WHEN row = 0 THEN array_to_string(cells, ' ') END)) AS head,
            bool_or(row = 0 AND regexp_matches(array_to_string(cells, ' '), '\\d')) AS digits,
            lower(string_agg(array_to_string(cells, ' '), ' ' ORDER BY row)) AS everything,
            string_agg(array_to_string(cells, '|'), '/' ORDER BY row) AS content
            FROM trows GROUP BY doc_id, table_idx, n, start, chars"""),
    ]


_COUNTS = ("SELECT d.doc_id, d.*, coalesce(l.n, 0) AS n_lines, coalesce(t.n, 0) AS n_tables FROM docs d "
           "LEFT JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id) l ON l.doc_id = d.doc_id "
           "LEFT JOIN (SELECT doc_id, count(*) AS n FROM tabs GROUP BY doc_id) t ON t.doc_id = d.doc_id")


def q_image(text, n_lines, n_tables):
    return (f"least(CAST(0.7 AS DOUBLE) + CASE WHEN length({text}) > 100 THEN CAST(0.1 AS DOUBLE) ELSE 0 END "
            f"+ CASE WHEN {n_lines} > 5 THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN {n_tables} > 0 THEN CAST(0.1 AS DOUBLE) ELSE 0 END, 1)")


def q_direct(text, n_tables):
    return (f"least(CAST(0.8 AS DOUBLE) + CASE WHEN length({text}) > 100 THEN CAST(0.1 AS DOUBLE) ELSE 0 END "
            f"+ CASE WHEN {n_tables} > 0 THEN CAST(0.1 AS DOUBLE) ELSE 0 END, 1)")


def counts():
    return detected() + [("counts", _COUNTS.replace("d.doc_id, d.*", "d.*"))]


# ---- suggestions -----------------------------------------------------------------

_TEMPLATES = values([(t, f) for t, f in rules.TEMPLATES.items()])


def suggested():
    asked = f"list_filter(list_transform(string_split(user_fields, ','), lambda f: {strip('f')}), lambda f: f <> '')"
    return classified() + [
        ("asked", f"""SELECT d.doc_id, d.text, d.user_fields, c.doc_type, c.confidence, {asked} AS asked, coalesce(t.fields, []::VARCHAR[]) AS tmpl
            FROM docs d JOIN classified c ON c.doc_id = d.doc_id LEFT JOIN (VALUES {_TEMPLATES}) t(doc_type, fields) ON t.doc_type = c.doc_type"""),
        ("suggested", f"""SELECT doc_id, text, doc_type, confidence,
            CASE WHEN user_fields IS NOT NULL AND {strip('user_fields')} <> '' THEN list_slice(list_concat(asked, list_filter(tmpl, lambda f: NOT list_contains(asked, f))), 1, 15)
                 ELSE list_slice(tmpl, 1, 10) END AS suggested FROM asked"""),
    ]


def out_type(t, text, has):
    base = f"CASE {t} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.OUTPUT_TYPES.items()) + " ELSE 'unknown' END"
    return (f"CASE WHEN {base} = 'medical_bill' AND {has} AND (contains(lower({text}), 'prescription') OR contains(lower({text}), 'rx')) "
            f"THEN 'prescription' ELSE {base} END")


_FALLBACK = """SELECT doc_id, min(i) AS first, name, value FROM (
    SELECT doc_id, unnest(list_slice(suggested, 1, k)) AS name, generate_subscripts(list_slice(suggested, 1, k), 1) AS i, value FROM (
        SELECT *, CASE WHEN confidence > 0.8 THEN 6 WHEN confidence > 0.5 THEN 3 ELSE 1 END AS k,
            CASE WHEN confidence > 0.5 THEN '[Extracted from ' || doc_type || ']' ELSE '[Low confidence extraction]' END AS value FROM suggested))
    GROUP BY doc_id, name, value"""


# ---- amounts ---------------------------------------------------------------------


def amounts():
    parts = []
    for i, (p, c) in enumerate(rules.MONEY_PATTERNS):
        found = f"regexp_extract_all(text, {lit(money_pattern(p))}, 1)"
        parts.append(f"SELECT doc_id, {i} AS p, unnest({found}) AS m, generate_subscripts({found}, 1) AS i, '{c}' AS context FROM docs")
    return [("amounts", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, i) - 1 AS ord, "
                        f"CAST(replace(m, ',', '') AS DOUBLE) AS value, context FROM ({' UNION ALL '.join(parts)})")]


_CTX_NAME = ("CASE context " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.AMOUNT_FIELD_NAMES.items())
             + " ELSE upper(context[1]) || lower(context[2:]) END")
_TOTALS_FIELDS = f"SELECT doc_id, name, {money('arg_max(value, ord)')} AS value FROM (SELECT *, {_CTX_NAME} AS name FROM amounts) GROUP BY doc_id, name"
_LINE_FIELDS = " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS name, arg_max(line, line_idx) AS value FROM lines WHERE element_type = '{k}'{extra} GROUP BY doc_id"
    for name, k, extra in (("Document Date", "date", ""), ("Amount", "currency", ""), ("Document Title", "header", " AND length(line) > 5")))


# ---- table responses -------------------------------------------------------------


def response_tables():
    return [
        ("tj", r"SELECT doc_id, regexp_extract(tables_json, '(?s)\{.*\}', 0) AS body FROM docs"),
        ("tlist", """SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS table_idx FROM (
            SELECT doc_id, CAST(json_extract(body, '$.tables') AS JSON[]) AS ts FROM tj WHERE body <> '' AND json_valid(body))"""),
        ("rtables", """SELECT doc_id, table_idx,
            coalesce(TRY_CAST(t->>'$.rows' AS INT), len(data) + CASE WHEN len(headers) > 0 THEN 1 ELSE 0 END) AS rows,
            coalesce(TRY_CAST(t->>'$.columns' AS INT), len(headers)) AS cols,
            coalesce(TRY_CAST(t->>'$.position.x' AS DOUBLE), 0) AS x, coalesce(TRY_CAST(t->>'$.position.y' AS DOUBLE), 0) AS y,
            coalesce(TRY_CAST(t->>'$.position.width' AS DOUBLE), 100) AS w, coalesce(TRY_CAST(t->>'$.position.height' AS DOUBLE), 50) AS h,
            headers, data FROM (SELECT *, coalesce(CAST(t->'$.headers' AS VARCHAR[]), []::VARCHAR[]) AS headers,
                coalesce(CAST(t->'$.data' AS VARCHAR[][]), []::VARCHAR[][]) AS data FROM tlist)"""),
        ("cells", """SELECT *, CAST(col * 25 AS DOUBLE) AS x, CAST(row * 20 AS DOUBLE) AS y, CAST(25 AS DOUBLE) AS w, CAST(20 AS DOUBLE) AS h FROM (
            SELECT doc_id, table_idx, rows, cols, 0 AS row, generate_subscripts(headers, 1) - 1 AS col, unnest(headers) AS content, true AS is_header FROM rtables
            UNION ALL SELECT doc_id, table_idx, rows, cols, row, generate_subscripts(r, 1) - 1 AS col, unnest(r) AS content, false FROM (
                SELECT doc_id, table_idx, rows, cols, generate_subscripts(data, 1) AS row, unnest(data) AS r FROM rtables))"""),
    ]


_CELL_FIELDS = " UNION ALL ".join(
    f"""SELECT doc_id, 'Table_' || CAST(table_idx + 1 AS VARCHAR) || '_{what}' AS name, arg_max(v, CAST(row AS BIGINT) * 2147483648 + col) AS value FROM (
        SELECT *, regexp_extract(content, {lit(p)}, 0) AS v FROM cells WHERE {any_of('lower(content)', words)}) WHERE v <> '' GROUP BY doc_id, table_idx"""
    for what, words, p in (("Total", rules.TABLE_TOTAL_WORDS, rules.CELL_AMOUNT_PATTERN), ("Date", rules.TABLE_DATE_WORDS, rules.SHORT_DATE_PATTERN)))


# ---- samples ---------------------------------------------------------------------

_NUM = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def samples():
    raw = " UNION ALL ".join(f"SELECT doc_id, {n} AS sample_no, response_{n} AS response FROM docs" for n in (1, 2, 3))
    f_ok = (f"json_type(f, '$.name') IS NOT NULL AND json_type(f, '$.name') <> 'NULL' AND json_type(f, '$.value') IS NOT NULL "
            f"AND (json_type(f, '$.confidence') IS NULL OR coalesce(regexp_matches(f->>'$.confidence', {_NUM}), false))")
    return [
        ("raw", raw),
        ("parsed0", rf"SELECT *, {strip('response')} AS trimmed, regexp_extract(response, '(?s)\{{.*\}}', 0) AS body FROM raw"),
        ("parsed1", """SELECT *, CASE WHEN json_valid(trimmed) AND json_type(CASE WHEN json_valid(trimmed) THEN trimmed ELSE 'null' END) <> 'OBJECT' THEN 'dropped'
            WHEN body = '' THEN 'empty' WHEN NOT json_valid(body) THEN 'dropped' WHEN trimmed = body THEN 'ok' ELSE 'recovered' END AS status FROM parsed0"""),
        ("parsed", """SELECT doc_id, sample_no, status, j->>'$.doc_type' AS doc_type, coalesce(CAST(j->'$.fields' AS JSON[]), []) AS fields,
            j->>'$.overall_confidence' AS overall_confidence, j FROM (
            SELECT *, CASE WHEN status IN ('ok', 'recovered') THEN CAST(body AS JSON) WHEN status = 'empty' THEN CAST('{}' AS JSON) END AS j FROM parsed1)"""),
        ("valid", f"""SELECT doc_id, sample_no, ok AS valid, CASE WHEN ok THEN coalesce(doc_type, 'unknown') END AS doc_type,
            CASE WHEN ok THEN fields END AS fields, CASE WHEN ok THEN CAST(overall AS DOUBLE) END AS overall_confidence,
            CASE WHEN ok THEN coalesce(CAST(j->'$.qa.passed_rules' AS VARCHAR[]), []) END AS passed_rules,
            CASE WHEN ok THEN coalesce(CAST(j->'$.qa.failed_rules' AS VARCHAR[]), []) END AS failed_rules
            FROM (SELECT *, coalesce(overall_confidence, '0.0') AS overall, status <> 'dropped'
                AND len(list_filter(fields, lambda f: NOT ({f_ok}))) = 0 AND regexp_matches(coalesce(overall_confidence, '0.0'), {_NUM}) AS ok FROM parsed)"""),
        ("fields", f"""SELECT doc_id, sample_no, pos, f->>'$.name' AS name, {norm_name("f->>'$.name'")} AS norm_name,
            coalesce(f->>'$.value', 'None') AS value, greatest(0, least(1, coalesce(TRY_CAST(f->>'$.confidence' AS DOUBLE), 0))) AS confidence,
            f->'$.source' AS source, sample_no * 4294967296 + pos AS ord
            FROM (SELECT doc_id, sample_no, unnest(fields) AS f, generate_subscripts(fields, 1) - 1 AS pos FROM valid WHERE valid)"""),
    ]


def consensus():
    return samples() + [
        ("tallied", f"""SELECT doc_id, norm_name, {strip('value')} AS v, count(*) AS n, min(ord) AS first FROM fields GROUP BY ALL"""),
        ("winner", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, norm_name ORDER BY n DESC, first) AS rn FROM tallied) WHERE rn = 1"),
        ("heads", """SELECT doc_id, norm_name, avg(confidence) AS confidence, count(*) AS n_entries, min(ord) AS ord, arg_min(name, ord) AS name,
            arg_min(struct_pack(s := source), ord).s AS source FROM fields GROUP BY doc_id, norm_name"""),
        ("consensus", """SELECT h.doc_id, h.norm_name, h.name, w.v AS value, h.confidence, h.n_entries, h.ord, h.source
            FROM heads h JOIN winner w ON w.doc_id = h.doc_id AND w.norm_name = h.norm_name"""),
    ]


_DATE_TESTS = rules.DATE_PATTERNS + [
    r"^\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$", r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T\d{2}:\d{2}$"]


def valid_expr(name, value):
    s = strip(value)
    dates = " OR ".join(f"regexp_matches({s}, {lit(p)})" for p in _DATE_TESTS)
    return (f"CASE WHEN {any_of(name, rules.DATE_NAME_WORDS)} THEN {dates} "
            f"WHEN {any_of(name, rules.AMOUNT_NAME_WORDS)} THEN regexp_matches({s}, {lit(rules.AMOUNT_PATTERN)}) "
            f"WHEN {any_of(name, rules.ID_NAME_WORDS)} THEN length({s}) >= 3 ELSE true END")


def totals_cte(source):
    def one(n):
        return f"max(CASE WHEN norm_name = '{n}' THEN num END)"
    return [("tot", f"""SELECT doc_id, CASE WHEN sub IS NOT NULL AND tax IS NOT NULL AND total IS NOT NULL THEN
            CASE WHEN abs(sub + tax - total) < 0.01 THEN 'passed' ELSE 'failed' END END AS totals_match FROM (
            SELECT doc_id, {one('subtotal')} AS sub, coalesce(nullif({one('tax amount')}, 0), {one('tax')}) AS tax,
              coalesce(nullif({one('total amount')}, 0), nullif({one('amount due')}, 0), {one('total')}) AS total
            FROM (SELECT doc_id, norm_name, {num('value')} AS num FROM {source}) GROUP BY doc_id)""")]


def located():
    """First line holding the value, by joining fields with the lines of their document."""
    return consensus() + lines(mime=False) + [
        ("located", f"""SELECT c.*, l.line_idx, l.w FROM consensus c LEFT JOIN (
            SELECT c.doc_id, c.norm_name, min(l.line_idx) AS line_idx, arg_min(l.w, l.line_idx) AS w FROM consensus c
            JOIN lines l ON l.doc_id = c.doc_id WHERE {strip('c.value')} <> '' AND contains(lower(l.line), lower({strip('c.value')}))
            GROUP BY c.doc_id, c.norm_name) l ON l.doc_id = c.doc_id AND l.norm_name = c.norm_name"""),
    ]


def scored():
    recognised = "coalesce(d.mime = 'application/pdf' OR starts_with(d.mime, 'image/'), false)"
    return hybrid() + located() + totals_cte("consensus") + [
        ("ns", "SELECT doc_id, sum(CASE WHEN valid THEN 1 ELSE 0 END) AS n_samples FROM valid GROUP BY doc_id"),
        ("scored", f"""SELECT *, power(least(1, CASE WHEN confidence0 = 0 THEN CAST(0.7 AS DOUBLE) ELSE confidence0 END), 0.4)
              * power(CASE WHEN line_idx IS NULL THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END, 0.3)
              * power(CASE WHEN n_samples > 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END, 0.2)
              * power(CASE WHEN valid THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END, 0.1) AS confidence
            FROM (SELECT l.doc_id, l.norm_name, l.name, l.value, l.ord, CASE WHEN {recognised} THEN l.line_idx END AS line_idx, l.w, l.confidence AS confidence0, n.n_samples, {valid_expr('l.norm_name', 'l.value')} AS valid
                  FROM located l JOIN ns n ON n.doc_id = l.doc_id JOIN docs d ON d.doc_id = l.doc_id)"""),
        ("hinted", f"SELECT c.*, {out_type('c.doc_type', 'd.text', recognised)} AS output_type FROM chosen c JOIN docs d ON d.doc_id = c.doc_id"),
        ("named", """SELECT v.doc_id, coalesce(p.doc_type, h.output_type) AS doc_type, count(*) AS n, min(v.sample_no) AS first
            FROM valid v JOIN parsed p ON p.doc_id = v.doc_id AND p.sample_no = v.sample_no JOIN hinted h ON h.doc_id = v.doc_id WHERE v.valid GROUP BY 1, 2"""),
        ("voted", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rn FROM named) WHERE rn = 1"),
        ("results", f"""SELECT c.doc_id, coalesce(o.doc_type, 'unknown') AS doc_type, coalesce(o.n, 0) AS n_votes, c.doc_type AS class_type, c.decided_by, c.confidence AS class_conf, c.output_type,
            coalesce(n.n_samples, 0) AS n_samples, coalesce(s.n, 0) AS n_names, coalesce(s.n_located, 0) AS n_located,
            coalesce(s.rate, 0) AS pass_rate, CASE WHEN s.n_low > 0 THEN CAST(s.n_low AS VARCHAR) || ' low-confidence fields' END AS notes, t.totals_match,
            least(1, CAST(0.6 AS DOUBLE) * coalesce(s.mean, 0) + CAST(0.25 AS DOUBLE) * c.confidence + CAST(0.15 AS DOUBLE) * coalesce(s.rate, 0)) AS overall
            FROM hinted c LEFT JOIN voted o ON o.doc_id = c.doc_id LEFT JOIN ns n ON n.doc_id = c.doc_id LEFT JOIN tot t ON t.doc_id = c.doc_id
            LEFT JOIN (SELECT doc_id, count(*) AS n, count(line_idx) AS n_located, avg(CASE WHEN valid THEN CAST(1 AS DOUBLE) ELSE 0 END) AS rate,
                sum(CASE WHEN confidence0 < 0.5 THEN 1 ELSE 0 END) AS n_low, avg(confidence) AS mean FROM scored GROUP BY doc_id) s ON s.doc_id = c.doc_id"""),
    ]


# ---- evaluation ------------------------------------------------------------------


def truth():
    return [("truth", f"""SELECT doc_id, pos, split_part(pair, '=', 1) AS name, substring(pair, strpos(pair, '=') + 1) AS value FROM (
        SELECT doc_id, unnest(ps) AS pair, generate_subscripts(ps, 1) - 1 AS pos FROM (
            SELECT doc_id, list_filter(string_split(truth_text, chr(10)), lambda x: x <> '') AS ps FROM docs))""")]


def outcomes():
    return consensus() + truth() + [
        ("last_truth", f"SELECT doc_id, {norm_name('name')} AS norm_name, arg_max(value, pos) AS value FROM truth GROUP BY 1, 2"),
        ("outcomes", f"""SELECT coalesce(p.doc_id, t.doc_id) AS doc_id, coalesce(p.norm_name, t.norm_name) AS norm_name, p.value AS pred_value, t.value AS true_value,
            CASE WHEN p.doc_id IS NULL THEN 'missing' WHEN t.doc_id IS NULL THEN 'spurious'
                 WHEN {norm_name('p.value')} IS NOT DISTINCT FROM {norm_name('t.value')} THEN 'match' ELSE 'mismatch' END AS outcome
            FROM consensus p FULL OUTER JOIN last_truth t ON t.doc_id = p.doc_id AND t.norm_name = p.norm_name"""),
    ]


def rates(key, group, level=None):
    more, own = (", level", f", {level}") if level else ("", "")
    return f"""SELECT {key}{more}, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM (
        SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM (
            SELECT {key}{own}, sum(CASE WHEN outcome = 'match' THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN outcome IN ('spurious', 'mismatch') THEN 1 ELSE 0 END) AS fp,
                sum(CASE WHEN outcome IN ('missing', 'mismatch') THEN 1 ELSE 0 END) AS fn FROM outcomes GROUP BY {group}))"""


# ---- models ----------------------------------------------------------------------


def grams(source, text, keep="doc_id", name="grams"):
    plain = f"regexp_replace(translate(lower({text}), '{ASCII_FROM}', '{ASCII_TO}'), '[^\\x00-\\x7F]', '', 'g')"
    stop = "[" + ", ".join(lit(w) for w in rules.STOP_WORDS) + "]"
    return [
        (f"{name}_t", f"SELECT {keep}, list_filter(regexp_extract_all({plain}, '[a-z0-9_]{{2,}}'), lambda w: NOT list_contains({stop}, w)) AS t FROM {source}"),
        (name, " UNION ALL ".join(
            f"SELECT {keep}, unnest(list_transform(range(1, len(t) - {n - 2}), lambda i: array_to_string(list_slice(t, i, i + {n - 1}), ' '))) AS term FROM {name}_t"
            for n in (1, 2, 3))),
    ]


def vocab(source, text="text"):
    cfg = rules.TFIDF
    return grams(source, text, name="vg") + [
        ("vocab", f"""SELECT term, df, tf, ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM (
            SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM vg GROUP BY term), (SELECT count(*) AS n FROM {source})
            WHERE df >= {cfg['min_df']} AND df <= CAST({cfg['max_df']} AS DOUBLE) * n ORDER BY tf DESC, term LIMIT {cfg['max_features']}"""),
    ]


def weights(name, gram_table, keep="doc_id"):
    return [(name, f"""SELECT {keep}, term, tf, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM (
        SELECT {keep}, g.term, count(*) AS tf, count(*) * any_value(v.idf) AS x FROM {gram_table} g JOIN vocab v ON v.term = g.term GROUP BY {keep}, g.term)""")]


def bayes(train, text="text"):
    return vocab(train, text) + weights("tw0", "vg") + [
        ("tw", f"SELECT w.*, t.label FROM tw0 w JOIN {train} t ON t.doc_id = w.doc_id"),
        ("classes", f"SELECT label, ln(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM {train})) AS prior FROM {train} GROUP BY label"),
        ("nb", f"""SELECT c.label, v.term, v.idf, c.prior, ln(coalesce(s.s, 0) + {rules.NB_ALPHA}) - ln(coalesce(k.total, 0) + {rules.NB_ALPHA} * (SELECT count(*) FROM vocab)) AS log_prob
            FROM classes c CROSS JOIN vocab v LEFT JOIN (SELECT label, term, sum(weight) AS s FROM tw GROUP BY label, term) s ON s.label = c.label AND s.term = v.term
            LEFT JOIN (SELECT label, sum(weight) AS total FROM tw GROUP BY label) k ON k.label = c.label"""),
    ]


def nb_scores(source, text="text"):
    return grams(source, preprocess(text), name="pg") + weights("pw", "pg") + [
        ("post", f"""SELECT d.doc_id, c.label, c.prior + coalesce(s.s, 0) AS raw FROM {source} d CROSS JOIN classes c
            LEFT JOIN (SELECT w.doc_id, n.label, sum(w.weight * n.log_prob) AS s FROM pw w JOIN nb n ON n.term = w.term GROUP BY w.doc_id, n.label) s
            ON s.doc_id = d.doc_id AND s.label = c.label"""),
        ("probs", "SELECT doc_id, label, exp(raw - mx) / sum(exp(raw - mx)) OVER (PARTITION BY doc_id) AS p FROM (SELECT *, max(raw) OVER (PARTITION BY doc_id) AS mx FROM post)"),
        ("best", "SELECT doc_id, label, p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 12) DESC, label) AS rn FROM probs) WHERE rn = 1"),
    ]


_LABELLED = [("labelled", "SELECT d.doc_id, d.text, l.quality AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id")]
_COLD = [("cold", "SELECT * FROM (VALUES " + values([(i, t, rules.TYPE_ORD[k]) for i, (k, t) in enumerate(rules.COLD_START)]) + ") c(doc_id, text, label)")]
_NAMES = "[" + ", ".join(lit(t) for t in rules.DOC_TYPES) + "]"


_INDICATORS = values([(t, *["|".join(x) for x in rules.indicators(t)]) for t in rules.RULE_TYPES])


def hybrid():
    """Rule results beside those of Naive Bayes, and which of them wins."""
    return classified() + _COLD + bayes("cold") + [("unsure", "SELECT d.doc_id, d.text FROM docs d JOIN classified c ON c.doc_id = d.doc_id WHERE c.confidence < 0.7")] + nb_scores("unsure") + [
        ("heavy", "SELECT doc_id, list(term ORDER BY round(weight, 12) DESC, term) AS t FROM pw GROUP BY doc_id"),
        ("sides", f"""SELECT c.*, b.label, b.p, coalesce(round(b.p, 12) > c.confidence, false) AS wins, coalesce(h.t, []) AS t, coalesce(i.p, '') AS ip, coalesce(i.s, '') AS isec, coalesce(i.x, '') AS ix
            FROM classified c LEFT JOIN best b ON b.doc_id = c.doc_id LEFT JOIN heavy h ON h.doc_id = c.doc_id LEFT JOIN (VALUES {_INDICATORS}) i(doc_type, p, s, x) ON i.doc_type = c.doc_type"""),
        ("chosen", f"""SELECT doc_id, CASE WHEN wins THEN ({_NAMES})[label + 1] ELSE doc_type END AS doc_type, CASE WHEN wins THEN p ELSE confidence END AS confidence,
            CASE WHEN wins THEN 'model' ELSE 'rules' END AS decided_by FROM sides""")]


def _sub_total(g):
    """One grouping set of the corpus report; a document counts once where rules are summed over."""
    kept = [c if not g & bit else None for c, bit in (("doc_type", 4), ("confidence_level", 2), ("failed_rule", 1))]
    keys = [c for c in kept if c]
    shown = ", ".join(c or f"CAST(NULL AS VARCHAR) AS {n}" for c, n in zip(kept, ("doc_type", "confidence_level", "failed_rule")))
    rows = "judged" if not g & 1 else "(SELECT DISTINCT doc_id, doc_type, confidence_level, confidence FROM judged)"
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    return f"SELECT {g} AS grouping_id, {shown}, count(*) AS n_docs, round(avg(confidence), 9) AS mean_confidence FROM {rows}{group}"


# ---- the queries -----------------------------------------------------------------


def oracle_sql() -> dict[str, str]:
    route = "CASE WHEN mime = 'application/pdf' THEN 'pdf' WHEN mime LIKE 'image/%' THEN 'image' ELSE 'unsupported' END"
    mb, chars = "CAST(size_bytes AS DOUBLE) / 1048576", "4 * CAST(ceil(size_bytes / 3) AS BIGINT)"
    gate = f"CASE WHEN {mb} > 2 THEN 'too_large' WHEN {chars} * 0.25 > 25000 THEN 'too_many_tokens' ELSE 'direct' END"
    text_docs = [("docs", "SELECT doc_id, text FROM documents")]
    a, b, c = (lit(x) for x in request_parts())
    bbox = "array_to_string(CAST(source->'$.bbox' AS INT[]), '|')"
    box = "CASE WHEN line_idx IS NOT NULL THEN '0|' || CAST(line_idx * 25 AS VARCHAR) || '|' || CAST(CAST(w AS INT) AS VARCHAR) || '|' || CAST(line_idx * 25 + 20 AS VARCHAR) END"
    label_re = r"'^([^:]+):\s*(.+)$'"
    status = "'subtotal_ok|tax_ok|total_ok'"
    x_bins, y_bins = "greatest(1, image_width // 20)", "greatest(1, image_height // 20)"
    grid = f"""SELECT doc_id, least(CAST(floor(y / 20) AS INT), {y_bins} - 1) AS y_idx, least(CAST(floor(x / 20) AS INT), {x_bins} - 1) AS x_idx,
        avg(confidence) AS m, count(*) AS n_lines FROM lines GROUP BY 1, 2, 3"""
    out: dict[str, str] = {}
    out["intake_route"] = build(docs("mime"), f"SELECT doc_id, mime, {route} AS route, CASE WHEN {route} = 'unsupported' THEN 'text' ELSE 'ocr' END AS method FROM docs")
    out["intake_size_gate"] = build(docs("size_bytes"), f"SELECT doc_id, size_bytes, round({mb}, 9) AS size_mb, {chars} AS base64_chars, CAST({chars} * 0.25 AS DOUBLE) AS est_tokens, {gate} AS gate FROM docs")
    out["intake_method"] = build(docs("mime", "size_bytes", "readable", "rasterised", "text") + counts(), f"""
        SELECT doc_id, CASE WHEN d THEN 'direct' WHEN i THEN 'images' WHEN b THEN 'basic' ELSE 'failed' END AS method, CASE WHEN d OR i OR b THEN length(text) END AS n_chars,
          round(CAST(CASE WHEN d THEN {q_direct('text', 'n_tables')} WHEN i THEN {q_image('text', 'n_lines', 'n_tables')} WHEN b THEN 0.6 ELSE 0 END AS DOUBLE), 9) AS quality
        FROM (SELECT *, readable AND {route} = 'pdf' AND {gate} = 'direct' AS d,
          readable AND ({route} = 'image' OR ({route} = 'pdf' AND rasterised)) AS i, readable AND {route} = 'pdf' AS b FROM counts)""")
    out["assemble_pages"] = f"""
        SELECT doc_id, count(*) AS n_pages, string_agg(text, {lit(rules.PAGE_BREAK)} ORDER BY page) AS joined_text,
            string_agg('--- Page ' || CAST(page + 1 AS VARCHAR) || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page)
                FILTER (WHERE {strip('text')} <> '') AS basic_text,
            CASE WHEN count(*) FILTER (WHERE {strip('text')} <> '') > 0 THEN 'text' ELSE 'blank' END AS status
        FROM (SELECT conv_id AS doc_id, turn AS page, text FROM conversations) GROUP BY doc_id"""
    out["batch_status"] = build(docs("sent_mime", "sent_size", "received", "text"), f"""
        SELECT doc_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'failed' END AS status, error FROM (
          SELECT doc_id, CASE WHEN sent_mime IS NULL THEN 'missing type' WHEN sent_size IS NULL OR sent_size < 0 THEN 'unreadable size'
            WHEN NOT received THEN 'no text' WHEN {strip('text')} = '' THEN 'empty document' END AS error FROM docs)""")
    out["batch_isolation"] = build(docs("sent_mime", "sent_size", "received", "text") + classified(), f"""
        SELECT doc_id, CASE WHEN error IS NULL THEN 'results' ELSE 'quarantine' END AS sink, CASE WHEN error IS NULL THEN doc_type END AS doc_type, error FROM (
          SELECT c.doc_id, c.doc_type, CASE WHEN sent_mime IS NULL THEN 'missing type' WHEN sent_size IS NULL OR sent_size < 0 THEN 'unreadable size'
            WHEN NOT received THEN 'no text' WHEN {strip('text')} = '' THEN 'empty document' END AS error FROM docs d JOIN classified c ON c.doc_id = d.doc_id)""")
    out["template_catalog"] = build(docs("stated_type"), f"""
        SELECT doc_id, doc_type, generate_subscripts(fields, 1) AS pos, unnest(fields) AS field FROM (
          SELECT d.doc_id, t.doc_type, t.fields FROM docs d JOIN (VALUES {_TEMPLATES}) t(doc_type, fields)
          ON t.doc_type = d.stated_type)""")
    out["normalize_text"] = f"SELECT doc_id, {norm_text('text')} AS norm FROM documents"
    out["ml_preprocess"] = f"SELECT doc_id, {preprocess('text')} AS processed FROM documents"
    out["normalize_name"] = build(docs("response_1", "response_2", "response_3") + samples(), "SELECT name, norm_name, count(*) AS n FROM fields GROUP BY name, norm_name")
    out["segment_lines"] = build(text_docs + lines(mime=False), "SELECT doc_id, line_idx, line AS text, x, y, w, h, confidence, element_type FROM lines")
    out["line_types"] = build(docs("mime", "text") + lines(), "SELECT doc_id, line_idx, line AS text, w, confidence, element_type FROM lines")
    out["element_counts"] = build(docs("text") + lines(mime=False), "SELECT doc_id, element_type, count(*) AS n_lines FROM lines GROUP BY doc_id, element_type")
    out["layout_points"] = build(docs("mime", "text") + lines(), """SELECT doc_id, line_idx, x + w / 2 AS cx, y + h / 2 AS cy,
        CASE WHEN length(line) > 30 THEN line[1:30] || '...' ELSE line END AS label, least(confidence * 20, CAST(15 AS DOUBLE)) AS size, element_type FROM lines""")
    out["confidence_grid"] = build(docs("mime", "text", "image_width", "image_height") + lines(), f"SELECT doc_id, y_idx, x_idx, round(m, 9) AS mean_confidence, n_lines FROM ({grid})")
    out["confidence_grid_dense"] = build(docs("mime", "text", "image_width", "image_height") + lines() + [("grid", grid), ("dims", f"""
        SELECT doc_id, CAST(yi AS INT) AS y_idx, unnest(range({x_bins})) AS x_idx FROM (SELECT *, unnest(range({y_bins})) AS yi FROM docs)""")],
        "SELECT d.doc_id, d.y_idx, d.x_idx, round(coalesce(g.m, 0), 9) AS mean_confidence, coalesce(g.n_lines, 0) AS n_lines FROM dims d LEFT JOIN grid g ON g.doc_id = d.doc_id AND g.y_idx = d.y_idx AND g.x_idx = d.x_idx")
    out["line_fields"] = build(docs("text") + lines(mime=False), _LINE_FIELDS)
    base = docs("text") + classified()
    out["keyword_scores"] = build(docs("text") + layers(), "SELECT doc_id, doc_type, round(score, 9) AS score FROM kw")
    out["keyword_scores_rules"] = out["keyword_scores"]
    out["structural_scores"] = build(docs("text") + layers(), "SELECT doc_id, doc_type, round(score, 9) AS score FROM st")
    out["context_scores"] = build(docs("text") + layers(), "SELECT doc_id, doc_type, round(score, 9) AS score FROM cx")
    out["layer_scores"] = build(base, "SELECT doc_id, doc_type, round(score, 9) AS score FROM scores")
    out["classify"] = build(base, _CLASSIFIED_COLS)
    out["classify_documents"] = build(text_docs + classified(), _CLASSIFIED_COLS)
    out["classify_stream"] = out["classify_documents"]
    out["indicators"] = build(base, f"""SELECT c.doc_id, c.doc_type, coalesce(i.p, '') AS primary_indicators, coalesce(i.s, '') AS secondary_indicators, coalesce(i.x, '') AS context_matches
        FROM classified c LEFT JOIN (VALUES {_INDICATORS}) i(doc_type, p, s, x) ON i.doc_type = c.doc_type""")
    out["confidence_band"] = build(base, "SELECT confidence_level AS band, count(*) AS n_docs, round(min(confidence), 9) AS lowest, round(max(confidence), 9) AS highest FROM classified GROUP BY 1")
    out["corpus_report"] = build(docs("text", "response_1", "response_2", "response_3") + classified() + samples() + [
        ("bad", "SELECT DISTINCT doc_id, unnest(failed_rules) AS failed_rule FROM valid"),
        ("judged", "SELECT c.doc_id, c.doc_type, c.confidence_level, c.confidence, coalesce(b.failed_rule, 'none') AS failed_rule FROM classified c LEFT JOIN bad b ON b.doc_id = c.doc_id")],
        " UNION ALL ".join(_sub_total(g) for g in range(8)))
    sug = docs("text", "user_fields") + suggested()
    out["suggest_fields"] = build(sug, "SELECT doc_id, doc_type, array_to_string(suggested, '|') AS suggested, len(suggested) AS n_suggested FROM suggested")
    out["map_doc_type"] = build(docs("text", "mime") + classified(), f"SELECT c.doc_id, c.doc_type, {out_type('c.doc_type', 'd.text', chr(40) + 'd.mime <> ' + lit('text/csv') + chr(41))} AS output_type FROM classified c JOIN docs d ON d.doc_id = c.doc_id")
    out["render_prompt"] = build(sug, f"""SELECT doc_id, {a} || {out_type('doc_type', 'text', 'true')} || {b} || CASE WHEN len(suggested) > 0 THEN array_to_string(suggested, ', ') ELSE {lit(ANY_FIELDS)} END
        || {c} || text AS request FROM suggested""")
    out["fallback_fields"] = build(sug + [("fb", _FALLBACK)], "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS pos, name, value FROM fb")
    out["rule_samples"] = build(sug + [
        ("labelled", f"""SELECT * FROM (SELECT doc_id, pos, {strip(f'regexp_extract(l, {label_re}, 1)')} AS name, {strip(f'regexp_extract(l, {label_re}, 2)')} AS value, asked FROM (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos,
              list_transform(suggested, lambda f: {norm_name('f')}) AS asked FROM suggested)) WHERE name <> '' AND value <> ''""")],
        f"""SELECT doc_id, 1 AS sample_no, pos, name, value, CAST(0.9 AS DOUBLE) AS confidence FROM labelled WHERE list_contains(asked, {norm_name('name')})
        UNION ALL SELECT doc_id, 2, pos, name, value, CAST(0.7 AS DOUBLE) FROM labelled WHERE len(list_filter(asked, lambda f: starts_with({norm_name('name')}, f))) > 0
        UNION ALL SELECT doc_id, 3, pos, name, value, CAST(0.5 AS DOUBLE) FROM labelled""")
    out["totals_scan"] = build(docs("text") + amounts(), "SELECT doc_id, ord, value, context FROM amounts")
    out["totals_fields"] = build(docs("text") + amounts(), _TOTALS_FIELDS)
    out["amounts_report"] = build(docs("text") + amounts(), f"SELECT doc_id, ord, context, value, {money('value')} AS label, context = 'total' AS is_total, {status} AS status FROM amounts")
    out["order_reconcile"] = build(docs("truth_text", "price_kind") + truth() + [
        ("items", """SELECT l_orderkey AS doc_id, count(*) AS n_items, sum(CASE WHEN abs(l_quantity * CASE WHEN price_kind = 'net' THEN l_extendedprice / l_quantity ELSE p_retailprice END - l_extendedprice) >= 0.01 THEN 1 ELSE 0 END) AS n_bad,
            CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS items_total FROM lineitem JOIN part ON l_partkey = p_partkey JOIN docs ON docs.doc_id = l_orderkey GROUP BY l_orderkey"""),
        ("said", f"""SELECT doc_id, arg_max(v, pos) FILTER (WHERE n = 'subtotal') AS subtotal, arg_max(v, pos) FILTER (WHERE n IN ('tax', 'tax amount')) AS tax,
            arg_max(v, pos) FILTER (WHERE n = 'total amount') AS total FROM (SELECT doc_id, pos, {norm_name('name')} AS n, TRY_CAST(value AS DOUBLE) AS v FROM truth)
            WHERE n IN ('subtotal', 'tax', 'tax amount', 'total amount') GROUP BY doc_id"""),
        ("chk", """SELECT *, coalesce(abs(items_total - subtotal) < 0.01, false) AS subtotal_matches, coalesce(tax >= 0 AND coalesce(abs(total - subtotal - tax) < 0.01, true), false) AS tax_calculation_valid,
            coalesce(abs(subtotal + coalesce(tax, 0) - total) < 0.01, false) AS total_matches FROM (
            SELECT coalesce(i.doc_id, s.doc_id) AS doc_id, coalesce(n_items, 0) AS n_items, coalesce(n_bad, 0) AS n_bad_items, coalesce(items_total, 0) AS items_total, subtotal, tax, total
            FROM items i FULL OUTER JOIN said s ON s.doc_id = i.doc_id)"""),
        ("msg", """SELECT *, list_filter([CASE WHEN n_bad_items > 0 THEN CAST(n_bad_items AS VARCHAR) || ' line totals differ' END,
            CASE WHEN subtotal IS NULL THEN 'subtotal not stated' WHEN NOT subtotal_matches THEN 'subtotal differs from line items' END, CASE WHEN total IS NULL THEN 'total not stated' WHEN subtotal IS NOT NULL AND NOT total_matches THEN 'total differs from subtotal and tax' END], lambda m: m IS NOT NULL) AS d FROM chk""")],
        """SELECT doc_id, n_items, n_bad_items, round(items_total, 2) AS items_total, subtotal, tax, total, subtotal_matches, tax_calculation_valid, total_matches, array_to_string(d, '|') AS discrepancies,
        array_to_string(list_concat(list_filter([CASE WHEN subtotal_matches THEN 'subtotal_ok' END, CASE WHEN tax_calculation_valid THEN 'tax_ok' END, CASE WHEN total_matches THEN 'total_ok' END], lambda m: m IS NOT NULL),
          list_transform(d, lambda m: 'problem: ' || m)), '|') AS status FROM msg""")
    out["detect_tables"] = build(docs("text") + detected(), f"""SELECT doc_id, table_idx, n AS rows, cols, CAST(0 AS DOUBLE) AS x, CAST(start * 25 AS DOUBLE) AS y, CAST(chars * 8 AS DOUBLE) AS w, CAST(n * 25 AS DOUBLE) AS h,
        CASE WHEN NOT digits AND {any_of('head', ['quantity', 'qty', 'price', 'item', 'description'])} THEN 'line_items' WHEN {any_of('everything', ['total', 'subtotal', 'balance'])} THEN 'summary' ELSE 'data' END AS table_type,
        NOT digits AS has_header, content FROM found""")
    rt = docs("tables_json") + response_tables()
    out["explode_cells"] = build(rt, "SELECT doc_id, table_idx, rows, cols, row, col, content, is_header, x, y, w, h FROM cells")
    out["rebuild_tables"] = build(rt + [
        ("good", "SELECT * FROM cells WHERE rows > 0 AND cols > 0 AND row < rows AND col < cols AND CAST(rows AS BIGINT) * cols <= 1000000"),
        ("place", "SELECT doc_id, table_idx, row, col, arg_max(content, CAST(row AS BIGINT) * 2147483648 + col) AS content FROM good GROUP BY ALL"),
        ("hdr", "SELECT doc_id, table_idx, col, arg_max(content, CAST(row AS BIGINT) * 2147483648 + col) AS content FROM good WHERE is_header GROUP BY ALL"),
        ("headed", f"SELECT DISTINCT doc_id, table_idx FROM hdr WHERE {strip('content')} <> ''"),
        ("slots", "SELECT doc_id, table_idx, rows, cols, row, unnest(range(cols)) AS col FROM (SELECT *, unnest(range(rows)) AS row FROM rtables WHERE rows > 0 AND cols > 0 AND CAST(rows AS BIGINT) * cols <= 1000000)"),
        ("drows", "SELECT s.doc_id, s.table_idx, s.rows, s.cols, s.row, string_agg(coalesce(p.content, ''), '|' ORDER BY s.col) AS v FROM slots s LEFT JOIN place p ON p.doc_id = s.doc_id AND p.table_idx = s.table_idx AND p.row = s.row AND p.col = s.col GROUP BY ALL"),
        ("large", "SELECT * FROM cells WHERE rows > 0 AND cols > 0 AND row < rows AND col < cols AND CAST(rows AS BIGINT) * cols > 1000000"),
        ("lheaded", f"SELECT DISTINCT doc_id, table_idx FROM large WHERE is_header AND {strip('content')} <> ''"),
        ("lsize", "SELECT t.doc_id, t.table_idx, rows, cols, h.doc_id IS NOT NULL AS headed FROM rtables t LEFT JOIN lheaded h ON h.doc_id = t.doc_id AND h.table_idx = t.table_idx WHERE rows > 0 AND cols > 0 AND CAST(rows AS BIGINT) * cols > 1000000"),
        ("lrows", """SELECT l.doc_id, l.table_idx, CAST(row AS BIGINT) AS row, s.cols, string_agg(coalesce(content, ''), '|' ORDER BY col) AS v FROM large l JOIN lsize s ON s.doc_id = l.doc_id AND s.table_idx = l.table_idx
            WHERE NOT (headed AND s.rows > 1 AND row = 0) GROUP BY ALL"""),
        ("lmarks", """SELECT doc_id, table_idx, cols, row FROM lrows UNION ALL SELECT doc_id, table_idx, cols, CAST(rows AS BIGINT) FROM lsize
            UNION ALL SELECT doc_id, table_idx, cols, CAST(CASE WHEN headed AND rows > 1 THEN 0 ELSE -1 END AS BIGINT) FROM lsize"""),
        ("lgaps", "SELECT doc_id, table_idx, cols, row + 1 AS row, lead(row) OVER (PARTITION BY doc_id, table_idx ORDER BY row) - row - 1 AS n FROM lmarks")],
        """SELECT d.doc_id, d.table_idx, 'data' AS kind, d.row AS row_no, d.v AS row_values, CAST(1 AS BIGINT) AS n_rows, d.cols AS n_cols FROM drows d LEFT JOIN headed h ON h.doc_id = d.doc_id AND h.table_idx = d.table_idx WHERE d.row > 0 OR d.rows <= 1 OR h.doc_id IS NULL
        UNION ALL SELECT s.doc_id, s.table_idx, 'header', 0, string_agg(coalesce(x.content, ''), '|' ORDER BY s.col), 1, s.cols FROM slots s JOIN headed h ON h.doc_id = s.doc_id AND h.table_idx = s.table_idx
          LEFT JOIN hdr x ON x.doc_id = s.doc_id AND x.table_idx = s.table_idx AND x.col = s.col WHERE s.row = 0 GROUP BY s.doc_id, s.table_idx, s.cols
        UNION ALL SELECT doc_id, table_idx, 'data', row, v, 1, cols FROM lrows
        UNION ALL SELECT l.doc_id, l.table_idx, 'header', 0, string_agg(coalesce(content, ''), '|' ORDER BY col), 1, l.cols FROM large l JOIN lheaded h ON h.doc_id = l.doc_id AND h.table_idx = l.table_idx WHERE is_header GROUP BY l.doc_id, l.table_idx, l.cols
        UNION ALL SELECT doc_id, table_idx, 'data', row, '', n, cols FROM lgaps WHERE n > 0""")
    out["sparse_tables"] = build(rt + [
        ("inside", "SELECT doc_id, table_idx, rows, cols, row, col, is_header, coalesce(content, '') AS content FROM cells WHERE rows > 0 AND cols > 0 AND row < rows AND col < cols"),
        ("headed", f"SELECT DISTINCT doc_id, table_idx FROM inside WHERE is_header AND {strip('content')} <> ''")],
        """SELECT i.doc_id, i.table_idx, rows, cols, h.doc_id IS NOT NULL AS headed, 'data' AS kind, row AS row_no, string_agg(col || '=' || content, '|' ORDER BY col) AS cells
        FROM inside i LEFT JOIN headed h ON h.doc_id = i.doc_id AND h.table_idx = i.table_idx WHERE NOT (h.doc_id IS NOT NULL AND rows > 1 AND row = 0) GROUP BY ALL
        UNION ALL SELECT i.doc_id, i.table_idx, rows, cols, true, 'header', 0, string_agg(col || '=' || content, '|' ORDER BY col)
        FROM inside i JOIN headed h ON h.doc_id = i.doc_id AND h.table_idx = i.table_idx WHERE is_header GROUP BY ALL""")
    out["table_rects"] = build(rt, "SELECT doc_id, table_idx, x AS x0, y AS y0, x + w AS x1, y + h AS y1, 'Table ' || CAST(table_idx + 1 AS VARCHAR) AS label FROM rtables")
    out["table_cell_fields"] = build(rt, _CELL_FIELDS)
    out["extract_quality"] = build(docs("text") + counts(), f"SELECT doc_id, round({q_image('text', 'n_lines', 'n_tables')}, 9) AS image_quality, round({q_direct('text', 'n_tables')}, 9) AS pdf_quality FROM counts")
    out["doc_metrics"] = build(docs("mime", "text") + counts(), f"""SELECT doc_id, length(text) AS n_chars, n_lines, n_tables > 0 AS has_tables, n_tables AS table_count,
        CASE WHEN {route} = 'unsupported' THEN 'text' ELSE 'ocr' END AS method,
        round(CASE {route} WHEN 'image' THEN {q_image('text', 'n_lines', 'n_tables')} WHEN 'pdf' THEN {q_direct('text', 'n_tables')} END, 9) AS quality FROM counts""")
    raw = docs("response_1", "response_2", "response_3")
    out["parse_samples"] = build(raw + samples(), "SELECT doc_id, sample_no, status, doc_type, len(fields) AS n_fields, overall_confidence FROM parsed")
    out["valid_samples"] = build(raw + samples(), """SELECT doc_id, sample_no, valid, doc_type, len(fields) AS n_fields, round(overall_confidence, 9) AS overall_confidence,
        array_to_string(passed_rules, '|') AS passed_rules, array_to_string(failed_rules, '|') AS failed_rules FROM valid""")
    out["vote_doc_type"] = build(raw + samples() + [("v", "SELECT doc_id, doc_type, count(*) AS n, min(sample_no) AS first FROM valid WHERE valid GROUP BY doc_id, doc_type"),
        ("b", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rn FROM v) WHERE rn = 1")],
        "SELECT d.doc_id, coalesce(b.doc_type, 'unknown') AS doc_type, coalesce(b.n, 0) AS votes FROM docs d LEFT JOIN b ON b.doc_id = d.doc_id")
    out["sample_confidence"] = build(raw + samples(), "SELECT doc_id, sum(CASE WHEN valid THEN 1 ELSE 0 END) AS n_samples, round(coalesce(avg(overall_confidence), 0), 9) AS mean_confidence FROM valid GROUP BY doc_id")
    out["qa_merge"] = build(raw + samples(), "SELECT DISTINCT doc_id, 'passed' AS outcome, unnest(passed_rules) AS rule FROM valid UNION SELECT doc_id, 'failed', unnest(failed_rules) FROM valid")
    out["field_consensus"] = build(raw + consensus(), f"SELECT doc_id, norm_name, name, value, round(confidence, 9) AS confidence, n_entries, CAST(source->>'$.page' AS INT) AS page, {bbox} AS bbox FROM consensus")
    out["validate_fields"] = build(raw + samples(), f"SELECT doc_id, sample_no, pos, norm_name, value, {valid_expr('norm_name', 'value')} AS valid FROM fields")
    out["totals_match"] = build(raw + consensus() + totals_cte("consensus"), "SELECT doc_id, totals_match FROM tot")
    out["validation_summary"] = build(raw + samples() + [
        ("lastf", f"SELECT doc_id, norm_name, arg_max(value, ord) AS value, sum(CASE WHEN confidence < 0.5 THEN 1 ELSE 0 END) AS low FROM fields GROUP BY doc_id, norm_name")] + totals_cte("lastf"),
        f"""SELECT s.doc_id, s.n_names, s.n_valid, round(s.n_valid / CAST(s.n_names AS DOUBLE), 9) AS pass_rate, CASE WHEN s.n_low > 0 THEN CAST(s.n_low AS VARCHAR) || ' low-confidence fields' END AS notes, t.totals_match,
          CASE WHEN t.totals_match = 'failed' THEN 'totals_match' ELSE '' END AS failed_rules, 'ok' AS status
        FROM (SELECT doc_id, count(*) AS n_names, sum(CASE WHEN {valid_expr('norm_name', 'value')} THEN 1 ELSE 0 END) AS n_valid, sum(low) AS n_low FROM lastf GROUP BY doc_id) s JOIN tot t ON t.doc_id = s.doc_id""")
    full = docs("text", "mime", "response_1", "response_2", "response_3")
    out["source_locate"] = build(full + located(), f"SELECT doc_id, norm_name, value, line_idx, CASE WHEN line_idx IS NOT NULL THEN 1 END AS page, {box} AS bbox, CASE WHEN line_idx IS NULL THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS source_confidence FROM located")
    out["field_confidence"] = build(full + scored(), "SELECT doc_id, norm_name, value, valid, line_idx, round(confidence, 9) AS confidence FROM scored")
    out["overall_confidence"] = build(full + scored(), "SELECT doc_id, doc_type, output_type, n_samples, n_names, n_located, round(pass_rate, 9) AS pass_rate, notes, totals_match, round(overall, 6) AS overall_confidence FROM results")
    out["process_file"] = build(full + scored(), f"""SELECT doc_id, doc_type, n_votes, class_type, output_type, round(class_conf, 6) AS classification_confidence, {band('class_conf')} AS confidence_level, decided_by,
        n_samples, n_names, n_located, round(pass_rate, 9) AS pass_rate, notes, totals_match, round(overall, 6) AS overall_confidence FROM results""")
    ocr = "(mime = 'application/pdf' OR starts_with(mime, 'image/'))"
    out["process_fields"] = build(docs("text", "mime", "tables_json", "response_1", "response_2", "response_3") + consensus() + response_tables() + amounts() + lines(mime=False) + [
        ("read", f"SELECT doc_id FROM docs WHERE {ocr}"), ("cf", _CELL_FIELDS), ("tf", _TOTALS_FIELDS), ("lf", _LINE_FIELDS),
        ("every", "SELECT doc_id, name, value, 1 AS prio, 'base' AS source FROM consensus" + "".join(
            f" UNION ALL SELECT doc_id, name, value, {i}, '{n}' FROM {t} SEMI JOIN read USING (doc_id)" for i, n, t in ((2, "table", "cf"), (3, "totals", "tf"), (4, "line", "lf"))))],
        "SELECT doc_id, name, arg_max(value, prio) AS value, arg_max(source, prio) AS source FROM every GROUP BY doc_id, name")
    out["document_report"] = build(full + scored(), """SELECT doc_type, count(*) AS n_docs, round(avg(overall), 6) AS mean_overall, round(avg(pass_rate), 9) AS mean_pass_rate,
        sum(CASE WHEN totals_match = 'passed' THEN 1 ELSE 0 END) AS totals_passed, sum(CASE WHEN totals_match = 'failed' THEN 1 ELSE 0 END) AS totals_failed, sum(n_located) AS n_located FROM results GROUP BY doc_type""")
    esc = lambda x: f"to_json({x})"
    out["export_json"] = build(full + scored() + [("fj", f"""SELECT doc_id, string_agg('{{"name":' || {esc('name')} || ',"value":' || {esc('value')} || ',"confidence":' || CAST(round(confidence, 6) AS VARCHAR)
        || ',"source":' || CASE WHEN line_idx IS NULL THEN 'null' ELSE '{{"page":1,"bbox":[0.0,' || CAST(line_idx * 25 AS VARCHAR) || '.0,' || CAST(w AS VARCHAR) || ',' || CAST(line_idx * 25 + 20 AS VARCHAR) || '.0]}}' END || '}}', ',' ORDER BY ord) AS fs FROM scored GROUP BY doc_id""")],
        f"""SELECT r.doc_id, r.doc_type, '{{"doc_type":"' || r.doc_type || '","fields":[' || coalesce(f.fs, '') || '],"overall_confidence":' || CAST(round(r.overall, 6) AS VARCHAR)
        || ',"qa":{{"passed_rules":' || CASE WHEN r.totals_match = 'passed' THEN '["totals_match"]' ELSE '[]' END || ',"failed_rules":' || CASE WHEN r.totals_match = 'failed' THEN '["totals_match"]' ELSE '[]' END
        || ',"notes":' || coalesce('"' || r.notes || '"', 'null') || '}}}}' AS record FROM results r LEFT JOIN fj f ON f.doc_id = r.doc_id""")
    out["merge_fields"] = build(docs("text", "user_fields", "tables_json") + suggested() + response_tables() + amounts() + lines(mime=False) + [
        ("fb", _FALLBACK), ("cf", _CELL_FIELDS), ("tf", _TOTALS_FIELDS), ("lf", _LINE_FIELDS),
        ("every", "SELECT doc_id, name, value, 1 AS prio, 'base' AS source FROM fb UNION ALL SELECT doc_id, name, value, 2, 'table' FROM cf UNION ALL SELECT doc_id, name, value, 3, 'totals' FROM tf UNION ALL SELECT doc_id, name, value, 4, 'line' FROM lf")],
        "SELECT doc_id, name, arg_max(value, prio) AS value, arg_max(source, prio) AS source FROM every GROUP BY doc_id, name")
    ev = docs("truth_text", "response_1", "response_2", "response_3") + outcomes()
    out["eval_fields"] = build(ev, "SELECT doc_id, norm_name, pred_value, true_value, outcome FROM outcomes")
    out["eval_metrics"] = build(ev, rates("doc_id", "doc_id"))
    out["eval_by_field"] = build(ev, rates("norm_name", "ROLLUP (norm_name)", "CASE WHEN GROUPING(norm_name) = 1 THEN 'corpus' ELSE 'field' END AS level"))
    out["tfidf_vocab"] = build(vocab("documents"), "SELECT term, df, tf, round(idf, 6) AS idf FROM vocab")
    tw = vocab("documents") + weights("w", "vg")
    out["tfidf_weights"] = build(tw, "SELECT doc_id, term, tf, round(weight, 6) AS weight FROM w")
    out["top_terms"] = build(tw, """SELECT doc_id, term, round(weight, 6) AS weight, rank, CASE WHEN rank <= 3 THEN 'primary' WHEN rank <= 6 THEN 'secondary' ELSE 'other' END AS role FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 12) DESC, term) AS rank FROM w) WHERE rank <= 10""")
    out["nb_model"] = build(_LABELLED + bayes("labelled"), "SELECT label, term, round(log_prob, 6) AS log_prob FROM nb")
    out["nb_predict"] = build(_LABELLED + bayes("labelled") + nb_scores("documents"), "SELECT doc_id, label, round(p, 6) AS confidence FROM best")
    out["hybrid_nb"] = build(docs("text") + hybrid(),
        f"""SELECT doc_id, CASE WHEN wins THEN ({_NAMES})[label + 1] ELSE doc_type END AS doc_type, round(CASE WHEN wins THEN p ELSE confidence END, 6) AS confidence,
          {band('CASE WHEN wins THEN p ELSE confidence END')} AS confidence_level, CASE WHEN wins THEN 'model' ELSE 'rules' END AS decided_by,
          CASE WHEN wins THEN array_to_string(list_concat(t[1:3], list_filter(string_split(ip, '|')[1:2], lambda w: w <> '')), '|') ELSE ip END AS primary_indicators,
          CASE WHEN wins THEN array_to_string(t[4:6], '|') ELSE isec END AS secondary_indicators, ix AS context_matches,
          round(CASE WHEN wins THEN p ELSE keyword_score END, 6) AS keyword_score, round(CASE WHEN wins THEN 0 ELSE structural_score END, 6) AS structural_score,
          round(CASE WHEN wins THEN 0 ELSE context_score END, 6) AS context_score FROM sides""")
    out["hybrid_untrained"] = build(base, f"""SELECT c.doc_id, c.doc_type, round(confidence, 6) AS confidence, confidence_level, 'rules' AS decided_by, coalesce(i.p, '') AS primary_indicators,
        coalesce(i.s, '') AS secondary_indicators, coalesce(i.x, '') AS context_matches, round(keyword_score, 6) AS keyword_score, round(structural_score, 6) AS structural_score,
        round(context_score, 6) AS context_score FROM classified c LEFT JOIN (VALUES {_INDICATORS}) i(doc_type, p, s, x) ON i.doc_type = c.doc_type""")
    return out
