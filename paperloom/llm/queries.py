"""Registered queries of this package and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import (bpe, collocations, decontaminate, digests, exact_dedup, jaccard, license_scan, line_dedup, pii, prefix_trie, quality, secrets_scan,
                           url_filter)
from paperloom.sources.tables import read_table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"), bpe.Tokenizer(spark, BYTE_BPE))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, key="surrogates-2024", count="n_entities")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(read_table(spark, sf_dir, "documents")).rows


def op3_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(read_table(spark, sf_dir, "documents"), every_link=True).rows


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    machine = quality.train(docs, labels.where(~quality.held_out()))
    return quality.score(docs, machine, "doc_id").select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.scan_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in secrets_scan.KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets_scan.joined(base), 256).alias("base_sha256"), secrets_scan.joined(F.col("spans")).alias("spans"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.withColumn("containment", F.round("containment", 9))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_verdicts(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(read_table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.compare_neighbours(read_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.opened_trie(read_table(spark, sf_dir, "conversations")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {
    "op1_bpe": op1_bpe, "op2_pii": op2_pii, "op3_jaccard": op3_jaccard, "op3_jaccard_links": op3_jaccard_links, "op4_url_filter": op4_url_filter,
    "op5_quality": op5_quality, "op6_decontaminate": op6_decontaminate, "op7_secrets": op7_secrets,
    "op8_licenses": op8_licenses, "op9_exact_dedup": op9_exact_dedup, "op10_line_dedup": op10_line_dedup,
    "op11_collocations": op11_collocations, "op12_fingerprints": op12_fingerprints, "op13_prefix_trie": op13_prefix_trie,
}


def _license_sql() -> str:
    """Exact containment over the same windows, without any retrieval."""
    notices = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in license_scan.NOTICES.items())
    word = r"[\p{L}\p{N}]+"
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in license_scan.rivals(license_scan.NOTICES))
    return f"""
WITH n(license_id, template) AS (VALUES {notices}),
     nw AS (SELECT license_id, regexp_extract_all(lower(template), '{word}') AS w FROM n),
     ns AS (SELECT DISTINCT license_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM nw, range(1, len(w) - 1) r(i)),
     nn AS (SELECT license_id, count(*) AS size, ceil(log2(count(*)))::INTEGER AS class FROM ns GROUP BY 1),
     dw AS (SELECT doc_id, regexp_extract_all(lower(text), '{word}') AS w FROM documents),
     ds AS (SELECT doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM dw, range(1, len(w) - 1) r(i)),
     hit AS (SELECT ds.doc_id, ds.pos, ds.s, ns.license_id, size, (1 << class) AS width FROM ds JOIN ns USING (s) JOIN nn USING (license_id)),
     win AS (SELECT *, pos // width AS win FROM hit UNION ALL SELECT *, pos // width - 1 FROM hit),
     every AS (SELECT doc_id, license_id, win, count(DISTINCT s) / any_value(size) AS containment FROM win GROUP BY 1, 2, 3),
     rival(license_id, other) AS (VALUES {pairs}),
     held AS (SELECT * FROM every WHERE containment >= 0.75),
     beaten AS (SELECT DISTINCT h.doc_id, h.license_id, h.win FROM held h JOIN rival r ON r.license_id = h.license_id
                JOIN held o ON o.doc_id = h.doc_id AND o.win = h.win AND o.license_id = r.other AND o.containment > h.containment)
SELECT doc_id, license_id, round(max(containment), 9) AS containment, count(*) AS n_windows FROM held ANTI JOIN beaten USING (doc_id, license_id, win) GROUP BY 1, 2"""


ORACLE_SQL = {
    "op3_jaccard": r"""
WITH RECURSIVE
     w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, range(1, greatest(len(w) - 3, 2)) r(i) WHERE len(w) > 0),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
     p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
     l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
     e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
     r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.c), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY w.doc_id""",
    "op8_licenses": _license_sql(),
    "op9_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op10_line_dedup": """
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
     l AS (SELECT doc_id, i - 1 AS line_no, trim(ls[i], ' ' || chr(9) || chr(13)) AS line FROM t, range(1, len(ls) + 1) r(i)),
     d AS (SELECT line, length(line) AS n, min((doc_id, line_no)) AS place FROM l WHERE line <> '' GROUP BY 1, 2),
     c AS (SELECT a.place, b.place AS other FROM d a JOIN d b ON left(a.line, 9) = left(b.line, 9)
             AND abs(a.n - b.n) <= 1 AND least(a.n, b.n) >= 20
           WHERE a.place > b.place AND levenshtein(a.line, b.line) <= 1
           UNION
           SELECT a.place, b.place FROM d a JOIN d b ON right(a.line, 9) = right(b.line, 9)
             AND abs(a.n - b.n) <= 1 AND least(a.n, b.n) >= 20
           WHERE a.place > b.place AND levenshtein(a.line, b.line) <= 1),
     e AS (SELECT place, min(other) AS other FROM c GROUP BY 1),
     f AS (SELECT l.doc_id, l.line_no, CASE WHEN e.other IS NOT NULL THEN e.other WHEN d.place <> (l.doc_id, l.line_no) THEN d.place END AS m,
                  e.other IS NOT NULL AS near
           FROM l LEFT JOIN d ON d.line = l.line LEFT JOIN e ON e.place = d.place)
SELECT doc_id, line_no, m IS NULL AS kept, m[1] AS match_doc_id, m[2] AS match_line_no,
       CASE WHEN m IS NOT NULL THEN near::INTEGER END AS edits FROM f""",
}
ORACLE_SQL["op11_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
     f1 AS MATERIALIZED (SELECT lang, x, count(*) AS c FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY 1, 2),
     t AS (SELECT lang, sum(c)::BIGINT AS n FROM f1 GROUP BY 1),
     f2 AS MATERIALIZED (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS c FROM w, range(1, len(w)) r(i) GROUP BY 1, 2, 3 HAVING count(*) >= 10),
     f3 AS MATERIALIZED (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS c FROM w, range(1, len(w) - 1) r(i) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
     h AS (SELECT lang, x, y, max(c) AS c FROM (SELECT lang, x, y, c FROM f3 UNION ALL SELECT lang, y, z, c FROM f3) GROUP BY 1, 2, 3),
     c AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, 1 AS k, f2.c AS a, l.c AS l, r.c AS r
           FROM f2 JOIN f1 l ON l.lang = f2.lang AND l.x = f2.x JOIN f1 r ON r.lang = f2.lang AND r.x = f2.y
           LEFT JOIN h ON h.lang = f2.lang AND h.x = f2.x AND h.y = f2.y WHERE h.c IS NULL OR 100 * h.c < 50 * f2.c
           UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, 1, f3.c, l.c, r.c
           FROM f3 JOIN f1 l ON l.lang = f3.lang AND l.x = f3.x JOIN f2 r ON r.lang = f3.lang AND r.x = f3.y AND r.y = f3.z
           UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, 2, f3.c, l.c, r.c
           FROM f3 JOIN f2 l ON l.lang = f3.lang AND l.x = f3.x AND l.y = f3.y JOIN f1 r ON r.lang = f3.lang AND r.x = f3.z),
     s AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM c),
     m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000"""
ORACLE_SQL["op13_prefix_trie"] = r"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
     n AS (SELECT conv_id, conv_id - conv_id % 20 AS lender, count(*) AS n,
                  xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                        lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                      lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END), 4294967295::BIGINT) % 4 AS h
           FROM o GROUP BY conv_id),
     g AS (SELECT n.conv_id, n.lender, n.h, least(n.h, coalesce(b.n, 0)) AS lent FROM n LEFT JOIN n b ON b.conv_id = n.lender),
     r AS (SELECT g.conv_id, o.pos - g.h + g.lent AS pos, role, text FROM g JOIN o USING (conv_id) WHERE o.pos >= g.h
           UNION ALL SELECT g.conv_id, o.pos, role, text FROM g JOIN o ON o.conv_id = g.lender WHERE o.pos < g.lent),
     x AS MATERIALIZED (SELECT conv_id, pos + 1 AS depth, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY pos) AS path,
                  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
                  pos + 1 = count(*) OVER (PARTITION BY conv_id) AS ends FROM r
           UNION ALL SELECT conv_id, 0, [], 0, conv_id NOT IN (SELECT conv_id FROM r) FROM n),
     d AS MATERIALIZED (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                  string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids FROM x GROUP BY path, depth),
     k AS (SELECT path[:-2] AS path, depth - 1 AS depth, count(*) AS n_children FROM d WHERE depth > 0 GROUP BY 1, 2),
     e AS MATERIALIZED (SELECT d.*, coalesce(n_children, 0) AS n_children FROM d LEFT JOIN k USING (path, depth)),
     s AS (SELECT x.path, x.depth, count(*) FILTER (WHERE e.n_children = 0) AS n_leaves, sum((e.n_convs - 1) * e.words)::BIGINT AS saved_tokens
           FROM e JOIN x ON x.conv_id = e.conv_id AND x.depth <= e.depth GROUP BY 1, 2)
SELECT e.conv_id, e.depth, u.conv_id AS parent_conv_id, e.n_convs, e.n_children, n_leaves, saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM e JOIN s USING (path, depth) LEFT JOIN e u ON u.depth = e.depth - 1 AND u.path = e.path[:-2]"""
# the same links, and their number for each row
ORACLE_SQL["op3_jaccard_links"] = ORACLE_SQL["op3_jaccard"].replace(
    "SELECT w.doc_id, coalesce", ", m AS (SELECT x, count(*) AS n_links FROM e GROUP BY 1)\nSELECT w.doc_id, coalesce").replace(
    "AS component_id\n", "AS component_id, coalesce(any_value(n_links), 0) AS n_links\n").replace(
    "LEFT JOIN r USING (doc_id)", "LEFT JOIN r USING (doc_id) LEFT JOIN m ON m.x = w.doc_id")
