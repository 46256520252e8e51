"""Layered rule classification.

Three layers score every document type: keywords on normalised text, structure
on the raw text and context on normalised text.  All layers are projections, so
classification never shuffles.  The words of all rules are found in one pass over
the normalised text and kept as bits, so a rule counts its words without the text.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.text import WS, confidence_band, normalize_text


def with_normalized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("norm", normalize_text(F.col("text")))


FEW = 4  # first characters that a search for rule words tries one after the other
BITS = 62  # words in one number; of its 64 bits the sign stays free


@cache
def rule_words() -> dict[str, int]:
    """Every word that a keyword or context rule looks for in normalised text, with its bit."""
    words = [w for rule in rules.KEYWORD_RULES for w in rule[3]]
    for _, _, primary, secondary, _ in rules.CONTEXT_RULES:
        words += [*primary, *[p.lower() for p in secondary if _is_word(p)]]
    return {w: i for i, w in enumerate(dict.fromkeys(words))}


def _is_word(pattern: str) -> bool:
    """Of the secondary context patterns those that are plain text."""
    return pattern not in ("$", "€", "£", "°F", "°C") and "\\" not in pattern


def _longest(words: list[str]) -> str:
    """Pattern for the longest of the words that starts at a place: common beginnings are written once, so that a place
    is left at its first character that continues no word."""
    after: dict[str, list[str]] = {}
    for w in words:
        if w:
            after.setdefault(w[0], []).append(w[1:])
    if not after:
        return ""
    begun = [(c, re.escape(c) + _longest(rest)) for c, rest in sorted(after.items())]
    either = "|".join(x for _, x in begun)
    if len(begun) > 2 * FEW:  # a choice tries all its branches one by one, so look for the few that may follow first
        parts = [begun[i:i + FEW] for i in range(0, len(begun), FEW)]
        either = "|".join(f"(?=[{''.join(c for c, _ in part)}])(?:{'|'.join(x for _, x in part)})" for part in parts)
    either = either if len(after) == 1 and "" not in words else f"(?:{either})"
    return either + "?" * ("" in words)


def _mask_columns() -> list[str]:
    return [f"rule_words_{i}" for i in range(-(-len(rule_words()) // BITS))]


def _masks(words: list[str]) -> list[int]:
    """The words' bits, one number for each mask column."""
    return [sum(1 << rule_words()[w] % BITS for w in set(words) if rule_words()[w] // BITS == i) for i in range(len(_mask_columns()))]


def with_rule_words(normalized: DataFrame) -> DataFrame:
    """Add the mask columns: the bits of all rule words that `norm` contains.

    One pass finds the longest word at every place; the words that it begins with are found there, too."""
    words = list(rule_words())
    begun = [_masks([w for w in words if longest.startswith(w)]) for longest in words]
    bits = F.expr(f"map({', '.join(f"'{w}', array({', '.join(f'{m}L' for m in ms)})" for w, ms in zip(words, begun, strict=True))})")
    first = "".join(sorted({w[0] for w in words}))
    found = F.array_distinct(F.regexp_extract_all("norm", F.lit(f"(?=[{first}])(?=({_longest(words)}))"), F.lit(1)))
    kept = normalized.columns
    masks = normalized.select(*kept, F.transform(found, lambda w: bits[w]).alias("rule_words"))
    return masks.select(*kept, *[F.expr(f"aggregate(rule_words, 0L, (a, m) -> a | m[{i}])").alias(c) for i, c in enumerate(_mask_columns())])


def _hits(words: list[str]) -> Column:
    """How many of the words occur."""
    parts = [f"bit_count({c} & {m}L)" for c, m in zip(_mask_columns(), _masks(words), strict=True) if m]
    return F.expr(" + ".join(parts))


def keyword_score(doc_type: str) -> Column:
    """Sum over the type's patterns of weight x share of keywords found.

    White space is already single here, so a position preference is met by any
    hit and acts as a constant factor.
    """
    score = F.lit(0.0)
    for weight, position, kws in rules.keyword_rules(doc_type):
        part = F.lit(weight) * (_hits(kws).cast("double") / F.lit(float(len(kws))))
        if position:
            part = part * F.lit(rules.POSITION_FACTOR)
        score = score + part
    return score


def _quick(pattern: str) -> str:
    """The pattern, case ignored; one that begins with a choice of words looks only at their first letters elsewhere."""
    choice = re.match(r"\(\?:([a-z]+(?:\|[a-z]+)*)\)", pattern)
    first = sorted({w[0] for w in choice[1].split("|")}) if choice else []
    ahead = f"(?=[{''.join(c + c.upper() for c in first)}])" if first else ""
    return f"(?i){ahead}" + pattern.replace(r"\s", WS)


def structural_score(text: Column, doc_type: str) -> Column:
    for t, header, footer, table, number, date in rules.STRUCTURE_RULES:
        if t != doc_type:
            continue
        top = F.lower(F.substring_index(text, "\n", 5))
        bottom = F.lower(F.substring_index(text, "\n", -5))
        score = F.lit(0.0)
        for w in header:
            score = score + F.when(top.contains(w), 1.0).otherwise(0.0)
        for w in footer:
            score = score + F.when(bottom.contains(w), 0.5).otherwise(0.0)
        score = score + F.when(text.rlike(_quick(number)), 1.0).otherwise(0.0)
        score = score + F.when(text.rlike(_quick(date)), 0.5).otherwise(0.0)
        if table:
            tabs = F.length(text) - F.length(F.replace(text, F.lit("\t"), F.lit("")))
            gaps = F.regexp_count(text, F.lit(" {2,}"))
            score = score + F.when(tabs + gaps > 10, 1.0).otherwise(0.0)
        return score
    return F.lit(0.0)


def _secondary(norm: str, patterns: list[str]) -> Column:
    """How many secondary context patterns hold.  They are regular expressions on normalised text: a bare $ is the end
    anchor and always matches, and patterns of characters that normalisation blanks never match."""
    count = _hits([p.lower() for p in patterns if _is_word(p)])
    for pattern in patterns:
        if pattern == "$":
            count = count + 1
        elif "\\" in pattern and pattern != r"\*{4}":
            count = count + F.expr(f"int({norm} RLIKE r'{pattern}')")
    return count


def context_score(doc_type: str, norm: str = "norm") -> Column:
    score = F.lit(0.0)
    for t, _, primary, secondary, weight in rules.CONTEXT_RULES:
        if t != doc_type:
            continue
        first, second = _hits(primary), _secondary(norm, secondary)
        share = (first + second).cast("double") / F.lit(float(len(primary) + len(secondary)))
        score = score + F.when((first > 0) & (second > 0), F.lit(weight) * share).otherwise(0.0)
    return score


def layer_scores(docs: DataFrame) -> DataFrame:
    """Add kw_<type>, st_<type> and cx_<type> columns for every rule type."""
    keep = [c for c in docs.columns]
    norm = with_rule_words(with_normalized(docs))
    return norm.select(
        *keep,
        *[keyword_score(t).alias(f"kw_{t}") for t in rules.RULE_TYPES],
        *[structural_score(F.col("text"), t).alias(f"st_{t}") for t in rules.RULE_TYPES],
        *[context_score(t).alias(f"cx_{t}") for t in rules.RULE_TYPES])


def with_candidates(docs: DataFrame) -> DataFrame:
    """Add `candidates`: one struct per rule type with its combined score.

    Types with structure or context rules are always candidates, the others
    only with a keyword hit; they are NULL without.
    """
    scored = layer_scores(docs)
    top = F.greatest(*[F.col(f"kw_{t}") for t in rules.RULE_TYPES], F.lit(1.0))
    w = rules.LAYER_WEIGHTS
    structs = []
    for t in rules.RULE_TYPES:
        kw, st, cx = F.col(f"kw_{t}"), F.col(f"st_{t}"), F.col(f"cx_{t}")
        score = (F.lit(w["keyword"]) * (kw / F.col("kw_top"))
                 + F.lit(w["structural"]) * F.least(st / F.lit(rules.STRUCTURE_MAX), F.lit(1.0))
                 + F.lit(w["context"]) * F.least(cx / F.lit(rules.CONTEXT_MAX), F.lit(1.0)))
        s = F.struct(F.round(score, 12).alias("score"), F.lit(-rules.TYPE_ORD[t]).alias("rank"),
                     F.lit(t).alias("doc_type"), kw.alias("keyword"), st.alias("structural"),
                     cx.alias("context"))
        structs.append(s if t in rules.ALWAYS_SCORED else F.when(kw > 0, s))
    return scored.withColumn("kw_top", top).select(
        *docs.columns, F.array(*structs).alias("candidates"))


def classify(docs: DataFrame) -> DataFrame:
    """Classify `docs(doc_id, text, ...)`; keeps all input columns.

    Ties go to the type declared first.  Confidence is the best score plus half
    its lead over the second, the lead counting at most 0.3; under 0.1 the type
    is unknown.
    """
    ordered = with_candidates(docs).withColumn("c", F.sort_array("candidates", asc=False))  # NULLs last
    best, second = F.col("c")[0], F.col("c")[1]
    conf = F.least(F.least(best["score"], F.lit(1.0))
                   + F.least((best["score"] - second["score"]) * 0.5, F.lit(0.3)), F.lit(1.0))
    decided = ordered.select(
        *docs.columns, F.round(conf, 12).alias("confidence"), best.alias("best"))
    known = F.col("confidence") >= 0.1
    return decided.select(
        *docs.columns,
        F.when(known, F.col("best.doc_type")).otherwise("unknown").alias("doc_type"),
        "confidence",
        *[F.when(known, F.col(f"best.{n}")).otherwise(0.0).alias(f"{n}_score")
          for n in ("keyword", "structural", "context")],
        confidence_band(F.col("confidence")).alias("confidence_level"))


def with_indicators(classified: DataFrame) -> DataFrame:
    """Add the explanation lists of the winning type."""
    def lookup(which: int) -> Column:
        out = None
        for t in rules.RULE_TYPES:
            value = F.array(*[F.lit(x) for x in rules.indicators(t)[which]]).cast("array<string>")
            cond = F.col("doc_type") == t
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return out.otherwise(F.array().cast("array<string>"))
    return classified.withColumns({
        "primary_indicators": lookup(0), "secondary_indicators": lookup(1),
        "context_matches": lookup(2)})


GRAM = 4  # characters of an index gram; shorter keywords are grams themselves
#: Up to so many grams of keywords are sent to the documents, so that the grams of these stay where they are made; more
#: of them meet the documents' by a join of Spark's own choice, with the same result.
SENT_GRAMS = 1_000_000


def _grams(text: Column, length: int) -> Column:
    """All substrings of a length: empty matches whose lookahead captures it."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))


def keyword_hits(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(doc_id, keyword) for each of the distinct, non-empty `keywords(keyword)` that a normalised text contains.

    A keyword occurs only where all its grams occur, so it is looked up by one of them: the one that the fewest
    documents have.  Documents are cut into grams once, and only grams of the index leave them.  A document's candidate
    keywords then meet its text in one row, where they are tested; the text is not copied for each of them.  Grams that
    no document has settle their keywords at once.
    """
    known = keywords.filter(F.col("keyword") != "").select("keyword").distinct()
    size = F.least(F.length("keyword"), F.lit(GRAM))
    sizes = known.groupBy(size.alias("n")).agg(F.sum(F.length("keyword") - size + 1).alias("grams")).orderBy("n").collect()  # GRAM rows at most
    if not sizes:
        return docs.select("doc_id", F.lit("").alias("keyword")).limit(0)
    lengths = [r.n for r in sizes]
    sent = F.broadcast if sum(r.grams for r in sizes) <= SENT_GRAMS else lambda df: df
    own = F.coalesce(*[F.when(size == n, _grams(F.col("keyword"), n)) for n in lengths])
    keyed = known.select("keyword", F.explode(F.array_distinct(own)).alias("gram"))
    norm = with_normalized(docs).select("doc_id", "norm").filter("doc_id IS NOT NULL")
    # one pass over a text: its windows of the longest length, shorter at its end; shorter grams are their beginnings
    windows = F.regexp_extract_all("norm", F.lit(f"(?s)(?=(.{{1,{lengths[-1]}}}))"), F.lit(1))
    cut = norm.select("doc_id", F.array_distinct(windows).alias("windows"))
    every = F.concat(*[F.array_distinct(F.transform(F.filter("windows", lambda w: F.length(w) >= n), lambda w: F.substring(w, 1, n))) for n in lengths])
    used = cut.select("doc_id", F.explode(every).alias("gram")).join(sent(keyed.select("gram").distinct()), "gram", "left_semi")
    # the grams of a document meet again where its text goes; both uses read the same shuffle
    by_doc = used.groupBy("doc_id").agg(F.collect_list("gram").alias("grams"))
    kept = by_doc.select("doc_id", F.explode("grams").alias("gram"))
    seen = kept.groupBy("gram").agg(F.count(F.lit(1)).alias("n_docs"))
    rarest = keyed.join(seen, "gram", "left").groupBy("keyword").agg(
        F.min(F.struct(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "gram")).alias("r"))
    index = rarest.filter(F.col("r.n_docs") > 0).select("keyword", "r.gram")
    candidates = kept.join(sent(index), "gram").groupBy("doc_id").agg(F.collect_list("keyword").alias("keywords"))
    tested = norm.join(candidates, "doc_id").select("doc_id", F.explode(F.filter("keywords", lambda k: F.contains("norm", k))).alias("keyword"))
    return tested


def keyword_scores_by_rules(docs: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Keyword layer for rules that live in a table of any size.  Returns doc_id, doc_type, score."""
    kw = rule_table.select(
        "doc_type", "pattern_id", "weight", "position", F.size("keywords").alias("n_keywords"),
        F.explode("keywords").alias("keyword")).withColumn("keyword", F.lower("keyword"))
    hits = (keyword_hits(docs, kw).join(kw, "keyword")
            .groupBy("doc_id", "doc_type", "pattern_id", "weight", "position", "n_keywords")
            .agg(F.count(F.lit(1)).alias("hits")))
    part = F.col("weight") * (F.col("hits").cast("double") / F.col("n_keywords").cast("double"))
    part = F.when(F.col("position").isNotNull(), part * rules.POSITION_FACTOR).otherwise(part)
    return (hits.select("doc_id", "doc_type", part.alias("part"))
            .groupBy("doc_id", "doc_type").agg(F.sum("part").alias("score")))
