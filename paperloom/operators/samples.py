"""Extractor samples: parsing, schema checks, voting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.scores import clip
from paperloom.functions.text import normalize_name, strip

RESPONSE_SCHEMA = (
    "doc_type string, fields array<map<string,string>>, overall_confidence string, "
    "qa struct<passed_rules array<string>, failed_rules array<string>, notes string>, _corrupt string")
SOURCE_SCHEMA = "page int, bbox array<double>"
SOURCE_TYPE = "struct<page:int,bbox:array<double>>"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _number(c: Column) -> Column:
    return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))


def parse_samples(raw: DataFrame) -> DataFrame:
    """`samples_raw(doc_id, sample_no, response)` to parsed samples with a status.

    ok: the response was the object itself; recovered: the widest {...} inside
    other text was; empty: no braces at all, which counts as a sample without
    fields; dropped: nothing readable, or JSON that is no object.
    """
    text = F.coalesce("response", F.lit(""))
    # a response that is nothing but the object needs neither trimming nor a search for it
    bare = text.startswith("{") & text.endswith("}")
    trimmed = F.when(bare, text).otherwise(strip(text))
    body = F.when(bare, text).otherwise(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    # only text that could be a list, string, number or literal needs the second parse
    maybe_other = ~bare & trimmed.rlike(r'^(\[|"|-?\d|true$|false$|null$)')
    not_object = maybe_other & F.try_parse_json(trimmed).isNotNull()
    parsed = raw.select("doc_id", "sample_no", trimmed.alias("trimmed"), body.alias("body"),
                        F.when(maybe_other, not_object).otherwise(False).alias("not_object"))
    parsed = parsed.withColumn("j", F.from_json(
        F.when(F.col("body") == "", "{}").otherwise(F.col("body")), RESPONSE_SCHEMA,
        {"columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}))
    # the reader stops after one object; what follows it shows in the length of an array of the whole
    single = F.coalesce(F.json_array_length(F.concat(F.lit("["), F.col("body"), F.lit("]"))), F.lit(0)) == 1
    key = F.lit("overall_confidence")
    null_overall = F.when(
        F.col("j.overall_confidence").isNull() & F.col("body").contains('"overall_confidence"'),
        F.map_contains_key(F.from_json("body", "map<string,string>"), key)).otherwise(False)
    status = (F.when(F.col("not_object"), "dropped").when(F.col("body") == "", "empty")
              .when(F.col("j._corrupt").isNotNull() | ~single, "dropped")
              .when(F.col("trimmed") == F.col("body"), "ok").otherwise("recovered"))
    empty = F.array().cast("array<map<string,string>>")
    readable = F.col("status") != "dropped"
    return parsed.withColumn("status", status).select(
        "doc_id", "sample_no", "status",
        F.when(readable, F.col("j.doc_type")).alias("doc_type"),
        F.when(readable, F.coalesce("j.fields", empty)).otherwise(empty).alias("fields"),
        # an explicit null is a value that is no number
        F.when(readable & null_overall, "null").when(readable, F.col("j.overall_confidence")).alias("overall_confidence"),
        F.when(readable, F.col("j.qa")).alias("qa"))


def valid_samples(parsed: DataFrame, hint: Column | None = None) -> DataFrame:
    """Apply defaults and keep whole samples only.

    A field without name or value key, or with a confidence that is no number,
    or an overall confidence that is none, makes the whole sample invalid.
    `hint` is the document type used when a sample names none.
    """
    fallback = hint if hint is not None else F.lit("unknown")
    overall = F.coalesce("overall_confidence", F.lit("0.0"))

    # each key is looked up once in a field's map, and each number read once
    looked = F.transform("fields", lambda f, i: F.struct(
        i.alias("pos"), f.alias("map"), f["name"].alias("name"), f["value"].alias("value"), f["confidence"].alias("said")))
    read = F.transform(looked, lambda r: F.struct(r.alias("r"), _number(r["said"]).alias("number")))

    def whole(x):
        """The field with its defaults; NULL for one that makes the sample invalid."""
        r, number = x["r"], x["number"]
        ok = (r["name"].isNotNull() & (r["value"].isNotNull() | F.map_contains_key(r["map"], "value"))
              & (number.isNotNull() | ~F.map_contains_key(r["map"], "confidence")))
        return F.when(ok, F.struct(
            r["pos"].alias("pos"), r["name"].alias("name"), F.coalesce(r["value"], F.lit("None")).alias("value"),
            clip(F.coalesce(number, F.lit(0.0))).alias("confidence"),
            F.from_json(r["map"]["source"], SOURCE_SCHEMA).alias("source")))

    checked = parsed.withColumn("clean", F.transform(read, whole))
    good = ((F.col("status") != "dropped") & F.forall("clean", lambda f: f.isNotNull()) & _number(overall).isNotNull())
    checked = checked.withColumn("valid", F.coalesce(good, F.lit(False)))
    none = F.array().cast("array<string>")
    return checked.select(
        "doc_id", "sample_no", "status", "valid",
        F.when(F.col("valid"), F.coalesce("doc_type", fallback)).alias("doc_type"),
        F.when(F.col("valid"), F.col("clean")).alias("fields"),
        F.when(F.col("valid"), _number(overall)).alias("overall_confidence"),
        F.when(F.col("valid"), F.coalesce("qa.passed_rules", none)).alias("passed_rules"),
        F.when(F.col("valid"), F.coalesce("qa.failed_rules", none)).alias("failed_rules"))


def sample_fields(samples: DataFrame) -> DataFrame:
    """Fields of the valid samples as a long table.

    Invalid samples carry no field list, so exploding leaves them out.  The list
    is exploded as an expression: on a bare column, and for a filter on `valid`,
    Spark would push a predicate down that parses every response again.
    """
    rows = samples.select("doc_id", "sample_no", F.explode(F.array_compact("fields")).alias("f"))
    return rows.select("doc_id", "sample_no", "f.pos", "f.name", "f.value", "f.confidence", "f.source")


def _order(*cols: str) -> Column:
    """First-seen order as one number."""
    if len(cols) == 1:
        return F.col(cols[0]).cast("long")
    return F.col(cols[0]).cast("long") * F.lit(1 << 32) + F.col(cols[1]).cast("long")


def vote_doc_type(samples: DataFrame) -> DataFrame:
    """Most frequent document type over valid samples; the first seen wins a tie.
    A document whose samples are all invalid is unknown."""
    counts = samples.groupBy("doc_id", "doc_type").agg(
        F.sum(F.col("valid").cast("int")).alias("n"), F.min("sample_no").alias("first"))
    best = counts.groupBy("doc_id").agg(F.max(F.when(F.col("n") > 0, F.struct(
        F.col("n"), (-F.col("first")).alias("rank"), F.col("doc_type")))).alias("b"))
    return best.select("doc_id", F.coalesce("b.doc_type", F.lit("unknown")).alias("doc_type"),
                       F.coalesce("b.n", F.lit(0)).alias("votes"))


def type_votes(samples: DataFrame) -> DataFrame:
    """Per document the types that its valid samples name, with how many and the first of them, and n_samples.  A type of
    NULL stands for samples that name none; `voted_type` gives them the document's own."""
    counts = samples.groupBy("doc_id", "doc_type").agg(
        F.sum(F.col("valid").cast("int")).alias("n"), F.min(F.when(F.col("valid"), F.col("sample_no"))).alias("first"))
    return counts.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("n") > 0, F.struct("doc_type", "n", "first"))).alias("votes"), F.sum("n").alias("n_samples"))


def voted_type(votes: Column, hint: Column) -> Column:
    """(doc_type, n) that most samples name, the first seen on a tie; `hint` counts for samples that name none.
    `unknown` without a valid sample.  A projection over the few types of one document."""
    named = F.transform(votes, lambda v: F.struct(F.coalesce(v["doc_type"], hint).alias("doc_type"), v["n"].alias("n"), v["first"].alias("first")))

    def total(v):
        return F.aggregate(F.filter(named, lambda o: o["doc_type"] == v["doc_type"]), F.struct(F.lit(0).cast("long").alias("n"), F.lit(2**31 - 1).alias("first")),
                           lambda s, o: F.struct((s["n"] + o["n"]).alias("n"), F.least(s["first"], o["first"]).alias("first")))
    ranked = F.transform(named, lambda v: F.struct(total(v)["n"].alias("n"), (-total(v)["first"]).alias("rank"), v["doc_type"].alias("doc_type")))
    best = F.array_max(ranked)
    return F.struct(F.coalesce(best["doc_type"], F.lit("unknown")).alias("doc_type"), F.coalesce(best["n"], F.lit(0)).alias("n"))


def sample_confidence(samples: DataFrame) -> DataFrame:
    """Valid samples and their mean confidence per document; 0 without samples."""
    return samples.groupBy("doc_id").agg(
        F.sum(F.col("valid").cast("int")).alias("n_samples"),
        F.coalesce(F.avg("overall_confidence"), F.lit(0.0)).alias("mean_confidence"))


def qa_merge(samples: DataFrame) -> DataFrame:
    """Distinct rule names over the valid samples, one row per (document, outcome, rule)."""
    rules_ = F.concat(
        F.transform("passed_rules", lambda r: F.struct(F.lit("passed").alias("outcome"), r.alias("rule"))),
        F.transform("failed_rules", lambda r: F.struct(F.lit("failed").alias("outcome"), r.alias("rule"))))
    return samples.select("doc_id", F.explode(rules_).alias("r")).select(
        "doc_id", "r.outcome", "r.rule").distinct()


def field_consensus(fields: DataFrame) -> DataFrame:
    """Merge the samples' fields per document and normalised name.

    The most frequent trimmed value wins, the first seen on a tie; confidence is
    the mean over all entries of the name; spelling and source come from the
    first entry.  Values are counted before names are merged, so a much repeated
    field is reduced on the map side first.
    """
    keyed = fields.select(
        "doc_id", normalize_name(F.col("name")).alias("norm_name"), strip(F.col("value")).alias("value"),
        "name", "confidence", "source", _order("sample_no", "pos").alias("ord"))
    merged = _merged(_counted(keyed, "doc_id", "norm_name", "value"), "doc_id", "norm_name")
    return merged.select("doc_id", "norm_name", F.col("head.name").alias("name"), "value",
                         "confidence", "n_entries", "ord", F.col("head.source").alias("source"))


def _counted(entries: DataFrame, *keys: str) -> DataFrame:
    """Entries counted by value, with the first of them."""
    return entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("conf_sum"), F.min("ord").alias("ord"),
        F.min_by(F.struct("name", "source"), "ord").alias("head"))


def _merged(counted: DataFrame, *keys: str) -> DataFrame:
    """The most frequent value of each name, and the first entry."""
    return counted.groupBy(*keys).agg(
        F.max_by("value", F.struct(F.col("n"), (-F.col("ord")).alias("rank"))).alias("value"),
        (F.sum("conf_sum") / F.sum("n")).alias("confidence"), F.sum("n").alias("n_entries"),
        F.min("ord").alias("ord"), F.min_by("head", "ord").alias("head"))


def consensus_and_votes(samples: DataFrame) -> DataFrame:
    """`field_consensus` and `type_votes` from one pass over the samples, so that responses are parsed once: one row for
    each document with a valid sample, with votes, n_samples and the list `fields` of its consensus fields.

    A sample's vote goes along with its fields as one more entry, at position -1 with the type as value.  Entries are
    counted and merged as fields are; what is collected is one document's distinct names and types.
    """
    vote = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("name"), F.col("doc_type").alias("value"),
                            F.lit(0.0).alias("confidence"), F.lit(None).cast(SOURCE_TYPE).alias("source")))
    rows = samples.select("doc_id", "sample_no", F.explode(F.array_compact(F.when(F.col("valid"), F.concat(vote, "fields")))).alias("f"))
    is_vote = F.col("f.pos") < 0
    keyed = rows.select(
        "doc_id", is_vote.alias("vote"), normalize_name(F.col("f.name")).alias("norm_name"),
        F.when(is_vote, F.col("f.value")).otherwise(strip(F.col("f.value"))).alias("value"), "f.name", "f.confidence", "f.source",
        F.when(is_vote, F.col("sample_no").cast("long")).otherwise(_order("sample_no", "f.pos")).alias("ord"))
    counted = _counted(keyed, "doc_id", "vote", "norm_name", "value").withColumn("voted", F.when(F.col("vote"), F.col("value")))
    merged = _merged(counted, "doc_id", "vote", "norm_name", "voted")
    name = F.struct("norm_name", F.col("head.name").alias("name"), "value", "confidence", "n_entries", "ord", F.col("head.source").alias("source"))
    said = F.struct(F.col("voted").alias("doc_type"), F.col("n_entries").alias("n"), F.col("ord").cast("int").alias("first"))
    return merged.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("vote"), said)).alias("votes"), F.sum(F.when(F.col("vote"), F.col("n_entries"))).alias("n_samples"),
        F.collect_list(F.when(~F.col("vote"), name)).alias("fields"))
