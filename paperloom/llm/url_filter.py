"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Host and path: the host runs from the first "://" to "/", "?", "#" or the end, A-Z lower-cased; the path from there to
"?", "#" or the end.  A null url, or one without "://", has an empty host and path.  A rule such as block com/de/ fits its
host and all subdomains when the path starts with the rule's; the longest rule that fits decides.

The trees learn from labelled urls (here those that a rule decides): lengths, depth, digit ratio, character entropy,
parameter counts, and statistics of the host's suffix, i.e. its number of labelled urls and its share of blocked ones.
Spark fits them on at most max_rows labelled urls (lowest url hashes, a documented bound); suffix statistics cover all
labelled urls, and every url is scored.

Rows: null urls get empty features and a verdict like any other; repeated urls get equal verdicts; without labelled
urls of both verdicts the trees' part falls to the one there is, or to allow.  Only the kept columns and url are read.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm._shared import stored
from paperloom.llm.exact_dedup import lower_ascii

FEATURES = ("n_url", "n_host", "n_path", "depth", "labels", "digits", "entropy", "parameters", "query", "fragment", "hyphens",
            "longest_label", "plain", "suffix_urls", "suffix_blocked")


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    u = F.col(f"`{url}`")
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": lower_ascii(F.coalesce(host, F.lit(""))), "path": F.coalesce(path, F.lit(""))})


def rule_of(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits host and path; null where none does.  rules: (verdict, rule)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, tail = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def with_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features (all but the suffix statistics) and the suffix of a table with host and path."""
    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    count = lambda c, what: (F.length(c) - F.length(F.replace(c, F.lit(what)))) / len(what)
    shares = F.transform(F.array_distinct(F.split(u, "")), lambda c: (F.length(u) - F.length(F.replace(u, c))) / n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    labels = F.split(F.col("host"), r"\.")
    return df.withColumns({
        "n_url": F.length(u), "n_host": F.length("host"), "n_path": F.length("path"), "depth": count(F.col("path"), "/"),
        "labels": F.size(labels), "digits": F.length(F.regexp_replace(u, "[^0-9]", "")) / n, "entropy": entropy,
        "parameters": count(u, "="), "query": (F.instr(u, "?") > 0).cast("int"), "fragment": (F.instr(u, "#") > 0).cast("int"),
        "hyphens": count(F.col("host"), "-"), "longest_label": F.array_max(F.transform(labels, F.length)),
        "plain": F.lower(u).startswith("http://").cast("int"), "suffix": F.element_at(labels, -1)})


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """suffix, suffix_urls (log of labelled urls), suffix_blocked (their share of label 1, drawn towards one half)."""
    return labelled.groupBy("suffix").agg(F.log1p(F.count(F.lit(1))).alias("suffix_urls"), ((F.sum("label") + 1.0) / (F.count(F.lit(1)) + 2.0)).alias("suffix_blocked"))


def _vectors(df: DataFrame, statistics: DataFrame) -> DataFrame:
    df = df.join(statistics, "suffix", "left").fillna({"suffix_urls": 0.0, "suffix_blocked": 0.5})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def train(labelled: DataFrame, statistics: DataFrame, max_rows: int = 20_000, trees: int = 20, depth: int = 4) -> Model | float:
    """Trees on a feature table with label 0 or 1; a constant where only one label occurs."""
    sample = labelled.orderBy(F.xxhash64("url"), "url").limit(max_rows)
    sample = stored(sample, "url-sample")
    seen = sorted(r[0] for r in sample.select("label").distinct().collect())
    if len(seen) < 2:
        return float(seen[0]) if seen else 0.0
    rows = _vectors(sample, statistics).select("features", "label").coalesce(4)
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=11).fit(rows)


def judge(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The kept columns, host, path, rule, verdict and score (the trees' probability of block)."""
    base = df.select(*[F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)], F.col(f"`{url}`").alias("url"))
    rule, verdict = rule_of(rules)
    rows = with_features(with_parts(base).withColumns({"rule": rule}).withColumn("says", verdict))
    rows = stored(rows, "url-features")
    labelled = rows.where("says is not null").withColumn("label", (F.col("says") == "block").cast("double"))
    statistics = stored(suffix_statistics(labelled), "url-suffixes")
    model = train(labelled, statistics)
    if isinstance(model, float):
        scored = rows.withColumn("score", F.lit(model))
    else:
        scored = model.transform(_vectors(rows, statistics)).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("says"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule", verdict.alias("verdict"), "score")
