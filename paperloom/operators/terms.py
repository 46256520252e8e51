"""TF-IDF term statistics.

The n-grams of a document are counted in its row: sorted, then cut into runs of equal terms.  Only distinct terms with
their counts leave the row, in one exchange by term.  The vocabulary has at most max_features terms (5,000), and that
bound lets it travel inside the plan: weighting is a projection over a sparse vector, without a join or a window.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.text import ngrams, tokens

_RUNS = """
element_at(transform(array(array_sort(terms)), s ->
  element_at(transform(array(filter(sequence(1, size(s)), i -> i = 1 OR s[i - 1] <> get(s, i - 2))), starts ->
    transform(starts, (p, k) -> named_struct('term', s[p - 1], 'tf', cast(coalesce(get(starts, k + 1), size(s) + 1) - p as bigint)))), 1)), 1)
"""


def with_terms(docs: DataFrame, text: Column, keep: list[str], stop_words: list[str] | None = None) -> DataFrame:
    """Add `terms`: the n-grams of a text, with repetitions."""
    toks = docs.select(*keep, tokens(text, stop_words).alias("toks"))
    return toks.select(*keep, F.coalesce(ngrams("toks", rules.TFIDF["ngram_max"]), F.array().cast("array<string>")).alias("terms"))


def term_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each distinct term of a row of `docs(..., terms)`: term, tf."""
    runs = F.when(F.size("terms") > 0, F.expr(_RUNS))
    return docs.select(*keep, F.explode(runs).alias("t")).select(*keep, "t.term", "t.tf")


def tfidf_vocab(docs: DataFrame, max_features=rules.TFIDF["max_features"], min_df=rules.TFIDF["min_df"],
                max_df=rules.TFIDF["max_df"], stop_words: list[str] | None = None) -> DataFrame:
    """Vocabulary of `docs(doc_id, text)`: term, df, tf, idf.

    Terms in at least min_df documents and at most max_df of them; the
    max_features most frequent (ties by term).  A row is a document.
    """
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    counts = term_counts(with_terms(docs, F.col("text"), [], stop_words), [])
    per_term = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    counted = per_term.filter(F.col("df") >= min_df).withColumn("n_docs", n_docs.scalar())
    top = counted.filter(F.col("df") <= F.lit(max_df) * F.col("n_docs")).orderBy(
        F.desc("tf"), "term").limit(max_features)
    idf = F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + 1.0
    return top.select("term", "df", "tf", idf.alias("idf"))


def number_list(values) -> Column:
    """A constant array of doubles, one expression whatever its length."""
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")


class Space(NamedTuple):
    """A vocabulary on the driver: its terms in order and their idf; max_features entries at most."""

    terms: list[str]
    idf: list[float]

    @classmethod
    def of(cls, vocab: DataFrame) -> Space:
        rows = vocab.select("term", "idf").orderBy("term").collect()
        return cls([r.term for r in rows], [r.idf for r in rows])

    def names(self) -> Column:
        return F.split(F.lit("\x01".join(self.terms)), "\x01")

    def weighted(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """`docs(..., terms)` with the L2-normalised weights of their vocabulary terms: idx, tf and weight, arrays in
        the order of the vocabulary."""
        if not self.terms:
            none = F.array().cast("array<double>")
            return docs.select(*keep, F.array().cast("array<int>").alias("idx"), none.alias("tf"), none.alias("weight"))
        vectors = CountVectorizerModel.from_vocabulary(self.terms, "terms", "vector").transform(docs)
        sparse = vectors.select(*keep, F.unwrap_udt("vector").alias("v")).select(*keep, F.col("v.indices").alias("idx"), F.col("v.values").alias("tf"))
        idf = number_list(self.idf)
        raw = sparse.select(*keep, "idx", "tf", F.zip_with("idx", "tf", lambda i, tf: tf * idf[i]).alias("raw"))
        norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
        return raw.withColumn("norm", norm).select(*keep, "idx", "tf", F.transform("raw", lambda x: x / F.col("norm")).alias("weight"))

    def top(self, k: int) -> Column:
        """Of the columns idx and weight: the k heaviest terms, ties by term, as (s, term, weight)."""
        names = self.names()
        ranked = F.transform(F.arrays_zip("idx", "weight"), lambda e: F.struct((-F.round(e["weight"], 12)).alias("s"), names[e["idx"]].alias("term"), e["weight"].alias("weight")))
        return F.slice(F.sort_array(ranked), 1, k)


def tfidf_weights(docs: DataFrame, space: Space, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per (document, vocabulary term): term, tf, weight; a projection."""
    rows = space.weighted(with_terms(docs, F.col("text"), list(keep)), list(keep))
    rows = rows.select(*keep, F.explode(F.arrays_zip("idx", "tf", "weight")).alias("t"))
    return rows.select(*keep, space.names()[F.col("t.idx")].alias("term"), F.col("t.tf").cast("long").alias("tf"), "t.weight")


def top_terms(docs: DataFrame, space: Space, k: int = 10) -> DataFrame:
    """The k heaviest terms per document (ties by term) with their role, picked inside the row."""
    rows = space.weighted(with_terms(docs, F.col("text"), ["doc_id"]), ["doc_id"])
    ranked = rows.select("doc_id", F.posexplode(space.top(k)).alias("at", "t"))
    ranked = ranked.select("doc_id", "t.term", "t.weight", (F.col("at") + 1).alias("rank"))
    role = F.when(F.col("rank") <= 3, "primary").when(F.col("rank") <= 6, "secondary").otherwise("other")
    return ranked.withColumn("role", role)
