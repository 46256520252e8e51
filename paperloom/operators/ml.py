"""Statistical fallback: Naive Bayes, kernel machine, ensemble, hybrid choice with explanations, saving and versions.

All parts share one vocabulary (operators.terms).  Training is aggregation; what reaches the driver is bounded by
max_features x labels, and by the kernel's number of features.  Scoring is a projection: it neither joins nor shuffles.
A model that could not be trained (no rows, no known label, no vocabulary) is a model too: it says unknown, 0.0.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.text import confidence_band, ml_preprocess
from paperloom.operators import kernel as K
from paperloom.operators.terms import Space, number_list, tfidf_vocab, with_terms
from paperloom.session import ship_source

EXPLAIN = 10  # terms that an explanation draws from


def known_rows(train: DataFrame, labels: list[int]) -> DataFrame:
    """Rows whose label is one of `labels`; others can't be learnt from."""
    return train.filter(F.col("label").isin(labels))


class Bayes(NamedTuple):
    """Multinomial Naive Bayes over TF-IDF weights: log-probabilities by label and term, log class shares.  A label
    without training rows has share 0 and is never predicted."""

    space: Space
    labels: list[int]
    log_probs: list[list[float]]
    priors: list[float]

    def raw(self) -> Column:
        """Unscaled log posterior of the columns idx and weight, an array in the order of labels."""
        def one(k: int) -> Column:
            logs = number_list(self.log_probs[k])
            return F.aggregate(F.zip_with("idx", "weight", lambda i, w: w * logs[i]), F.lit(0.0), lambda s, x: s + x)
        priors = [F.lit(float(p)) for p in self.priors]
        return F.array(*[one(k) + priors[k] if self.space.terms else priors[k] for k in range(len(self.labels))])


def nb_model(train: DataFrame, space: Space, labels: list[int], alpha: float = rules.NB_ALPHA) -> Bayes:
    """Fit on `train(text, label)`: one exchange, by term."""
    weighted = space.weighted(with_terms(known_rows(train, labels), F.col("text"), ["label"]), ["label"])
    # a row without vocabulary terms still counts for its label's share, as term -1
    rows = weighted.select("label", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("idx"), F.lit(1.0).alias("weight"))), F.arrays_zip("idx", "weight"))).alias("t"))
    sums = rows.groupBy("t.idx").agg(*[F.sum(F.when(F.col("label") == k, F.col("t.weight")).otherwise(0.0)).alias(f"s{j}") for j, k in enumerate(labels)])
    table = np.zeros((len(space.terms) + 1, len(labels)))
    for r in sums.collect():
        table[r[0]] = r[1:]  # -1 is the last row
    counts, sums = table[-1], table[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        priors = np.log(counts / counts.sum()) if counts.sum() else np.full(len(labels), -np.inf)
        logs = np.log(sums + alpha) - np.log(sums.sum(axis=0) + alpha * len(space.terms))
    return Bayes(space, labels, logs.T.tolist(), priors.tolist())


def nb_model_rows(spark: SparkSession, model: Bayes) -> DataFrame:
    """The model as one row per (label, term)."""
    rows = [(k, t, float(p)) for k, logs in zip(model.labels, model.log_probs) for t, p in zip(model.space.terms, logs)]
    return spark.createDataFrame(rows, "label int, term string, log_prob double")


def nb_predict(docs: DataFrame, model: Bayes, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Label and probability for `docs(doc_id, text)`; text is preprocessed first.  Documents without a vocabulary term
    are decided by the class shares."""
    rows = model.space.weighted(with_terms(docs, ml_preprocess(F.col("text")), list(keep)), list(keep))
    probs = rows.select(*keep, model.raw().alias("raw")).select(*keep, _softmax(F.col("raw")).alias("probs"))
    return best_label(probs, model.labels, keep)


def _softmax(raw: Column) -> Column:
    top = F.array_max(raw)
    exps = F.transform(raw, lambda v: F.exp(v - top))
    total = F.aggregate(exps, F.lit(0.0), lambda a, v: a + v)
    return F.transform(exps, lambda v: v / total)


def best_label(df: DataFrame, labels: list[int], keep) -> DataFrame:
    """Label with the highest probability; the first of equal ones."""
    best = F.array_max("probs")
    pos = F.array_position(F.transform("probs", lambda p: F.round(p, 12)), F.round(best, 12)).cast("int")
    return df.select(*keep, F.element_at(F.array(*[F.lit(k) for k in labels]), pos).alias("label"),
                     best.alias("confidence"), "probs")


def label_name(label: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(t) for t in rules.DOC_TYPES]), label), F.lit("unknown"))


def linear_predict(train: DataFrame, docs: DataFrame, labels: list[int], reg: float = 0.01) -> DataFrame:
    """Label and confidence of a multinomial logistic regression over the same features."""
    space = Space.of(tfidf_vocab(train))
    counts = CountVectorizerModel.from_vocabulary(space.terms, "terms", "tf")
    idf = ElementwiseProduct(scalingVec=Vectors.dense(space.idf), inputCol="tf", outputCol="tfidf")
    l2 = Normalizer(p=2.0, inputCol="tfidf", outputCol="features")
    index = F.array_position(F.array(*[F.lit(k) for k in labels]), F.col("label")) - 1
    data = with_terms(known_rows(train, labels).select("text", index.cast("double").alias("y")), F.col("text"), ["y"])
    features = l2.transform(idf.transform(counts.transform(data))).select("features", "y").cache()
    model = LogisticRegression(featuresCol="features", labelCol="y", family="multinomial", regParam=reg, maxIter=100).fit(features)
    features.unpersist()
    prepared = with_terms(docs, ml_preprocess(F.col("text")), ["doc_id"])
    scored = model.transform(l2.transform(idf.transform(counts.transform(prepared))))
    return best_label(scored.select("doc_id", vector_to_array("probability").alias("probs")), labels, ("doc_id",))


class FallbackModel:
    """Kernel machine and Naive Bayes over one vocabulary, mixed by fixed weights; untrained without a Bayes part."""

    def __init__(self, labels: list[int], bayes: Bayes | None = None, kernel: K.Kernel | None = None, threshold: float = rules.ML_THRESHOLD):
        self.labels, self.bayes, self.kernel, self.threshold = labels, bayes, kernel, threshold

    @property
    def is_trained(self) -> bool:
        return self.bayes is not None

    @classmethod
    def fit(cls, train: DataFrame, labels: list[int], alpha: float = rules.NB_ALPHA, features: int = K.FEATURES, seed: int = 42) -> FallbackModel:
        """Fit on `train(doc_id, text, label)`.  Rows with a label outside `labels` aren't learnt from; without rows or
        without a vocabulary the model stays untrained."""
        rows = known_rows(train, labels)
        space = Space.of(tfidf_vocab(rows))
        if not space.terms:
            return cls(labels)
        bayes = nb_model(rows, space, labels, alpha)
        index = F.array_position(F.array(*[F.lit(k) for k in labels]), F.col("label")) - 1
        data = space.weighted(with_terms(rows.select("text", index.alias("y")), F.col("text"), ["y"]), ["y"])
        return cls(labels, bayes, K.fit(data, len(space.terms), len(labels), kernel_width(data, len(space.terms)), features, seed=seed))

    def probabilities(self, docs: DataFrame, keep: list[str], which: str = "ensemble", wanted: Column | None = None) -> DataFrame:
        """`docs(..., terms)` with probs, and with idx and weight for explanations.  Rows that aren't wanted have NULL
        probabilities and aren't scored."""
        rows = self.bayes.space.weighted(docs, keep)
        ask = F.lit(True) if wanted is None else wanted
        rows = rows.select(*keep, "idx", "weight", F.when(ask, F.col("idx")).alias("asked"))
        if which != "nb":
            ship_source(docs.sparkSession)
            rows = rows.withColumn("kernel_probs", K.scored(self.kernel, "asked", "weight"))
        rows = rows.withColumn("nb_raw", F.when(F.col("asked").isNotNull(), self.bayes.raw()))
        rows = rows.withColumn("nb_probs", _softmax(F.col("nb_raw")))
        a, b = rules.ENSEMBLE_WEIGHTS
        mixed = {"nb": lambda: F.col("nb_probs"), "kernel": lambda: F.col("kernel_probs"),
                 "ensemble": lambda: F.zip_with("kernel_probs", "nb_probs", lambda x, y: a * x + b * y)}[which]()
        return rows.select(*keep, "idx", "weight", mixed.alias("probs"))

    def predict(self, docs: DataFrame, which: str = "ensemble") -> DataFrame:
        """doc_id, label, confidence, probs from the ensemble or one member ('kernel', 'nb')."""
        if not self.is_trained:
            return docs.select("doc_id", F.lit(None).cast("int").alias("label"), F.lit(0.0).alias("confidence"), F.lit(None).cast("array<double>").alias("probs"))
        prepared = with_terms(docs, ml_preprocess(F.col("text")), ["doc_id"])
        return best_label(self.probabilities(prepared, ["doc_id"], which), self.labels, ("doc_id",))

    def hybrid(self, classified: DataFrame, threshold: float | None = None, which: str = "ensemble", carry: tuple[str, ...] = ()) -> DataFrame:
        """Rule result of `classify` and `with_indicators`, replaced by the model's where rules are unsure and the model
        is surer; see `choose`.  Sure documents get an empty term list, so one pass without split or join serves both.
        `carry` names further columns that come along."""
        unsure = F.col("confidence") < (self.threshold if threshold is None else threshold)
        keep = ["doc_id", "unsure", "rule", "carried"]
        carried = F.struct(F.lit(0).alias("none"), *carry).alias("carried")
        rows = classified.select("doc_id", "text", unsure.alias("unsure"), F.struct(*RULE_COLUMNS).alias("rule"), carried)
        if not self.is_trained:
            none = F.lit(None).cast("int").alias("label"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("top")
            return choose(rows.select(*keep, *none), carry)
        prepared = with_terms(rows, F.when(F.col("unsure"), ml_preprocess(F.col("text"))).otherwise(""), keep)
        scored = self.probabilities(prepared, keep, which, F.col("unsure"))
        top = F.transform(self.bayes.space.top(EXPLAIN), lambda t: t["term"])
        return choose(best_label(scored.withColumn("top", top), self.labels, (*keep, "top")), carry)

    def info(self, version: str | None = None) -> dict:
        """What the model is, for a catalogue of models."""
        return {"is_trained": self.is_trained, "version": version, "threshold": self.threshold, "labels": list(self.labels),
                "supported_types": [rules.DOC_TYPES[k] for k in self.labels if 0 <= k < len(rules.DOC_TYPES)],
                "n_terms": len(self.bayes.space.terms) if self.bayes else 0, "priors": list(self.bayes.priors) if self.bayes else [],
                "kernel_features": self.kernel.features if self.kernel else 0, "gamma": self.kernel.gamma if self.kernel else None,
                **{k: v for k, v in rules.TFIDF.items()}}

    def save(self, spark: SparkSession, path: str) -> None:
        """Two tables under path: info (one row) and terms, with a term's idf and its numbers in each member.  The
        kernel's weights lie beside them, a row for each feature."""
        i, b, k = self.info(), self.bayes, self.kernel
        terms = [(n, t, float(b.space.idf[n]), [logs[n] for logs in b.log_probs]) for n, t in enumerate(b.space.terms)] if b else []
        spark.createDataFrame(terms, "i int, term string, idf double, log_probs array<double>").write.mode("overwrite").parquet(f"{path}/terms")
        rows = [(n, r) for n, r in enumerate(k.weights.tolist())] if k else []
        spark.createDataFrame(rows, "i int, weights array<double>").write.mode("overwrite").parquet(f"{path}/kernel")
        spark.createDataFrame([(i["is_trained"], self.labels, self.threshold, i["priors"], i["kernel_features"], i["gamma"], k.seed if k else None, k.platt.tolist() if k else [])],
                              "is_trained boolean, labels array<int>, threshold double, priors array<double>, features int, gamma double, seed int, platt array<array<double>>"
                              ).write.mode("overwrite").parquet(f"{path}/info")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FallbackModel:
        info = spark.read.parquet(f"{path}/info").first()
        if not info.is_trained:
            return cls(list(info.labels), threshold=info.threshold)
        terms = spark.read.parquet(f"{path}/terms").orderBy("i").collect()
        space = Space([r.term for r in terms], [r.idf for r in terms])
        bayes = Bayes(space, list(info.labels), [list(x) for x in zip(*[r.log_probs for r in terms])], list(info.priors))
        weights = np.array([r.weights for r in spark.read.parquet(f"{path}/kernel").orderBy("i").collect()])
        kernel = K.Kernel(len(terms), info.features, info.gamma, info.seed, weights, np.array(info.platt, dtype=float))
        return cls(list(info.labels), bayes, kernel, info.threshold)


def kernel_width(data: DataFrame, n_terms: int) -> float:
    """1 / (number of terms x variance of all weights, zeros included)."""
    s = data.select(F.aggregate("weight", F.lit(0.0), lambda s, x: s + x).alias("s"), F.aggregate("weight", F.lit(0.0), lambda s, x: s + x * x).alias("q")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
    cells = s.n * n_terms
    variance = s.q / cells - (s.s / cells) ** 2
    return 1 / (n_terms * variance) if variance > 0 else 1.0


#: Columns of a rule result that the hybrid choice passes on.
RULE_COLUMNS = ["doc_type", "confidence", "keyword_score", "structural_score", "context_score", "primary_indicators", "secondary_indicators", "context_matches"]


def choose(ml: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rule or model result: the model wins where rules were unsure and it is strictly surer.

    The model explains itself with its heaviest terms, three in front of two indicators of the rules and three behind,
    under the rules' contexts; its confidence stands in for the keyword score, and it has no other scores."""
    use = F.col("unsure") & F.coalesce(F.round("confidence", 12) > F.round("rule.confidence", 12), F.lit(False))
    conf = F.when(use, F.col("confidence")).otherwise(F.col("rule.confidence"))
    return ml.select(
        "doc_id", *[f"carried.{c}" for c in carry], F.when(use, label_name(F.col("label"))).otherwise(F.col("rule.doc_type")).alias("doc_type"),
        conf.alias("confidence"), confidence_band(conf).alias("confidence_level"),
        F.when(use, "model").otherwise("rules").alias("decided_by"),
        F.when(use, F.concat(F.slice("top", 1, 3), F.slice("rule.primary_indicators", 1, 2))).otherwise(F.col("rule.primary_indicators")).alias("primary_indicators"),
        F.when(use, F.slice("top", 4, 3)).otherwise(F.col("rule.secondary_indicators")).alias("secondary_indicators"),
        F.col("rule.context_matches").alias("context_matches"),
        F.when(use, conf).otherwise(F.col("rule.keyword_score")).alias("keyword_score"),
        F.when(use, 0.0).otherwise(F.col("rule.structural_score")).alias("structural_score"),
        F.when(use, 0.0).otherwise(F.col("rule.context_score")).alias("context_score"))


def hybrid_nb(classified: DataFrame, model: Bayes, threshold: float = rules.ML_THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """Hybrid choice with Naive Bayes alone as the fallback."""
    return FallbackModel(model.labels, model, None, threshold).hybrid(classified, which="nb", carry=carry)


def retrain(current: FallbackModel | None, rows: DataFrame, labels: list[int]) -> FallbackModel | None:
    """Refit from the new rows only.  Without rows that can be learnt from, or if the fit fails, the current model stays."""
    try:
        new = FallbackModel.fit(rows, labels)
    except Exception as e:  # a failing fit must not cost the model in use; the reason is kept with it
        if current is not None:
            current.last_failure = f"{type(e).__name__}: {e}"
        return current
    return new if new.is_trained else current


# ---- versions -------------------------------------------------------------------


def publish(spark: SparkSession, model: FallbackModel, root: str, version: str) -> None:
    """Saves a version under root and makes it the current one.  The pointer is a small file that is renamed into place,
    which is atomic; a reader sees the old version or the new one, and publishing a version again changes nothing."""
    model.save(spark, f"{root}/{version}")
    jvm = spark._jvm
    conf, path = spark._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path
    fresh, current = path(f"{root}/.current-{uuid.uuid4().hex}"), path(f"{root}/current")
    out = fresh.getFileSystem(conf).create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), conf).rename(fresh, current, options)


def current_version(spark: SparkSession, root: str) -> str | None:
    """Name of the version in use; None before the first one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/current")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.text(f"{root}/current").first()[0]


def current_model(spark: SparkSession, root: str, labels: list[int]) -> FallbackModel:
    """The version in use, or an untrained model."""
    version = current_version(spark, root)
    return FallbackModel(labels) if version is None else FallbackModel.load(spark, f"{root}/{version}")
