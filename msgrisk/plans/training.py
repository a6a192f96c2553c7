"""Training, evaluation, storage and loading of the probability model."""

from __future__ import annotations

import json
import logging

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from msgrisk import fixed_values as fv
from msgrisk.operators import learning
from msgrisk.plans.assess import extract_features
from msgrisk.registry import Registry
from msgrisk.session import store
from msgrisk.sources.messages import deduplicate_texts

TREE_ROWS = 5_000       # rows that a task of a tree's fit reads; each is a dense array of some 8,000 numbers there

log = logging.getLogger(__name__)


class TextPassThrough:
    """Keeps the normalised text among the features, for building training frames."""

    version = "text"

    def prepare(self, df: DataFrame) -> DataFrame:
        return df.withColumn("model_text", F.col("text"))


class TrainedModel:
    """Text stage (before the text is dropped) and final stage (on all features)."""

    def __init__(self, text_stage: PipelineModel, final_stage: PipelineModel, version: str = fv.MODEL_VERSION):
        self.text_stage, self.final_stage, self.version = text_stage, final_stage, version

    def prepare(self, df: DataFrame) -> DataFrame:
        terms = learning.words_and_pairs(F.col("_words"))
        prepared = df.withColumn("_words", learning.words(F.col("text"))).withColumn("terms", terms)
        return self.text_stage.transform(prepared).drop("_words", "terms", "term_counts", "term_weights")

    def predict(self, df: DataFrame) -> DataFrame:
        filled = df.withColumns(
            {c: F.coalesce(F.col(c), F.lit(0.0)) for c in fv.NUMERIC_FEATURES}
        )
        scored = self.final_stage.transform(filled)
        probability = F.round(vector_to_array("probability")[1], 4)
        return scored.withColumn("ml_probability", probability).drop(
            "text_vector", "numeric_raw", "numeric", "features_vector", "rawPrediction", "probability", "prediction"
        )

    def save(self, path: str) -> None:
        self.text_stage.write().overwrite().save(f"{path}/text_stage")
        self.final_stage.write().overwrite().save(f"{path}/final_stage")
        spark = SparkSession.getActiveSession()
        meta = json.dumps({"version": self.version, "numeric_columns": fv.NUMERIC_FEATURES})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TrainedModel | None":
        """The stored model, or None where none is stored (the fallback is used then); other errors are raised."""
        try:
            meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            log.warning("no model at %s, the fallback is used", path)
            return None
        stages = [PipelineModel.load(f"{path}/{name}") for name in ("text_stage", "final_stage")]
        return cls(*stages, meta["version"])


def training_frame(messages: DataFrame, registry: Registry) -> DataFrame:
    """Label, normalised text and the 43 numeric features of labelled messages."""
    features = extract_features(messages, registry, TextPassThrough())
    return features.select("msg_id", "label", F.col("model_text").alias("text"), *fv.NUMERIC_FEATURES)


def fit_text_stage(train: DataFrame, size: int = fv.VOCABULARY_SIZE) -> PipelineModel:
    """Vocabulary and weights from the distributed term counts.

    The driver sees the chosen terms only (at most ``size``), never the corpus.
    """
    docs = train.select(learning.words(F.col("text")).alias("_words")).select(
        learning.words_and_pairs(F.col("_words")).alias("terms")
    )
    total = train.count()
    chosen = learning.vocabulary(docs, "terms", size).select(
        "term", learning.smooth_idf(F.col("n_docs"), F.lit(total)).alias("idf")
    ).collect()
    if not chosen:
        raise ValueError("the training texts contain no words")
    spark = train.sparkSession
    counter = CountVectorizerModel.from_vocabulary(
        [r["term"] for r in chosen], inputCol="terms", outputCol="term_counts", minTF=1.0
    )
    weights = ElementwiseProduct(
        scalingVec=Vectors.dense([r["idf"] for r in chosen]), inputCol="term_counts", outputCol="term_weights"
    )
    unit = Normalizer(p=2.0, inputCol="term_weights", outputCol="text_vector")
    empty = spark.createDataFrame([([""],)], "terms array<string>")
    return Pipeline(stages=[counter, weights, unit]).fit(empty)


def feature_stages(train: DataFrame) -> list:
    """Numeric features scaled to unit deviation (not centred), joined with the text vector."""
    deviations = train.agg(*[F.stddev_pop(c).alias(c) for c in fv.NUMERIC_FEATURES]).first()
    scale = [1.0 / deviations[c] if deviations[c] else 1.0 for c in fv.NUMERIC_FEATURES]
    return [
        VectorAssembler(inputCols=fv.NUMERIC_FEATURES, outputCol="numeric_raw"),
        ElementwiseProduct(scalingVec=Vectors.dense(scale), inputCol="numeric_raw", outputCol="numeric"),
        VectorAssembler(inputCols=["text_vector", "numeric"], outputCol="features_vector"),
    ]


def logistic_regression(n_rows: int) -> LogisticRegression:
    """L2 strength 1 on balanced rows: the weights add up to n, hence 1/n here."""
    return LogisticRegression(
        featuresCol="features_vector", labelCol="label", weightCol="weight",
        regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-4,
    )


def tree_rows(vectors: DataFrame, n_rows: int) -> DataFrame:
    """The vectors in parts of about ``TREE_ROWS`` rows, if they are in larger ones.

    The fit of trees keeps every row as a dense array and reads a part whole, so that the bytes of a part must be
    bounded by rows, not by the size of the sparse vectors."""
    parts = -(-n_rows // TREE_ROWS)
    large = parts > min(vectors.rdd.getNumPartitions(), vectors.sparkSession.sparkContext.defaultParallelism)
    return vectors.repartition(parts) if large else vectors


def split_rule(frame: DataFrame) -> tuple[float, bool, int]:
    """(test share, stratify?, rows) from the class sizes."""
    counts = {r["label"]: r["n_rows"] for r in learning.class_weights(frame).collect()}
    rows = sum(counts.values())
    return (0.25 if rows >= 8 else 0.5), len(counts) > 1 and min(counts.values()) >= 2, rows


def _split_vectors(frame: DataFrame, text_size: int, seed: int):
    """(model without classifier, feature pipeline, training vectors, test vectors, rows).

    Of rows with one text the first is kept.  The split frame and the vectors are read by many passes, so they
    are stored.
    """
    frame = deduplicate_texts(frame, "text", "msg_id")
    share, stratify, n_rows = split_rule(frame)
    parts = store(learning.stratified_split(frame, "label", "msg_id", share, seed, stratify))
    train, test = parts.filter(~F.col("is_test")), parts.filter("is_test")
    model = TrainedModel(fit_text_stage(train, text_size), None)
    weights = learning.class_weights(train).select("label", "weight")
    weighted = model.prepare(train).join(F.broadcast(weights), "label")     # one row per class
    stages = Pipeline(stages=feature_stages(train)).fit(weighted)
    vectors = store(stages.transform(weighted).select("label", "weight", "features_vector"))
    return model, stages, vectors, test, n_rows


def train_model(frame: DataFrame, text_size: int = fv.VOCABULARY_SIZE, seed: int = 42):
    """(model, metrics, test predictions) from a training frame."""
    model, stages, vectors, test, n_rows = _split_vectors(frame, text_size, seed)
    classifier = logistic_regression(vectors.count()).fit(vectors)
    model.final_stage = PipelineModel(stages=[*stages.stages, classifier])
    predictions = store(
        model.predict(model.prepare(test)).select(
            "msg_id", "label", F.col("ml_probability").alias("score"),
            (F.col("ml_probability") >= 0.5).cast("int").alias("prediction"),
        )
    )
    report = {r["name"]: r.asDict() for r in learning.evaluation_report(predictions).collect()}
    metrics = {
        "rows": n_rows,
        "roc_auc": learning.roc_auc(predictions).first()["auc"],
        "classification_report": report,
    }
    return model, metrics, predictions


def model_run_row(spark: SparkSession, metrics: dict, version: str = fv.MODEL_VERSION) -> DataFrame:
    """One row for the table of model runs."""
    row = (version, metrics["rows"], metrics["roc_auc"], json.dumps(metrics["classification_report"], sort_keys=True))
    return spark.createDataFrame([row], "version string, n_rows long, roc_auc double, report string")


def compare_models(frame: DataFrame, seed: int = 42, text_size: int = fv.VOCABULARY_SIZE, max_fpr: float = 0.05) -> DataFrame:
    """Several classifiers on one split, each at its best threshold with a false-positive rate of at most
    ``max_fpr``: best recall first, the lower rate breaks ties."""
    model, stages, train_vectors, test, _ = _split_vectors(frame, text_size, seed)
    test_vectors = store(stages.transform(model.prepare(test)).select("label", "features_vector"))
    n_train = train_vectors.count()
    common = dict(featuresCol="features_vector", labelCol="label", weightCol="weight")
    candidates = {
        "logistic_regression": logistic_regression(n_train),
        "linear_svm": LinearSVC(**common, regParam=0.01, maxIter=30),
        "random_forest": RandomForestClassifier(**common, numTrees=20, maxDepth=4, seed=seed),
        "boosted_trees": GBTClassifier(**common, maxIter=5, maxDepth=3, seed=seed),
    }
    results = None
    for name, estimator in candidates.items():
        of_trees = isinstance(estimator, (RandomForestClassifier, GBTClassifier))
        rated = estimator.fit(tree_rows(train_vectors, n_train) if of_trees else train_vectors).transform(test_vectors)
        # margins of a machine without probabilities keep their order on the way to 0..1
        score = vector_to_array("probability")[1] if "probability" in rated.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
        point = learning.operating_point(rated.select("label", score.alias("score")), max_fpr)
        row = point.select(F.lit(name).alias("model"), "threshold", "recall", "fpr", "tp", "fp", "fn", "tn")
        results = row if results is None else results.unionByName(row)
    return results.orderBy(F.desc("recall"), "fpr", "model")
