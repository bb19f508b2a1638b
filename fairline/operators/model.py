"""Model training, calibration and scoring with Spark ML (E5-E7, E11-E13, E16, E17); calibration (E8) is in ``calibrate``."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.operators.calibrate import apply_isotonic, fit_isotonic  # noqa: F401  (part of the model family)
from fairline.operators.clean import finite_columns
from fairline.operators.evaluate import aggregate_cv, binary_metrics, expanding_folds


@dataclass(frozen=True)
class ModelSettings:
    """Sizes of the three model kinds; smaller values suit tests."""

    forest_trees: int = 300
    forest_depth: int = 12
    boost_rounds: int = 500
    boost_depth: int = 6
    boost_rate: float = 0.05
    subsample: float = 0.8
    seed: int = 42


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Class weights n / (2 n_class), so rare hits count as much as misses."""
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("k")).select(F.struct("*")).scalar()
    positive = stats["n"] / F.greatest(stats["k"] * 2, F.lit(1))
    negative = stats["n"] / F.greatest((stats["n"] - stats["k"]) * 2, F.lit(1))
    return df.withColumn(out, F.when(F.col(label) == 1, positive).otherwise(negative))


def prepare_features(features: list[str]) -> list:
    """E5: stages that fill gaps with *training* medians and assemble the vector."""
    filled = [f"{c}__f" for c in features]
    return [Imputer(strategy="median", inputCols=features, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep")]


def classifier(kind: str, settings: ModelSettings, label: str, validation: str | None = None) -> list:
    common = {"labelCol": label, "weightCol": "weight"}
    if kind == "logistic":
        return [StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
                LogisticRegression(featuresCol="scaled", maxIter=100, **common)]
    if kind == "forest":
        return [RandomForestClassifier(numTrees=settings.forest_trees, maxDepth=settings.forest_depth, seed=settings.seed, **common)]
    if kind == "boosted":
        extra = {"validationIndicatorCol": validation} if validation else {}
        return [GBTClassifier(maxIter=settings.boost_rounds, maxDepth=settings.boost_depth, stepSize=settings.boost_rate,
                              subsamplingRate=settings.subsample, seed=settings.seed, **extra, **common)]
    raise ValueError(f"unknown model kind {kind}")


def train_model(kind: str, train: DataFrame, features: list[str], label: str, settings: ModelSettings = ModelSettings(),
                validation: str | None = None) -> PipelineModel:
    """One fitted pipeline; infinities count as missing."""
    return train_models(train, features, label, (kind,), settings, validation)[kind]


def train_models(train: DataFrame, features: list[str], label: str, kinds: tuple[str, ...] = ("logistic", "forest", "boosted"),
                 settings: ModelSettings = ModelSettings(), validation: str | None = None) -> dict[str, PipelineModel]:
    """All model kinds on the same training rows; rows are read, filled and assembled once for all kinds."""
    keep = [*features, label, *([validation] if validation else [])]
    rows = balanced_weights(finite_columns(train.select(*keep), features), label).persist()
    try:
        prepared = Pipeline(stages=prepare_features(features)).fit(rows)
        vectors = prepared.transform(rows).drop(*features, *[f"{c}__f" for c in features])
        return {kind: PipelineModel([*prepared.stages, *Pipeline(stages=classifier(kind, settings, label, validation)).fit(vectors).stages]) for kind in kinds}
    finally:
        rows.unpersist()


def predict(model: PipelineModel, df: DataFrame, features: list[str], out: str = "probability_1") -> DataFrame:
    """Score rows; only the probability column is added."""
    scored = model.transform(finite_columns(df, features))
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))


def train_boosted_logloss(
    train: DataFrame, validation: DataFrame, features: list[str], label: str,
    candidates: tuple[ModelSettings, ...] = (ModelSettings(boost_rounds=400, boost_depth=5, boost_rate=0.03),),
) -> tuple[PipelineModel, float]:
    """Boosted trees with early stopping on validation rows; the best by AUC - 0.5 x log loss."""
    both = train.withColumn("_held", F.lit(False)).unionByName(validation.withColumn("_held", F.lit(True)))
    best = None
    for settings in candidates:
        model = train_model("boosted", both, features, label, settings, validation="_held")
        m = binary_metrics(predict(model, validation, features), "probability_1", label).first()
        score = m["roc_auc"] - 0.5 * m["log_loss"]
        if best is None or score > best[1]:
            best = (model, score)
    return best


METRICS = ["accuracy", "roc_auc", "precision", "recall", "f1", "pr_auc", "log_loss", "brier_score"]


def expanding_cv(df: DataFrame, date: str, features: list[str], label: str, kind: str = "logistic", folds: int = 5,
                 settings: ModelSettings = ModelSettings(), threshold: float = 0.5) -> DataFrame:
    """Metrics per expanding fold; the loop launches one Spark training per fold."""
    parts = []
    for i, (train, test) in enumerate(expanding_folds(df, date, folds)):
        scored = predict(train_model(kind, train, features, label, settings), test, features)
        parts.append(binary_metrics(scored, "probability_1", label, threshold).withColumn("fold", F.lit(i)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cv_summary(fold_metrics: DataFrame) -> DataFrame:
    return aggregate_cv(fold_metrics, METRICS)


@dataclass
class DualModel:
    """An enhanced model with more features and a core model to fall back to."""

    core: PipelineModel
    core_features: list[str]
    enhanced: PipelineModel | None = None
    enhanced_features: list[str] = field(default_factory=list)


def score_with_fallback(model: DualModel, df: DataFrame, threshold: float = 0.15) -> DataFrame:
    """The enhanced score if all its columns exist, the core score for rows it gives nothing valid for.

    The choice of the model is made from the columns while planning; an invalid
    score is one outside [0, 1].
    """
    use = model.enhanced is not None and all(c in df.columns for c in model.enhanced_features)
    scored = predict(model.core, df, model.core_features, "core_p")
    if use:
        scored = predict(model.enhanced, scored, model.enhanced_features, "enhanced_p")
        good = F.col("enhanced_p").between(0, 1) & ~F.isnan("enhanced_p")
        p = F.when(good, F.col("enhanced_p")).otherwise(F.col("core_p"))
    else:
        p = F.col("core_p")
    out = scored.withColumn("hr_probability", p).drop("core_p", "enhanced_p")
    return out.withColumns({"used_model": F.lit("enhanced" if use else "core"), "label": (F.col("hr_probability") >= threshold).cast("int")})


def feature_importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return [(f, float(v)) for f, v in zip(features, values)]


def ablation_experiments(
    train: DataFrame, test: DataFrame, groups: list[tuple[str, list[str]]], label: str, kind: str = "boosted",
    settings: ModelSettings = ModelSettings(), top: int = 50, minimum_importance: float = 0.001,
) -> tuple[DataFrame, DataFrame]:
    """One experiment per cumulative feature group and one on the most important features.

    Returns the results table and the importances in long form. The rows are split and weighted and their medians found
    once for all experiments; they wait on disk, as the memory is for the trees' own form of them.
    """
    every = [c for c in dict.fromkeys(c for _, added in groups for c in added) if c in train.columns]
    given = balanced_weights(finite_columns(train.select(*every, label), every), label).persist(StorageLevel.DISK_ONLY)
    held = test.select(*every, label).persist(StorageLevel.DISK_ONLY)
    try:
        return _ablation(given, held, every, groups, label, kind, settings, top, minimum_importance)
    finally:
        given.unpersist()
        held.unpersist()


def _ablation(given: DataFrame, held: DataFrame, every: list[str], groups: list[tuple[str, list[str]]], label: str, kind: str, settings: ModelSettings,
              top: int, minimum_importance: float) -> tuple[DataFrame, DataFrame]:
    spark, rows, weights, features = given.sparkSession, [], [], []
    medians = prepare_features(every)[0].fit(given)

    def run(step: int, name: str, columns: list[str]) -> None:
        begin = time.time()
        prepared = [medians, prepare_features(columns)[1]]
        vectors = PipelineModel(prepared).transform(given).drop(*every, *[f"{c}__f" for c in every])
        model = PipelineModel([*prepared, *Pipeline(stages=classifier(kind, settings, label)).fit(vectors).stages])
        trained = time.time()
        m = binary_metrics(predict(model, held, columns), "probability_1", label).first().asDict()
        values = [float(m[k]) if m[k] is not None else None for k in METRICS]
        rows.append((name, step, len(columns), *values, trained - begin, time.time() - trained))
        if kind != "logistic":
            weights.extend((name, f, w) for f, w in feature_importances(model, columns))

    for step, (name, added) in enumerate(groups):
        features = features + [c for c in added if c in every and c not in features]
        run(step, name, features)
    if weights:
        means: dict[str, list[float]] = {}
        for _, f, w in weights:
            means.setdefault(f, []).append(w)
        ranked = sorted(((sum(v) / len(v), f) for f, v in means.items()), reverse=True)
        chosen = [f for w, f in ranked if w > minimum_importance][:top]
        if chosen:
            run(len(groups), "top_features", chosen)
    metric_ddl = ", ".join(f"{m} double" for m in METRICS)
    results = spark.createDataFrame(rows, f"experiment_name string, step int, feature_count int, {metric_ddl}, training_time double, prediction_time double")
    return results, spark.createDataFrame(weights, "experiment_name string, feature string, importance double")


def save_model(model: PipelineModel, path: str, features: list[str], extra: dict | None = None) -> None:
    """The pipeline and one JSON row of its metadata."""
    model.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps({"features": features, **(extra or {})}),), ], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/pipeline"), json.loads(spark.read.text(f"{path}/metadata").first()[0])


def backtest(model: DualModel, df: DataFrame, date: str, label: str, first: str, last: str, threshold: float = 0.15) -> DataFrame:
    """Score a date range and put actual and predicted rate beside the metrics, in one row."""
    span = df.where(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    scored = score_with_fallback(model, span, threshold)
    rates = scored.agg(F.avg(label).alias("actual_rate"), F.avg("hr_probability").alias("predicted_rate")).select(F.struct("*")).scalar()
    return binary_metrics(scored, "hr_probability", label, threshold).withColumns({
        "actual_rate": rates["actual_rate"], "predicted_rate": rates["predicted_rate"]})


def newest_rows_backtest(model: DualModel, df: DataFrame, date: str, label: str, keys: list[str], rows: int = 1000) -> DataFrame:
    """E17, quick form: metrics over the newest rows."""
    newest = df.orderBy(F.desc(date), *keys).limit(rows)
    return binary_metrics(score_with_fallback(model, newest), "hr_probability", label, 0.15)
