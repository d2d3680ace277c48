"""Gradient-boosted matcher on pair features."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.assignment import class_weights
from tessera.session import stage_table

SEED = 42


def fit(labelled: DataFrame, features: list[str], *, trees: int = 60, depth: int = 5, rate: float = 0.1, subsample: float = 0.8, validation: str | None = None) -> PipelineModel:
    """Trained with balanced class weights. validation: a boolean column that marks rows for early stopping."""
    weights = class_weights(labelled).select("label", "weight")
    rows = stage_table(labelled.join(F.broadcast(weights), "label").withColumn("label", F.col("label").cast("double")), "training")  # two rows
    gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, featureSubsetStrategy="all", seed=SEED)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), gbt]).fit(rows)


def predict(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """pairs with prob."""
    scored = model.transform(pairs)
    return scored.select(*pairs.columns, vector_to_array("probability")[1].alias("prob"))


def importances(model: PipelineModel) -> DataFrame:
    from pyspark.sql import SparkSession

    names, values = model.stages[0].getInputCols(), model.stages[1].featureImportances.toArray().tolist()
    return SparkSession.active().createDataFrame(list(zip(names, values, strict=True)), "feature string, importance double").orderBy(F.desc("importance"))


def save(model: PipelineModel, path: str, thresholds: dict[str, float]) -> None:
    model.write().overwrite().save(f"{path}/model")
    from pyspark.sql import SparkSession

    meta = json.dumps({"thresholds": thresholds, "features": model.stages[0].getInputCols()})
    SparkSession.active().createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(path: str) -> tuple[PipelineModel, dict]:
    from pyspark.sql import SparkSession

    return PipelineModel.load(f"{path}/model"), json.loads(SparkSession.active().read.text(f"{path}/meta").first()[0])


def train_matcher(labelled: DataFrame, records: DataFrame, truth: DataFrame, features: list[str], *, taus: tuple[float, ...] | None = None, exclusive: bool = False, **options) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """The model, thresholds (country, threshold) and the validation pairs with prob.

    Reference records are split by country; pairs of training records fit the
    trees, those of validation records stop them early and choose each
    country's threshold by mean F0.5. labelled: s1_id, cand_id, label and the
    features. records: entity_id, country. truth: s1_id, cand_id. Without
    pairs of one of the labels there is no model, and fit raises.
    """
    from tessera.operators import evaluation as E
    from tessera.operators.assignment import stratified_split

    split = stage_table(stratified_split(records), "split").select(F.col("entity_id").alias("s1_id"), "country", (F.col("split") == "validation").alias("held_out"))
    rows = stage_table(labelled.join(split.select("s1_id", "held_out"), "s1_id"), "matcher-rows")
    model = fit(rows, features, validation="held_out", **options)
    scored = stage_table(predict(model, rows.where("held_out").select("s1_id", "cand_id", "label", *features)).select("s1_id", "cand_id", "label", "prob"), "matcher-scores")
    held = split.where("held_out").select("s1_id", "country")
    own = truth.join(held.select("s1_id"), "s1_id", "left_semi")
    sweep = E.threshold_sweep(own, scored, held, taus or E.TAUS_C, exclusive=exclusive)
    return model, sweep.where("best").select("country", F.col("tau").alias("threshold")), scored
