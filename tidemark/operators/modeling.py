"""Models on Spark ML: survival, calibration, out-of-fold scores and principal components."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression, IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import once


def survival(train: DataFrame, rows: DataFrame, features: list[str], duration: str, event: str) -> DataFrame:
    """rows with `expected`: the duration that a Weibull model of censored durations expects. Nulls in features are 0."""
    assemble = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="features")

    def filled(df: DataFrame) -> DataFrame:
        return assemble.transform(df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}))

    known = filled(train).select("features", F.greatest(F.col(duration).cast("double"), F.lit(0.5)).alias("label"), F.col(event).cast("double").alias("censor"))
    model = AFTSurvivalRegression(maxIter=50).fit(known)
    return model.transform(filled(rows)).select(*rows.columns, F.col("prediction").alias("expected"))


def out_of_fold(df: DataFrame, key: str, features: list[str], label: str, folds: int = 4) -> DataFrame:
    """(key, label, fold, score): logistic scores of every row by models that were fitted without its fold.

    Folds are hashes of the key within each class, features are scaled, classes weigh the same. The rows are computed once and
    kept in the shared folder, so that neither a fit nor the union of the folds' scores computes df again.
    """
    order = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(folds)).cast("int")
    rows = once(df.select(key, F.col(label).cast("double").alias("label"), order.alias("fold"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(sizes.values())
    weight = F.lit(0.0)
    for y, n in sizes.items():
        weight = F.when(F.col("label") == y, total / (len(sizes) * n)).otherwise(weight)
    stages = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), LogisticRegression(weightCol="weight", maxIter=30)]
    out = None
    for fold in range(folds):
        model = Pipeline(stages=stages).fit(rows.where(F.col("fold") != fold).withColumn("weight", weight))
        part = model.transform(rows.where(F.col("fold") == fold)).select(key, "label", "fold", vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def calibrate(scored: DataFrame, score: str, label: str, form: str = "isotonic") -> DataFrame:
    """scored with `calibrated`: an isotonic or a logistic curve from scores to labels, within [0, 1]."""
    if form == "isotonic":
        model = IsotonicRegression(featuresCol="_x").fit(scored.select(F.col(score).cast("double").alias("_x"), F.col(label).cast("double").alias("label")))
        out = model.transform(scored.withColumn("_x", F.col(score).cast("double"))).withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))))
        return out.select(*scored.columns, "calibrated")
    vectors = scored.withColumn("features", array_to_vector(F.array(F.col(score).cast("double"))))
    model = LogisticRegression(featuresCol="features", labelCol="_y", maxIter=50).fit(vectors.withColumn("_y", F.col(label).cast("double")))
    return model.transform(vectors).select(*scored.columns, vector_to_array("probability")[1].alias("calibrated"))


def principal_components(train: DataFrame, rows: DataFrame, key: str, vector: str, parts: int) -> DataFrame:
    """(key, parts): vectors on the main directions of the training vectors."""

    def read(df: DataFrame) -> DataFrame:
        return df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))

    model = PCA(k=parts, inputCol="_v", outputCol="_p").fit(read(train))
    return model.transform(read(rows)).select(key, vector_to_array("_p").alias("parts"))
