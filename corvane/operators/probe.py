"""Shortcut probe: can simple features tell the classes? Median imputation, scaling and logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import medians


def fit_probe(train: DataFrame, test: DataFrame, features: list[str], label: str, c: float = 1.0) -> DataFrame:
    """The test rows with `probability` of class 1. Infinite values count as missing."""
    finite = lambda f: F.when(F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) != float("inf")), F.col(f).cast("double"))
    train, test = (x.withColumns({f: finite(f) for f in features}) for x in (train, test))
    names = [f"__{f}" for f in features]
    rows = max(1, train.count())
    # a feature without a value in training counts as 0
    middle = medians(train, features).select(*[F.coalesce(f, F.lit(0.0)).alias(n) for f, n in zip(features, names)])
    train, test = (x.crossJoin(F.broadcast(middle)).withColumns({n: F.coalesce(f, n) for f, n in zip(features, names)}) for x in (train, test))
    steps = [
        VectorAssembler(inputCols=names, outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True),
        LogisticRegression(featuresCol="__x", labelCol=label, regParam=1 / (c * rows), standardization=False, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__g"),
    ]
    scored = Pipeline(stages=steps).fit(train).transform(test)
    return scored.withColumn("probability", vector_to_array("__p")[1]).drop("__raw", "__x", "__p", "__r", "__g", *names)
