"""Linear and two-layer probes on embeddings with Spark ML."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterset.functions import vectors


def _standardised(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scale by the training mean and population deviation."""
    n = train.count()
    model = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True).fit(train)
    # the scaler divides by the sample deviation; the probe uses the population one
    factor = float(((n / (n - 1)) ** 0.5) if n > 1 else 1.0)

    width = int(train.select(F.size("_x").alias("d")).first()["d"])
    stretch = ElementwiseProduct(scalingVec=Vectors.dense([factor] * width), inputCol="_z", outputCol="features")
    return stretch.transform(model.transform(train)), stretch.transform(model.transform(test))


def _prepared(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("_x", vectors.as_double(F.col(vector))).withColumn("_v", array_to_vector("_x"))


def _balanced_weights(train: DataFrame, label: str) -> DataFrame:
    """n / (classes * class count) for every row."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("k")).first()
    weight = F.lit(float(totals["n"])) / (F.lit(float(totals["k"])) * F.col("_c"))
    return train.join(counts, label).withColumn("_w", weight).drop("_c")


def fit_predict(
    train: DataFrame, test: DataFrame, *, vector: str, label: str, balanced: bool = False, c: float = 1.0, max_iter: int = 3000
) -> DataFrame:
    """Test rows with ``prediction`` from a standardised multinomial regression."""
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
    names = indexer.labels
    ready_train = _prepared(indexer.transform(train), vector)
    if balanced:
        ready_train = _balanced_weights(ready_train, label)
    ready_train = ready_train.persist()
    scaled_train, scaled_test = _standardised(ready_train, _prepared(test, vector))
    n = ready_train.count()
    model = LogisticRegression(
        featuresCol="features", labelCol="_y", predictionCol="_p", family="multinomial",
        regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-4,
        **({"weightCol": "_w"} if balanced else {}),
    ).fit(scaled_train)
    ready_train.unpersist()
    predicted = model.transform(scaled_test)
    names_array = F.array(*[F.lit(n_) for n_ in names])
    return predicted.withColumn("prediction", F.get(names_array, F.col("_p").cast("int"))).select(*test.columns, "prediction")


def linear_probe(
    df: DataFrame, *, vector: str, label: str, fold: str = "fold", balanced: bool = False, max_iter: int = 3000
) -> DataFrame:
    """Out-of-fold predictions: one distributed fit per fold."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    parts = [
        fit_predict(df.where(F.col(fold) != k), df.where(F.col(fold) == k), vector=vector, label=label,
                    balanced=balanced, max_iter=max_iter)
        for k in folds
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def mlp_probe(
    train: DataFrame, dev: DataFrame, *, vector: str, label: str, hidden: int = 128, max_iter: int = 100, seed: int = 0
) -> DataFrame:
    """Dev rows with ``prediction`` from a two-layer network (sigmoid hidden units)."""
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(train)
    scaled_train, scaled_dev = _standardised(_prepared(indexer.transform(train), vector), _prepared(dev, vector))
    width = int(scaled_train.select(F.size("_x").alias("d")).first()["d"])
    model = MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="_y", predictionCol="_p",
        layers=[width, hidden, len(indexer.labels)], maxIter=max_iter, seed=seed,
    ).fit(scaled_train)
    names_array = F.array(*[F.lit(n) for n in indexer.labels])
    return model.transform(scaled_dev).withColumn(
        "prediction", F.get(names_array, F.col("_p").cast("int"))
    ).select(*dev.columns, "prediction")
