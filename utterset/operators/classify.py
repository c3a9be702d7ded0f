"""Weighted classification scores from confusion counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(
    df: DataFrame, keys: Sequence[str], gold: str = "gold", prediction: str = "prediction", weight: str | None = None
) -> DataFrame:
    """Weight per (keys, gold, prediction)."""
    w = F.sum(F.col(weight).cast("double")) if weight else F.count(F.lit(1)).cast("double")
    return df.groupBy(*keys, F.col(gold).alias("gold"), F.col(prediction).alias("prediction")).agg(
        w.alias("w")
    )


def label_counts(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per (keys, label): weight in gold (g), in prediction (p) and in both (tp).  Zero weights do not count."""
    hit = F.when(F.col("gold") == F.col("prediction"), F.col("w")).otherwise(0.0)
    roles = F.explode(
        F.array(
            F.struct(
                F.col("gold").alias("label"), F.col("w").alias("g"), F.lit(0.0).alias("p"), hit.alias("tp")
            ),
            F.struct(
                F.col("prediction").alias("label"), F.lit(0.0).alias("g"), F.col("w").alias("p"), F.lit(0.0).alias("tp")
            ),
        )
    )
    return (
        cells.where(F.col("w") > 0)
        .select(*keys, roles.alias("r"))
        .groupBy(*keys, F.col("r.label").alias("label"))
        .agg(F.sum("r.g").alias("g"), F.sum("r.p").alias("p"), F.sum("r.tp").alias("tp"))
    )


def label_scores(per_label: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores per ``keys`` from label counts: recall over labels in gold, F1 over labels in gold or prediction."""
    recall = F.when(F.col("g") > 0, F.col("tp") / F.col("g"))
    return per_label.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("g")).alias("accuracy"),
        F.avg(recall).alias("balanced_accuracy"),
        F.avg(2 * F.col("tp") / (F.col("g") + F.col("p"))).alias("macro_f1"),
        F.sum("g").alias("weight"),
    )


def fold_scores(cells: DataFrame, keys: Sequence[str], fold: str = "fold") -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 of each (keys, fold)."""
    return label_scores(label_counts(cells, [*keys, fold]), [*keys, fold])


def classification_metrics(
    df: DataFrame,
    keys: Sequence[str] = (),
    *,
    fold: str = "fold",
    gold: str = "gold",
    prediction: str = "prediction",
    weight: str | None = None,
) -> DataFrame:
    """Fold scores averaged without weights, per ``keys``."""
    cells = confusion(df, [*keys, fold], gold, prediction, weight)
    return average_folds(fold_scores(cells, keys, fold), keys)


def average_folds(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(
        F.avg("accuracy").alias("accuracy"),
        F.avg("balanced_accuracy").alias("balanced_accuracy"),
        F.avg("macro_f1").alias("macro_f1"),
        F.count(F.lit(1)).alias("folds"),
    )


def fold_summary(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation over folds."""
    metrics = ("accuracy", "balanced_accuracy", "macro_f1")
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_splits"),
        *[F.avg(m).alias(m) for m in metrics],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics],
    )


def seed_summary(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and sample deviation over probe seeds; one seed has no deviation."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.avg(value).alias("seed_mean"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp(value)).alias("seed_sample_sd"),
    )


def probe_macro_f1(df: DataFrame, classes: DataFrame, label: str = "label", gold: str = "gold", prediction: str = "prediction") -> DataFrame:
    """Macro F1 over all training classes; a class never seen scores 0."""
    hits = df.select(
        F.explode(
            F.array(
                F.struct(F.col(gold).alias("c"), F.lit(1).alias("g"), F.lit(0).alias("p"),
                         (F.col(gold) == F.col(prediction)).cast("int").alias("tp")),
                F.struct(F.col(prediction).alias("c"), F.lit(0).alias("g"), F.lit(1).alias("p"),
                         F.lit(0).alias("tp")),
            )
        ).alias("r")
    ).groupBy(F.col("r.c").alias(label)).agg(
        F.sum("r.g").alias("g"), F.sum("r.p").alias("p"), F.sum("r.tp").alias("tp")
    )
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(F.col("g") + F.col("p"), F.lit(0)), F.lit(0.0))
    return classes.select(label).distinct().join(hits, label, "left").agg(F.avg(f1).alias("macro_f1"))


def restrict_labels(dev: DataFrame, train: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(kept dev rows, one-row report): dev labels must occur in train."""
    known = train.select(label).distinct().withColumn("_known", F.lit(True))
    marked = dev.join(known, label, "left")
    report = marked.agg(
        F.count_if(F.col("_known").isNotNull()).alias("kept"),
        F.count_if(F.col("_known").isNull()).alias("dropped"),
    )
    return marked.where(F.col("_known").isNotNull()).drop("_known"), report


def label_map(train: DataFrame, label: str) -> DataFrame:
    """(label, class_index): sorted distinct labels numbered from 0."""
    from pyspark.sql import Window

    distinct = train.select(label).distinct()
    return distinct.withColumn(
        "class_index", (F.row_number().over(Window.orderBy(label)) - 1).cast("int")
    )
