"""Supervised labels on vectors."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscape import constants as c

# Training rows of one task.
TASK_ROWS = 100_000


def _with_features(df: DataFrame, v: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(v).cast("array<double>")))


def train_classifier(
    df: DataFrame,
    v: str = "embedding",
    label: str = "label",
    trees: int = c.TREES,
    seed: int = c.SEED,
    key: str = "id",
    depth: int = c.TREE_DEPTH,
) -> PipelineModel:
    """A random forest over vectors, with labels of any type.

    Trees draw their rows task by task, so training rows are laid out by their key first: the forest
    depends on the rows alone, not on how the input was split. Trees grow until leaves are pure or
    ``depth`` is reached.
    """
    tasks = math.ceil(df.count() / TASK_ROWS)
    laid = df.select(key, v, label).repartition(max(1, tasks), key).sortWithinPartitions(key)
    indexer = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc")
    rows = _with_features(laid.withColumn(label, F.col(label).cast("string")), v)
    indexed = indexer.fit(rows)
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label_index", predictionCol="pred_index"
    )
    names = IndexToString(inputCol="pred_index", outputCol="predicted", labels=indexed.labels)
    fitted = forest.fit(indexed.transform(rows))
    return PipelineModel(stages=[fitted, names])


def predict(model: PipelineModel, df: DataFrame, v: str = "embedding") -> DataFrame:
    """Add the predicted label as a string."""
    scored = model.transform(_with_features(df, v))
    return scored.drop("features", "rawPrediction", "probability", "pred_index")


def classification_report(df: DataFrame, y: str = "label", pred: str = "predicted") -> DataFrame:
    """Rows ``(name, precision, recall, f1, support)`` per class, plus ``accuracy``,
    ``macro avg`` and ``weighted avg``. A ratio with nothing below the line is 0.

    The rows are counted once into the confusion table; everything after that works on
    classes x classes numbers.
    """
    cells = df.groupBy(F.col(y).cast("string").alias("y"), F.col(pred).cast("string").alias("p")).agg(
        F.count("*").alias("n")
    )
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    sides = cells.select("n", hit.alias("hit"), F.explode(F.array(
        F.struct(F.col("y").alias("name"), F.lit(1).alias("is_true")),
        F.struct(F.col("p").alias("name"), F.lit(0).alias("is_true")),
    )).alias("side"))
    true_rows = F.col("side.is_true") == 1
    per_class = sides.groupBy(F.col("side.name").alias("name")).agg(
        F.sum(F.when(true_rows, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~true_rows, F.col("n")).otherwise(0)).alias("guessed"),
        F.sum(F.when(true_rows, F.col("hit")).otherwise(0)).alias("hits"),
    )
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    scored = per_class.withColumns({
        "precision": ratio(F.col("hits"), F.col("guessed")),
        "recall": ratio(F.col("hits"), F.col("support")),
    }).withColumn(
        "f1",
        ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )
    scores = ["precision", "recall", "f1"]
    weighted = lambda s: F.sum(F.col(s) * F.col("support")) / F.sum("support")
    totals = scored.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("name"),
                *[(F.sum("hits") / F.sum("support")).alias(s) for s in scores],
                F.sum("support").alias("support"),
            ),
            F.struct(F.lit("macro avg").alias("name"), *[F.avg(s).alias(s) for s in scores], F.sum("support").alias("support")),
            F.struct(F.lit("weighted avg").alias("name"), *[weighted(s).alias(s) for s in scores], F.sum("support").alias("support")),
        ).alias("rows")
    ).select(F.inline("rows"))
    both = scored.select("name", *scores, "support").unionByName(totals)
    return both.select("name", *[F.round(s, 6).alias(s) for s in scores], "support")
