"""The pair classifier over embedding features, fitted with Spark ML."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import durable

# The 4-way training classes and the 3-way labels a judge may give.
CLASSES = ("DIVERGENT", "AGREE", "RELATED_UNTYPED", "UNRELATED")
JUDGE_LABELS = {"DIVERGENT": "DIVERGENT", "AGREE": "AGREE", "RELATED_UNTYPED": "UNRELATED", "UNRELATED": "UNRELATED"}


def pair_examples(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs(src, dst, label) with the features of their two vectors."""
    side = lambda key: vectors.select(F.col("chunk_id").alias(key), F.col("vector").alias(f"{key}_vector"))
    return (
        pairs.join(side("src"), "src").join(side("dst"), "dst")
        .withColumn("features", array_to_vector(V.pair_features(F.col("src_vector"), F.col("dst_vector"))))
        .drop("src_vector", "dst_vector")
    )


def balanced(examples: DataFrame) -> DataFrame:
    """Class index and a weight that makes every class count the same."""
    index = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("label")).cast("double") - 1
    sizes = examples.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total, kinds = examples.agg(F.count(F.lit(1))).scalar(), sizes.agg(F.count(F.lit(1))).scalar()
    weights = sizes.select("label", (total / (kinds * F.col("n"))).alias("weight"))
    return examples.withColumn("class_index", index).join(weights, "label")


def fitted_head(examples: DataFrame, kind: str = "linear", seed: int = 0):
    rows = balanced(examples)
    if kind == "linear":
        return LogisticRegression(
            featuresCol="features", labelCol="class_index", weightCol="weight", maxIter=100, regParam=0.01, family="multinomial"
        ).fit(rows)
    if kind == "mlp":
        width = len(rows.select("features").first()[0])
        return MultilayerPerceptronClassifier(
            featuresCol="features", labelCol="class_index", layers=[width, 32, len(CLASSES)], seed=seed
        ).fit(rows)
    raise ValueError(f"unknown head kind: {kind!r}")


def class_name(index):
    return F.element_at(F.array(*[F.lit(c) for c in CLASSES]), index.cast("int") + 1)


def judge_name(label):
    return F.element_at(F.create_map(*[F.lit(x) for kv in JUDGE_LABELS.items() for x in kv]), label)


def predictions(model, examples: DataFrame) -> DataFrame:
    label = class_name(F.col("prediction"))
    return model.transform(examples).select("src", "dst", "label", label.alias("predicted"), judge_name(label).alias("judge_label"))


def held_out_predictions(examples: DataFrame, folds: int, kind: str = "linear", seed: int = 0) -> DataFrame:
    """Each example predicted by a head fitted without its fold; as many folds as
    examples is leave-one-out.  Folds follow a hash of the pair, so a rerun agrees."""
    marked = examples.withColumn("fold", F.pmod(F.xxhash64("src", "dst"), F.lit(folds)))
    marked = durable(marked)
    present = [r.fold for r in marked.select("fold").distinct().orderBy("fold").collect()]
    out = None
    for fold in present:
        model = fitted_head(marked.where(F.col("fold") != fold), kind, seed)
        part = predictions(model, marked.where(F.col("fold") == fold))
        out = part if out is None else out.unionByName(part)
    return out


def class_recalls(predicted: DataFrame) -> DataFrame:
    """Recall per class and, with label NULL, their mean (balanced accuracy)."""
    per = predicted.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("recall")
    )
    mean = per.agg(F.lit(None).cast("string").alias("label"), F.sum("n").alias("n"), F.avg("recall").alias("recall"))
    return per.unionByName(mean).withColumn("recall", F.round("recall", 6))


def permutation_baseline(predicted: DataFrame, rounds: int = 20, seed: int = 0) -> DataFrame:
    """Balanced accuracy when predictions are dealt out at random, per round.

    A random deal is fixed by how many of each prediction every class receives,
    so only the class counts leave Spark, never the rows.
    """
    tally = lambda c: {r[c]: r["count"] for r in predicted.groupBy(c).count().collect()}     # one row per class
    labels, said = tally("label"), tally("predicted")
    names = sorted(set(labels) | set(said))
    rng, rows = np.random.default_rng(seed), []
    for number in range(rounds):
        left, recalls = np.array([said.get(n, 0) for n in names]), []
        for name, size in sorted(labels.items()):
            dealt = rng.multivariate_hypergeometric(left, size)
            left = left - dealt
            recalls.append(float(dealt[names.index(name)] / size))
        rows.append((number, round(sum(recalls) / len(recalls), 6)))
    return predicted.sparkSession.createDataFrame(rows, "round int, balanced_accuracy double")


def recall_by_origin(predicted: DataFrame, origins: DataFrame) -> DataFrame:
    """Recovered DIVERGENT rows by the origin of their source chunk."""
    rows = predicted.where(F.col("label") == "DIVERGENT").join(origins.select(F.col("chunk_id").alias("src"), "origin"), "src")
    return rows.groupBy("origin").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("predicted") == "DIVERGENT").cast("bigint")).alias("n_recovered")
    )
