"""Boosted trees are fitted on cells of bins: the trees are those of all rows."""

import random

from pyspark.sql import functions as F

from tapestream.operators import models


def _rows(spark, classes):
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        a, b = round(rng.expovariate(0.1) - 3, 2), rng.random() * 24
        y = 5 * a - b * b / 9 + rng.gauss(0, 20)
        rows.append((i, a, b, 1.0, float(y > 0) if classes else y))
    return spark.createDataFrame(rows, "row long, a double, b double, same double, y double").coalesce(2).cache()


def _on_all_rows(rows, features, kind, trees):
    from pyspark.ml.feature import VectorAssembler

    stage = VectorAssembler(inputCols=features, outputCol="_features")
    return stage, kind(featuresCol="_features", labelCol="y", maxIter=trees, stepSize=0.05, maxDepth=4, seed=7).fit(stage.transform(rows))


def _check(spark, classes, kind):
    rows, features = _rows(spark, classes), ["a", "b", "same"]
    plain, want = _on_all_rows(rows, features, kind, 6)
    stages, found = models.boosted_trees(rows, features, "y", trees=6, classify=classes)
    both = want.transform(plain.transform(rows)).select("row", F.col("prediction").alias("p")).join(found.transform(stages.transform(rows)).select("row", F.col("prediction").alias("q")), "row")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9
    assert max(abs(p - q) for p, q in zip(want.featureImportances.toArray(), found.featureImportances.toArray())) < 1e-9


def test_regression_on_cells_equals_all_rows(spark):
    from pyspark.ml.regression import GBTRegressor

    _check(spark, False, GBTRegressor)


def test_classes_on_cells_equal_all_rows(spark):
    from pyspark.ml.classification import GBTClassifier

    _check(spark, True, GBTClassifier)


def test_cells_are_few_and_weigh_all_rows(spark):
    rows, features = _rows(spark, False), ["a", "b", "same"]
    bounds = [models.bin_bounds(rows, f) for f in features]
    assert [len(b) for b in bounds] == [31, 31, 0]
    _, cells = models.binned_cells(rows, features, "y", bounds)
    n, weight, total = cells.agg(F.count("*"), F.sum("_weight"), F.sum(F.col("_weight") * F.col("y"))).first()
    assert n <= 32 * 32 and n < 3000 and weight == 3000
    assert abs(total - rows.agg(F.sum("y")).first()[0]) < 1e-6
