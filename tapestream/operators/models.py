"""Models in closed form or from the ML library, and chronological folds."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapestream.sources.scratch import stored

#: Cells of bins that one task holds while trees are fitted, at most.
CELLS = 50_000


class Preprocessor:
    """Train medians for missing values, indicators where training had some, population standardisation."""

    def __init__(self, train: DataFrame, features: Sequence[str]) -> None:
        self.features = list(features)
        row = train.agg(*[F.median(f).alias(f"m_{f}") for f in features], *[F.count_if(F.col(f).isNull()).alias(f"n_{f}") for f in features]).first()
        self.medians = {f: row[f"m_{f}"] if row[f"m_{f}"] is not None else 0.0 for f in features}
        self.indicators = [f for f in features if row[f"n_{f}"]]
        filled = train.select(*[self._filled(f).alias(f) for f in features])
        row = filled.agg(*[F.avg(f).alias(f"a_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
        self.centre = {f: row[f"a_{f}"] or 0.0 for f in features}
        self.scale = {f: row[f"s_{f}"] or 1.0 for f in features}

    def _filled(self, f: str) -> Column:
        return F.coalesce(F.col(f).cast("double"), F.lit(self.medians[f]))

    @property
    def columns(self) -> list[str]:
        return [f"{f}_z" for f in self.features] + [f"{f}_missing" for f in self.indicators]

    def apply(self, rows: DataFrame) -> DataFrame:
        made = {f"{f}_z": (self._filled(f) - self.centre[f]) / self.scale[f] for f in self.features}
        made |= {f"{f}_missing": F.col(f).isNull().cast("double") for f in self.indicators}
        return rows.withColumns(made)


def ols_one(train: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return train.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def ridge(train: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept from one pass of moments and a solve of as many equations as features."""
    names = [*features, y]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = train.dropna(subset=names).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"a{i}") for i, c in enumerate(names)], *[F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    n, k = row["n"], len(features)
    if not n:
        return np.zeros(k), 0.0
    cov = np.zeros((k + 1, k + 1))
    for i, (a, b) in enumerate(pairs):
        p, q = names.index(a), names.index(b)
        cov[p, q] = cov[q, p] = row[f"c{i}"]
    w = np.linalg.solve(n * cov[:k, :k] + alpha * np.eye(k), n * cov[:k, k])
    return w, row[f"a{k}"] - float(w @ [row[f"a{i}"] for i in range(k)])


def linear_prediction(features: Sequence[str], weights: Sequence[float], intercept: float) -> Column:
    out = F.lit(float(intercept))
    for f, w in zip(features, weights):
        out = out + F.col(f) * float(w)
    return out


def bin_bounds(train: DataFrame, feature: str, seed: int = 7) -> list[float]:
    """The bounds of the bins that the ML library's trees put a feature in: those of a tree that tells the feature's own values apart.

    Bins less than about 1e-8 standard deviations apart may become one.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    x = F.col(feature).cast("double")
    row = train.agg(F.avg(x).alias("a"), F.stddev_pop(x).alias("s")).first()
    rows = VectorAssembler(inputCols=[feature], outputCol="_features").transform(train.select(feature))
    rows = rows.withColumn("_own", (x - (row["a"] or 0.0)) / (row["s"] or 1.0))
    tree = DecisionTreeRegressor(featuresCol="_features", labelCol="_own", maxDepth=30, seed=seed).fit(rows)
    return sorted({float(c) for c in re.findall(r"feature 0 <= ([^)\s]+)\)", tree.toDebugString)})


def binned_cells(train: DataFrame, features: Sequence[str], y: str, bounds: Sequence[Sequence[float]], classify: bool = False):
    """The stages that bin features and assemble them, and a weighted row (y, _weight, _features) per cell of bins.

    Trees see of a feature only its bin.  Squared errors of a cell's rows and of as many rows at their mean differ by
    what no split changes, so both give the same trees; classes keep a row per cell and class.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler

    # a tree's bin includes its upper bound, a bucket its lower one; a constant feature is in one bucket, whatever the bound
    splits = [[-math.inf, *(math.nextafter(c, math.inf) for c in own or [0.0]), math.inf] for own in bounds]
    buckets, bins = [f"_bucket_{f}" for f in features], [f"_bin_{f}" for f in features]
    plain = ", ".join(f"`{a}` + 0D AS `{b}`" for a, b in zip(buckets, bins))  # buckets are marked as categories, which have no order
    binned = PipelineModel([Bucketizer(splitsArray=splits, inputCols=list(features), outputCols=buckets), SQLTransformer(statement=f"SELECT *, {plain} FROM __THIS__")])
    assembler = VectorAssembler(inputCols=bins, outputCol="_features")
    by = [*bins, y] if classify else bins
    counted = binned.transform(train).groupBy(*by).agg(F.count("*").cast("double").alias("_weight"), *([] if classify else [F.avg(y).alias(y)]))
    most = math.prod(len(own) + 1 for own in bounds)
    return PipelineModel([binned, assembler]), assembler.transform(counted.coalesce(-(-most // CELLS)))


def boosted_trees(train: DataFrame, features: Sequence[str], y: str, seed: int = 7, trees: int = 120, classify: bool = False):
    """Gradient-boosted trees of the ML library with the study's frozen size, as the stages before the model and the model.

    Fitted on a weighted row per cell of bins, so each of the many passes reads as many rows as there are cells.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    kind = GBTClassifier if classify else GBTRegressor
    rows = stored(train.dropna(subset=[*features, y]).select(*features, y), "train")
    stages, cells = binned_cells(rows, features, y, [bin_bounds(rows, f, seed) for f in features], classify)
    return stages, kind(featuresCol="_features", labelCol=y, weightCol="_weight", maxIter=trees, stepSize=0.05, maxDepth=4, seed=seed).fit(cells)


def mean_model(train: DataFrame, y: str) -> float | None:
    """The null model: what every prediction is."""
    return train.agg(F.avg(y).alias("m")).first()["m"]


def class_frame(rows: DataFrame, available: str, direction: str) -> DataFrame:
    """Rows that are available and move, with target 1 for up and 0 for down."""
    return rows.where(F.col(available) & F.col(direction).isin(1, -1)).withColumn("target", F.when(F.col(direction) == 1, 1).otherwise(0))


def logistic(train: DataFrame, features: Sequence[str], y: str, c: float = 1.0, rounds: int = 50, tol: float = 1e-10) -> tuple[list[float], float]:
    """Weights and intercept of an L2-penalised logistic regression; c is the penalty's inverse, as a sum over rows.

    Newton's method: each round is one aggregate of as many moments as pairs of features, and
    a solve of as many equations as features.  A round that makes the objective worse is halved.
    """
    rows = train.dropna(subset=[*features, y]).select(*[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)], F.col(y).cast("double").alias("_y"))
    k = len(features)
    xs = [*[F.col(f"_x{i}") for i in range(k)], F.lit(1.0)]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    penalty = np.diag([1.0 / c] * k + [0.0])

    def moments(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = sum((x * float(v) for x, v in zip(xs, w)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("_y") * z
        row = rows.agg(F.sum(loss), *[F.sum((p - F.col("_y")) * x) for x in xs], *[F.sum(p * (1 - p) * xs[i] * xs[j]) for i, j in pairs]).first()
        values = np.array([v or 0.0 for v in row])
        hessian = np.zeros((k + 1, k + 1))
        for v, (i, j) in zip(values[k + 2 :], pairs):
            hessian[i, j] = hessian[j, i] = v
        return values[0] + 0.5 * float(w @ penalty @ w), values[1 : k + 2] + penalty @ w, hessian + penalty

    w = np.zeros(k + 1)
    loss, gradient, hessian = moments(w)
    for _ in range(rounds):
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        share = 1.0
        while share > 1e-6:
            new = moments(w - share * step)
            if new[0] <= loss + 1e-12 * abs(loss):
                break
            share /= 2
        w, (loss, gradient, hessian) = w - share * step, new
        if np.abs(share * step).max() <= tol * max(1.0, np.abs(w).max()):
            break
    return [float(v) for v in w[:k]], float(w[k])


def logistic_probability(rows: DataFrame, features: Sequence[str], fitted: tuple[Sequence[float], float]) -> DataFrame:
    return rows.withColumn("prob", 1 / (1 + F.exp(-linear_prediction(features, *fitted))))


def expanding_ols(rows: DataFrame, fold: str, x: str, y: str) -> DataFrame:
    """fold, slope and intercept of y on x over all earlier folds: one aggregate, then running moments, a row per fold."""
    from pyspark.sql import Window

    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = {"n": F.count("*"), "sx": F.sum(a), "sy": F.sum(b), "sxx": F.sum(a * a), "sxy": F.sum(a * b)}
    earlier = Window.orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)  # a row per fold
    by = rows.groupBy(fold).agg(*[v.alias(name) for name, v in sums.items()])
    by = by.select(fold, *[F.sum(name).over(earlier).alias(name) for name in sums])
    slope = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.nullif(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0)))
    return by.withColumn("slope", slope).select(fold, "slope", F.try_divide(F.col("sy") - F.col("slope") * F.col("sx"), F.col("n")).alias("intercept"))


def fold_importance(rows: DataFrame, fold: str, x: str, y: str, order: Sequence[str], first: int, key: str) -> DataFrame:
    """fold and importance: how much larger the mean absolute error of the model of earlier folds gets with x dealt anew.

    Of the folds after the first ``first``.
    """
    from pyspark.sql import Window

    fits = expanding_ols(rows, fold, x, y).withColumn("_k", F.row_number().over(Window.orderBy(fold))).where(F.col("_k") > first).drop("_k")
    every = rows.select(fold, x, y, F.lit(0).alias("_d")).unionByName(permuted(rows, [fold], key, order, x).select(fold, x, y, F.lit(1).alias("_d")))
    error = F.abs(F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))
    both = every.join(fits, fold).groupBy(fold).agg(F.avg(F.when(F.col("_d") == 1, error)).alias("_p"), F.avg(F.when(F.col("_d") == 0, error)).alias("_o"))
    return both.select(fold, (F.col("_p") - F.col("_o")).alias("importance"))


def importances(rows: DataFrame, features: Sequence[str], y: str, order: Sequence[str], first_days: int = 20, repeats: int = 3) -> DataFrame:
    """feature, gain and permuted: the rise of the mean absolute error on later days with the feature dealt anew, over ``repeats`` deals.

    rows has ``day`` and is stored, as each deal passes over it twice; all deals are scored in one pass.
    """
    from pyspark.sql import Window

    rows = stored(rows.select("day", *dict.fromkeys([*order, *features, y])), "days")
    days = [r.day for r in rows.select("day").distinct().orderBy("day").collect()]  # a row per day
    cut = days[min(first_days, len(days) - 1)]
    assembler, model = boosted_trees(rows.where(F.col("day") < cut), features, y)
    later = rows.where(F.col("day") >= cut)
    every = later.withColumns({"_of": F.lit(""), "_deal": F.lit(0)})
    for f in features:
        for k in range(repeats):
            every = every.unionByName(permuted(later, ["day"], f"{f}|{k}", order, f).withColumns({"_of": F.lit(f), "_deal": F.lit(k)}))
    errors = model.transform(assembler.transform(every)).groupBy("_of", "_deal").agg(F.avg(F.abs(F.col(y) - F.col("prediction"))).alias("e"))
    by = errors.groupBy("_of").agg(F.avg("e").alias("e"))
    base = F.max(F.when(F.col("_of") == "", F.col("e"))).over(Window.partitionBy(F.lit(0)))  # a row per feature; joined, all rows would be scored twice
    gains = F.create_map(*[x for f, g in zip(features, model.featureImportances.toArray()) for x in (F.lit(f), F.lit(float(g)))])
    rises = by.withColumn("permuted", F.col("e") - base).where("_of <> ''")
    return rises.select(F.col("_of").alias("feature"), gains[F.col("_of")].alias("gain"), "permuted")


def expanding_folds(dates: Sequence[str], first_train: int) -> list[tuple[list[str], str]]:
    """All dates before each validation date."""
    dates = sorted(dates)
    return [(dates[:i], dates[i]) for i in range(first_train, len(dates))]


def rolling_folds(dates: Sequence[str], width: int, first: int | None = None) -> list[tuple[list[str], str]]:
    """The ``width`` dates before each validation date."""
    dates = sorted(dates)
    return [(dates[i - width : i], dates[i]) for i in range(max(width, first or width), len(dates))]


def permuted(rows: DataFrame, by: Sequence[str], key: str, order: Sequence[str], column: str) -> DataFrame:
    """rows with the column dealt anew within each group, by a keyed hash of the row: same values, other places."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    shuffled = F.row_number().over(Window.partitionBy(*by).orderBy(F.sha2(F.concat_ws("|", F.lit(key), *order), 256), *order))
    values = rows.select(*by, F.col(column).alias("_v"), shuffled.alias("_k"))
    return rows.withColumn("_k", at).join(values, [*by, "_k"]).withColumn(column, F.col("_v")).drop("_v", "_k")


def keyed_sample(rows: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """n rows, the same in each run, without replacement."""
    return rows.orderBy(F.sha2(F.concat_ws("|", F.lit(key), *order), 256), *order).limit(n)
