"""Classifiers: Spark ML estimators by name, and incremental ones whose state is small enough for the driver."""

from __future__ import annotations

import numpy as np


def classifier(name: str, features: int = 1, classes: int = 2, hidden: int = 100):
    """forest, mlp (for so many features and classes), svm (one against the rest), logistic."""
    from pyspark.ml import classification as C

    made = {
        "forest": lambda: C.RandomForestClassifier(numTrees=100, seed=7),
        "mlp": lambda: C.MultilayerPerceptronClassifier(maxIter=100, seed=7, layers=[features, hidden, classes]),
        "svm": lambda: C.OneVsRest(classifier=C.LinearSVC(maxIter=30), parallelism=8),
        "logistic": lambda: C.LogisticRegression(maxIter=100),
    }
    if name not in made:
        raise ValueError(f"unknown classifier {name!r}: use one of {sorted(made)}")
    return made[name]()


def features(rows, dictionary, kind: str = "distance"):
    """rows with an array `features`: the series itself (raw), its least distances to the atoms (distance), or its codes over them (codes)."""
    from pyspark.sql import functions as F

    from . import learning, series

    if kind == "raw":
        return rows.withColumn("features", F.col("x"))
    if kind == "distance":
        return series.feature_matrix(rows, dictionary)
    if kind == "codes":
        return rows.join(learning.encode(rows, dictionary, lam=0.1).select("vec_id", F.col("a").alias("features")), "vec_id")
    raise ValueError(f"unknown features {kind!r}: use raw, distance or codes")


def shapelet_pipeline(dictionary, name: str = "mlp", kind: str = "distance", classes: int = 2, label: str = "label"):
    """An ML pipeline over vec_id, label, x: features of a dictionary, label index, classifier."""
    from pyspark.ml import Pipeline, Transformer
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    class ShapeletFeatures(Transformer):
        """vector: features() as a vector."""

        def _transform(self, dataset):
            return features(dataset, dictionary, kind).withColumn("vector", array_to_vector("features"))

    index = StringIndexer(inputCol=label, outputCol="target", stringOrderType="alphabetAsc")
    model = classifier(name, features=dictionary.count(), classes=classes).setFeaturesCol("vector").setLabelCol("target")
    return Pipeline(stages=[ShapeletFeatures(), index, model])


def grid_scores(train, test, grid, name: str = "logistic", **how):
    """k, share, lam, accuracy on the held-out rows, for each (k, share, lam): dictionaries of train, distance features, one classifier."""
    from pyspark.sql import functions as F

    from . import learning

    out, classes = [], train.agg(F.countDistinct("label")).first()[0]
    for k, share, lam in grid:
        d = learning.learn_dictionaries(train, k=k, share=share, lam=lam, **how).select("label", "shapelet_id", "s").collect()
        d = train.sparkSession.createDataFrame([(n, *r) for n, r in enumerate(sorted(d, key=lambda r: (r.label, r.shapelet_id)))], "pos long, label string, shapelet_id long, s array<double>")
        got = shapelet_pipeline(d, name, classes=classes).fit(train).transform(test)
        out.append((k, float(share), float(lam), got.agg(F.avg((F.col("prediction") == F.col("target")).cast("double"))).first()[0]))
    return train.sparkSession.createDataFrame(out, "k long, share double, lam double, accuracy double")


def assemble(features, label: str = "label"):
    """features (array) as an ML vector and label as an index in alphabetical order."""
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    df = features.withColumn("vector", array_to_vector("features"))
    return StringIndexer(inputCol=label, outputCol="target", stringOrderType="alphabetAsc").fit(df).transform(df)


class LinearSgd:
    """One-against-rest linear models with hinge loss, learned row by row over shuffled passes; rate 1 / (alpha (t + t0))."""

    def __init__(self, classes, alpha: float = 1e-4, passes: int = 10, seed: int = 0, scale: bool = False):
        self.classes, self.alpha, self.passes = np.array(sorted(classes)), alpha, passes
        self.w = self.b = None
        self.t, self.rng, self.scaler = 1, np.random.default_rng(seed), RunningScaler() if scale else None

    def partial_fit(self, x, y) -> LinearSgd:
        x, y = np.asarray(x, dtype=float), np.asarray(y)
        if self.scaler:
            x = self.scaler.partial_fit(x).transform(x)
        if self.w is None:
            self.w, self.b = np.zeros((len(self.classes), x.shape[1])), np.zeros(len(self.classes))
        sign = np.where(y[:, None] == self.classes[None, :], 1.0, -1.0)
        t0 = 1.0 / (self.alpha * 1.0)
        for _ in range(self.passes):
            for i in self.rng.permutation(len(x)):
                rate, own, v = 1.0 / (self.alpha * (self.t + t0)), sign[i], x[i]
                wrong = own * (self.w @ v + self.b) < 1
                self.w *= 1 - rate * self.alpha
                if wrong.any():
                    move = rate * own * wrong
                    self.w += move[:, None] * v
                    self.b += move
                self.t += 1
        return self

    def resize(self, features: int) -> LinearSgd:
        """Weights of further features begin at 0, those of features that are gone are forgotten."""
        if self.w is not None:
            keep = self.w[:, :features]
            self.w = np.pad(keep, ((0, 0), (0, features - keep.shape[1])))
        return self

    def fit(self, x, y) -> LinearSgd:
        """Learn anew."""
        self.w = self.b = None
        self.t, self.scaler = 1, RunningScaler() if self.scaler else None
        return self.partial_fit(x, y)

    def decision(self, x):
        x = np.asarray(x, dtype=float)
        return (self.scaler.transform(x) if self.scaler else x) @ self.w.T + self.b

    def predict(self, x):
        return self.classes[self.decision(x).argmax(axis=1)]

    def predict_proba(self, x):
        p = 1 / (1 + np.exp(-self.decision(x)))
        return p / p.sum(axis=1, keepdims=True)


class RunningScaler:
    """Mean and population variance of all rows so far, merged batch by batch."""

    def __init__(self):
        self.n, self.mean, self.m2 = 0, 0.0, 0.0

    def partial_fit(self, x):
        n, mean, m2 = len(x), x.mean(axis=0), ((x - x.mean(axis=0)) ** 2).sum(axis=0)
        d, whole = mean - self.mean, self.n + n
        self.m2 = self.m2 + m2 + d * d * self.n * n / whole
        self.mean, self.n = self.mean + d * n / whole, whole
        return self

    def transform(self, x):
        s = np.sqrt(self.m2 / self.n)
        return (x - self.mean) / np.where(s == 0, 1.0, s)
