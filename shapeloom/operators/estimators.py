"""Shapelet features as stages of an ML pipeline that can be fitted, tuned, saved and loaded.

ShapeletDictionary (an Estimator) learns the dictionaries of the labels of its rows; ShapeletFeatures (its Model) turns a series into
features over them. Both keep their settings as Params, so grids and cross-validation reach them.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learning, models
from .tables import written

BANK = "pos long, label string, shapelet_id long, s array<double>"


class _Settings(Params):
    inputCol = Param(Params._dummy(), "inputCol", "series, an array of doubles", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "features, a vector", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "labels, by which dictionaries are learned", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "an id of the series, by which first atoms and codes are drawn", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "atoms of a label", TypeConverters.toInt)
    share = Param(Params._dummy(), "share", "an atom's share of a series' length", TypeConverters.toFloat)
    lam = Param(Params._dummy(), "lam", "penalty of coefficients", TypeConverters.toFloat)
    iterations = Param(Params._dummy(), "iterations", "most alternations", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of first atoms and codes", TypeConverters.toInt)
    kind = Param(Params._dummy(), "kind", "raw, distance or codes", TypeConverters.toString)

    def _defaults(self) -> None:
        self._setDefault(inputCol="x", outputCol="vector", labelCol="label", idCol="vec_id", k=5, share=0.5, lam=0.1, iterations=1000, seed=0, kind="distance")

    def setParams(self, **values):
        return self._set(**values)


class ShapeletDictionary(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """fit() learns a dictionary per label; null labels are a label, null series count for nothing."""

    def __init__(self, **values):
        super().__init__()
        self._defaults()
        self._set(**values)

    def _fit(self, dataset: DataFrame) -> ShapeletFeatures:
        get = self.getOrDefault
        rows = dataset.select(F.col(get("idCol")).alias("vec_id"), F.col(get("labelCol")).cast("string").alias("label"), F.col(get("inputCol")).alias("x"))
        got = learning.learn_dictionaries(rows, k=get("k"), share=get("share"), lam=get("lam"), most=get("iterations"), seed=get("seed")).collect()  # labels times atoms
        got.sort(key=lambda r: (r.label is None, r.label or "", r.shapelet_id))
        return self._copyValues(ShapeletFeatures([(n, r.label, r.shapelet_id, list(r.s)) for n, r in enumerate(got)]))


class ShapeletFeatures(Model, _Settings, MLWritable, MLReadable):
    """transform() adds the features of the chosen kind over the dictionary as a vector; a null or short series has no finite distance,
    which is written as the largest double."""

    def __init__(self, bank: list[tuple] | None = None):
        super().__init__()
        self._defaults()
        self.bank = bank or []

    def dictionary(self, spark) -> DataFrame:
        """pos, label, shapelet_id, s."""
        return spark.createDataFrame(self.bank, BANK)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        source = dataset.withColumns({"_own_id": F.col(get("idCol")), "_own_x": F.col(get("inputCol"))})
        rows = source.select(F.struct(*dataset.columns).alias("_row"), F.col("_own_id").alias("vec_id"), F.col(get("inputCol")).cast("array<double>").alias("x"), F.lit(None).cast("string").alias("label"))
        made = models.features(rows, self.dictionary(dataset.sparkSession), get("kind"))
        finite = F.transform("features", lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(1.7976931348623157e308)).otherwise(v))
        return made.select("_row.*", array_to_vector(finite).alias(get("outputCol")))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: ShapeletFeatures):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.dictionary(self.sparkSession).coalesce(1).write.parquet(f"{path}/dictionary")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ShapeletFeatures:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        bank = self.sparkSession.read.parquet(f"{path}/dictionary").orderBy("pos").collect()
        model = self.cls([(r.pos, r.label, r.shapelet_id, list(r.s)) for r in bank])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def shapelet_classifier(name: str = "logistic", **settings):
    """A Pipeline of ShapeletDictionary, label index and a classifier of models.classifier()."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer

    made = ShapeletDictionary(**settings)
    index = StringIndexer(inputCol=made.getOrDefault("labelCol"), outputCol="target", stringOrderType="alphabetAsc")
    return Pipeline(stages=[made, index, models.classifier(name).setFeaturesCol(made.getOrDefault("outputCol")).setLabelCol("target")])


def held_out(pipeline, rows: DataFrame) -> DataFrame:
    """The predictions of a shapelet_classifier(), fitted to the rows that aren't is_test, for those that are. Rows and features are
    written, as learner and classifier read them many times."""
    from pyspark.ml import Pipeline

    made, *rest = pipeline.getStages()
    rows = written(rows, "split")
    data = written(made.fit(rows.filter("not is_test")).transform(rows).drop(made.getOrDefault("inputCol")), "features")
    return Pipeline(stages=rest).fit(data.filter("not is_test")).transform(data.filter("is_test"))


def cross_validated(pipeline, rows: DataFrame, k: list[int], share: list[float], lam: list[float], folds: int = 3, seed: int = 0):
    """The CrossValidatorModel over a grid of the dictionary's settings, and k, share, lam, accuracy (mean over the folds) of each."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    made = pipeline.getStages()[0]
    grid = ParamGridBuilder().addGrid(made.k, k).addGrid(made.share, share).addGrid(made.lam, lam).build()
    check = MulticlassClassificationEvaluator(labelCol="target", predictionCol="prediction", metricName="accuracy")
    fit = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=check, numFolds=folds, seed=seed, parallelism=2).fit(rows)
    found = [(int(g[made.k]), float(g[made.share]), float(g[made.lam]), float(m)) for g, m in zip(grid, fit.avgMetrics)]
    return fit, rows.sparkSession.createDataFrame(found, "k long, share double, lam double, accuracy double")
