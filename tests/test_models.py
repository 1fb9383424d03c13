"""Pooled MLlib learners: samples as they are stored for them, fitted side by side."""

import threading

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tickframe.plans import models as ml


def _partitions(df):
    return df.rdd.getNumPartitions()


def _samples(spark, rows=400):
    feats = dict.fromkeys([*ml.PRICE_FEATURES, *ml.TREND_FEATURES, *ml.RISK_FEATURES, *ml.SENTIMENT_FEATURES, *ml.FUND_FEATURES])
    x = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0
    labels = {"fwd_return_30": x(90) + x(0), "fwd_price_std_30": x(91) + x(1), "target_trend": F.round(x(92)), "fwd_return_7": x(93)}
    return spark.range(rows).select("id", *[x(i).alias(c) for i, c in enumerate(feats)], *[e.alias(c) for c, e in labels.items()])


def test_learners_get_few_partitions(spark):
    """One histogram a partition travels at every level of MLlib's trees."""
    cores = spark.sparkContext.defaultParallelism
    samples = _samples(spark)
    many, few = samples.repartition(25 * cores), samples.repartition(3 * cores)
    assert _partitions(ml.in_few_parts(many, 400)) == cores and _partitions(ml.in_few_parts(few, 400)) == 3 * cores
    assert _partitions(ml.in_few_parts(many, 3 * cores * ml.PART_ROWS)) == 3 * cores
    assert sorted(ml.in_few_parts(many, 400).collect()) == sorted(samples.collect())


def test_learners_fit_side_by_side_with_the_models_of_one_after_another(spark, monkeypatch):
    train, found, fit = _samples(spark).repartition(2).persist(), {}, Pipeline.fit
    small = {"trees": 3, "risk_trees": 2, "depth": 3, "rounds": 2}
    together = threading.Barrier(5)

    def meet(self, df, params=None):
        together.wait(60)  # breaks unless all five are being fitted
        found[type(self.getStages()[-1]).__name__, self.getStages()[-1].getLabelCol()] = self
        return fit(self, df, params)

    monkeypatch.setattr(Pipeline, "fit", meet)
    models = ml.fit_models(train, **small)
    assert list(models) == ["price", "trend", "risk", "sentiment", "fundamental"] and len(found) == 5
    latest = train.limit(20)
    for m in models.values():
        learner = m.stages[-1]
        own = found[next(k for k in found if learner.__class__.__name__.startswith(k[0].replace("Regressor", "").replace("Regression", ""))
                         and k[1] == learner.getLabelCol())]
        alone, column = fit(own, train.fillna(0.0, ["fwd_return_30", "fwd_return_7", "fwd_price_std_30"])), learner.getPredictionCol()
        assert [r[0] for r in m.transform(latest).select(column).collect()] == [r[0] for r in alone.transform(latest).select(column).collect()]
