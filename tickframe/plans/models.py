"""Feature tables and learners.

Feature tables are one series layout plus joins; learners are MLlib
estimators in a Pipeline (distributed training, no driver-side data).
The per-symbol linear forecast (M14) is fitted from per-symbol sufficient
statistics (X'X, X'y), summed per Arrow batch and then joined, and each
symbol's small normal equation is solved in an Arrow batch (mapInPandas over
one row per symbol), so no symbol's rows are ever gathered into one task.
"""

from __future__ import annotations

import sys
from multiprocessing.pool import ThreadPool

from pyspark import cloudpickle, inheritable_thread_target
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions import scores as sc
from tickframe.functions import signals as sg
from tickframe.operators import align, clean
from tickframe.operators import indicators as ind
from tickframe.operators import series
from tickframe.operators import stats as st
from tickframe.operators.series import BY, N, RN

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

# Fixed lists: the features of the five learners.
PRICE_FEATURES = ["sma_20", "sma_50", "rsi", "macd", "volatility", "price_change_1d", "price_change_7d", "price_change_30d",
                  "volume_ratio", "market_cap", "pe_ratio", "beta", "sentiment_score"]
TREND_FEATURES = ["sma_20", "sma_50", "rsi", "macd", "volatility", "price_change_1d", "price_change_7d", "volume_ratio",
                  "sentiment_score", "trend_strength"]
RISK_FEATURES = ["volatility", "beta", "debt_to_equity", "current_ratio", "price_change_30d", "volume_ratio", "market_cap",
                 "pe_ratio", "sentiment_score"]
SENTIMENT_FEATURES = ["price_momentum_1d", "price_momentum_7d", "price_momentum_30d", "volume_surge", "volatility_level",
                      "trend_strength"]
FUND_FEATURES = ["pe_ratio", "forward_pe", "peg_ratio", "price_to_book", "price_to_sales", "debt_to_equity", "current_ratio",
                 "gross_margin", "operating_margin", "profit_margin", "return_on_equity", "return_on_assets", "revenue_growth",
                 "earnings_growth", "dividend_yield", "beta", "free_cashflow", "total_cash", "total_debt", "book_value"]
BILLIONS = ["market_cap", "free_cashflow", "total_cash", "total_debt"]


def feature_table(bars: DataFrame, fundamentals: DataFrame, *, by: str = BY, start: int = 50,
                  tail: int = 30, keep_latest: bool = False) -> DataFrame:
    """M1: pooled samples over all symbols: indicators + fundamentals (J4) +
    per-row price sentiment (W29) + targets (forward 30-row return, 7-row
    direction, forward 30-row price std); rows with index in [start, n-tail)
    (W43), or also each symbol's latest row when ``keep_latest``.  Money
    columns of ``fundamentals`` are scaled to billions (P8); missing features
    are 0 (a missing volume ratio 1)."""
    p = series.prepare(bars, by, "ts")
    for n in (20, 50):
        p = ind.sma(p, n, by=by)
    p = ind.macd(ind.rsi_sma(p, 14, by=by), by=by)
    p = ind.price_std_prior(ind.volume_ratio_prior(p, 20, by=by), 20, by=by)
    for k in (1, 7, 30):
        p = ind.momentum(p, k, by=by)
    p = ind.volume_sma(ind.relative_volatility(p, 20, by=by), 20, by=by)
    p = ind.trend_zscore(ind.sentiment_from_price(p, by=by), 50, by=by)
    p = ind.forward_return(ind.forward_return(p, 30, by=by), 7, by=by)
    p = ind.forward_price_std(p, 30, by=by)
    keep = (F.col(RN) >= start) & (F.col(RN) < F.col(N) - tail)
    if keep_latest:
        keep = keep | (F.col(RN) == F.col(N) - 1)
    rows = series.finish(p.filter(keep), keep_index=True)
    named = {"rsi": "rsi_14", "volatility": "price_std_prior_20", "price_change_1d": "momentum_1", "price_change_7d": "momentum_7",
             "price_change_30d": "momentum_30", "price_momentum_1d": "momentum_1", "price_momentum_7d": "momentum_7",
             "price_momentum_30d": "momentum_30", "volume_surge": "volume_ratio_20", "volatility_level": "relative_volatility_20",
             "trend_strength": "trend_zscore_50", "sentiment_score": "price_sentiment"}
    rows = rows.withColumns({k: F.col(c) for k, c in named.items()} | {
        "volume_ratio": F.coalesce("volume_ratio_prior_20", F.lit(1.0)), "is_latest": F.col(RN) == F.col(N) - 1,
        "target_trend": F.when(F.col("fwd_return_7") > 0, 1.0).otherwise(0.0)})
    money = [c for c in BILLIONS if c in fundamentals.columns]
    dim = fundamentals.select(by, *[(F.col(c) / 1e9 if c in money else F.col(c)).alias(c) for c in fundamentals.columns if c != by])
    rows = align.attach_fundamentals(rows, dim, on=by)
    feats = [c for c in dict.fromkeys([*PRICE_FEATURES, *TREND_FEATURES, *RISK_FEATURES, *SENTIMENT_FEATURES, *FUND_FEATURES])
             if c in rows.columns]
    rows = clean.replace_inf(clean.fill_default(rows, {c: 0.0 for c in feats}), columns=feats)
    return rows.select(by, "ts", "close", "is_latest", *feats, "fwd_return_30", "fwd_return_7", "fwd_price_std_30", "target_trend")


class Identity(Transformer):
    """A last pipeline stage that learns nothing: the scaled features alone (M3)."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset


def _pipe(features, learner, *, scaler: str | None = "standard"):
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep")]
    if scaler == "standard":
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    elif scaler == "minmax":
        stages.append(MinMaxScaler(inputCol="_raw", outputCol="features"))
    else:
        stages[0].setOutputCol("features")
    stages.append(learner)
    return Pipeline(stages=stages)


#: Samples that a partition may hold where partitions are joined, and partitions a core that are left as they are.
PART_ROWS, PARTS = 1 << 20, 4


def in_few_parts(t: DataFrame, n: int) -> DataFrame:
    """The ``n`` stored samples, where they lie in more than ``PARTS`` partitions a core,
    in one partition a core (more, where ``PART_ROWS`` asks for it): MLlib's trees
    shuffle a level's histograms once per partition.  Others stay as they are, as
    the draws of MLlib's trees depend on the partitions."""
    cores = t.sparkSession.sparkContext.defaultParallelism
    return t.coalesce(max(cores, -(-n // PART_ROWS))) if t.rdd.getNumPartitions() > PARTS * cores else t


def fit_models(train: DataFrame, *, seed: int = 42, trees: int = 100, risk_trees: int = 50, depth: int = 10,
               rounds: int = 100) -> dict:
    """M4-M8: price (forest on the 30-row forward return), trend (boosting on
    the 7-row direction), risk (forest on the forward price std), sentiment
    (OLS on the price sentiment), fundamental (ridge alpha=1 on the forward
    return; Spark's penalty is scaled as SURVEY Q26), each on min-max scaled
    features.  Missing targets are 0.  The samples are kept while fitting.  The
    learners are fitted side by side: boosting is a long chain of short jobs."""
    have = lambda names: [c for c in names if c in train.columns]
    t = train.fillna(0.0, ["fwd_return_30", "fwd_return_7", "fwd_price_std_30"]).persist()
    n = t.count()
    sd = t.agg(F.stddev_pop("fwd_return_30")).first()[0] or 1.0
    forest = lambda y, c, k: RandomForestRegressor(labelCol=y, predictionCol=c, numTrees=k, maxDepth=depth, seed=seed)
    learners = {
        "price": (PRICE_FEATURES, forest("fwd_return_30", "pred_price", trees)),
        "trend": (TREND_FEATURES, GBTRegressor(labelCol="target_trend", predictionCol="pred_trend", maxIter=rounds, maxDepth=3,
                                               stepSize=0.1, seed=seed)),
        "risk": (RISK_FEATURES, forest("fwd_price_std_30", "pred_risk", risk_trees)),
        "sentiment": (SENTIMENT_FEATURES, LinearRegression(labelCol="sentiment_score", predictionCol="pred_sentiment", solver="normal")),
        "fundamental": (FUND_FEATURES, LinearRegression(labelCol="fwd_return_30", predictionCol="pred_fundamental", elasticNetParam=0.0,
                                                        standardization=False, regParam=1.0 * sd / max(n, 1), solver="normal")),
    }
    few = in_few_parts(t, n)
    fit = inheritable_thread_target(t.sparkSession)(lambda f, m: _pipe(have(f), m, scaler="minmax").fit(few))
    with ThreadPool(len(learners)) as pool:
        models = pool.starmap(fit, learners.values())
    t.unpersist()
    return dict(zip(learners, models))


def score_latest(models: dict, latest: DataFrame, *, by: str = BY, relative_risk: bool = False) -> DataFrame:
    """Apply the five models to each symbol's latest feature row and score
    the predictions."""
    out = latest
    for m in models.values():
        out = m.transform(out).drop("_raw", "features")
    return score_predictions(out, by=by, relative_risk=relative_risk)


def persistence_predictions(bars: DataFrame, fundamentals: DataFrame, *, by: str = BY) -> DataFrame:
    """The five predictions of a forecaster that expects what was: the last 30-row
    return, the share of rising closes and the deviation of the close among the
    last 20 rows, a mood from the last 7-row return, the revenue growth."""
    back = lambda k: F.max(F.when(F.col(RN) == F.col(N) - 1 - k, F.col("close")))
    late = lambda x: F.when(F.col(RN) >= F.col(N) - 20, x)
    g = st.with_returns(bars, by=by).groupBy(by).agg(
        F.max("ts").alias("ts"), back(0).alias("close"), (back(0) / back(30) - 1.0).alias("pred_price"),
        F.avg(late(F.when(F.col("ret") > 0, 1.0).otherwise(0.0))).alias("pred_trend"), F.stddev_samp(late(F.col("close"))).alias("pred_risk"),
        (F.lit(50.0) + (back(0) / back(7) - 1.0) * 500.0).alias("pred_sentiment"))
    return g.join(fundamentals.select(by, F.col("revenue_growth").alias("pred_fundamental")), by)


def score_predictions(out: DataFrame, *, by: str = BY, relative_risk: bool = False) -> DataFrame:
    """A22 + X11-X15: scores, labels and the model score of given predictions.

    The price part is 50 + 1000 * return, the trend part the strength of the
    bucket, the risk part the clamped prediction * 100; ``relative_risk``
    divides the predicted price deviation by the price first (SURVEY Q18)."""
    price_score = F.lit(50.0) + F.col("pred_price") * 1000.0
    trend_score = sg.trend_bucket_strength("pred_trend") * 100.0
    risk_score = sg.clamp(F.col("pred_risk") / (F.col("close") if relative_risk else F.lit(1.0)) * 100.0)
    sent_score = sg.clamp(F.col("pred_sentiment"))
    fund_score = sg.fundamental_points(F.col("pred_fundamental"))
    out = out.select(by, "ts", "close", "pred_price", "pred_trend", "pred_risk", "pred_sentiment", "pred_fundamental",
                     price_score.alias("price_score"), trend_score.alias("trend_score"),
                     risk_score.alias("risk_score"), sent_score.alias("sentiment_score"),
                     fund_score.alias("fundamental_score"))
    out = out.withColumn("model_score", sc.model_score("price_score", "trend_score", "risk_score",
                                                       "sentiment_score", "fundamental_score"))
    conf = (sg.confidence("pred_price", 10.0) + sg.confidence("pred_trend", 2.0, 0.5)
            + sg.confidence(F.col("pred_risk") / F.col("close"), 5.0, 0.2)) / 3.0
    return out.select("*", sg.price_direction("pred_price").alias("price_direction"),
                      sg.trend_bucket("pred_trend").alias("trend_direction"),
                      sg.risk_level("risk_score").alias("risk_level"),
                      sg.sentiment_label("sentiment_score", strict=True).alias("sentiment"),
                      sg.letter_grade("fundamental_score").alias("grade"),
                      conf.alias("confidence"),
                      sg.recommendation("model_score", model=True).alias("recommendation"))


def prediction_report(out: DataFrame, *, by: str = BY, relative_risk: bool = False) -> DataFrame:
    """One row per symbol with five structs (price, trend, risk, sentiment,
    fundamental), each with its own confidence, and the overall score and advice.
    Missing predictions leave nulls in their struct."""
    s = score_predictions(out, by=by, relative_risk=relative_risk)
    spread = F.col("pred_risk") / F.col("close")
    return s.select(
        by, "ts",
        F.struct(F.col("close").alias("current_price"), (F.col("close") * (F.col("pred_price") + 1.0)).alias("predicted_price"),
                 F.col("pred_price").alias("expected_return"), F.col("price_direction").alias("direction"),
                 sg.confidence("pred_price", 10.0).alias("confidence")).alias("price"),
        F.struct(F.col("trend_direction").alias("direction"), sg.trend_bucket_strength("pred_trend").alias("strength"),
                 F.col("pred_trend").alias("probability"), sg.confidence("pred_trend", 2.0, 0.5).alias("confidence")).alias("trend"),
        F.struct("risk_level", "risk_score", spread.alias("predicted_volatility"), sg.confidence(spread, 5.0, 0.2).alias("confidence")).alias("risk"),
        F.struct("sentiment", F.col("sentiment_score").alias("score"), sg.confidence("sentiment_score", 0.02, 50.0).alias("confidence")).alias("sentiment"),
        F.struct(F.col("fundamental_score").alias("score"), "grade", F.col("pred_fundamental").alias("expected_return"),
                 sg.confidence("pred_fundamental", 5.0).alias("confidence")).alias("fundamental"),
        "model_score", "recommendation")


def regression_metrics(pred: DataFrame, *, label: str, prediction: str = "prediction") -> dict:
    """A36 via MLlib's evaluator (also available as a DataFrame: stats.regression_metrics)."""
    ev = RegressionEvaluator(labelCol=label, predictionCol=prediction)
    return {m: ev.setMetricName(m).evaluate(pred) for m in ("mse", "mae", "r2")}


def feature_importance(model, features, spark) -> DataFrame:
    """Forest importances joined to the feature names."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(features, imp)), "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature")


#: Fixed lists: features of the short form and of the all-feature form.
LINEAR_FEATURES = ["sma_20", "sma_50", "rsi_wilder_14", "macd_rec_diff", "close_ma_5", "close_ma_10"]
ALL_LINEAR_FEATURES = ["sma_20", "sma_50", "ema_rec_12", "ema_rec_26", "macd_rec_diff", "macd_rec_signal", "rsi_wilder_14",
                       "bbp_upper_20", "bbp_lower_20", "bbp_mid_20", "close_lag_1", "close_lag_2", "close_lag_3", "close_lag_5",
                       "close_lag_10", "volume_lag_1", "volume_lag_2", "volume_lag_3", "volume_lag_5", "volume_lag_10",
                       "close_ma_5", "volume_ma_5", "close_std_5", "close_ma_10", "volume_ma_10", "close_std_10",
                       "close_ma_20", "volume_ma_20", "close_std_20", "price_to_ma20", "volume_to_ma20"]


def linear_features(bars: DataFrame, *, by: str = BY) -> DataFrame:
    """The bars with every feature of M14, rows without a missing one."""
    p = series.prepare(bars, by, "ts")
    for n in (20, 50):
        p = ind.sma(p, n, by=by)
    p = ind.ema_recursive(ind.ema_recursive(p, 12, by=by), 26, by=by)
    p = ind.bollinger_pop(ind.rsi_wilder(ind.macd_recursive(p, by=by), 14, by=by), 20, by=by)
    p = ind.lag_features(p, by=by)
    p = ind.rolling_features(p, (5, 10, 20), by=by)
    return clean.drop_incomplete(series.finish(p, keep_index=True), columns=ALL_LINEAR_FEATURES)


def _sums(names):
    """One row per key and Arrow batch: rows, means and centred sums of products
    (upper triangle) of the columns, and the latest row's values."""
    def run(batches):
        import numpy
        import pyarrow

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            code, rn = coded.indices.to_numpy(), batch.column(1).to_numpy()
            values = numpy.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], 1)
            order = numpy.lexsort((rn, code))
            code, values, rn = code[order], values[order], rn[order]
            first = numpy.flatnonzero(numpy.append(True, code[1:] != code[:-1]))
            out = []
            for lo, hi in zip(first, numpy.append(first[1:], len(code))):
                x = values[lo:hi]
                mean = x.mean(0)
                gram = (x - mean).T @ (x - mean)
                out.append((int(hi - lo), mean, gram[numpy.triu_indices(len(mean))], int(rn[hi - 1]), x[-1]))
            n, mean, half, last, latest = zip(*out)
            listed = lambda v: pyarrow.array([a.tolist() for a in v], pyarrow.list_(pyarrow.float64()))
            yield pyarrow.RecordBatch.from_arrays(
                [coded.dictionary.take(pyarrow.array(code[first])), pyarrow.array(n, pyarrow.int64()), listed(mean), listed(half),
                 pyarrow.array(last, pyarrow.int64()), listed(latest)], names=[names[0], "n", "mean", "half", "last", "x_last"])
    return run


def _joined(name):
    """The rows of one key joined into one: mean and centred sums of all its rows."""
    def run(table):
        import numpy
        import pyarrow

        n, mean = table.column("n").to_numpy(), numpy.stack(table.column("mean").to_pylist())
        half = numpy.stack(table.column("half").to_pylist())
        total, at = n.sum(), int(numpy.argmax(table.column("last").to_numpy()))
        middle = (n[:, None] * mean).sum(0) / total
        gap = mean - middle
        sums = half.sum(0) + ((gap * n[:, None]).T @ gap)[numpy.triu_indices(len(middle))]
        kind = pyarrow.list_(pyarrow.float64())
        return pyarrow.table({name: table.column(name).slice(0, 1), "n": pyarrow.array([int(total)], pyarrow.int64()),
                              "mean": pyarrow.array([middle.tolist()], kind), "half": pyarrow.array([sums.tolist()], kind),
                              "x_last": pyarrow.array([table.column("x_last")[at].as_py()], kind)})
    return run


def linear_moments(bars: DataFrame, *, features=ALL_LINEAR_FEATURES, by: str = BY) -> DataFrame:
    """(by, n, mean, half, x_last) per symbol over ``features`` and the close, from
    one reading of the features: an Arrow batch gives one row per symbol in it,
    and a symbol's rows are joined (means apart, so large prices do not cancel)."""
    names = [*features, "close"]
    rows = linear_features(bars, by=by).filter(F.col(by).isNotNull()).select(by, RN, *[F.col(c).cast("double").alias(c) for c in names])
    kind = rows.schema[by].dataType.simpleString()
    arrays = "mean array<double>, half array<double>"
    parts = rows.mapInArrow(_sums([by, *names]), f"{by} {kind}, n bigint, {arrays}, last bigint, x_last array<double>")
    return parts.groupBy(by).applyInArrow(_joined(by), f"{by} {kind}, n bigint, {arrays}, x_last array<double>")


def _solver(by, at, size):
    """Least squares of each symbol's centred normal equations, in unit scale:
    columns ``at`` of ``size`` are the features, the last one is the close."""
    def solve(batches):
        import numpy
        import pandas

        for pdf in batches:
            if not len(pdf):
                continue
            n, mean = pdf["n"].to_numpy(float), numpy.stack(pdf["mean"])
            full = numpy.zeros((len(pdf), size, size))
            i, j = numpy.triu_indices(size)
            full[:, i, j] = full[:, j, i] = numpy.stack(pdf["half"])
            xx = full[:, at][:, :, at] / n[:, None, None]
            xy = full[:, at, -1] / n[:, None]
            scale = numpy.sqrt(numpy.maximum(numpy.diagonal(xx, axis1=1, axis2=2), 1e-300))
            inverse = numpy.linalg.pinv(xx / (scale[:, :, None] * scale[:, None, :]), rcond=1e-12, hermitian=True)
            w = (inverse @ (xy / scale)[:, :, None])[:, :, 0] / scale
            last = numpy.stack(pdf["x_last"])[:, at]
            yield pandas.DataFrame({by: pdf[by], "intercept": mean[:, -1] - (w * mean[:, at]).sum(1), "_wx": (w * last).sum(1)})
    return solve


def forecast_linear(bars: DataFrame, days: int = 30, *, decay: float = 0.99, features=LINEAR_FEATURES, by: str = BY,
                    moments: DataFrame | None = None) -> DataFrame:
    """Per-symbol OLS of close on ``features``; path
    y_k = b + decay^(k-1) * (w . x_last).  The short form takes six features
    and decay 0.99, the long form all features and 0.995.

    Each symbol's small system is solved in an Arrow batch over one row per
    symbol.  ``moments`` (``linear_moments`` of all features) serves several forms."""
    names = list(features) if moments is None else ALL_LINEAR_FEATURES
    stats = linear_moments(bars, features=names, by=by) if moments is None else moments
    kind = stats.schema[by].dataType.simpleString()
    j = stats.mapInPandas(_solver(by, [names.index(c) for c in features], len(names) + 1), f"{by} {kind}, intercept double, _wx double")
    h = align.horizon_cross(j, n=days)
    return h.select(by, "day", (F.col("intercept") + F.pow(F.lit(decay), F.col("day") - 1) * F.col("_wx"))
                    .alias("predicted"))


def forecast_ensemble(paths: list, *, by: str = BY) -> DataFrame:
    """0.4 / 0.3 / 0.3 blend of the six-feature linear, drift and
    all-feature linear path (by (symbol, day)); ``paths`` is a list of
    (weight, DataFrame(symbol, day, predicted))."""
    out, expr = None, None
    for i, (w, df) in enumerate(paths):
        d = df.select(by, "day", F.col("predicted").alias(f"_p{i}"))
        out = d if out is None else out.join(d, [by, "day"])
        term = F.col(f"_p{i}") * w
        expr = term if expr is None else expr + term
    return out.select(by, "day", expr.alias("predicted"))


def trend_probability(bars: DataFrame, *, seed: int = 42, by: str = BY) -> DataFrame:
    """Forest on next-bar direction from bar shape and MA ratios, pooled
    over symbols; the latest row's probability -> label (X14)."""
    p = series.prepare(bars, by, "ts")
    p = ind.bar_shape(p, by=by)
    for n in (5, 10, 20, 50):
        p = ind.ma_ratio(p, n, by=by)
    p = ind.forward_direction(p, by=by)
    rows = series.finish(p, keep_index=True)  # warm-up rows drop out below, as in the reference
    feats = ["high_low_ratio", "close_open_ratio", "price_change", "volume_change", "ma_ratio_5", "ma_ratio_10",
             "ma_ratio_20", "ma_ratio_50"]
    rows = clean.replace_inf(clean.drop_incomplete(rows, columns=feats), columns=feats)
    train = rows.filter(F.col(RN) < F.col(N) - 1).withColumn("label", F.col("fwd_direction").cast("double"))
    m = _pipe(feats, RandomForestRegressor(labelCol="label", predictionCol="probability_up", numTrees=100,
                                           seed=seed)).fit(train)
    last = m.transform(rows.filter(F.col(RN) == F.col(N) - 1)).select(by, "probability_up")
    return last.select(by, "probability_up", sg.prob_direction("probability_up").alias("direction"),
                       sg.prob_confidence("probability_up").alias("confidence"))


def wide_feature_table(bars: DataFrame, fundamentals: DataFrame, news: DataFrame, macro: DataFrame, *, by: str = BY) -> DataFrame:
    """M2: every indicator of the library per bar, with fundamentals (J4), news
    sentiment (J5) and the slow macro value at the bar's date (J3); targets
    next return, next direction and next 5-row volatility.  Missing and
    non-finite features are 0 (P5, P6).  The other tables join the bars ahead
    of the indicators, so only narrow rows travel and are sorted."""
    given = align.asof_value(bars, macro, value="cpi", by=by)
    given = align.packed(align.packed(given, fundamentals, "_fund", on=by), news.select(by, *align.SENTIMENT_DEFAULTS), "_news", on=by)
    p = align.value_change(series.prepare(given, by, "ts"), "cpi", by=by)
    for n in (5, 10, 20, 50, 100, 200):
        p = ind.sma(p, n, by=by)
    for n in (5, 10, 12, 20, 26, 50):
        p = ind.ema_adjusted(p, n, by=by)
    p = ind.macd(p, by=by)
    for n in (7, 14, 21):
        p = ind.rsi_sma(p, n, by=by)
    p = ind.bb_width(ind.bb_position(ind.bollinger(p, 20, by=by)))
    p = ind.williams_r(ind.stochastic(p, by=by), by=by)
    p = ind.obv(ind.atr(p, by=by), by=by)
    for k in (1, 5, 10, 20):
        p = ind.momentum(p, k, by=by)
    for n in (5, 10, 20):
        p = ind.rolling_volatility(p, n, by=by)
    p = ind.volume_sma(ind.bar_shape(p, by=by), by=by)
    p = ind.forward_direction(ind.forward_return(p, 1, by=by), by=by)
    rows = align.unpacked(align.unpacked(series.finish(p), "_fund"), "_news")
    rows = rows.fillna(align.fundamental_defaults(fundamentals, by) | align.SENTIMENT_DEFAULTS)
    numeric = [f.name for f in rows.schema if f.dataType.typeName() == "double"]
    return clean.replace_inf(clean.fill_default(rows, {c: 0.0 for c in numeric}), columns=numeric)
