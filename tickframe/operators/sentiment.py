"""Sentiment aggregates.

Article scores are Column expressions over whole texts; per-symbol results
are partial aggregations.  "Latest n per symbol" uses ``top_n_per_key``,
which salts the key so a symbol with a third of all articles is ranked in
many tasks, never in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions import signals as sg
from tickframe.functions import text as tx
from tickframe.operators import series
from tickframe.operators.ranking import top_n_per_key
from tickframe.operators.series import BY


def score_articles(news: DataFrame, positive=tx.POSITIVE_WORDS, negative=tx.NEGATIVE_WORDS) -> DataFrame:
    """X4 + X2: per-article 0..100 score of title + ' ' + summary."""
    d = news.withColumn("_headline", tx.headline_text(F.col("title"), F.col("summary")))
    return tx.add_polarity(d, "_headline", "sentiment_score", positive, negative).drop("_headline")


def news_sentiment(news: DataFrame, *, n: int = 20, by: str = BY, start=None, end=None,
                   positive=tx.POSITIVE_WORDS, negative=tx.NEGATIVE_WORDS) -> DataFrame:
    """Mean article score over the n most recent articles per symbol
    (optionally only articles with start <= p_date <= end), label, count."""
    if start is not None:
        news = news.filter(F.col("p_date") >= F.lit(start).cast("date"))
    if end is not None:
        news = news.filter(F.col("p_date") <= F.lit(end).cast("date"))
    recent = top_n_per_key(news, by, [F.col("p_date").desc(), F.col("guid").desc()], n)
    g = score_articles(recent, positive, negative).groupBy(by).agg(F.avg("sentiment_score").alias("score"),
                                               F.count(F.lit(1)).alias("article_count"))
    return g.withColumn("sentiment", sg.sentiment_label("score"))


def news_keyword_sentiment(news: DataFrame, *, by: str = BY) -> DataFrame:
    """A15 (training variant): mean variant-A keyword score of all articles,
    trend at ±0.1, article count."""
    s = tx.add_lexicon(news.withColumn("_headline", tx.headline_text(F.col("title"), F.col("summary"))), "_headline",
                       _s=(tx.POSITIVE_WORDS, tx.NEGATIVE_WORDS, "A"))
    g = s.groupBy(by).agg(F.avg("_s").alias("average_sentiment"), F.count(F.lit(1)).alias("news_count"))
    return g.withColumn("sentiment_trend", sg.news_trend("average_sentiment"))


def news_daily_stats(news: DataFrame, *, by: str = BY, positive=tx.POSITIVE_WORDS,
                     negative=tx.NEGATIVE_WORDS) -> DataFrame:
    """Avg and median of title / summary scores per symbol-day."""
    s = tx.add_polarity(news, "title", "st", positive, negative)
    s = tx.add_polarity(s, "summary", "ss", positive, negative)
    return s.groupBy(by, "p_date").agg(
        F.count(F.lit(1)).alias("articles"),
        F.avg("ss").alias("sentiment_summary_avg"), F.median("ss").alias("sentiment_summary_med"),
        F.avg("st").alias("sentiment_title_avg"), F.median("st").alias("sentiment_title_med"))


def news_price_daily(news: DataFrame, bars: DataFrame, *, by: str = BY, positive=tx.POSITIVE_WORDS,
                     negative=tx.NEGATIVE_WORDS) -> DataFrame:
    """Daily news stats joined to that day's bar (left join) with the
    day's % change."""
    d = news_daily_stats(news, by=by, positive=positive, negative=negative)
    p = series.prepare(bars, by, "ts")
    p = p.withColumn("change", F.try_divide(F.col("close"), series.lag("close", 1, by)) - 1.0)
    b = series.finish(p).select(by, F.col("ts").alias("p_date"), "open", "close", "high", "low", "volume", "change")
    return d.join(b, [by, "p_date"], "left")


def analyst_consensus(ratings: DataFrame, *, n: int = 20, by: str = BY) -> DataFrame:
    """The last n ratings per symbol -> mean grade score, label,
    consensus, count."""
    recent = top_n_per_key(ratings, by, [F.col("rated_on").desc(), F.col("rating_id").desc()], n)
    g = (recent.withColumn("_g", sg.grade_to_score(F.col("to_grade")))
         .groupBy(by).agg(F.avg("_g").alias("score"), F.count(F.lit(1)).alias("recommendation_count")))
    return (g.withColumn("sentiment", sg.sentiment_label("score"))
            .withColumn("consensus", sg.consensus_label("score")))


def price_reaction_sentiment(bars: DataFrame, *, by: str = BY, n: int = 5) -> DataFrame:
    """Over the last n bars: score = clamp(50 + 1000 * last 1-bar
    change), mentions = int(std of the n-1 returns * 10000), trend at ±2 %."""
    p = series.prepare(bars, by, "ts")
    w = series.win(by)
    p = p.withColumn("_prev", F.lag("close", 1).over(w))
    tail = series.finish(p, keep_index=True).filter(F.col(series.RN) >= F.col(series.N) - n)
    # returns inside the tail only: the first tail row has none
    tail = tail.withColumn("_r", F.when(F.col(series.RN) > F.col(series.N) - n,
                                        F.try_divide(F.col("close"), F.col("_prev")) - 1.0))
    g = tail.groupBy(by).agg(F.max_by("close", series.RN).alias("_c"),
                             F.max_by(F.coalesce("_prev", "close"), series.RN).alias("_p"),
                             F.stddev_samp("_r").alias("_sd"), F.count(F.lit(1)).alias("_k"))
    ch = F.when(F.col("_k") > 1, (F.col("_c") - F.col("_p")) / F.col("_p")).otherwise(F.lit(0.0))
    g = g.withColumn("price_change", ch)
    return g.select(
        by, "price_change",
        sg.clamp(F.lit(50.0) + F.col("price_change") * 1000.0).alias("score"),
        F.coalesce((F.col("_sd") * 10000.0).cast("long"), F.lit(0).cast("long")).alias("mentions"),
        F.when(F.col("price_change") > 0.02, F.lit("increasing")).when(F.col("price_change") < -0.02,
                                                                       F.lit("decreasing"))
         .otherwise(F.lit("stable")).alias("trend"))


def sentiment_blend(symbols: DataFrame, news: DataFrame, social: DataFrame, analyst: DataFrame, *,
                    by: str = BY) -> DataFrame:
    """0.4 news + 0.3 price reaction + 0.3 analyst, round 2; a missing
    part counts 50."""
    j = (symbols.select(by).distinct()
         .join(news.select(by, F.col("score").alias("_n")), by, "left")
         .join(social.select(by, F.col("score").alias("_s")), by, "left")
         .join(analyst.select(by, F.col("score").alias("_a")), by, "left"))
    s = (F.coalesce("_n", F.lit(50.0)) * 0.4 + F.coalesce("_s", F.lit(50.0)) * 0.3
         + F.coalesce("_a", F.lit(50.0)) * 0.3)
    return j.select(by, F.round(s, 2).alias("overall_sentiment_score")).withColumn(
        "sentiment_trend", sg.sentiment_trend_label("overall_sentiment_score"))


def lexicon_intensity(news: DataFrame, lexicon: DataFrame, *, by: str = BY, alpha: float = 15.0) -> DataFrame:
    """Per article, the sum of lexicon weights of its whole-word tokens
    (lower-cased, whitespace split) normalised as s / sqrt(s^2 + alpha);
    mean per symbol.  Tokens are exploded and equi-joined with the lexicon
    (a small table; Spark broadcasts it under its size threshold)."""
    text = F.lower(tx.headline_text(F.col("title"), F.col("summary")))
    toks = news.select(by, "guid", F.explode(F.split(text, tx.WS + "+")).alias("word"))
    hits = toks.join(lexicon.select(F.lower("word").alias("word"), "polarity"), "word")
    per = hits.groupBy(by, "guid").agg(F.sum("polarity").alias("_s"))
    arts = news.select(by, "guid").join(per, [by, "guid"], "left").fillna({"_s": 0.0})
    comp = F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + F.lit(alpha))
    return arts.groupBy(by).agg(F.avg(comp).alias("intensity"), F.count(F.lit(1)).alias("articles"))
