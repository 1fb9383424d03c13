"""Registered queries: text functions and sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.functions import text as tx
from tickframe.operators import sentiment as se
from tickframe.plans.catalog import query
from tickframe.plans.sqlkit import Q, rounded
from tickframe.sources import fixtures as fx
from tickframe.sources import scans

POS = [w for w, p in fx.LEXICON if p > 0]
NEG = [w for w, p in fx.LEXICON if p < 0]


def s_clean(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace({x}, '{tx.NON_WORD}', ' ', 'g'), "
            f"'{tx.WS}+', ' ', 'g'))")


def s_wc(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN 0 ELSE len(regexp_extract_all({x}, '{tx.NON_WS_RUN}')) END)"


def s_hits(x: str, words) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains(lower({x}), '{w}') THEN 1 ELSE 0 END)" for w in words) + ")"


def s_lex(x: str, pos, neg, variant: str = "A") -> str:
    raw = f"CAST({s_hits(x, pos)} - {s_hits(x, neg)} AS DOUBLE) / {s_wc(x)}"
    if variant == "A":
        val, empty = f"GREATEST(-1.0, LEAST(1.0, {raw}))", "0.0"
    else:
        val, empty = f"GREATEST(0.0, LEAST(1.0, {raw} + 0.5))", "0.5"
    return f"(CASE WHEN {x} IS NULL OR length({x}) = 0 OR {s_wc(x)} = 0 THEN {empty} ELSE {val} END)"


def s_polarity(x: str, pos=POS, neg=NEG) -> str:
    c = s_clean(x)
    return (f"(CASE WHEN {x} IS NULL OR length({c}) = 0 THEN 50.0 "
            f"ELSE GREATEST(0.0, LEAST(100.0, ({s_lex(c, pos, neg)} + 1) * 50)) END)")


HEADLINE = "(COALESCE(title, '') || ' ' || COALESCE(summary, ''))"


def _docs(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents")


@query("clean_text", Q(f"SELECT doc_id, {s_clean('text')} AS clean FROM documents"))
def q_clean_text(spark, sf_dir):
    """X3 over every document's whole text."""
    return _docs(spark, sf_dir).select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


@query("headline_text", Q(f"SELECT guid, {HEADLINE} AS headline FROM news", "news"))
def q_headline_text(spark, sf_dir):
    """Title + ' ' + summary (the whole document)."""
    return fx.news(spark, sf_dir).select("guid", tx.headline_text(F.col("title"), F.col("summary")).alias("headline"))


@query("lexicon_sentiment", Q(
    f"SELECT doc_id, {s_wc('text')} AS words, {s_lex('text', tx.POSITIVE_WORDS, tx.NEGATIVE_WORDS, 'A')} AS score_a, "
    f"{s_lex('text', tx.POSITIVE_WORDS_EXT, tx.NEGATIVE_WORDS_EXT, 'B')} AS score_b, "
    f"{s_lex('text', POS, NEG, 'A')} AS score_fixture FROM documents",
    doubles=("score_a", "score_b", "score_fixture")))
def q_lexicon_sentiment(spark, sf_dir):
    """X1 on whole documents: default lists (variant A), extended lists
    (variant B) and the fixture lexicon (variant A)."""
    scored = tx.add_lexicon(_docs(spark, sf_dir), "text", words="words", score_a=(tx.POSITIVE_WORDS, tx.NEGATIVE_WORDS, "A"),
                            score_b=(tx.POSITIVE_WORDS_EXT, tx.NEGATIVE_WORDS_EXT, "B"), score_fixture=(POS, NEG, "A"))
    return rounded(scored.select("doc_id", "words", "score_a", "score_b", "score_fixture"))


@query("polarity_score_0_100", Q(f"SELECT doc_id, {s_polarity('text')} AS score FROM documents", doubles=("score",)))
def q_polarity(spark, sf_dir):
    """X2 on whole documents with the fixture lexicon."""
    return rounded(tx.add_polarity(_docs(spark, sf_dir), "text", "score", POS, NEG).select("doc_id", "score"))


_TOP20 = """(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY p_date DESC, guid DESC) AS r
                           FROM news) WHERE r <= 20)"""


@query("news_scan", Q(f"SELECT guid, symbol, p_date FROM {_TOP20}", "news"))
def q_news_scan(spark, sf_dir):
    """The 20 most recent articles per symbol."""
    return scans.news_scan(fx.news(spark, sf_dir)).select("guid", "symbol", "p_date")


def _score_sql(src: str) -> str:
    return f"(SELECT *, {s_polarity(HEADLINE)} AS sentiment_score FROM {src})"


def _label(x: str) -> str:
    return (f"CASE WHEN {x} >= 70 THEN 'very_positive' WHEN {x} >= 60 THEN 'positive' WHEN {x} >= 40 THEN 'neutral' "
            f"WHEN {x} >= 30 THEN 'negative' ELSE 'very_negative' END")


_NEWS_SENT = f"""ns AS (SELECT symbol, AVG(sentiment_score) AS score, COUNT(*) AS article_count
       FROM {_score_sql(_TOP20)} GROUP BY symbol)"""


@query("news_sentiment", Q(f"WITH {_NEWS_SENT}\nSELECT symbol, score, article_count, {_label('score')} AS sentiment FROM ns",
                           "news", doubles=("score",)))
def q_news_sentiment(spark, sf_dir):
    """Mean score of the 20 latest articles per symbol (fixture lexicon)."""
    return rounded(se.news_sentiment(fx.news(spark, sf_dir), positive=POS, negative=NEG))


@query("news_keyword_sentiment", Q(f"""SELECT symbol, AVG(s) AS average_sentiment, COUNT(*) AS news_count,
  CASE WHEN AVG(s) > 0.1 THEN 'positive' WHEN AVG(s) < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment_trend
FROM (SELECT symbol, {s_lex(HEADLINE, tx.POSITIVE_WORDS, tx.NEGATIVE_WORDS)} AS s FROM news) GROUP BY symbol""",
                                   "news", doubles=("average_sentiment",)))
def q_news_keyword_sentiment(spark, sf_dir):
    """A15 training variant: mean keyword score of every article per symbol."""
    return rounded(se.news_keyword_sentiment(fx.news(spark, sf_dir)))


_DAILY = f"""SELECT symbol, p_date, COUNT(*) AS articles,
  AVG(ss) AS sentiment_summary_avg, MEDIAN(ss) AS sentiment_summary_med,
  AVG(st) AS sentiment_title_avg, MEDIAN(st) AS sentiment_title_med
FROM (SELECT symbol, p_date, {s_polarity('title')} AS st, {s_polarity('summary')} AS ss FROM news)
GROUP BY symbol, p_date"""
_DAILY_D = ("sentiment_summary_avg", "sentiment_summary_med", "sentiment_title_avg", "sentiment_title_med")


@query("news_daily_stats", Q(_DAILY, "news", doubles=_DAILY_D))
def q_news_daily_stats(spark, sf_dir):
    """Avg and median title / summary scores per symbol-day."""
    return rounded(se.news_daily_stats(fx.news(spark, sf_dir), positive=POS, negative=NEG))


@query("news_price_daily", Q(f"""WITH d AS ({_DAILY}),
b AS (SELECT symbol, ts AS p_date, open, close, high, low, volume,
             close / LAG(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS change FROM bars)
SELECT d.*, b.open, b.close, b.high, b.low, b.volume, b.change FROM d LEFT JOIN b USING (symbol, p_date)""",
                             "news", "bars", doubles=_DAILY_D + ("open", "close", "high", "low", "volume", "change")))
def q_news_price_daily(spark, sf_dir):
    """Daily news stats joined to that day's bar."""
    return rounded(se.news_price_daily(fx.news(spark, sf_dir), fx.bars(spark, sf_dir), positive=POS, negative=NEG))


_GRADE = ("CASE lower(trim(to_grade)) WHEN 'strong buy' THEN 80.0 WHEN 'buy' THEN 80.0 WHEN 'outperform' THEN 70.0 "
          "WHEN 'positive' THEN 70.0 WHEN 'hold' THEN 50.0 WHEN 'neutral' THEN 50.0 WHEN 'market perform' THEN 50.0 "
          "WHEN 'underperform' THEN 30.0 WHEN 'negative' THEN 30.0 WHEN 'sell' THEN 20.0 WHEN 'strong sell' THEN 20.0 "
          "ELSE 50.0 END")
_ANALYST = f"""an AS (SELECT symbol, AVG({_GRADE}) AS score, COUNT(*) AS recommendation_count
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY rated_on DESC, rating_id DESC) AS r FROM ratings)
  WHERE r <= 20 GROUP BY symbol)"""


@query("analyst_consensus", Q(f"""WITH {_ANALYST}
SELECT symbol, score, recommendation_count, {_label('score')} AS sentiment,
  CASE WHEN score >= 70 THEN 'Buy' WHEN score >= 60 THEN 'Outperform' WHEN score >= 40 THEN 'Hold'
       WHEN score >= 30 THEN 'Underperform' ELSE 'Sell' END AS consensus FROM an""", "ratings", doubles=("score",)))
def q_analyst_consensus(spark, sf_dir):
    """The 20 latest ratings per symbol -> score, label, consensus."""
    return rounded(se.analyst_consensus(fx.ratings(spark, sf_dir)))


_SOCIAL = """so AS (
  SELECT symbol,
    CASE WHEN COUNT(*) > 1 THEN (arg_max(close, rn) - arg_max(COALESCE(prev, close), rn)) / arg_max(COALESCE(prev, close), rn)
         ELSE 0.0 END AS price_change,
    COALESCE(CAST(TRUNC(STDDEV_SAMP(CASE WHEN rn > n - 5 THEN close / prev - 1 END) * 10000) AS BIGINT), 0) AS mentions
  FROM (SELECT *, LAG(close) OVER (PARTITION BY symbol ORDER BY rn) AS prev
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn,
                     COUNT(*) OVER (PARTITION BY symbol) AS n FROM bars))
  WHERE rn >= n - 5 GROUP BY symbol)"""


@query("price_reaction_sentiment", Q(f"""WITH {_SOCIAL}
SELECT symbol, price_change, GREATEST(0.0, LEAST(100.0, 50 + price_change * 1000)) AS score, mentions,
  CASE WHEN price_change > 0.02 THEN 'increasing' WHEN price_change < -0.02 THEN 'decreasing' ELSE 'stable' END AS trend
FROM so""", "bars", doubles=("price_change", "score")))
def q_price_reaction(spark, sf_dir):
    """Price-reaction sentiment from each symbol's last 5 bars."""
    return rounded(se.price_reaction_sentiment(fx.bars(spark, sf_dir)))


@query("sentiment_blend", Q(f"""WITH {_NEWS_SENT}, {_ANALYST}, {_SOCIAL},
syms AS (SELECT DISTINCT symbol FROM bars),
j AS (SELECT syms.symbol, ROUND(COALESCE(ns.score, 50) * 0.4
        + COALESCE(GREATEST(0.0, LEAST(100.0, 50 + so.price_change * 1000)), 50) * 0.3
        + COALESCE(an.score, 50) * 0.3, 2) AS overall_sentiment_score
      FROM syms LEFT JOIN ns USING (symbol) LEFT JOIN so USING (symbol) LEFT JOIN an USING (symbol))
SELECT symbol, overall_sentiment_score,
  CASE WHEN overall_sentiment_score >= 70 THEN 'bullish' WHEN overall_sentiment_score >= 60 THEN 'slightly_bullish'
       WHEN overall_sentiment_score >= 50 THEN 'neutral' WHEN overall_sentiment_score >= 40 THEN 'slightly_bearish'
       ELSE 'bearish' END AS sentiment_trend FROM j""", "bars", "news", "ratings",
                            doubles=("overall_sentiment_score",)))
def q_sentiment_blend(spark, sf_dir):
    """0.4 news + 0.3 price reaction + 0.3 analyst per bar symbol."""
    bars = fx.bars(spark, sf_dir)
    return rounded(se.sentiment_blend(bars, se.news_sentiment(fx.news(spark, sf_dir), positive=POS, negative=NEG),
                                      se.price_reaction_sentiment(bars),
                                      se.analyst_consensus(fx.ratings(spark, sf_dir))))


@query("lexicon_intensity", Q(f"""WITH toks AS (
  SELECT symbol, guid, unnest(string_split_regex(lower({HEADLINE}), '{tx.WS}+')) AS word FROM news),
per AS (SELECT symbol, guid, SUM(polarity) AS s FROM toks JOIN lexicon USING (word) GROUP BY symbol, guid),
arts AS (SELECT n.symbol, n.guid, COALESCE(per.s, 0.0) AS s FROM news n LEFT JOIN per USING (symbol, guid))
SELECT symbol, AVG(s / SQRT(s * s + 15.0)) AS intensity, COUNT(*) AS articles FROM arts GROUP BY symbol""",
                              "news", "lexicon", doubles=("intensity",)))
def q_lexicon_intensity(spark, sf_dir):
    """Weighted whole-word lexicon intensity per article, mean per symbol."""
    return rounded(se.lexicon_intensity(fx.news(spark, sf_dir), fx.lexicon(spark)))
