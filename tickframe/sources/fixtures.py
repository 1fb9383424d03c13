"""Stand-in inputs derived from the driver tables (FIXTURES.md section B).

These builders only reshape the TPC-H-ish tables into the schemas the
operators expect (bars, index series, sectors, fundamentals, news, ratings,
macro, ticks).  They do none of the operators' work.  Each builder has a SQL
twin in ``FIXTURE_SQL`` that the DuckDB oracle uses; the two must stay
equivalent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.functions.fundamentals import INFO_FIELDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars(symbol BIGINT, ts DATE, open, high, low, close, volume DOUBLE).

    One bar per (supplier, ship day).  Open/close are the first/last line in a
    fixed total order; ``min_by``/``max_by`` keep this a partial aggregation,
    so a hot supplier-day is combined map-side instead of landing in one task.
    """
    li = table(spark, sf_dir, "lineitem")
    order_key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return (li.select(F.col("l_suppkey").alias("symbol"),
                      F.to_date("l_shipdate").alias("ts"),
                      "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
            .withColumn("_k", order_key)
            .groupBy("symbol", "ts")
            .agg(F.min_by("l_extendedprice", "_k").alias("open"),
                 F.max("l_extendedprice").alias("high"),
                 F.min("l_extendedprice").alias("low"),
                 F.max_by("l_extendedprice", "_k").alias("close"),
                 F.sum("l_quantity").alias("volume")))


def market_index(spark: SparkSession, sf_dir: str, bars_df: DataFrame | None = None) -> DataFrame:
    """market_index(ts DATE, close, volume DOUBLE): volume-weighted close per day."""
    b = bars_df if bars_df is not None else bars(spark, sf_dir)
    return (b.groupBy("ts")
            .agg((F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("close"),
                 F.sum("volume").alias("volume")))


def index_bars(spark: SparkSession, sf_dir: str, bars_df: DataFrame | None = None) -> DataFrame:
    """The market index as a bar series with a constant symbol (-1), so that
    every per-symbol operator also runs on it (SURVEY section 4, point 3)."""
    m = market_index(spark, sf_dir, bars_df)
    return m.select(F.lit(-1).cast("bigint").alias("symbol"), "ts",
                    F.col("close").alias("open"), F.col("close").alias("high"),
                    F.col("close").alias("low"), "close", "volume")


def sector_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("sector"),
                    F.col("n_name").alias("industry")))


def _d(x) -> Column:
    return F.lit(x).cast("double")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("symbol"),
        F.when(k % 7 == 0, F.lit(None).cast("double"))
         .otherwise((5 + (k * 13) % 40).cast("double")).alias("trailing_pe"),
        (F.col("s_acctbal").cast("double") / _d(20000)).alias("profit_margin"),
        (((k * 7) % 50).cast("double") / _d(100) - _d(0.2)).alias("revenue_growth"),
        (((k * 11) % 30).cast("double") / _d(20)).alias("debt_to_equity"),
        ((5 + k % 25).cast("double") / _d(10)).alias("current_ratio"),
        ((3 + k % 18).cast("double") / _d(10)).alias("beta"),
        (_d(1000000000) * (1 + (k * 17) % 500).cast("double")).alias("market_cap"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """news(guid, symbol, title, summary, p_date).

    The title is the first 80 characters; the summary is the *whole* rest of
    the document, so title + ' ' + summary covers the full text.
    """
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("guid"),
        (F.substring("source", 4, 1 << 20).cast("int") % 10).alias("symbol"),
        F.expr("substr(text, 1, 80)").alias("title"),
        F.expr("substr(text, 81)").alias("summary"),
        F.expr("date_add(DATE'1995-01-02', CAST(doc_id % 2500 AS INT))").alias("p_date"))


GRADE_CASE = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'Strong Buy' WHEN '2-HIGH' THEN 'Outperform' "
              "WHEN '3-MEDIUM' THEN 'Hold' WHEN '4-NOT SPECIFIED' THEN 'Underperform' ELSE 'Sell' END")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ratings(symbol, rating_id, firm, rated_on, to_grade).  Both sides are dealt to
    a fixed number of partitions: a task sorts and hashes all its rows, which take
    many times the shuffled bytes that adaptive execution joins partitions by."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    o = table(spark, sf_dir, "orders").repartition(n, "o_orderkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").repartition(n, "l_orderkey")
    return (o.join(li, li.l_orderkey == o.o_orderkey)
            .select(F.col("l_suppkey").alias("symbol"), F.col("o_orderkey").alias("rating_id"),
                    F.col("o_custkey").alias("firm"), F.to_date("o_orderdate").alias("rated_on"),
                    F.expr(GRADE_CASE).alias("to_grade"))
            .distinct())


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """macro(ts first of month, cpi): the slow series for the as-of join."""
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("ts"))
            .agg(F.avg("o_totalprice").alias("cpi")))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticks(symbol STRING, ts TIMESTAMP, price, volume DOUBLE, user_id, event_id)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
                    F.col("value").alias("price"), F.lit(1.0).alias("volume"), "user_id", "event_id")


def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as a long, intraday bar series (5 symbols, thousands of rows
    each): the input for tests of the blocked layout and for streaming."""
    t = ticks(spark, sf_dir)
    return t.select(F.col("symbol"), F.col("ts"), F.col("price").alias("open"),
                    F.col("price").alias("high"), F.col("price").alias("low"),
                    F.col("price").alias("close"), "volume", "event_id")


# ---------------------------------------------------------------- inline fixtures
# Fixed values from FIXTURES.md (identical literals on both engines).
PORTFOLIO = [(0, 0.30), (1, 0.25), (2, 0.20), (3, 0.15), (4, 0.10)]
LEXICON = [("with", 1.0), ("the", 1.0), ("est", 1.0), ("and", -1.0), ("une", -1.0), ("der", -1.0)]
HORIZONS = [7, 14, 21, 30]
MACRO_LEVELS = [("VIX", 32.0), ("RATE", 4.2), ("DOLLAR", 101.0)]


def portfolio(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PORTFOLIO, "symbol bigint, weight double")


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "word string, polarity double")


def horizons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in HORIZONS], "day int")


def macro_levels(spark: SparkSession, levels=MACRO_LEVELS) -> DataFrame:
    return spark.createDataFrame(list(levels), "series string, value double")


# ---------------------------------------------------------------- SQL twins
def _lit(v, typ: str) -> str:
    return f"CAST({v!r} AS {typ})" if not isinstance(v, str) else f"CAST('{v}' AS {typ})"


def _values(rows, cols, types) -> str:
    body = ", ".join("(" + ", ".join(_lit(v, t) for v, t in zip(r, types)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


FIXTURE_SQL = {
    "bars": """
SELECT symbol, ts,
       MAX(CASE WHEN rn = 1 THEN px END) AS open, MAX(px) AS high, MIN(px) AS low,
       MAX(CASE WHEN rn = n THEN px END) AS close, SUM(qty) AS volume
FROM (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ts, l_extendedprice AS px, l_quantity AS qty,
             ROW_NUMBER() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
                                ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS rn,
             COUNT(*) OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)) AS n
      FROM lineitem) t
GROUP BY symbol, ts""",
    "market_index": """
SELECT ts, SUM(close * volume) / SUM(volume) AS close, SUM(volume) AS volume FROM bars GROUP BY ts""",
    "index_bars": """
SELECT CAST(-1 AS BIGINT) AS symbol, ts, close AS open, close AS high, close AS low, close, volume
FROM market_index""",
    "sector_members": """
SELECT s_suppkey AS symbol, r_name AS sector, n_name AS industry
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "fundamentals": """
SELECT s_suppkey AS symbol,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(5 + (s_suppkey * 13) % 40 AS DOUBLE) END AS trailing_pe,
       CAST(s_acctbal AS DOUBLE) / CAST(20000 AS DOUBLE) AS profit_margin,
       CAST((s_suppkey * 7) % 50 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(0.2 AS DOUBLE) AS revenue_growth,
       CAST((s_suppkey * 11) % 30 AS DOUBLE) / CAST(20 AS DOUBLE) AS debt_to_equity,
       CAST(5 + s_suppkey % 25 AS DOUBLE) / CAST(10 AS DOUBLE) AS current_ratio,
       CAST(3 + s_suppkey % 18 AS DOUBLE) / CAST(10 AS DOUBLE) AS beta,
       CAST(1000000000 AS DOUBLE) * CAST(1 + (s_suppkey * 17) % 500 AS DOUBLE) AS market_cap
FROM supplier""",
    "news": """
SELECT doc_id AS guid, CAST(SUBSTR(source, 4) AS INT) % 10 AS symbol,
       SUBSTR(text, 1, 80) AS title, SUBSTR(text, 81) AS summary,
       DATE '1995-01-02' + CAST(doc_id % 2500 AS INT) AS p_date
FROM documents""",
    "ratings": f"""
SELECT DISTINCT l_suppkey AS symbol, o_orderkey AS rating_id, o_custkey AS firm,
       CAST(o_orderdate AS DATE) AS rated_on, {GRADE_CASE} AS to_grade
FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    "macro": """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ts, AVG(o_totalprice) AS cpi FROM orders GROUP BY 1""",
    "ticks": """
SELECT event_type AS symbol, ts, value AS price, CAST(1 AS DOUBLE) AS volume, user_id, event_id FROM events""",
    "portfolio": _values(PORTFOLIO, ["symbol", "weight"], ["BIGINT", "DOUBLE"]),
    "lexicon": _values(LEXICON, ["word", "polarity"], ["VARCHAR", "DOUBLE"]),
    "horizons": _values([(d,) for d in HORIZONS], ["day"], ["INTEGER"]),
    "macro_levels": _values(MACRO_LEVELS, ["series", "value"], ["VARCHAR", "DOUBLE"]),
}

# dependency order for WITH clauses
_ORDER = ["bars", "market_index", "index_bars", "sector_members", "fundamentals", "news", "ratings",
          "macro", "ticks", "portfolio", "lexicon", "horizons", "macro_levels"]
_DEPS = {"market_index": ["bars"], "index_bars": ["market_index"]}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix ``sql`` with WITH-clauses for the named fixtures (plus dependencies)."""
    need: set[str] = set()

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        need.add(n)

    for n in names:
        add(n)
    if not need:
        return sql
    ctes = [f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in _ORDER if n in need]
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + sql[15:]
    if sql.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + sql


def index_series(spark: SparkSession, sf_dir: str, bars_df: DataFrame | None = None) -> DataFrame:
    """index_series(index_name, ts, close, volume): the market index plus one
    volume-weighted index per sector (region), built from member bars in one
    reading: a bar counts for the market and once per sector row of its symbol."""
    b = bars_df if bars_df is not None else bars(spark, sf_dir)
    mine = (sector_members(spark, sf_dir).groupBy("symbol")
            .agg(F.collect_list(F.struct(F.lit(False).alias("whole"), F.col("sector").alias("index_name"))).alias("_in")))
    market = F.array(F.struct(F.lit(True).alias("whole"), F.lit("MARKET").alias("index_name")))
    each = F.explode(F.concat(market, F.coalesce("_in", F.slice(market, 1, 0))))
    return (b.join(mine, "symbol", "left").select("ts", "close", "volume", each.alias("_i"))
            .groupBy("_i.whole", "_i.index_name", "ts")
            .agg((F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("close"),
                 F.sum("volume").alias("volume"))
            .select("index_name", "ts", "close", "volume"))


FIXTURE_SQL["index_series"] = """
SELECT 'MARKET' AS index_name, ts, close, volume FROM market_index
UNION ALL
SELECT r_name AS index_name, ts, SUM(close * volume) / SUM(volume) AS close, SUM(volume) AS volume
FROM bars JOIN supplier ON s_suppkey = symbol JOIN nation ON s_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, ts"""
_ORDER.insert(_ORDER.index("sector_members"), "index_series")
_DEPS["index_series"] = ["market_index"]


# ---------------------------------------------------------------- company fields
def _info_rule(i: int) -> tuple[int, int, int]:
    """Multiplier, modulus and gap of the i-th company field."""
    return 2 * i + 3, 89 + i, 5 + i % 7


def company_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company_info(symbol, one column per source field), every field null for some symbols."""
    k = F.col("s_suppkey")
    cols = []
    for i, name in enumerate(INFO_FIELDS):
        m, n, gap = _info_rule(i)
        cols.append(F.when(k % gap != 0, ((k * m) % n).cast("double") / _d(8)).alias(name))
    return table(spark, sf_dir, "supplier").select(k.alias("symbol"), *cols)


FIXTURE_SQL["company_info"] = "SELECT s_suppkey AS symbol, " + ", ".join(
    'CASE WHEN s_suppkey % {2} <> 0 THEN CAST((s_suppkey * {0}) % {1} AS DOUBLE) / 8 END AS "{3}"'.format(*_info_rule(i), name)
    for i, name in enumerate(INFO_FIELDS)) + " FROM supplier"
_ORDER.append("company_info")


def market_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market_months(month, vix, interest_rate, dollar_strength, momentum_20): one
    row per month of the slow series, joined to the index's last bar of the month."""
    from tickframe.operators import indicators, series

    p = indicators.momentum(series.prepare(index_bars(spark, sf_dir)), 20)
    p = indicators.rolling_volatility(p, 20)
    last = (series.finish(p).groupBy(F.to_date(F.date_trunc("month", "ts")).alias("ts"))
            .agg(F.max_by("momentum_20", "ts").alias("momentum_20"), F.max_by("volatility_20", "ts").alias("v")))
    return (macro(spark, sf_dir).join(last, "ts", "left")
            .select(F.col("ts").alias("month"), (F.col("v") * 100).alias("vix"), (F.col("cpi") / 40000).alias("interest_rate"),
                    (F.col("cpi") / 1430).alias("dollar_strength"), "momentum_20"))
