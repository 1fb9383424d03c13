"""Lexicon scores as steps: by hand, and the costly parts once per row."""

from pyspark.sql import functions as F

import __spark_entry__ as ent
from tests.conftest import SF001
from tickframe.functions import text as tx


def test_lexicon_steps_by_hand(spark):
    rows = spark.createDataFrame([(1, "Profit and LOSS and growth"), (2, ""), (3, None), (4, "  "), (5, "gain gain risk")], "id int, t string")
    got = tx.add_lexicon(rows, "t", words="n", a=(tx.POSITIVE_WORDS, tx.NEGATIVE_WORDS, "A"), b=(tx.POSITIVE_WORDS_EXT, tx.NEGATIVE_WORDS_EXT, "B"))
    assert got.columns == ["id", "t", "n", "a", "b"]
    assert {r.id: (r.n, r.a, r.b) for r in got.collect()} == {
        1: (5, 0.2, 0.7), 2: (0, 0.0, 0.5), 3: (0, 0.0, 0.5), 4: (0, 0.0, 0.5), 5: (3, 1 / 3, 0.5)}
    one = rows.select("id", tx.lexicon_sentiment(F.col("t")).alias("a"))
    assert {tuple(r) for r in one.collect()} == {(r.id, r.a) for r in got.collect()}


def test_words_are_counted_once_per_row(spark):
    plan = ent.queries()["lexicon_sentiment"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") + plan.lower().count("regexp_count") + plan.lower().count("regexpcount") == 1, plan[:2000]
