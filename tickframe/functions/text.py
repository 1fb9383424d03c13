"""Text functions as Column builders over whole texts.

Whitespace is the ASCII set [ \\t\\n\\r\\f\\v] and word characters are
Unicode letters, digits and '_' ; the DuckDB oracle uses the same classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickframe.functions.signals import _c

WS = r"[ \t\n\r\f\x0B]"
NON_WS_RUN = r"[^ \t\n\r\f\x0B]+"
NON_WORD = r"[^\p{L}\p{N}_ \t\n\r\f\x0B]"

# The default keyword lists (substring match, each word counted once).
POSITIVE_WORDS = [
    "bullish", "growth", "profit", "gain", "rise", "increase", "strong", "positive",
    "beat", "exceed", "outperform", "upgrade", "buy", "recommend", "success",
    "breakthrough", "innovation", "leading", "dominant", "expansion"]
NEGATIVE_WORDS = [
    "bearish", "decline", "loss", "fall", "decrease", "weak", "negative",
    "miss", "underperform", "downgrade", "sell", "avoid", "failure",
    "crisis", "recession", "bankruptcy", "lawsuit", "investigation"]
# The extended lists of the monthly training path.
POSITIVE_WORDS_EXT = POSITIVE_WORDS + ["surge", "rally", "momentum", "optimistic", "confident", "robust", "solid"]
NEGATIVE_WORDS_EXT = NEGATIVE_WORDS + ["crash", "plunge", "slump", "concern", "risk", "uncertainty", "volatile"]


def word_count(text) -> Column:
    """Number of whitespace-separated words (Python ``len(text.split())``)."""
    t = _c(text)
    return F.when(t.isNull(), F.lit(0)).otherwise(F.regexp_count(t, F.lit(NON_WS_RUN))).cast("long")


def keyword_hits(text, words) -> Column:
    """How many of ``words`` occur as substrings of lower(text), each once."""
    return _hits(F.lower(_c(text)), words)


def _hits(low: Column, words) -> Column:
    parts = [F.when(low.contains(w), F.lit(1)).otherwise(F.lit(0)) for w in words]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _lexicon(t: Column, low: Column, n: Column, positive, negative, variant: str) -> Column:
    raw = (_hits(low, positive) - _hits(low, negative)).cast("double") / n.cast("double")
    if variant == "A":
        val, empty = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)), F.lit(0.0)
    else:
        val, empty = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw + 0.5)), F.lit(0.5)
    return F.when(t.isNull() | (F.length(t) == 0) | (n == 0), empty).otherwise(val)


def lexicon_sentiment(text, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS, *, variant: str = "A") -> Column:
    """(positive hits - negative hits) / word count.

    Variant A: clamp to [-1, 1], 0 for empty text.  Variant B: +0.5 and clamp
    to [0, 1], 0.5 for empty text.
    """
    t = _c(text)
    return _lexicon(t, F.lower(t), word_count(t), positive, negative, variant)


def add_lexicon(df, text: str, *, words: str = "_words", **scores):
    """X1 as DataFrame steps for several scores, name=(positive, negative,
    variant): the lower-cased text and the word count (kept as ``words``) become
    columns first, so they are worked out once per row."""
    d = df.withColumns({"_low": F.lower(F.col(text)), words: word_count(F.col(text))})
    d = d.withColumns({name: _lexicon(F.col(text), F.col("_low"), F.col(words), *rule) for name, rule in scores.items()})
    return d.drop("_low")


def clean_text(text) -> Column:
    """Non-word characters -> space, whitespace runs -> one space, trim."""
    t = F.regexp_replace(_c(text), NON_WORD, " ")
    t = F.regexp_replace(t, WS + "+", " ")
    return F.trim(t)


def polarity_score_0_100(text, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS) -> Column:
    """(polarity + 1) * 50 clamped to 0..100; blank text -> 50.  The
    polarity is the variant-A lexicon score of the cleaned text."""
    c = clean_text(text)
    pol = lexicon_sentiment(c, positive, negative, variant="A")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (pol + 1.0) * 50.0))
    return F.when(_c(text).isNull() | (F.length(c) == 0), F.lit(50.0)).otherwise(score)


def add_polarity(df, text: str, out: str, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS):
    """X2 as DataFrame steps: the cleaned text and its word count become
    columns first, so the regex work runs once per row (and each generated
    projection stays small)."""
    tmp = f"_clean_{out}"
    pol = F.col(f"_polarity_{out}")
    d = add_lexicon(df.withColumn(tmp, clean_text(F.col(text))), tmp, words=f"_words_{out}", **{f"_polarity_{out}": (positive, negative, "A")})
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (pol + 1.0) * 50.0))
    val = F.when(F.col(text).isNull() | (F.length(F.col(tmp)) == 0), F.lit(50.0)).otherwise(score)
    return d.withColumn(out, val).drop(tmp, f"_words_{out}", f"_polarity_{out}")


def headline_text(title, summary) -> Column:
    """Title + ' ' + summary with '' for missing parts."""
    return F.concat(F.coalesce(_c(title), F.lit("")), F.lit(" "), F.coalesce(_c(summary), F.lit("")))
