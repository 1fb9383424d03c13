"""Queries of the llm operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm import (
    ball_tree,
    collocations,
    language_id,
    mixing,
    multi_index,
    ngram_join,
    packing,
    secrets,
    segment_topk,
    suffix_dedup,
    token_files,
    toxicity,
    url_filters,
)
from tickframe.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


@query("op1_secrets")
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base counts and digest, all spans, findings by layer."""
    got = secrets.secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(F.col("row.doc_id").alias("doc_id"), "n_assign", "n_access", "n_hex",
                      F.sha2("base", 256).alias("base_sha256"), "spans", "findings", "layers")


#: Fixed values of the task.
SITE_RULES = [url_filters.site_rule("block", "net", "/"), url_filters.site_rule("allow", "example.net", "/en/"),
              url_filters.site_rule("block", "example.com", "/de/"), url_filters.site_rule("allow", "org", "/fr/")]
#: Where no site rule fits: urls that name spam, scripts or programs are blocked.
PAGE_PATTERNS = ["^spam^", "^casino^", "^viagra^", "^porn^", "^phishing^", "^malware^", "/cgi-bin/", "/wp-login.php", ".exe|"]

OP2_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '(?s)^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             substr(rest, length(raw) + 1) AS after FROM h),
q AS (SELECT page_id, host, after, regexp_extract(after, '(?s)^[^?#]*') AS path FROM p),
r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM q)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host || after, '(^|[^A-Za-z0-9])(spam|casino|viagra|porn|phishing|malware)([^A-Za-z0-9]|$)')
      OR contains(host || after, '/cgi-bin/') OR contains(host || after, '/wp-login.php') OR ends_with(host || after, '.exe')
    THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


@query("op2_url_filters", OP2_SQL)
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, winning site rule and verdict of every page's url."""
    rules = SITE_RULES + [url_filters.Rule(p, "block") for p in PAGE_PATTERNS]
    got = url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return got.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and significant passages of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"), "passages")


@query("op4_multi_index")
def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found for every query vector, by cosine."""
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op5_segment_topk")
def op5_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products for every query vector."""
    return segment_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


@query("op7_ngram_jaccard")
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with a 5-word shingle similarity of 0.75 or more."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"))


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document shares with another."""
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query("op10_mixing")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed by source: flattest weights that repeat no source more
    than twice, within a budget of as many tokens as there are."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op11_token_files")
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to Simple-8b files in doc_id order and read back."""
    return token_files.token_files(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
t AS (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), n),
part AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // total)))) AS s
      FROM tf JOIN weight USING (term), n),
scores AS (SELECT item_id, row, doc_id, CAST(sum(s) AS BIGINT) AS score FROM part JOIN q USING (term) GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores QUALIFY rank <= 50
"""


@query("op12_ball_tree", OP12_SQL)
def op12_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ball_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM p),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, m, f AS a, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
s AS (SELECT c.lang, c.phrase, c.m, a, k, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
             JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
worst AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, f
      FROM (SELECT lang, string_split(phrase, ' ') AS w, f, n, unnest(range(1, m - n + 2)) AS i
            FROM f, (SELECT unnest([2, 3]) AS n) WHERE m > n)),
longer AS (SELECT lang, phrase, max(f) AS longest FROM inner_parts GROUP BY ALL),
kept AS (SELECT worst.* FROM worst LEFT JOIN longer USING (lang, phrase) WHERE longest IS NULL OR 100 * CAST(longest AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op13_collocations", OP13_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of 2 to 4 words of every language, by exact counts."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))
