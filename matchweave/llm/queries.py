"""The registered queries of the corpus operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchweave.llm import (
    jaccard,
    langid,
    mixing,
    negatives,
    packing,
    quality,
    simhash,
    token_counts,
    topk,
    toxicity,
    trie,
    warc,
    winnow,
)
from matchweave.llm.shared import columns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def documents(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    return columns(spark.read.parquet(f"{folder}/documents.parquet"), *(names or ("doc_id", "text")))


@query
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix of all sources by weight takes of each document."""
    return mixing.mix_plan(documents(spark, folder, "doc_id", "text", "source"))


@query
def op2_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness."""
    return winnow.with_edits(documents(spark, folder), rolled=True).drop("marks")


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals at every context limit that is the length of a document."""
    lengths = token_counts.encoded_lengths(documents(spark, folder, "text"))
    return token_counts.every_limit(token_counts.length_histogram(lengths))


@query
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.classes(documents(spark, folder))


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document cut and packed into sequences of 2,048 tokens."""
    return packing.pack_documents(documents(spark, folder), capacity=2048, end_id=0)


@query
def op6_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest other vectors of every vector whose id is divisible by 50."""
    vectors = columns(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding")
    return topk.nearest_of_every(vectors, every=50, k=5)


def labels(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return columns(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id", name)


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities of the toxicity categories of every document."""
    return toxicity.judge(documents(spark, folder), labels(spark, folder, "toxic"))


@query
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence, site shares and posterior quality of every document."""
    return quality.judge(documents(spark, folder, "doc_id", "text", "source", "lang"), labels(spark, folder, "quality"))


@query
def op9_langid(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(documents(spark, folder, "doc_id", "text", "lang"))


@query
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """What archives of all pages say of each page when they are read back."""
    return warc.round_trip(columns(spark.read.parquet(f"{folder}/pages.parquet"), "page_id", "url", "html"))


@query
def op11_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Set size and class of every document, by links of a four-word likeness of 85 %."""
    return jaccard.classes(documents(spark, folder))


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Negatives just below the positives of every vector whose id is divisible by 100."""
    vectors = columns(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding", "label")
    return negatives.mine(vectors, every=100)


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return trie.trie_of_rebuilt(spark.read.parquet(f"{folder}/conversations.parquet"))


ORACLES["op10_warc"] = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), f AS (
    SELECT html, min(page_id) AS first_id FROM p GROUP BY html
), b AS (
    SELECT p.page_id, p.html, f.first_id, sha1(p.html) AS hex,
           '0123456789abcdef' AS digits
    FROM p JOIN f ON p.html = f.html
), bits AS (
    SELECT page_id, html, first_id,
           array_to_string(list_transform(range(1, 41), lambda i:
               right(bin(strpos(digits, substr(hex, i, 1)) + 15), 4)), '') AS bits
    FROM b
)
SELECT page_id,
       octet_length(encode(html)) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  list_sum(list_transform(range(0, 5), lambda j:
                      CAST(substr(bits, CAST(5 * i + j + 1 AS INT), 1) AS INT) * CAST(2 ** (4 - j) AS INT)))::INT + 1, 1)), '')
           AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM bits
"""

ORACLES["op6_topk"] = """
WITH v AS (
    SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON c.r <> q.r
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, r ORDER BY score DESC, vec_id) AS n FROM s)
WHERE n <= 5
"""

ORACLES["op12_hard_negatives"] = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label,
           CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
    FROM v a JOIN v c ON c.vec_id <> a.vec_id
    WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE label = own)
    WHERE n <= 5
), m AS (
    SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS n
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> s.own
     AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM m WHERE n <= 5
"""

ORACLES["op11_jaccard_join"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), g AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
    FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), l AS (
    SELECT x.doc_id AS a, y.doc_id AS b
    FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id, p.n, q.n
    HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), r(doc_id, reached) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached
)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reached) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

# The bits of crc32 one by one: h is the last two of them.
ORACLES["op13_prefix_trie"] = r"""
WITH own AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
    FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
    SELECT c, CAST(4294967295 - list_reduce(
        list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT)),
        lambda crc, d: list_reduce(range(0, 8), lambda x, i:
            CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(crc, d)),
        CAST(4294967295 AS BIGINT)) AS BIGINT) % 4 AS h
    FROM (SELECT DISTINCT c FROM own)
), lines AS (
    SELECT heads.c, n, role, text FROM heads JOIN own ON own.c = heads.c - heads.c % 20 WHERE n <= h
    UNION ALL
    SELECT heads.c, 3 + n, role, text FROM heads JOIN own ON own.c = heads.c WHERE n > h
), steps AS (
    SELECT c, row_number() OVER (PARTITION BY c ORDER BY n) AS d,
           sha256(role || chr(1) || text) AS id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
    FROM lines
), paths AS (
    SELECT c, d, words, string_agg(id, '/') OVER (PARTITION BY c ORDER BY d) AS path,
           coalesce(string_agg(id, '/') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS above
    FROM steps
    UNION ALL
    SELECT c, 0, 0, '', NULL FROM heads
), sized AS (
    SELECT *, max(d) OVER (PARTITION BY c) AS total FROM paths
), node AS (
    SELECT path, any_value(above) AS above, min(c) AS conv_id, d AS depth, count(*) AS n_convs, any_value(words) AS words,
           sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = total), '')) AS ends_sha256
    FROM sized GROUP BY path, d
), kids AS (
    SELECT above, count(*) AS n FROM node WHERE depth > 0 GROUP BY above
), below AS (
    SELECT s.path, t.path AS under, t.n_convs, t.words, kids.n AS kids
    FROM (SELECT DISTINCT x.path, y.path AS under FROM sized x JOIN sized y ON x.c = y.c AND x.d <= y.d) s
    JOIN node t ON t.path = s.under LEFT JOIN kids ON kids.above = t.path
), sums AS (
    SELECT path, count(*) FILTER (WHERE kids IS NULL) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
    FROM below GROUP BY path
)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n_convs,
       CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, sums.n_leaves, CAST(sums.saved_tokens AS BIGINT) AS saved_tokens,
       node.ends_sha256
FROM node JOIN sums ON sums.path = node.path LEFT JOIN kids ON kids.above = node.path
LEFT JOIN node up ON up.path = node.above AND node.depth > 0
"""
