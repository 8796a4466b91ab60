"""The registered queries of this subpackage: each operator over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm import alignment, language, licenses, lines, mixture, negatives, neighbours, overlap, packing, passages, token_files, topk, urls
from corpuskit.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_multi_index_neighbours(spark, sf_dir):
    """Twenty near vectors of every twentieth vector."""
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


@query
def op2_exact_top_k(spark, sf_dir):
    """The twenty largest integer products of every twentieth vector with all others."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


ORACLE["op2_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op8_pareto_mixture(spark, sf_dir):
    """Words that a mix of all sources by target weights takes of each document."""
    return mixture.mix_sizes(table(spark, sf_dir, "documents"))


ORACLE["op8_pareto_mixture"] = mixture.MIX_SQL


@query
def op9_minimum_slack_packing(spark, sf_dir):
    """Every document's token pieces with their places in sequences of 2,048."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op10_cross_parsing_language(spark, sf_dir):
    """The language of every document, learned from three of four folds."""
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op6_url_model_ratio(spark, sf_dir):
    """Every page's URL judged by rules and, beyond them, by the ratio of two character models."""
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op4_repeated_passages(spark, sf_dir):
    """What is left of every document without passages of 50 words that an earlier one holds."""
    return passages.without_repeated_passages(table(spark, sf_dir, "documents"), texts=False)


ORACLE["op4_repeated_passages"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT w.doc_id, i, unnest(range(0, 50)) AS k
      FROM w JOIN f ON w.h = f.h AND w.doc_id > f.first)),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, len(ws) AS n, coalesce(len(gone), 0) AS m,
             list_filter(ws, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)) AS kept
      FROM d LEFT JOIN g ON d.doc_id = g.doc_id)
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


@query
def op7_prefix_jaccard_join(spark, sf_dir):
    """Every document's component of near copies, by shingles of five words."""
    return overlap.jaccard_components(table(spark, sf_dir, "documents"))


ORACLE["op7_prefix_jaccard_join"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM t a JOIN t b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents
      UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""


@query
def op3_near_line_dedup(spark, sf_dir):
    """How many lines of every document repeat an earlier line, or one an edit away, and what is left."""
    return lines.line_report(table(spark, sf_dir, "documents"))


ORACLE["op3_near_line_dedup"] = lines.LINES_SQL


@query
def op5_license_scan(spark, sf_dir):
    """Licence notices and texts in all documents, with coverage and spans."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op11_elias_fano_tokens(spark, sf_dir):
    """Every document's place and checksum in binary token files, written and read back."""
    return token_files.token_report(table(spark, sf_dir, "documents"))


@query
def op12_tree_bound_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector for each of its five nearest of the same label."""
    return negatives.hard_negatives(negatives.shifted_labels(table(spark, sf_dir, "embeddings")))


ORACLE["op12_tree_bound_negatives"] = negatives.NEGATIVES_SQL


@query
def op13_tokenizer_alignment(spark, sf_dir):
    """Two tokenizations of every document against each other, with the corpus-wide counts of linked ids."""
    return alignment.aligned(table(spark, sf_dir, "documents"))
