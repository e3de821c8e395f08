"""One query per operator, over its whole table, and the SQL it is checked against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.llm import (
    bpe,
    centroids,
    chat,
    exact_dedup,
    fingerprints,
    hard_negatives,
    line_dedup,
    near_dedup,
    packing,
    pii,
    secrets,
    token_files,
    toxicity,
)
from cartwise.llm.common import table
from cartwise.llm.vectors import integer_vectors
from cartwise.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL["op6_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)"""


@query
def op10_toxicity(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.scored_with_holdout(documents, labels)


@query
def op5_token_files(spark, sf_dir):
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder)
    return token_files.read_token_files(spark, folder)


@query
def op3_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


@query
def op9_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op1_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_pairs(table(spark, sf_dir, "documents"))


@query
def op7_chat(spark, sf_dir):
    return chat.digests(chat.with_probe(table(spark, sf_dir, "conversations")))


ORACLE_SQL["op7_chat"] = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (
  SELECT *, 4 + length(role) + 1 + length(text) + 4
    + 4 * (length(role || text) - length(replace(role || text, '&', '')))
    + 3 * (length(role || text) - length(replace(role || text, '<', '')))
    + 4 * (length(role || text) - length(replace(role || text, '[', '')))
    + 4 * (length(role || text) - length(replace(role || text, ']', ''))) AS size FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id"""


@query
def op4_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), size=4)


@query
def op8_line_dedup(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query
def op2_pii(spark, sf_dir):
    return pii.span_report(table(spark, sf_dir, "documents"))


@query
def op11_secrets(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


@query
def op12_hard_negatives(spark, sf_dir):
    label = F.col("label").cast("long")
    marked = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    )
    rows = integer_vectors(marked, ["vec_id", "label"])
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


# Lists of doubles multiply exactly here: integers far below 2**53.
ORACLE_SQL["op12_hard_negatives"] = """
WITH e AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM e a, e r WHERE a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id AND len(a.q) = len(r.q)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3"""


@query
def op13_centroids(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def _rounds_in_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """The rounds one after another, each as an assignment and an update."""
    steps = []
    for turn in range(rounds + 1):
        steps.append(f"""
a{turn} AS MATERIALIZED (
  SELECT vec_id, any_value(q) AS q, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT v.vec_id, v.q, c.cluster,
          CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM v, c{turn} c)
  GROUP BY vec_id)""")
        if turn < rounds:
            steps.append(f"""
c{turn + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(n.q, c.q) AS q
  FROM c{turn} c LEFT JOIN (
    SELECT cluster, list(CAST(floor(total / n) AS BIGINT) ORDER BY place) AS q
    FROM (SELECT cluster, place, CAST(sum(x) AS DOUBLE) AS total, count(*) AS n
          FROM (SELECT cluster, unnest(q) AS x, unnest(range({dims})) AS place FROM a{turn}) GROUP BY cluster, place)
    GROUP BY cluster) n USING (cluster))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, q FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= {k}),{",".join(steps)}
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance,
       CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""


ORACLE_SQL["op13_centroids"] = _rounds_in_sql()
