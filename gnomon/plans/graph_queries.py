"""Queries of the graph algorithms that the catalogue's star schema graph can be held against in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gnomon import corpus
from gnomon.operators import graph as G
from gnomon.operators import hybrid as H
from gnomon.plans.registry import query

EDGES = """e AS MATERIALIZED (SELECT 'supplier:' || s_suppkey AS subject, 'located_in' AS predicate, 'nation:' || s_nationkey AS object, 1.0::DOUBLE AS confidence FROM supplier
UNION ALL SELECT 'customer:' || c_custkey, 'located_in', 'nation:' || c_nationkey, 1.0 FROM customer
UNION ALL SELECT 'nation:' || n_nationkey, 'part_of', 'region:' || n_regionkey, 1.0 FROM nation
UNION ALL SELECT 'supplier:' || l_suppkey, 'supplies', 'part:' || l_partkey, round(1 - avg(l_discount), 6) FROM lineitem GROUP BY l_suppkey, l_partkey)"""


def _place(t):
    """The edges that place suppliers and customers, with ids."""
    return G.star_schema_graph(t).where("predicate <> 'supplies'").withColumn("id", F.concat_ws(">", "subject", "object"))


def _node(t, kind, column):
    return t(kind).select(F.concat(F.lit(kind + ":"), F.col(column).cast("string")).alias("id"))


@query(f"""WITH {EDGES}, p AS (SELECT 'part:' || p_partkey AS id FROM part), v AS (SELECT subject AS id FROM e UNION SELECT object FROM e), a AS (SELECT count(*) AS alone FROM p WHERE id NOT IN (SELECT id FROM v)),
n AS (SELECT count(*) + (SELECT alone FROM a) AS entities FROM v), r AS (SELECT count(*) AS relations, count(DISTINCT (subject, predicate, object)) AS unique_edges FROM e),
g AS (SELECT DISTINCT subject AS x, object AS y FROM e UNION SELECT DISTINCT object, subject FROM e), c0 AS (SELECT id, id AS l FROM v), {", ".join(f"c{i} AS MATERIALIZED (SELECT c.id, least(c.l, min(d.l)) AS l FROM c{i - 1} c JOIN g ON c.id = g.x JOIN c{i - 1} d ON g.y = d.id GROUP BY c.id, c.l)" for i in range(1, 9))}
SELECT entities, relations, unique_edges, round(relations / (entities::DOUBLE * (entities - 1)), 10) AS density, round(2 * relations / entities, 6) AS average_degree, (SELECT count(DISTINCT l) FROM c8) + (SELECT alone FROM a) AS components, (SELECT alone FROM a) AS isolated FROM n, r""")
def graph_statistics(t):
    return G.full_statistics(G.star_schema_graph(t), _node(t, "part", "p_partkey"))


@query(f"""WITH {EDGES}, v AS (SELECT subject AS id FROM e WHERE predicate <> 'supplies' UNION SELECT object FROM e WHERE predicate <> 'supplies'), n AS (SELECT count(*) AS n FROM v), d AS (SELECT object AS id, count(*) AS c FROM e WHERE predicate = 'located_in' GROUP BY 1)
SELECT id, round(coalesce(c, 0) / ((n - 1) * (n - 2))::DOUBLE, 9) AS centrality FROM v LEFT JOIN d USING (id), n""")
def betweenness(t):
    return G.betweenness(_place(t))


_WALK = f"""{EDGES}, f AS (SELECT subject || '>' || object AS id, subject, object FROM e WHERE predicate <> 'supplies'), s AS (SELECT DISTINCT n_regionkey AS query_id, 'region:' || n_regionkey AS id FROM nation),
a AS (SELECT query_id, f.id, subject AS other, row_number() OVER (PARTITION BY query_id ORDER BY f.id) AS pos FROM s JOIN f ON object = s.id),
k AS (SELECT query_id, count(*) AS k FROM a GROUP BY 1),
m AS (SELECT a.query_id, a.other AS here, 0 AS side, f.id, f.object AS other FROM a JOIN f ON f.subject = a.other UNION ALL SELECT a.query_id, a.other, 1, f.id, f.subject FROM a JOIN f ON f.object = a.other),
b AS (SELECT query_id, id, other, pos FROM (SELECT m.*, k + row_number() OVER (PARTITION BY query_id ORDER BY here, side, id) AS pos FROM m JOIN k USING (query_id)) WHERE pos <= 500),
q AS (SELECT query_id, other AS id, min(pos) AS pos FROM b WHERE other NOT LIKE 'region:%' AND (query_id, other) NOT IN (SELECT query_id, other FROM a) GROUP BY ALL),
w AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos, id) AS n FROM q)"""


@query(f"""WITH {_WALK} SELECT query_id, id, 0 AS depth FROM s UNION ALL SELECT query_id, other, 1 FROM a UNION ALL SELECT query_id, id, 2 FROM w JOIN k USING (query_id) WHERE n + k + 1 <= 100""")
def traversal_limits(t):
    seeds = t("nation").select(F.col("n_regionkey").alias("query_id"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("id"))
    return G.walk(_place(t), seeds, 2, 100, 500)[0]


@query(f"WITH {_WALK} SELECT query_id, id, CAST(pos AS INTEGER) AS pos FROM a UNION ALL SELECT query_id, id, CAST(pos AS INTEGER) FROM b")
def traversal_edges(t):
    seeds = t("nation").select(F.col("n_regionkey").alias("query_id"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("id"))
    return G.walk(_place(t), seeds, 2, 100, 500)[1].select("query_id", "id", F.col("at").alias("pos"))


@query(f"""WITH {EDGES}, r AS (SELECT s.subject AS source, s.object AS mid, n.object AS target, s.confidence * n.confidence AS weight FROM e s JOIN e n ON s.object = n.subject WHERE s.subject LIKE 'supplier:%')
SELECT source, target, source || '>' || mid || '>' || target AS path, 2 AS hops, round(weight, 6) AS weight FROM r""")
def paths_ranked(t):
    pairs = _node(t, "supplier", "s_suppkey").withColumnRenamed("id", "source").crossJoin(F.broadcast(_node(t, "region", "r_regionkey").withColumnRenamed("id", "target")))
    return G.paths_between(G.star_schema_graph(t), pairs, 3, 20).drop("place")


@query()
def communities(t):
    return G.communities(_place(t))


@query()
def communities_synchronous(t):
    return G.synchronous_communities(G.star_schema_graph(t))


# Answers over the labelled corpus, with the published figures.
@query("SELECT metric, CAST(value AS DOUBLE) AS value FROM (VALUES ('entity_recall', 1.0), ('relation_recall', 1.0), ('evidence_precision', 0.548)) v(metric, value)")
def corpus_graph_quality(t):
    return corpus.graph_quality(t.spark).select("metric", F.round("value", 3).alias("value"))


@query("SELECT metric, CAST(value AS DOUBLE) AS value FROM (VALUES ('claim_accuracy', 1.0), ('calibration_error', 0.133), ('provenance_correctness', 1.0)) v(metric, value)")
def corpus_claim_quality(t):
    return corpus.claim_quality(t.spark).select("metric", F.round("value", 3).alias("value"))


@query()
def hybrid_topk(t):
    kb = corpus.knowledge_base(t.spark)
    rows = H.retrieve(kb, corpus.queries(t.spark), 5, rounds=30)
    return rows.select("query_id", "object_id", "position", F.round("score", 9).alias("score"), F.round("rerank_score", 6).alias("rerank_score"))
