"""Queries of contradictions, gaps with importance, and planning. Gaps to plan for are bound to orders: nine kinds, every second
with two candidates of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from gnomon.functions.storage import cut_lineage
from gnomon.operators import knowledge as K
from gnomon.operators import planning as P
from gnomon.plans.registry import query

_KINDS = list(P.CAPABILITIES)
_LIST = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"
_GAPS = f"""g AS (SELECT o_orderkey, 'g' || o_orderkey AS id, {_LIST}[1 + o_orderkey % 9] AS kind, least(1, o_totalprice / 500000) AS u, (o_orderkey % 10) / 10.0::DOUBLE AS i, 1.0::DOUBLE + o_orderkey % 5 AS c FROM orders),
k AS (SELECT g.*, 'about ' || id || '?' AS question, c AS cost, 60.0::DOUBLE AS seconds, CASE WHEN kind = 'contradiction' THEN 0.7::DOUBLE ELSE 0.2 END AS risk, 0.5::DOUBLE AS av, id AS redundancy FROM g WHERE o_orderkey % 2 = 1
UNION ALL SELECT g.*, 'first of ' || id || '?', 2.5, 120.0, 0.9, 0.8, 'same' || id FROM g WHERE o_orderkey % 2 = 0 UNION ALL SELECT g.*, 'second of ' || id || '?', c, 60.0, CASE WHEN kind = 'contradiction' THEN 0.7::DOUBLE ELSE 0.2 END, 0.5, 'same' || id FROM g WHERE o_orderkey % 2 = 0),
e AS (SELECT *, least(1, greatest(0, CASE kind WHEN 'missing_relation' THEN 0.3::DOUBLE + 0.7::DOUBLE * i WHEN 'low_confidence' THEN 0.2::DOUBLE + 0.8::DOUBLE * u WHEN 'unsupported_claim' THEN 0.4::DOUBLE * u + 0.4::DOUBLE * i + 0.2::DOUBLE WHEN 'contradiction' THEN 0.6::DOUBLE * u
WHEN 'missing_evidence' THEN 0.3::DOUBLE + 0.7::DOUBLE * u WHEN 'low_diversity' THEN 0.25::DOUBLE + 0.75::DOUBLE * u ELSE 0.5 END)) AS gain, i * (1 - u) * 0.5::DOUBLE + u * 0.5::DOUBLE AS priority, count(*) OVER (PARTITION BY redundancy) AS n FROM k),
s AS (SELECT *, (n - 1) / n AS red, gain * i * u / greatest(cost, 1e-6) AS known FROM e),
z AS (SELECT *, least(1, greatest(0, 0.25::DOUBLE * gain + 0.15::DOUBLE * i + 0.15::DOUBLE * u + 0.1::DOUBLE * av + 0.1::DOUBLE * priority + 0.1::DOUBLE * known / (1 + known) - 0.05::DOUBLE * cost / (1 + cost) - 0.03::DOUBLE * seconds / (seconds + 300) - 0.04::DOUBLE * risk - 0.08::DOUBLE * red)) AS score FROM s)"""


def _planned(t):
    k = F.col("o_orderkey")
    ident = F.concat(F.lit("g"), k.cast("string"))
    none = F.array().cast("array<string>")
    inv = lambda name, cost, meta: F.struct(F.concat(F.lit(name[0]), ident).alias("id"), F.concat(F.lit(f"{name} of "), ident, F.lit(".")).alias("description"), none.alias("target_entities"), F.lit(cost).alias("estimated_cost"), meta.alias("metadata"))
    same = [F.lit("redundancy_key"), F.concat(F.lit("same"), ident)]
    own = F.array(inv("first", 2.5, F.create_map(*same, F.lit("risk"), F.lit("0.9"), F.lit("estimated_duration_seconds"), F.lit("120"), F.lit("evidence_availability"), F.lit("0.8"))), inv("second", 0.0, F.create_map(*same)))
    doubt, weight = F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0), (k % 10) / 10.0
    kind = F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (k % 9 + 1).cast("int"))
    return t("orders").select(ident.alias("id"), kind.alias("kind"), F.concat(F.lit(" about "), ident, F.lit("..? ")).alias("description"), F.lit("a reason").alias("reason"), F.array(ident).alias("affected_entities"), doubt.alias("uncertainty"), weight.alias("importance"), (1.0 + k % 5).alias("estimated_cost"), K.priority(weight, doubt).alias("priority"), F.when(k % 2 == 0, own).otherwise(F.array().cast(P.CANDIDATE)).alias("candidates"))


@query(f"WITH {_GAPS} SELECT id AS gap_id, question, round(gain, 9) AS gain, cost, seconds, risk FROM e")
def candidate_generate(t):
    return P.candidates(_planned(t)).select("gap_id", "question", F.round("gain", 9).alias("gain"), "cost", "seconds", "risk")


@query(f"WITH {_GAPS} SELECT id AS gap_id, question, round(red, 9) AS redundancy, round(score, 9) AS score FROM z")
def candidate_score(t):
    return P.score(P.candidates(_planned(t))).select("gap_id", "question", F.round("redundancy", 9).alias("redundancy"), F.round("score", 9).alias("score"))


@query(f"WITH {_GAPS} SELECT round(sum(gain * score), 3) AS expected_information_gain, round(sum(u * score), 3) AS expected_uncertainty_reduction, round(sum(cost), 3) AS estimated_cost, round(sum(gain * score) / sum(cost), 6) AS information_gain_per_cost FROM z")
def candidate_forecast(t):
    f = P.forecast(P.score(P.candidates(_planned(t))))
    return f.select(*[F.round(c, 6 if c.endswith("per_cost") else 3).alias(c) for c in f.columns])


@query()
def candidate_select(t):
    # Written once, with what a score and a choice need only: the texts of the candidates are not asked for.
    rows = cut_lineage(P.candidates(_planned(t)).select("id", "gap_id", "redundancy_key", "gain", "importance", "reduction", "availability", "priority", "cost", "seconds", "risk"))
    scored = P.score(rows).select("id", "gap_id", "redundancy_key", "cost", "seconds", "score")
    return P.select(scored, P.Budget(cost=40.0, seconds=600.0), workers=12, least=0.1).select("id", "gap_id", "selected", "reason")


_TREE = "n AS (SELECT c_custkey AS id, CASE WHEN c_custkey // 4 > 0 AND c_custkey // 4 IN (SELECT c_custkey FROM customer) THEN c_custkey // 4 END AS parent FROM customer)"


def _tree(t):
    ids = t("customer").select(F.col("c_custkey").alias("id"))
    edges = ids.select(F.expr("id div 4").alias("parent"), "id").where("parent > 0").join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi")
    return ids, edges


@query(f"WITH RECURSIVE {_TREE}, w AS (SELECT id, 0 AS wave FROM n WHERE parent IS NULL UNION ALL SELECT n.id, wave + 1 FROM n JOIN w ON n.parent = w.id) SELECT * FROM w")
def plan_waves(t):
    return P.waves(*_tree(t))


_STATE = "CASE WHEN id % 5 = 0 AND id < 400 THEN 'DEAD_LETTERED' WHEN id % 7 = 0 AND id < 400 THEN 'RUNNING' WHEN id < 400 THEN 'SUCCEEDED' END"


@query(f"""WITH RECURSIVE {_TREE}, s AS (SELECT id, parent, {_STATE} AS state FROM n), w AS (SELECT id, CASE state WHEN 'SUCCEEDED' THEN 'succeeded' WHEN 'DEAD_LETTERED' THEN 'failed' WHEN 'RUNNING' THEN 'running' ELSE 'submit' END AS status, CAST(NULL AS VARCHAR) AS blocked_by FROM s WHERE parent IS NULL
UNION ALL SELECT s.id, CASE WHEN state = 'SUCCEEDED' THEN 'succeeded' WHEN state = 'DEAD_LETTERED' THEN 'failed' WHEN state = 'RUNNING' THEN 'running' WHEN w.status IN ('failed', 'blocked') THEN 'blocked' WHEN w.status = 'succeeded' THEN 'submit' ELSE 'waiting' END,
CASE WHEN state IS NULL AND w.status IN ('failed', 'blocked') THEN CAST(w.id AS VARCHAR) END FROM s JOIN w ON s.parent = w.id) SELECT * FROM w""")
def plan_advance(t):
    ids, edges = _tree(t)
    i = F.col("id")
    state = F.when((i % 5 == 0) & (i < 400), "DEAD_LETTERED").when((i % 7 == 0) & (i < 400), "RUNNING").when(i < 400, "SUCCEEDED")
    return P.advance(ids, edges, ids.withColumn("state", state).where("state is not null"))


@query("""WITH d AS (SELECT c_custkey AS id FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 100 = 0), m AS (SELECT max(c_custkey) AS m FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS id, 'duplicate id' AS problem FROM customer WHERE c_custkey % 100 = 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'unknown dependency: ' || (c_custkey + m) FROM customer, m WHERE c_custkey % 50 = 7
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'depends on itself' FROM customer WHERE c_custkey % 50 = 9 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'cycle' FROM customer, m WHERE c_custkey % 50 IN (11, 12) AND (c_custkey // 50) * 50 + 12 <= m""")
def plan_problems(t):
    c = t("customer").select(F.col("c_custkey").alias("k"))
    top = c.agg(F.max("k")).first()[0]
    text = lambda col: col.cast("string")
    nodes = c.unionByName(c.where("k % 100 = 0")).select(text(F.col("k")).alias("id"))
    k = F.col("k")
    bad = [c.where("k % 50 = 7").select(text(k + top).alias("parent"), text(k).alias("id")), c.where("k % 50 = 9").select(text(k).alias("parent"), text(k).alias("id")), c.where("k % 50 = 11").select(text(k + 1).alias("parent"), text(k).alias("id")), c.where("k % 50 = 12").select(text(k - 1).alias("parent"), text(k).alias("id"))]
    edges = bad[0]
    for more in bad[1:]:
        edges = edges.unionByName(more)
    known = c.select(text(k).alias("parent"))
    edges = edges.where("id <> parent").join(known.withColumn("known", F.lit(1)), "parent", "left").where(f"known = 1 or cast(parent as bigint) > {top}").select("parent", "id").where(f"cast(parent as bigint) <> {top} + 1 or cast(id as bigint) % 50 <> 11").unionByName(edges.where("id = parent"))
    return P.plan_problems(nodes, edges)


# Contradictions and gaps of a knowledge base of customers and what their orders say.
def _records(t):
    o, price = t("orders"), F.col("o_totalprice")
    order = F.col("o_orderkey").cast("string")
    ids = lambda when: F.sort_array(F.collect_list(F.when(when, order)))
    return o.groupBy(F.col("o_custkey").cast("string").alias("subject"), F.col("o_orderstatus").alias("object")).agg(
        F.round(F.least(F.lit(1.0), F.avg(price) / 500000.0), 12).alias("confidence"), ids(price >= 100000).alias("supporting_evidence"), ids(price < 20000).alias("contradicting_evidence"), F.sort_array(F.collect_set("o_orderpriority")).alias("source_ids"), F.max("o_orderdate").alias("seen"),
    ).select(F.concat_ws(":", "subject", "object").alias("id"), F.concat_ws(" ", "subject", F.lit("order_status"), "object").alias("text"), "subject", F.lit("order_status").alias("predicate"), "object", "confidence", "supporting_evidence", "contradicting_evidence", "source_ids", F.when(F.col("seen") < "1996-01-01", "stale").otherwise("unverified").alias("verification_state"))


_RECORDS = """c AS (SELECT o_custkey || ':' || o_orderstatus AS id, CAST(o_custkey AS VARCHAR) AS subject, o_orderstatus AS object, round(least(1, avg(o_totalprice) / 500000), 12) AS confidence, count(*) FILTER (o_totalprice >= 100000) AS support, count(DISTINCT o_orderpriority) AS sources,
CASE WHEN max(o_orderdate) < TIMESTAMP '1996-01-01' THEN 'stale' ELSE 'unverified' END AS state FROM orders GROUP BY o_custkey, o_orderstatus),
pairs AS (SELECT x.id AS a, y.id AS b, least(1, x.confidence * y.confidence * (1 + x.support + y.support) / 3) AS strength FROM c x JOIN c y ON x.subject = y.subject AND x.object < y.object),
r AS (SELECT 'customer:' || o_custkey AS id, count(*)::DOUBLE / 1000 AS rank FROM orders GROUP BY o_custkey), top AS (SELECT max(rank) AS top FROM r),
m AS (SELECT c.id, least(1, CASE WHEN k.c_custkey IS NULL THEN 0 ELSE least(1, coalesce(rank, 0) / top) END * confidence + 0.2::DOUBLE) AS importance, k.c_custkey IS NOT NULL AS named FROM c LEFT JOIN customer k ON CAST(k.c_custkey AS VARCHAR) = subject LEFT JOIN r ON r.id = 'customer:' || subject, top)"""


def _knowledge(t):
    key = F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))
    entities = t("customer").select(key.alias("id"), F.col("c_custkey").cast("string").alias("name"), F.lit("").alias("canonical_name"))
    ranks = t("orders").groupBy(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("id")).agg((F.count("*") / 1000.0).alias("rank"))
    claims = _records(t)
    flat = claims.select("id", "subject", "predicate", "object", "confidence", F.size("supporting_evidence").alias("evidence"), F.col("verification_state").alias("state"))
    found = K.contradictions(flat, flat.select("id", "subject", "predicate", F.col("object"), "confidence", "evidence").where("false"))
    relations = t("customer").where("c_custkey % 3 <> 0").select(key.alias("subject_id"), F.lit("nation").alias("object_id"))
    pairs = t("customer").where("c_custkey % 100 = 0").select(key.alias("a"), F.concat(F.lit("customer:"), (F.col("c_custkey") + 1).cast("string")).alias("b"), (F.col("c_custkey") % 7).alias("shared"))
    return claims, relations, entities, found, ranks, pairs


@query("""WITH c AS (SELECT o_custkey AS s, o_orderpriority AS p, o_orderstatus AS o, min(o_orderkey) AS id FROM orders GROUP BY ALL), d AS (SELECT c.*, o_totalprice / 600000 AS confidence FROM c JOIN orders ON id = o_orderkey)
SELECT CAST(x.s AS VARCHAR) AS subject, x.p AS predicate, least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, round(least(1, x.confidence * y.confidence * 7 / 3), 6) AS strength FROM d x JOIN d y ON x.s = y.s AND x.p = y.p AND x.o < y.o""")
def exclusive_relations(t):
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("subject"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object"), (F.col("o_totalprice") / 600000.0).alias("confidence"), F.lit(3).alias("evidence"))
    return K.exclusive_relations(o)


@query(f"""WITH {_RECORDS}, x AS (SELECT 'conflicting_claims' AS kind, least(a, b) AS a, greatest(a, b) AS b, strength FROM pairs UNION ALL SELECT 'stale_claim', id, id, 0.5 FROM c WHERE state = 'stale')
SELECT 'contra_' || substr(sha256(kind || chr(31) || a || chr(31) || b), 1, 16) AS id, kind, a, b, round(strength, 6) AS strength FROM x""")
def contradictions(t):
    return _knowledge(t)[3]


_FOUND = f"""{_RECORDS}, x AS (SELECT least(a, b) AS a, greatest(a, b) AS b, round(strength, 6) AS strength FROM pairs UNION ALL SELECT id, id, 0.5 FROM c WHERE state = 'stale'),
f AS (SELECT 'low_confidence' AS kind, c.id AS k, 1 - confidence AS u, importance AS i, 1.0::DOUBLE AS cost FROM c JOIN m USING (id) WHERE confidence < 0.4 UNION ALL SELECT 'unsupported_claim', c.id, 1 - confidence, importance, 1 FROM c JOIN m USING (id) WHERE support = 0
UNION ALL SELECT 'stale', c.id, 0.8, importance, 1 FROM c JOIN m USING (id) WHERE state = 'stale' UNION ALL SELECT 'missing_evidence', c.id, 0.6, importance, 1 FROM c JOIN m USING (id) WHERE support < 1 UNION ALL SELECT 'low_diversity', c.id, 0.5, importance, 1 FROM c JOIN m USING (id) WHERE sources < 2
UNION ALL SELECT 'contradiction', CASE WHEN a = b THEN a ELSE a || '/' || b END, least(1, 1.5::DOUBLE * strength), strength, 1 FROM x
UNION ALL SELECT 'missing_relation', 'customer:' || k.c_custkey || '/customer:' || (k.c_custkey + 1), 0.5, least(1, (coalesce(p.rank, 0) + coalesce(q.rank, 0)) / top), 1.5::DOUBLE * (1 + 0.5::DOUBLE * (k.c_custkey % 7)) FROM customer k LEFT JOIN r p ON p.id = 'customer:' || k.c_custkey LEFT JOIN r q ON q.id = 'customer:' || (k.c_custkey + 1), top WHERE k.c_custkey % 100 = 0
UNION ALL SELECT 'disconnected_entity', 'customer:' || k.c_custkey, 1, least(1, coalesce(p.rank, 0) / top), 2 FROM customer k LEFT JOIN r p ON p.id = 'customer:' || k.c_custkey, top WHERE k.c_custkey % 3 = 0)"""


@query(f"WITH {_FOUND} SELECT kind, k AS about, round(u, 9) AS uncertainty, round(i, 9) AS importance, cost AS estimated_cost, round(i * (1 - u) * 0.5::DOUBLE + u * 0.5::DOUBLE, 9) AS priority FROM f")
def gaps_found(t):
    about = F.array_join(F.when(F.size("affected_claims") > 0, F.col("affected_claims")).otherwise(F.col("affected_entities")), "/")
    return K.find_gaps(*_knowledge(t)).select("kind", about.alias("about"), F.round("uncertainty", 9).alias("uncertainty"), F.round("importance", 9).alias("importance"), "estimated_cost", F.round("priority", 9).alias("priority"))


@query(f"WITH {_FOUND} SELECT kind, count(*) AS n, round(sum(i / greatest(CASE WHEN kind = 'missing_relation' THEN 1.5::DOUBLE ELSE cost END, 1e-6)), 4) AS score FROM f GROUP BY 1")
def investigation_centrality(t):
    return K.score_gaps(K.find_gaps(*_knowledge(t)), "centrality").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))


@query("""WITH q AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 0.5 ELSE least(1, greatest(0, s_acctbal / 5000)) END AS q FROM supplier), l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT o_orderkey AS id, round(coalesce(avg(CASE WHEN l_suppkey IS NOT NULL THEN coalesce(q, 0.5) END), 0.5), 10) AS quality, count(l_suppkey) AS sources FROM orders LEFT JOIN l ON o_orderkey = l_orderkey LEFT JOIN q ON l_suppkey = s_suppkey GROUP BY 1""")
def source_signals(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_suppkey").alias("source_ids"))
    claims = t("orders").select(F.col("o_orderkey").alias("id")).join(lines, "id", "left").withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<bigint>")))
    sources = t("supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 4 != 0, F.create_map(F.lit("quality"), (F.col("s_acctbal") / 5000.0).cast("string"))).otherwise(F.create_map(F.lit("quality"), F.lit("none"))).alias("metadata"))
    return K.source_signals(claims, sources).select("id", F.round("quality", 10).alias("quality"), "sources")
