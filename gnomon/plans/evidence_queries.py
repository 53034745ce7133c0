"""Queries of the evidence pipeline: every order is a piece of evidence for its customer's claim of an order status.

Objects are written in two spellings and some evidence speaks against its claim, so that identity and roles count.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gnomon.operators import evidence as V
from gnomon.plans.registry import query

_EVIDENCE = """e AS (SELECT o_orderkey AS seq, 'e' || o_orderkey AS evidence_id, CAST(o_custkey AS VARCHAR) AS subject, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS object,
o_orderpriority AS source_id, CASE WHEN o_totalprice < 20000 THEN 'contradicting' ELSE 'supporting' END AS role, least(1, o_totalprice / 300000) AS confidence, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) / 5.0::DOUBLE AS quality FROM orders),
u AS (SELECT *, lower(object) AS o, subject || ':' || object AS claim_id, min(seq) OVER (PARTITION BY subject, lower(object), source_id, role) AS original FROM e)"""


def _evidence(t):
    o, key = t("orders"), F.col("o_orderkey").cast("string")
    subject = F.col("o_custkey").cast("string")
    thing = F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
    values = {"tool_call_id": key, "source_id": F.col("o_orderpriority"), "source_reference": F.concat(F.lit("order://"), key)}
    provenance = F.struct(*[values.get(n, F.lit(n)).alias(n) for n in V.PROVENANCE])
    return o.select(
        F.concat(F.lit("e"), key).alias("evidence_id"), F.col("o_orderkey").alias("seq"), F.concat_ws(":", subject, thing).alias("claim_id"), F.concat_ws(" ", subject, F.lit("order_status"), thing).alias("text"), subject.alias("subject"), F.lit("order_status").alias("predicate"), thing.alias("object"),
        F.when(F.col("o_totalprice") < 20000, "contradicting").otherwise("supporting").alias("role"), F.least(F.lit(1.0), F.col("o_totalprice") / 300000.0).alias("confidence"), (F.substring("o_orderpriority", 1, 1).cast("long") / 5.0).alias("source_quality"),
        F.col("o_orderpriority").alias("excerpt"), F.lit(None).cast("string").alias("payload"), provenance.alias("provenance"),
    )


@query(f"WITH {_EVIDENCE} SELECT evidence_id, CASE WHEN seq > original THEN 'e' || original END AS duplicate_of FROM u")
def evidence_dedup(t):
    return V.with_duplicates(_evidence(t)).select("evidence_id", "duplicate_of")


@query(f"WITH {_EVIDENCE} SELECT evidence_id, round(sqrt(confidence * quality), 9) AS strength, CASE WHEN sqrt(confidence * quality) >= 0.7 THEN 'strong' WHEN sqrt(confidence * quality) >= 0.4 THEN 'moderate' ELSE 'weak' END AS grade FROM e")
def evidence_grades(t):
    s = V.X.strength(F.col("confidence"), F.col("source_quality"))
    return _evidence(t).select("evidence_id", F.round(s, 9).alias("strength"), V.X.grade(s).alias("grade"))


@query(f"""WITH {_EVIDENCE}, s AS (SELECT subject, sqrt(confidence * quality) AS s FROM e)
SELECT subject, count(*) FILTER (s >= 0.7) AS strong, count(*) FILTER (s >= 0.4 AND s < 0.7) AS moderate, count(*) FILTER (s < 0.4) AS weak, round(avg(s), 9) AS mean_strength FROM s GROUP BY 1""")
def evidence_grade_counts(t):
    return V.grades(_evidence(t), ["subject"]).withColumn("mean_strength", F.round("mean_strength", 9))


_FUSED = f"""{_EVIDENCE}, f AS (SELECT subject, o, min(claim_id) AS claim_id, list_sort(coalesce(list(evidence_id) FILTER (role = 'supporting'), [])) AS supporting, list_sort(coalesce(list(evidence_id) FILTER (role = 'contradicting'), [])) AS contradicting
FROM u WHERE seq = original GROUP BY ALL)"""


@query(f"WITH {_FUSED} SELECT claim_id, array_to_string(supporting, ',') AS supporting, array_to_string(contradicting, ',') AS contradicting FROM f")
def evidence_fuse(t):
    return V.fuse(_evidence(t)).select("claim_id", F.array_join("supporting", ",").alias("supporting"), F.array_join("contradicting", ",").alias("contradicting"))


@query(f"""WITH {_FUSED} SELECT x.claim_id AS claim_a, y.claim_id AS claim_b, CAST(len(x.supporting) AS INTEGER) AS evidence_a, CAST(len(y.supporting) AS INTEGER) AS evidence_b FROM f x JOIN f y ON x.subject = y.subject AND x.o < y.o WHERE len(x.supporting) > 0 AND len(y.supporting) > 0""")
def evidence_conflicts(t):
    return V.conflicts(V.fuse(_evidence(t))).select("claim_a", "claim_b", F.size("evidence_a").alias("evidence_a"), F.size("evidence_b").alias("evidence_b"))


_EVALUATED = f"""{_EVIDENCE}, g AS (SELECT *, confidence >= 0.5 AND quality >= 0.5 AS good, confidence * quality AS w FROM u WHERE seq = original), d AS (SELECT subject, o, count(*) AS duplicates FROM u WHERE seq > original GROUP BY ALL),
b AS (SELECT subject, o, min(claim_id) AS claim_id, count(*) FILTER (good AND role = 'supporting') AS n, count(*) FILTER (good AND role = 'contradicting') AS m, count(*) FILTER (NOT good) AS low_quality, coalesce(sum(w) FILTER (good AND role = 'supporting'), 0) AS support,
 coalesce(sum(w) FILTER (good AND role = 'contradicting'), 0) AS explicit, coalesce(avg(quality) FILTER (good AND role = 'supporting'), 0) AS mean_quality, count(DISTINCT source_id) FILTER (good AND role = 'supporting') AS sources FROM g GROUP BY ALL),
k AS (SELECT subject, sum(support) AS total, count(*) AS backed FROM b WHERE n > 0 GROUP BY 1),
c AS (SELECT b.*, coalesce(duplicates, 0) AS duplicates, CASE WHEN n > 0 THEN backed - 1 ELSE 0 END AS conflicts, explicit + CASE WHEN n > 0 AND backed > 1 THEN total - support ELSE 0 END AS against FROM b LEFT JOIN k USING (subject) LEFT JOIN d USING (subject, o)),
v AS (SELECT *, CASE WHEN support > 0 THEN least(1, greatest(0, support / n * support / (support + against))) ELSE 0 END AS confidence FROM c)"""
_DECIDED = f"""{_EVALUATED}, z AS (SELECT *, CASE WHEN conflicts > 0 OR m > 0 THEN 'contradicted' WHEN n = 0 OR sources < 2 THEN 'insufficient_evidence' WHEN mean_quality < 0.5 THEN 'uncertain' WHEN confidence >= 0.7 THEN 'confirmed' WHEN confidence >= 0.5 THEN 'probable' ELSE 'uncertain' END AS status FROM v)"""


@query(f"WITH {_EVALUATED} SELECT claim_id, n AS supporting, m AS contradicting, low_quality, duplicates, sources, CAST(conflicts AS BIGINT) AS conflicts, round(mean_quality, 9) AS mean_quality, round(confidence, 9) AS confidence FROM v")
def claim_evaluation(t):
    n = lambda c: F.size(c).cast("long").alias(c)
    return V.evaluate(_evidence(t)).select("claim_id", n("supporting"), n("contradicting"), n("low_quality"), "duplicates", "sources", "conflicts", F.round("mean_quality", 9).alias("mean_quality"), F.round("confidence", 9).alias("confidence"))


@query(f"WITH {_DECIDED} SELECT claim_id, status, status = 'confirmed' AS eligible FROM z")
def claim_verification(t):
    return V.verify(V.evaluate(_evidence(t))).select("claim_id", "status", "eligible")


_ACQUIRED = """CASE WHEN status IS NULL THEN 'rejected' WHEN status = 'confirmed' THEN 'verified' WHEN status = 'contradicted' THEN 'rejected' ELSE 'deferred' END AS lifecycle"""


@query(f"""WITH {_DECIDED}, w AS (SELECT DISTINCT 'c' || c_custkey || ':' || s AS candidate_id, CAST(c_custkey AS VARCHAR) AS subject, lower(s) AS o FROM customer, (SELECT DISTINCT o_orderstatus AS s FROM orders))
SELECT candidate_id, {_ACQUIRED} FROM w LEFT JOIN z USING (subject, o)""")
def claim_acquisition(t):
    states = t("orders").select(F.col("o_orderstatus").alias("object")).distinct()
    key = F.col("c_custkey").cast("string")
    candidates = t("customer").crossJoin(F.broadcast(states)).select(F.concat(F.lit("c"), key, F.lit(":"), "object").alias("candidate_id"), key.alias("subject"), F.lit("order_status").alias("predicate"), "object")
    return V.acquire(candidates, V.verify(V.evaluate(_evidence(t)))).select("candidate_id", "lifecycle")


# Conclusions: one for each order, about its lines as observations; every seventh names a line that does not exist.
def _conclusions(t):
    o = t("orders")
    key, run = F.col("o_orderkey").cast("string"), F.concat(F.lit("r"), (F.col("o_custkey") % 50).cast("string"))
    lines = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))).alias("ids"))
    rows = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    ids = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.coalesce("ids", F.array().cast("array<string>")), F.array(F.lit("none")))).otherwise(F.coalesce("ids", F.array().cast("array<string>")))
    conclusions = rows.select(run.alias("result_id"), F.col("o_orderkey").alias("seq"), key.alias("conclusion_id"), F.concat(F.lit("k"), key).alias("claim_id"), key.alias("text"), key.alias("subject"), F.lit("status").alias("predicate"), F.col("o_orderstatus").alias("object"), F.lit(0.8).alias("confidence"), ids.alias("supporting_observation_ids"))
    named = o.select("o_orderkey", run.alias("result_id"))
    observations = t("lineitem").join(named, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "result_id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("observation_id"), F.lit("lines").alias("tool_name"), F.lit("{}").alias("input"),
        F.to_json(F.struct(F.col("l_returnflag").alias("text"))).alias("output"), F.create_map(F.lit("source_id"), F.col("l_suppkey").cast("string"), F.lit("source_quality"), F.col("l_discount").cast("string")).alias("metadata"), F.lit(None).cast("string").alias("source_reference"),
    )
    results = conclusions.select("result_id").distinct().select("result_id", *[F.lit(n).alias(n) for n in ("session_id", "investigation_id", "task_id", "attempt_id")], F.col("result_id").alias("run_id"))
    return V.extract_candidates(results, conclusions, observations)


_LINES = """l AS (SELECT l_orderkey, l_linenumber, l_orderkey || '-' || l_linenumber AS id, min(row(l_returnflag, CAST(l_suppkey AS VARCHAR), CAST(l_discount AS VARCHAR))) AS m FROM lineitem GROUP BY ALL),
n AS (SELECT l_orderkey, list_sort(list(id)) AS ids FROM l GROUP BY 1), o AS (SELECT o_orderkey, 'r' || o_custkey % 50 AS result_id, ids FROM orders LEFT JOIN n ON o_orderkey = l_orderkey)"""


@query(f"""WITH {_LINES} SELECT result_id, CAST(o_orderkey AS VARCHAR) AS conclusion_id, 'candidate_' || substr(sha256('k' || o_orderkey || chr(31) || array_to_string(ids, chr(31))), 1, 24) AS candidate_id, CAST(len(ids) AS INTEGER) AS evidence FROM o WHERE ids IS NOT NULL AND o_orderkey % 7 <> 0""")
def candidate_claims(t):
    return _conclusions(t).candidates.select("result_id", "conclusion_id", "candidate_id", F.size("supporting_observation_ids").alias("evidence"))


@query(f"""WITH {_LINES} SELECT result_id, CAST(o_orderkey AS VARCHAR) AS conclusion_id, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown_observation_reference' ELSE 'no_supporting_observations' END AS code FROM o WHERE o_orderkey % 7 = 0 OR ids IS NULL""")
def candidate_diagnostics(t):
    return _conclusions(t).diagnostics.select("result_id", "conclusion_id", "code")


@query(f"""WITH {_LINES}, x AS (SELECT result_id, o_orderkey, unnest(ids) AS id FROM o WHERE ids IS NOT NULL AND o_orderkey % 7 <> 0)
SELECT 'evidence_' || substr(sha256('k' || o_orderkey || chr(31) || id), 1, 24) AS evidence_id, m[2] AS source_id, m[1] AS excerpt, round(CAST(m[3] AS DOUBLE), 6) AS source_quality FROM x JOIN l USING (id)""")
def candidate_evidence(t):
    return _conclusions(t).evidence.select("evidence_id", F.col("provenance.source_id").alias("source_id"), "excerpt", F.round("source_quality", 6).alias("source_quality"))


@query(f"""WITH {_DECIDED}, x AS (SELECT claim_id, unnest(list(evidence_id)) AS evidence_id FROM (SELECT z.claim_id, g.evidence_id FROM z JOIN g USING (subject, o) WHERE z.status = 'confirmed' AND g.good AND g.role = 'supporting') GROUP BY 1),
p AS (SELECT claim_id, evidence_id, CAST(substr(evidence_id, 2) AS BIGINT) % 3 = 0 AS held FROM x)
SELECT claim_id, evidence_id, 'unresolved provenance' AS problem FROM p WHERE NOT held""")
def update_problems(t):
    """Evidence of claims that may be committed, whose chain the knowledge base (of every third order) does not hold."""
    o = t("orders").where("o_orderkey % 3 = 0")
    evidence = _evidence(t)
    kept = evidence.join(o.select(F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("evidence_id")), "evidence_id", "left_semi").select("provenance")
    p = kept.select("provenance.*")
    sources = p.select(F.col("source_id").alias("id"), F.col("source_reference").alias("reference")).distinct()
    chunks, documents = p.select(F.col("chunk_id").alias("id"), "document_id").distinct(), p.select(F.col("document_id").alias("id"), "source_id").distinct()
    return V.prepare(V.verify(V.evaluate(evidence)), evidence, sources, documents, chunks)[1]


@query("""WITH b AS (SELECT o_custkey AS id, max(least(1, o_totalprice / 500000)) AS u FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), a AS (SELECT o_custkey AS id, min(least(1, o_totalprice / 500000)) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1),
j AS (SELECT * FROM b FULL JOIN a USING (id)), x AS (SELECT DISTINCT o_orderpriority AS id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000), y AS (SELECT DISTINCT o_orderpriority AS id FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 250000),
s AS (SELECT count(u) AS gaps_before, count(v) AS gaps_after, count(*) FILTER (v IS NULL) AS resolved, count(*) FILTER (u IS NULL) AS discovered, coalesce(sum(u), 0) AS base, coalesce(sum(CASE WHEN v IS NULL THEN u WHEN u IS NOT NULL THEN greatest(0, u - v) END), 0) AS reduced, coalesce(sum(v) FILTER (u IS NULL), 0) AS added FROM j),
i AS (SELECT (SELECT count(*) FROM y WHERE id NOT IN (SELECT id FROM x)) AS n, (SELECT count(*) FROM x) AS w)
SELECT gaps_before, gaps_after, CAST(resolved AS INTEGER) AS resolved, CAST(discovered AS INTEGER) AS discovered, round(reduced, 6) AS uncertainty_reduced, round(least(1, greatest(-1, (reduced - added) / greatest(1, base) - 0.25 * n / greatest(1, w + n))), 6) AS information_gain FROM s, i""")
def progress_report(t):
    o = t("orders")
    doubt = F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0)
    before = o.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("id"), doubt.alias("uncertainty"))
    after = o.where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.min(doubt).alias("uncertainty"))
    conflict = lambda s: o.where((F.col("o_orderstatus") == s) & (F.col("o_totalprice") > 250000)).select(F.col("o_orderpriority").alias("id"))
    return V.progress(before, after, conflict("F"), conflict("O")).select("gaps_before", "gaps_after", F.size("resolved").alias("resolved"), F.size("discovered").alias("discovered"), F.round("uncertainty_reduced", 6).alias("uncertainty_reduced"), F.round("information_gain", 6).alias("information_gain"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN 'user_cancellation' WHEN o_orderkey % 23 = 0 THEN 'system_failure' WHEN o_orderkey % 19 = 0 THEN 'objective_satisfied' WHEN o_orderkey % 5 = 0 AND o_totalprice >= 270000 THEN 'confidence_threshold_reached'
WHEN o_orderkey % 11 >= 9 THEN 'maximum_iterations_reached' WHEN o_totalprice >= 250000 THEN 'budget_exhausted' WHEN o_orderkey % 13 = 0 AND o_orderstatus <> 'O' THEN 'unresolvable_contradiction' WHEN o_orderkey % 4 = 0 OR o_orderkey % 100 < 5 THEN 'no_valuable_investigation' END AS reason FROM orders""")
def termination_decisions(t):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    rows = t("orders").select(
        "o_orderkey", F.lit("PLANNING").alias("state"), (k % 11).alias("iteration"), F.lit(9).alias("most_iterations"), (k % 29 == 0).alias("cancel"), (k % 23 == 0).alias("failure"), (k % 19 == 0).alias("satisfied"), (k % 5).alias("gaps"), (price / 300000.0).alias("confidence"),
        (k % 13 == 0).cast("int").alias("contradictions"), (F.col("o_orderstatus") == "O").alias("resolvable"), F.when(k % 4 != 0, (k % 100) / 100.0).alias("best_score"),
        *[F.lit(0.0).alias(f"used_{n}") for n in ("investigations", "agent_runs", "seconds")], price.alias("used_cost"), *[F.lit(9.0).alias(f"most_{n}") for n in ("investigations", "agent_runs", "seconds")], F.lit(250000.0).alias("most_cost"),
    )
    return V.termination(rows).select("o_orderkey", "reason")
