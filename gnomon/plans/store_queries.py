"""Queries of record stores: upserts, deletes, lookups, merges, logs, and records as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from gnomon.plans.registry import query
from gnomon.sources import stores as S

_LAST = "last AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL)"


def _log(t):
    return t("events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("id"), F.col("event_id").alias("seq"), "value")


def _state(t):
    """Records of the first half of the log."""
    return S.latest(_log(t).where("seq % 2 = 0"))


@query("WITH l AS (SELECT user_id || ':' || event_type AS id, max(event_id) AS seq FROM events GROUP BY 1) SELECT l.id, l.seq, value FROM l JOIN events ON seq = event_id")
def repository_latest(t):
    return S.latest(_log(t))


_HALF = "s AS (SELECT user_id || ':' || event_type AS id, max(event_id) AS seq FROM events WHERE event_id % 2 = 0 GROUP BY 1), r AS (SELECT user_id || ':' || event_type AS id, max(event_id) AS last, min(event_id) AS first FROM events WHERE event_id % 2 = 1 GROUP BY 1)"


@query(f"WITH {_HALF} SELECT id, coalesce(last, seq) AS seq FROM s FULL JOIN r USING (id)")
def repository_upsert(t):
    return S.upsert(_state(t), _log(t).where("seq % 2 = 1")).select("id", "seq")


@query(f"WITH {_HALF} SELECT id, coalesce(seq, first) AS seq FROM s FULL JOIN r USING (id)")
def entity_insert_absent(t):
    return S.insert_absent(_state(t), _log(t).where("seq % 2 = 1")).select("id", "seq")


@query("WITH l AS (SELECT user_id, event_type, user_id || ':' || event_type AS id, max(event_id) AS seq FROM events GROUP BY ALL) SELECT id, seq FROM l WHERE NOT (user_id % 3 = 0 AND event_type = 'view')")
def repository_delete(t):
    gone = t("events").where("user_id % 3 = 0 and event_type = 'view'").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("id"))
    return S.delete(S.latest(_log(t)), gone).select("id", "seq")


@query("SELECT c_custkey AS id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS existed FROM customer")
def repository_get(t):
    return S.existed(t("orders").withColumnRenamed("o_custkey", "id"), t("customer").select("c_custkey"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey = 3")
def repository_by_field(t):
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_nationkey")
    return S.where_equal(rows, c_nationkey=3).select("id", "name")


@query("SELECT 'orders' AS \"table\", count(*) AS rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part")
def store_healthcheck(t):
    return S.healthcheck({n: t(n) for n in ("orders", "customer", "part")})


@query("""WITH n AS (SELECT c_custkey AS id, c_name AS name, 'Firm ' || c_custkey AS canonical, c_mktsegment || ' ' || c_nationkey AS alias FROM customer), k AS (SELECT id, unnest([lower(trim(name)), lower(trim(canonical)), lower(trim(alias))]) AS key FROM n), f AS (SELECT key, min(id) AS id FROM k GROUP BY 1),
a AS (SELECT DISTINCT ' ' || upper(c_name) AS name FROM customer UNION SELECT DISTINCT c_mktsegment || ' ' || c_nationkey FROM customer UNION SELECT 'firm 7')
SELECT a.name, id FROM a JOIN f ON lower(trim(a.name)) = key""")
def entities_by_name(t):
    alias = F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string"))
    c = t("customer")
    entities = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("Firm "), F.col("c_custkey").cast("string")).alias("canonical_name"), F.array(alias).alias("aliases"))
    asked = c.select(F.concat(F.lit(" "), F.upper("c_name")).alias("name")).unionByName(c.select(alias.alias("name"))).unionByName(c.limit(1).select(F.lit("firm 7").alias("name")))
    return S.by_name(entities, asked)


@query("""WITH g AS (SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_regionkey = 2) SELECT 'c' || c_custkey AS id FROM customer WHERE 'nation:' || c_nationkey NOT IN (SELECT id FROM g)""")
def entity_remove_cascade(t):
    """Relations that are left when the nations of a region are removed."""
    nations = t("nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), "n_regionkey")
    relations = t("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("subject_id"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("object_id"))
    return S.remove_entities(nations, relations, nations.where("n_regionkey = 2").select("id"))[1].select("id")


@query("""WITH o AS (SELECT *, CAST(o_custkey % 40 AS VARCHAR) AS s FROM orders), l AS (SELECT s, o_orderpriority, o_orderstatus, min(o_orderkey) AS first, arg_max(o_totalprice, o_orderkey) AS confidence, count(*) AS n, arg_min(o_orderstatus, o_orderkey) AS st,
 list_sort(list(DISTINCT 'p' || o_custkey)) AS provenance, list_sort(list(DISTINCT o_orderstatus || (o_orderkey % 4))) AS source_ids FROM o GROUP BY ALL)
SELECT s AS subject_id, o_orderpriority AS predicate, o_orderstatus AS object_id, first AS id, confidence, CASE WHEN n > 1 THEN 'unverified' ELSE 'supported' END AS verification_state, array_to_string(provenance, ',') AS provenance, array_to_string(source_ids, ',') AS source_ids, '' AS contradicting_evidence FROM l""")
def relation_merge(t):
    k = F.col("o_orderkey")
    log = t("orders").select(
        k.alias("seq"), k.alias("id"), (F.col("o_custkey") % 40).cast("string").alias("subject_id"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object_id"), F.col("o_totalprice").alias("confidence"), F.lit("supported").alias("verification_state"),
        F.array(F.concat(F.lit("p"), F.col("o_custkey").cast("string"))).alias("provenance"), F.array(F.concat("o_orderstatus", (k % 4).cast("string"))).alias("source_ids"), F.array().cast("array<string>").alias("contradicting_evidence"),
    )
    text = lambda c: F.array_join(c, ",").alias(c)
    return S.merge_relations(log).select("subject_id", "predicate", "object_id", "id", "confidence", "verification_state", text("provenance"), text("source_ids"), text("contradicting_evidence"))


@query("SELECT event_id, event_type FROM events WHERE event_id % 2 = 1")
def event_record_once(t):
    """Events twice over, against a log that has every second one."""
    e = t("events").select("event_id", "event_type", F.col("event_id").alias("seq"))
    again = e.unionByName(e.withColumn("event_type", F.lit("repeat")).withColumn("seq", F.col("seq") + 1_000_000_000))
    return S.record_once(e.where("event_id % 2 = 0"), again).select("event_id", "event_type")


@query("SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, props AS payload FROM events")
def checkpoint_versions(t):
    return S.checkpoints(t("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.col("props").alias("payload")))


@query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer")
def codec_round_trip(t):
    """Records to JSON and back, beside records of another type."""
    rows = t("customer").select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    both = S.to_plain(rows, "Customer").unionByName(S.to_plain(t("nation"), "Nation"))
    return S.from_plain(both, {"Customer": "c_custkey bigint, c_name string, c_acctbal double, segment string", "Nation": "n_nationkey int"}, "Customer")


@query("""SELECT o_custkey AS session_id, o_orderstatus AS kind, arg_max(o_orderpriority, o_orderkey) AS payload, max(o_orderkey) AS seq FROM orders GROUP BY ALL""")
def artifacts_latest(t):
    return S.artifacts_latest(t("orders").select(F.col("o_custkey").alias("session_id"), F.lit(1).alias("iteration"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("payload")))
