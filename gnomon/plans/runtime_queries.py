"""Queries of tasks, workers, agents and events. Every order is a task whose commands follow from its numbers, so that SQL can say what must become of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from gnomon.operators import tasks as T
from gnomon.plans.registry import query

_POLICY = T.RetryPolicy(most_attempts=2, initial=4.0)


def _none():
    return F.lit(None).cast("string")


def _commands(t):
    """Each task is submitted (with a deadline, if k % 8 = 0) and claimed for 10 seconds at 1, unless k % 8 = 7; started, answered
    k % 16 seconds later, swept at 30, queued again at 40, cancelled at 45 if k % 10 = 9, and its deadline looked at at 50."""
    k = F.col("o_orderkey")
    task, lease = F.concat(F.lit("t"), k.cast("string")), F.concat(F.lit("l"), k.cast("string"))
    bad = F.when(k % 3 == 0, "TRANSIENT").when(k % 3 == 1, "PERMANENT")
    def command(seq, at, name, when=None, worker="w", failure=None, text=None, seconds=None):
        return F.struct(F.lit(seq).cast("long").alias("seq"), at.cast("double").alias("at"), F.lit(name).alias("command"), F.lit(worker).alias("worker"), lease.alias("lease"), (_none() if failure is None else failure).alias("failure"), (_none() if text is None else text).alias("text"), (F.lit(None) if seconds is None else seconds).cast("double").alias("seconds"), (F.lit(True) if when is None else when).alias("when"))

    done = F.lit(3) + k % 16
    rows = t("orders").select(task.alias("task_id"), F.inline(F.array(
        command(0, F.lit(0), "submit", seconds=F.when(k % 8 == 0, 48)),
        command(1, F.lit(1), "claim", k % 8 != 7, seconds=F.lit(10)),
        command(2, F.lit(2), "start", k % 8 != 7),
        command(3, done, "complete", (k % 8 != 7) & (k % 4 != 3), text=lease),
        command(4, done, "fail", (k % 8 != 7) & (k % 4 == 3), failure=F.coalesce(bad, F.lit("CANCELLED")), text=F.lit("broken")),
        command(5, F.lit(30), "release"),
        command(6, F.lit(40), "due"),
        command(7, F.lit(45), "cancel", k % 10 == 9),
        command(8, F.lit(50), "expire"),
    )))
    return rows.where(F.col("when")).drop("when")


_TASKS = """k AS (SELECT o_orderkey AS k FROM orders), a AS (SELECT k, k % 8 <> 7 AS claimed, k % 16 < 8 AS intime, k % 4 = 3 AS fails, k % 3 AS kind, k % 10 = 9 AS cancels, k % 8 = 0 AS dead FROM k),
b AS (SELECT *, CASE WHEN NOT claimed THEN 'QUEUED' WHEN intime AND NOT fails THEN 'SUCCEEDED' WHEN intime AND kind = 0 THEN 'RETRY' WHEN intime AND kind = 1 THEN 'DEAD_LETTERED' WHEN intime THEN 'CANCELLED' ELSE 'LOST' END AS s FROM a),
z AS (SELECT *, CASE WHEN s IN ('SUCCEEDED', 'DEAD_LETTERED', 'CANCELLED') THEN s WHEN cancels THEN 'CANCELLED' WHEN dead THEN 'DEAD_LETTERED' ELSE 'QUEUED' END AS state FROM b)"""


@query(f"""WITH {_TASKS} SELECT 't' || k AS task_id, state, CAST(CASE WHEN claimed THEN 1 ELSE 0 END AS BIGINT) AS attempt, CASE WHEN s = 'SUCCEEDED' THEN 'l' || k END AS result_ref,
CASE WHEN s IN ('RETRY', 'LOST', 'QUEUED') AND state = 'DEAD_LETTERED' THEN 'task deadline expired' WHEN s IN ('RETRY', 'DEAD_LETTERED') THEN 'broken' WHEN s = 'LOST' THEN 'lease expired' END AS error FROM z""")
def task_states(t):
    return T.current(T.fold(_commands(t), _POLICY)).select("task_id", "state", "attempt", "result_ref", "error")


@query(f"WITH {_TASKS} SELECT 't' || k AS task_id, CASE WHEN fails THEN 'fail' ELSE 'complete' END AS command, 'lease is stale' AS note FROM z WHERE s = 'LOST'")
def task_late_answers(t):
    return T.fold(_commands(t), _POLICY).where("command in ('complete', 'fail') and not accepted").select("task_id", "command", "note")


@query(f"""WITH {_TASKS}, n AS (SELECT state, count(*) AS tasks FROM z GROUP BY 1), s AS (SELECT unnest(['QUEUED', 'CLAIMED', 'RUNNING', 'FAILED', 'RETRY_WAIT', 'CANCEL_REQUESTED', 'DEAD_LETTERED', 'SUCCEEDED', 'CANCELLED']) AS state)
SELECT state, coalesce(tasks, 0) AS tasks FROM s LEFT JOIN n USING (state) UNION ALL SELECT 'depth', count(*) FROM z WHERE state = 'QUEUED'""")
def queue_stats(t):
    return T.queue_stats(T.current(T.fold(_commands(t), _POLICY)))


_TABLE = """w AS (SELECT 't' || o_orderkey AS task_id, ['QUEUED', 'CLAIMED', 'RUNNING', 'RETRY_WAIT', 'CANCEL_REQUESTED', 'SUCCEEDED'][1 + o_orderkey % 6] AS state, CAST(o_orderkey % 3 AS BIGINT) AS attempt, CASE WHEN o_orderkey % 6 IN (1, 2, 4) THEN (o_orderkey % 100)::DOUBLE END AS lease_until, (o_orderkey % 90)::DOUBLE AS available_at,
CASE WHEN o_orderkey % 7 = 0 THEN (o_orderkey % 110)::DOUBLE END AS deadline, CASE WHEN o_orderkey % 6 IN (1, 2, 4) THEN 'w' || o_orderkey % 10 END AS worker FROM orders)"""


def _table(t):
    k = F.col("o_orderkey")
    states = F.array(*[F.lit(s) for s in ("QUEUED", "CLAIMED", "RUNNING", "RETRY_WAIT", "CANCEL_REQUESTED", "SUCCEEDED")])
    held = (k % 6).isin(1, 2, 4)
    worker = F.when(held, F.concat(F.lit("w"), (k % 10).cast("string")))
    return t("orders").select(F.concat(F.lit("t"), k.cast("string")).alias("task_id"), F.element_at(states, (k % 6 + 1).cast("int")).alias("state"), (k % 3).alias("attempt"), F.when(held, (k % 100).cast("double")).alias("lease_until"), (k % 90).cast("double").alias("available_at"), F.when(k % 7 == 0, (k % 110).cast("double")).alias("deadline"), worker.alias("worker"), worker.alias("lease"), _none().alias("error"))


@query(f"""WITH {_TABLE}, s AS (SELECT *, CASE WHEN state IN ('QUEUED', 'RETRY_WAIT') AND deadline <= 50 THEN 'deadline' WHEN state = 'RETRY_WAIT' AND available_at <= 50 THEN 'retry' WHEN lease_until <= 50 AND state = 'CANCEL_REQUESTED' THEN 'cancelled' WHEN lease_until <= 50 AND attempt >= 2 THEN 'dead' WHEN lease_until <= 50 THEN 'waits' END AS swept FROM w)
SELECT task_id, CASE WHEN swept IN ('deadline', 'dead') THEN 'DEAD_LETTERED' WHEN swept = 'retry' THEN 'QUEUED' WHEN swept = 'cancelled' THEN 'CANCELLED' WHEN swept = 'waits' THEN 'RETRY_WAIT' ELSE state END AS state, CASE WHEN swept = 'waits' THEN 54.0 ELSE available_at END AS available_at,
CASE WHEN swept IN ('cancelled', 'dead', 'waits') THEN NULL ELSE worker END AS worker, CASE WHEN swept = 'deadline' THEN 'task deadline expired' WHEN swept IN ('dead', 'waits') THEN 'lease expired' END AS error FROM s""")
def task_recovery(t):
    return T.recovery(_table(t), F.lit(50.0), _POLICY).select("task_id", "state", "available_at", "worker", "error")


@query(f"WITH {_TABLE} SELECT 'queued' AS list, task_id FROM w WHERE state = 'QUEUED' AND available_at <= 50 AND (deadline IS NULL OR deadline > 50) UNION ALL SELECT 'expired', task_id FROM w WHERE lease_until <= 50 UNION ALL SELECT 'w3', task_id FROM w WHERE worker = 'w3'")
def task_lists(t):
    w, now = _table(t), F.lit(50.0)
    name = lambda df, n: df.select(F.lit(n).alias("list"), "task_id")
    return name(T.queued(w, now), "queued").unionByName(name(T.expired(w, now), "expired")).unionByName(name(T.of_worker(w, "w3"), "w3"))


@query("""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'unknown task' WHEN o_orderkey % 5 = 0 THEN 'version conflict' WHEN o_orderkey % 3 = 0 THEN 'coordination fields require a command' END AS note FROM orders)
SELECT 't' || o_orderkey AS task_id, note FROM p WHERE note IS NOT NULL""")
def task_update_conflicts(t):
    k = F.col("o_orderkey")
    base = t("orders").select(k.alias("k"), F.concat(F.lit("t"), k.cast("string")).alias("task_id"), F.lit(4).cast("long").alias("version"), F.lit("QUEUED").alias("state"), F.lit(0).alias("priority"))
    changed = base.withColumns({"version": F.when(F.col("k") % 5 == 0, F.lit(3).cast("long")).otherwise(F.col("version")), "state": F.when(F.col("k") % 3 == 0, "RUNNING").otherwise("QUEUED"), "priority": F.lit(100)})
    return T.update_if(base.where("k % 11 <> 0").drop("k"), changed.drop("k"))[1].select("task_id", "note")


@query("""SELECT 't' || o_orderkey AS task_id, CASE WHEN o_orderkey % 7 = 0 THEN 'run_id and correlation_id are required' WHEN o_orderkey % 5 = 0 THEN 'deadline is not after creation' WHEN o_orderkey % 3 = 0 THEN 'blank capability' WHEN o_orderkey % 2 = 0 THEN 'metadata is not JSON' END AS problem FROM orders""")
def task_validation(t):
    k = F.col("o_orderkey")
    rows = t("orders").select(F.concat(F.lit("t"), k.cast("string")).alias("task_id"), F.when(k % 7 == 0, " ").otherwise("r").alias("run_id"), F.lit("c").alias("correlation_id"), F.array(F.lit("search"), F.when(k % 3 == 0, "").otherwise("x")).alias("capabilities"), F.when(k % 2 == 0, "{").otherwise('{"a": 1}').alias("metadata"), F.lit(10.0).alias("created"), F.when(k % 5 == 0, 9.0).alias("deadline"))
    return T.valid_tasks(rows).select("task_id", "problem")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= 970 AS accepted FROM orders")
def task_admission(t):
    rows = t("orders").select("o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("seq"))
    return T.admit(rows, 30, 1000).select("o_orderkey", "accepted")


_AGED = """q AS (SELECT 't' || o_orderkey AS task_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) * 10 + CAST(floor(greatest(0, 1000 - o_orderkey % 1200) / 60.0::DOUBLE) AS BIGINT) AS effective, (o_orderkey % 1200)::DOUBLE AS created FROM orders WHERE o_orderkey % 100 <= 50 AND (o_orderkey % 9 <> 0 OR o_orderkey % 2000 > 1000) AND o_orderkey % 4 <> 3)"""


def _waiting(t):
    k = F.col("o_orderkey")
    return t("orders").select(F.concat(F.lit("t"), k.cast("string")).alias("task_id"), (F.substring("o_orderpriority", 1, 1).cast("long") * 10).alias("priority"), (k % 1200).cast("double").alias("created"), (F.lit(950.0) + k % 100).alias("available_at"), F.when(k % 9 == 0, (k % 2000).cast("double")).alias("deadline"), F.when(k % 4 == 3, F.array(F.lit("rare"))).otherwise(F.array(F.lit("search"))).alias("capabilities"))


@query(f"WITH {_AGED} SELECT task_id, effective, row_number() OVER (ORDER BY effective DESC, created, task_id) AS rank FROM q")
def task_rank(t):
    return T.rank(_waiting(t), F.lit(1000.0), ["search", "verification"]).select("task_id", "effective", "rank")


@query(f"WITH {_AGED} SELECT task_id, effective FROM q ORDER BY effective DESC, created, task_id LIMIT 25")
def task_claims(t):
    """The 25 tasks that a worker of that many slots would claim."""
    return T.rank(_waiting(t), F.lit(1000.0), ["search", "verification"], top=25).select("task_id", "effective")


@query("""WITH d AS (SELECT 't' || o_orderkey AS task_id, o_orderkey % 5 AS n, sha256('t' || o_orderkey || ':' || o_orderkey % 5) AS h FROM orders), u AS (SELECT task_id, n, ('0x' || substr(h, 1, 16))::UBIGINT::DOUBLE / 18446744073709551615.0::DOUBLE AS unit FROM d)
SELECT task_id, round(least(10, least(10, 2.0::DOUBLE * pow(2, greatest(0, n - 1))) * (0.75::DOUBLE + 0.5::DOUBLE * unit)), 6) AS delay FROM u""")
def retry_delays(t):
    k = F.col("o_orderkey")
    task = F.concat(F.lit("t"), k.cast("string"))
    policy = T.RetryPolicy(initial=2.0, longest=10.0, jitter=0.25)
    return t("orders").select(task.alias("task_id"), F.round(policy.delay_column(task, k % 5), 6).alias("delay"))


# Workers: registered at 0, tasks assigned by threes, sometimes drained, checked at 100 after a heartbeat of some at 80.
@query("""SELECT 'w' || s_suppkey AS worker, CASE WHEN s_suppkey % 5 = 0 THEN 'DRAINING' WHEN s_suppkey % 2 = 0 THEN 'BUSY' ELSE 'UNHEALTHY' END AS status, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 3 END AS INTEGER) AS tasks FROM supplier WHERE NOT (s_suppkey % 5 = 0 AND s_suppkey % 2 = 1)
UNION ALL SELECT 'w' || s_suppkey, 'UNHEALTHY', CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 3 END FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey % 2 = 1""")
def worker_states(t):
    k = F.col("s_suppkey")
    def command(seq, at, name, text=None, number=None, when=None):
        return F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(float(at)).alias("at"), F.lit(name).alias("command"), (_none() if text is None else text).alias("text"), F.lit(number).cast("long").alias("number"), (F.lit(True) if when is None else when).alias("when"))

    steps = [command(0, 0, "register", number=3), *[command(i, i, "assign", F.lit(f"t{i}")) for i in range(1, 5)], command(5, 10, "release", F.lit("t1"), when=k % 3 == 0), command(6, 20, "drain", when=k % 5 == 0), command(7, 80, "heartbeat", when=k % 2 == 0), command(8, 100, "check")]
    rows = t("supplier").select(F.concat(F.lit("w"), k.cast("string")).alias("worker"), F.inline(F.array(*steps))).where(F.col("when"))
    out = T.fold_workers(rows, 30.0)
    last = out.groupBy("worker").agg(F.max_by(F.struct("status", "tasks"), "seq").alias("s"))
    return last.select("worker", F.col("s.status").alias("status"), F.size("s.tasks").alias("tasks"))


@query("""SELECT count(*) AS workers, CAST(sum(s_suppkey % 4) AS BIGINT) AS capacity, CAST(sum(s_suppkey % 3) AS BIGINT) AS running, round(sum(s_suppkey % 3) / sum(s_suppkey % 4), 9) AS utilization FROM supplier""")
def runtime_stats(t):
    return T.runtime_stats(t("supplier").select(F.col("s_suppkey").alias("worker"), (F.col("s_suppkey") % 4).alias("capacity"), (F.col("s_suppkey") % 3).alias("running"))).withColumn("utilization", F.round("utilization", 9))


@query("SELECT 's' || s_suppkey AS subject, s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 AS authorized FROM supplier")
def worker_authorization(t):
    k = F.col("s_suppkey")
    subject = F.concat(F.lit("s"), k.cast("string"))
    mine = t("supplier").select(subject.alias("subject"), F.when(k % 3 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("capabilities"))
    grants = t("supplier").where("s_suppkey % 2 = 0").select(subject.alias("subject"), F.array(F.lit("a"), F.lit("b")).alias("capabilities"))
    return T.authorized(mine, grants).select("subject", "authorized")


# Events and agents.
@query("""WITH s AS (SELECT * FROM (VALUES ('view', 's1'), ('*', 's2'), ('view', 's3'), ('click', 's4')) v(topic, sub)) SELECT event_id, event_type AS topic, sub AS subscription_id FROM events JOIN s ON s.topic = event_type OR s.topic = '*'""")
def event_deliveries(t):
    subs = t.spark.createDataFrame([("view", "s1"), ("*", "s2"), ("view", "s3"), ("click", "s4")], "topic string, subscription_id string")
    return T.deliveries(t("events").select("event_id", F.concat("event_type", F.lit(".done")).alias("event_type")), subs)


def _refuse(event: dict) -> None:
    if event["event_id"] % 10 == 0:
        raise ValueError(event["event_id"])


@query("""SELECT event_id, 'picky' AS subscription_id, event_id % 10 <> 0 AS ok, CASE WHEN event_id % 10 = 0 THEN 'subscriber failed: ValueError(' || event_id || ')' END AS reason FROM events UNION ALL SELECT event_id, 'views', true, NULL FROM events WHERE event_type = 'view'""")
def event_dispatch(t):
    return T.dispatch(t("events").select("event_id", "event_type"), {"picky": ("*", _refuse), "views": ("view", len)})


@query("""WITH RECURSIVE r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 > 0 AND c_custkey - 1 IN (SELECT c_custkey FROM customer) THEN c_custkey - 1 END AS p FROM customer), d AS (SELECT k, k AS root, 0 AS depth FROM r WHERE p IS NULL UNION ALL SELECT r.k, root, depth + 1 FROM r JOIN d ON p = d.k)
SELECT k AS run_id, root AS root_run_id, depth FROM d""")
def run_lineage(t):
    ids = t("customer").select(F.col("c_custkey").alias("run_id"))
    known = ids.select(F.col("run_id").alias("p"), F.lit(True).alias("known"))
    runs = ids.withColumn("p", F.when(F.col("run_id") % 4 > 0, F.col("run_id") - 1)).join(known, "p", "left").select("run_id", F.when(F.col("known"), F.col("p")).alias("parent_run_id"))
    return T.lineage(runs).select("run_id", "root_run_id", "depth")


@query("""SELECT 'r' || c_custkey AS parent_run_id, CAST(c_custkey % 5 + 1 AS INTEGER) AS depth, CASE WHEN c_custkey % 3 = 0 THEN 'parent run is not running' WHEN c_custkey % 5 = 4 THEN 'deeper than 4' END AS problem FROM customer""")
def run_delegations(t):
    k = F.col("c_custkey")
    run = F.concat(F.lit("r"), k.cast("string"))
    parents = t("customer").select(run.alias("run_id"), F.when(k % 3 == 0, "PAUSED").otherwise("RUNNING").alias("state"), (k % 5).cast("int").alias("depth"), _none().alias("root_run_id"))
    asked = t("customer").select(run.alias("parent_run_id"), F.lit("a").alias("agent_id"), F.lit("look").alias("task"), k.alias("seq"))
    return T.delegations(parents, asked).select("parent_run_id", "depth", "problem")


@query("""WITH s AS (SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seq FROM conversations), u AS (SELECT conv_id, seq, role, sum(n) OVER (PARTITION BY conv_id, role ORDER BY seq) AS used FROM s)
SELECT conv_id AS run_id, seq, role AS kind, CAST(used AS BIGINT) AS used, used > CASE role WHEN 'user' THEN 500 ELSE 900 END AS paused FROM u""")
def budget_use(t):
    from pyspark.sql import Window as W

    seq = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    usage = t("conversations").select(F.col("conv_id").alias("run_id"), seq.alias("seq"), F.col("role").alias("kind"), F.length("text").cast("long").alias("amount"))
    limits = usage.select("run_id", "kind").distinct().withColumn("most", F.when(F.col("kind") == "user", 500).otherwise(900))
    return T.budget_use(usage, limits)


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unknown tool' WHEN event_id % 5 = 0 THEN 'input must be an object' WHEN event_id % 3 = 0 THEN 'input does not match required fields' END AS problem,
CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 3 = 0 THEN NULL WHEN user_id % 2 = 1 THEN 'DENY' WHEN event_type = 'error' THEN 'REQUIRE_APPROVAL' ELSE 'ALLOW' END AS decision FROM events""")
def tool_calls(t):
    e, k = t("events"), F.col("event_id")
    calls = e.select("event_id", F.col("user_id").alias("principal"), F.when(k % 7 == 0, "nothing").otherwise(F.col("event_type")).alias("tool"), F.when(k % 5 == 0, "[1]").when(k % 3 == 0, '{"limit": 2}').otherwise('{"query": "x"}').alias("input"))
    kinds = e.select("event_type").distinct()
    tools = kinds.select(F.col("event_type").alias("tool"), F.lit("search").alias("capability"), F.when(F.col("event_type") == "error", "destructive").otherwise("read").alias("side_effect"), F.array(F.lit("query")).alias("required"))
    grants = e.where("user_id % 2 = 0").select(F.col("user_id").alias("principal"), F.lit("search").alias("capability")).distinct()
    return T.tool_calls(calls, tools, grants, []).select("event_id", "problem", "decision")


@query("""SELECT event_id AS result_id, 'about ' || event_type AS text, 0.5::DOUBLE + (event_id % 2) * 0.25 AS confidence, CAST(event_id % 3 AS INTEGER) AS observations FROM events UNION ALL SELECT event_id, 'plain', 0.5, 0 FROM events WHERE event_id % 4 = 0""")
def agent_conclusions(t):
    return T.parse_conclusions(_outputs(t))[0].select("result_id", "text", "confidence", F.size("supporting_observation_ids").alias("observations"))


@query("""SELECT event_id AS result_id, 1 AS index, 'conclusion must be an object' AS reason FROM events UNION ALL SELECT event_id, 2, CASE event_id % 4 WHEN 1 THEN 'claim must be an object' WHEN 2 THEN 'claim object must be a text' ELSE 'conclusion confidence must be numeric' END FROM events WHERE event_id % 4 > 0""")
def agent_conclusions_malformed(t):
    return T.parse_conclusions(_outputs(t))[1].select("result_id", "index", "reason")


def _outputs(t):
    k = F.col("event_id")
    claim = '{"text": "plain", "subject": "s", "predicate": "p", "object": "o"}'
    ids = F.when(k % 3 == 0, "[]").when(k % 3 == 1, '["a"]').otherwise('["a", "b"]')
    sure = F.when(k % 2 == 0, "0.5").otherwise("0.75")
    first = F.concat(F.lit('{"claim": {"text": "about '), "event_type", F.lit('", "subject": "s", "predicate": "p", "object": "o"}, "confidence": '), sure, F.lit(', "supporting_observation_ids": '), ids, F.lit("}"))
    third = F.when(k % 4 == 0, '{"claim": ' + claim + "}").when(k % 4 == 1, '{"claim": "x"}').when(k % 4 == 2, '{"claim": {"text": "plain", "subject": "s", "predicate": "p", "object": " "}}').otherwise('{"claim": ' + claim + ', "confidence": true}')
    return t("events").select(k.alias("result_id"), F.concat(F.lit('{"conclusions": ['), first, F.lit(", 5, "), third, F.lit("]}")).alias("output"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'POLICY_VIOLATION' WHEN event_id % 3 = 1 THEN 'BUDGET_EXHAUSTED' ELSE 'TRANSIENT' END AS failure FROM events")
def failure_classes(t):
    k = F.col("event_id")
    error = F.when(k % 3 == 0, "tool Denied by Policy").when(k % 3 == 1, "token budget exhausted").otherwise("socket closed")
    return t("events").select("event_id", T.failure_class(error).alias("failure"))


@query("""WITH c AS (SELECT event_type AS name, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1) SELECT name, value FROM c UNION ALL SELECT 'success_rate', round(max(value) FILTER (name = 'purchase') / max(value) FILTER (name = 'click'), 9) FROM c""")
def investigation_metrics(t):
    from gnomon.operators.runtime import counters

    return counters(t("events").select(F.col("event_type").alias("name"), F.lit(1).alias("amount")), "purchase", "click")
