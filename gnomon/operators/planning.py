"""Planning of investigations: candidates from gaps, scores, forecast, selection under a budget, plans and their execution in waves.

Gaps are rows (id, kind, description, reason, affected_entities, uncertainty, importance, estimated_cost, priority,
candidates): candidates is an array of (id, description, target_entities, estimated_cost, metadata as a map of strings).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gnomon.functions.storage import cut_lineage
from gnomon.functions.text import clamp, stable_id
from gnomon.operators.evidence import number_hint
from gnomon.operators.knowledge import expected_gain

# What each kind of gap asks for.
CAPABILITIES = {
    "missing_relation": ["graph_reasoning", "search"],
    "low_confidence": ["search", "verification"],
    "unsupported_claim": ["search", "verification"],
    "contradiction": ["criticism", "verification"],
    "stale": ["search", "verification"],
    "disconnected_entity": ["graph_reasoning", "search"],
    "missing_evidence": ["document_analysis", "search"],
    "anomalous_region": ["criticism", "graph_reasoning"],
    "low_diversity": ["search", "verification"],
}
EVIDENCE = {
    "missing_relation": ["direct relational evidence", "independent source"],
    "low_confidence": ["independent supporting or refuting evidence"],
    "unsupported_claim": ["source-backed claim evidence"],
    "contradiction": ["independent evidence for each conflicting claim"],
    "stale": ["current dated source"],
    "disconnected_entity": ["entity relationship evidence"],
    "missing_evidence": ["traceable primary or secondary source"],
    "anomalous_region": ["independent explanation of the anomaly"],
    "low_diversity": ["evidence from a distinct source"],
}
# What benefits and penalties count.
BENEFITS = {"information_gain": 0.25, "gap_importance": 0.15, "uncertainty_reduction": 0.15, "evidence_availability": 0.10, "priority": 0.10, "knowledge_score": 0.10}
PENALTIES = {"cost": 0.05, "time": 0.03, "risk": 0.04, "redundancy": 0.08}
CANDIDATE = "array<struct<id:string,description:string,target_entities:array<string>,estimated_cost:double,metadata:map<string,string>>>"
OPEN = ("QUEUED", "CLAIMED", "RUNNING", "FAILED", "RETRY_WAIT", "CANCEL_REQUESTED")


def _by_kind(table: dict[str, list[str]], default: str) -> Column:
    out = None
    for kind, values in table.items():
        value = F.array(*[F.lit(v) for v in values])
        out = F.when(F.col("kind") == kind, value) if out is None else out.when(F.col("kind") == kind, value)
    return out.otherwise(F.array(F.lit(default)))


def candidates(gaps: DataFrame, question: str = "", objective_id: str = "") -> DataFrame:
    """Candidate investigations: one for each candidate of a gap, or one for a gap without any. Equal ones count once.

    Their id is a hash of the gap, the question and the evidence and entities asked for; risk, duration, availability of
    evidence, channel and redundancy_key may be given in a candidate's metadata.
    """
    rows = gaps.withColumn("c", F.explode_outer("candidates"))
    said = F.coalesce("c.description", "description")
    asked = F.concat(F.regexp_replace(F.regexp_replace(said, r"^\s+|\s+$", ""), r"[.?]+$", ""), F.lit("?"))
    none = F.array().cast("array<string>")
    targets = F.when(F.size(F.coalesce("c.target_entities", none)) > 0, F.col("c.target_entities")).otherwise(F.coalesce("affected_entities", none))
    meta = F.coalesce("c.metadata", F.create_map().cast("map<string,string>"))
    cost = F.when(F.coalesce("c.estimated_cost", F.lit(0.0)) > 0, F.col("c.estimated_cost")).otherwise(F.col("estimated_cost"))
    risk = F.coalesce(F.try_element_at(meta, F.lit("risk")).try_cast("double"), F.when(F.col("kind") == "contradiction", 0.7).otherwise(0.2))
    rows = rows.select(
        F.col("id").alias("gap_id"), "kind", "reason", "importance", "uncertainty", asked.alias("question"), F.concat(F.lit("Evidence addressing '"), "description", F.lit(f"' will reduce uncertainty for '{question}'.")).alias("hypothesis"),
        _by_kind(EVIDENCE, "independent provenance-complete evidence").alias("required_evidence"), _by_kind(CAPABILITIES, "search").alias("capabilities"), targets.alias("target_entities"),
        expected_gain(F.col("kind"), F.col("importance"), F.col("uncertainty")).alias("gain"), clamp(F.col("uncertainty")).alias("reduction"), F.greatest(F.lit(0.0), cost).alias("cost"),
        number_hint(meta, "estimated_duration_seconds", 60.0, unit=False).alias("seconds"), clamp(risk).alias("risk"), clamp(F.col("priority")).alias("priority"), number_hint(meta, "evidence_availability", 0.5).alias("availability"),
        F.coalesce(F.try_element_at(meta, F.lit("evidence_channel")), F.lit("")).alias("channel"), F.nullif(F.trim(F.try_element_at(meta, F.lit("redundancy_key"))), F.lit("")).alias("explicit"), F.col("c.id").alias("source_id"),
    )
    need = [F.to_json("required_evidence"), F.to_json("target_entities")]
    key = F.coalesce("explicit", stable_id("evidence-need", F.col("gap_id"), *need, F.col("channel")))
    rows = rows.withColumn("redundancy_key", key).withColumn("id", stable_id("candidate", F.lit(objective_id), F.col("gap_id"), F.col("question"), *need))
    first = F.row_number().over(W.partitionBy("id").orderBy("gap_id", "question", "source_id"))
    return rows.withColumn("nth", first).where("nth = 1").drop("nth", "explicit")


def score(rows: DataFrame, check: DataFrame | None = None) -> DataFrame:
    """Candidates with redundancy and score (0 to 1): six benefits less four penalties.

    check: gaps, if candidates of unknown gaps are to be an error.
    """
    if check is not None and not rows.join(check.select(F.col("id").alias("gap_id")), "gap_id", "left_anti").isEmpty():
        raise ValueError("candidates of unknown gaps")
    many = rows.groupBy("redundancy_key").agg(F.count("*").alias("many"))
    rows = rows.join(many, "redundancy_key")
    known = F.col("gain") * clamp(F.col("importance")) * F.col("reduction") / F.greatest("cost", F.lit(1e-6))
    parts = {
        "information_gain": F.col("gain"), "gap_importance": clamp(F.col("importance")), "uncertainty_reduction": F.col("reduction"), "evidence_availability": F.col("availability"), "priority": F.col("priority"), "knowledge_score": known / (1.0 + known),
        "cost": F.col("cost") / (1.0 + F.col("cost")), "time": F.col("seconds") / (F.col("seconds") + 300.0), "risk": F.col("risk"), "redundancy": F.col("redundancy"),
    }
    total = F.lit(0.0)
    for name, weight in BENEFITS.items():
        total = total + weight * parts[name]
    for name, weight in PENALTIES.items():
        total = total - weight * parts[name]
    return rows.withColumn("redundancy", (F.col("many") - 1) / F.col("many")).withColumn("score", clamp(total)).drop("many")


def forecast(scored: DataFrame) -> DataFrame:
    """One row: what all scored candidates promise, weighted by their scores, and what they cost."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    sums = scored.agg(zero(F.col("gain") * F.col("score")).alias("g"), zero(F.col("reduction") * F.col("score")).alias("r"), zero("cost").alias("c"))
    return sums.select(F.round("g", 6).alias("expected_information_gain"), F.round("r", 6).alias("expected_uncertainty_reduction"), F.round("c", 6).alias("estimated_cost"), F.round(F.when(F.col("c") != 0, F.col("g") / F.col("c")).otherwise(F.col("g")), 6).alias("information_gain_per_cost"))


@dataclass(frozen=True)
class Budget:
    """What a session may use at most, and (used) what it has used."""

    iterations: int = 10
    investigations: int = 100
    agent_runs: int = 100
    cost: float = 1000.0
    seconds: float = 3600.0


def select(scored: DataFrame, budget: Budget, used: Budget = Budget(0, 0, 0, 0.0, 0.0), workers: int = 1, top: int | None = None, least: float = 0.0, block: int = 10_000) -> DataFrame:
    """Candidates with selected and reason, best score first, as long as limits, needs, cost and time allow.

    A candidate that is passed over uses nothing up, so every decision needs those before it. What is left is read in blocks in
    the order of score, without those whose need is taken or that no longer fit: what is spent only grows, so none of them can
    be chosen later. The first of each block is chosen, so there are at most `limit` blocks and one that is empty. At most
    `limit` candidates and a block are ever held.
    """
    if workers < 1 or (top is not None and top < 1):
        raise ValueError("workers and top must be positive")
    scored = cut_lineage(scored)
    limit = min(x for x in (workers, max(0, budget.investigations - used.investigations), max(0, budget.agent_runs - used.agent_runs), top) if x is not None)
    money, seconds = max(0.0, budget.cost - used.cost), max(0.0, budget.seconds - used.seconds) * workers
    spark = scored.sparkSession
    ordered = scored.select("id", "redundancy_key", "cost", "seconds", "score").withColumn("less", -F.col("score"))
    chosen, keys, spent, took, after = [], set(), 0.0, 0.0, None
    while len(chosen) < limit:
        # The sums are made in the order of the sums below, so that they agree in every bit.
        rest = ordered.where((F.col("score") >= least) & (F.lit(spent) + F.col("cost") <= money) & (F.lit(took) + F.col("seconds") <= seconds))
        if keys:
            rest = rest.join(F.broadcast(spark.createDataFrame([(k,) for k in keys], "redundancy_key string")), "redundancy_key", "left_anti")
        if after is not None:
            rest = rest.where((F.col("less") > after[0]) | ((F.col("less") == after[0]) & (F.col("id") > after[1])))
        rows = rest.sort("less", "id").limit(block).collect()
        for r in rows:
            if len(chosen) < limit and r["redundancy_key"] not in keys and spent + r["cost"] <= money and took + r["seconds"] <= seconds:
                chosen.append((r["id"], r["less"], r["cost"], r["seconds"], r["redundancy_key"]))
                keys.add(r["redundancy_key"])
                spent, took = spent + r["cost"], took + r["seconds"]
        if len(rows) < block:
            break
        after = (rows[-1]["less"], rows[-1]["id"])
    # The reason of every other candidate, from what had been chosen when its turn came: `n` of the turns, at what cost. Nearly
    # all candidates come after the last turn, so only the others look through the turns.
    key = spark.createDataFrame([(k, (s, i)) for i, s, _, _, k in chosen], "redundancy_key string, taken struct<less:double,id:string>")
    costs = [0.0, *accumulate(c for _, _, c, _, _ in chosen)]
    turns = spark.createDataFrame([([(s, i) for i, s, *_ in chosen], costs)], "turns array<struct<less:double,id:string>>, costs array<double>")
    rows = scored.withColumn("less", -F.col("score")).join(F.broadcast(key), "redundancy_key", "left").crossJoin(F.broadcast(turns))
    me = F.struct("less", "id")
    rows = rows.withColumn("n", F.when(F.try_element_at("turns", F.lit(-1)) < me, len(chosen)).otherwise(F.size(F.filter("turns", lambda x: x < me))))
    reason = F.when(F.col("taken.id") == F.col("id"), None).when(F.col("n") >= limit, "selection_limit").when(F.col("score") < least, "below_minimum_score")
    reason = reason.when(F.col("taken") < me, "redundant_evidence_need").when(F.element_at("costs", F.col("n") + 1) + F.col("cost") > money, "cost_budget").otherwise("execution_time_budget")
    return rows.withColumn("reason", reason).withColumn("selected", F.col("reason").isNull()).drop("less", "taken", "turns", "costs", "n")


# Plans: nodes (id) and edges (parent, id).
def plan_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, problem: ids that occur twice, dependencies that are unknown or on oneself, and nodes on or behind a cycle."""
    ids = nodes.groupBy("id").agg(F.count("*").alias("n"))
    twice = ids.where("n > 1").select("id", F.lit("duplicate id").alias("problem"))
    known = ids.select(F.col("id").alias("parent"))
    unknown = edges.join(known, "parent", "left_anti").select("id", F.concat(F.lit("unknown dependency: "), "parent").alias("problem"))
    own = edges.where("id = parent").select("id", F.lit("depends on itself").alias("problem"))
    levels = waves(nodes, edges.where("id <> parent").join(known, "parent", "left_semi"))
    cyclic = levels.where("wave is null").select("id", F.lit("cycle").alias("problem"))
    return twice.unionByName(unknown).unionByName(own).unionByName(cyclic)


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, wave: how many steps must be done before each node (0 for none); null on a cycle or behind one."""
    ids = nodes.select("id").distinct()
    left = cut_lineage(ids)
    deps = cut_lineage(edges.select("parent", "id").distinct())
    done, n = None, 0
    while True:
        waiting = deps.join(left.select(F.col("id").alias("parent")), "parent", "left_semi").select("id").distinct()
        ready = cut_lineage(left.join(waiting, "id", "left_anti").withColumn("wave", F.lit(n)))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        left = cut_lineage(left.join(ready, "id", "left_anti"))
        n += 1
    rest = left.withColumn("wave", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def advance(nodes: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """id, status, blocked_by of a plan's nodes, to a fixed point.

    states: (id, state) of nodes that were submitted. Others are `submit` when all they depend on succeeded, `blocked` when
    something they depend on was cancelled, dead-lettered or is blocked itself, else `waiting`; submitted ones are
    succeeded, failed or running. blocked_by names the direct dependencies that failed, sorted.
    """
    now = F.when(F.col("state") == "SUCCEEDED", "succeeded").when(F.col("state").isin("CANCELLED", "DEAD_LETTERED"), "failed").when(F.col("state").isNotNull(), "running")
    rows = cut_lineage(nodes.select("id").distinct().join(states.select("id", "state"), "id", "left").select("id", now.alias("status")))
    deps = cut_lineage(edges.select("parent", "id").distinct())
    while True:
        parents = deps.join(rows.select(F.col("id").alias("parent"), "status"), "parent").groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("status").isin("failed", "blocked"), F.col("parent")))).alias("bad"))
        new = cut_lineage(rows.join(parents, "id", "left").withColumn("to", F.when(F.col("status").isNull() & (F.size("bad") > 0), "blocked")))
        if new.where("to is not null").isEmpty():
            break
        rows = new.select("id", F.coalesce("status", "to").alias("status"))
    parents = deps.join(rows.select(F.col("id").alias("parent"), F.col("status").alias("p")), "parent", "left").groupBy("id").agg(F.bool_and(F.coalesce(F.col("p") == "succeeded", F.lit(False))).alias("ready"), F.sort_array(F.collect_list(F.when(F.col("p").isin("failed", "blocked"), F.col("parent")))).alias("bad"))
    status = F.coalesce("status", F.when(F.coalesce("ready", F.lit(True)), "submit").otherwise("waiting"))
    return rows.join(parents, "id", "left").select("id", status.alias("status"), F.when(status == "blocked", F.array_join("bad", ", ")).alias("blocked_by"))


def task_priority(value: Column) -> Column:
    """100 (high) from 0.67 on, 0 (low) up to 0.33, else 50."""
    return F.when(value >= 0.67, 100).when(value <= 0.33, 0).otherwise(50)


def submissions(ready: DataFrame, plan_id: str, session_id: str, run_ids: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks for nodes that are ready (id, priority, capabilities): those that the task table holds already (of this run,
    session, plan and node) as they are, the others new. Two tasks for one node are an error."""
    mine = tasks.where((F.col("correlation_id") == session_id) & (F.col("plan_id") == plan_id)).select("run_id", F.col("investigation_id").alias("id"), "task_id")
    rows = ready.join(run_ids.select("id", "run_id"), "id").join(mine, ["id", "run_id"], "left")
    if not rows.groupBy("id").agg(F.count("task_id").alias("n")).where("n > 1").isEmpty():
        raise ValueError("duplicate tasks for one investigation")
    fresh = stable_id("task", F.lit(session_id), F.lit(plan_id), F.col("id"), F.col("run_id"))
    return rows.select("id", "run_id", F.coalesce("task_id", fresh).alias("task_id"), F.col("task_id").isNull().alias("new"), task_priority(F.col("priority")).alias("priority"), "capabilities")


def collect_results(execution: DataFrame, tasks: DataFrame, results: DataFrame) -> DataFrame:
    """investigation_id, task_id, attempt_id, run_id, state, error, result_id of all nodes of a plan that have ended.

    execution: session_id, plan_id, investigation_id, run_id, task_id, blocked_by (null, or why it was never submitted).
    tasks: task_id, run_id, state, attempt_id (the last), result_ref, last_error. A success must have a result of the same
    session, node, task, run and attempt; anything else raises when the row is read.
    """
    r = results.select("result_ref", *[F.col(c).alias("r_" + c) for c in ("session_id", "investigation_id", "task_id", "run_id", "attempt_id", "result_id")])
    t = tasks.select("task_id", F.col("run_id").alias("t_run"), "state", "attempt_id", "result_ref", "last_error")
    rows = execution.join(t, "task_id", "left").join(r, "result_ref", "left")
    good = (F.col("r_session_id") == F.col("session_id")) & (F.col("r_investigation_id") == F.col("investigation_id")) & (F.col("r_task_id") == F.col("task_id")) & (F.col("r_run_id") == F.col("t_run")) & (F.col("r_attempt_id") == F.col("attempt_id"))
    won = F.col("state") == "SUCCEEDED"
    wrong = F.raise_error(F.concat(F.lit("result and task do not agree: "), "task_id"))
    blocked = F.col("blocked_by").isNotNull()
    out = F.when(blocked, "FAILED").when(won, F.when(F.coalesce(good, F.lit(False)), "COMPLETED").otherwise(wrong)).when(F.col("state") == "CANCELLED", "CANCELLED").when(F.col("state") == "DEAD_LETTERED", "FAILED")
    error = F.when(blocked, F.concat(F.lit("dependency failed: "), "blocked_by")).when(F.col("state") == "DEAD_LETTERED", F.coalesce("last_error", F.lit("dead_lettered")))
    task = F.when(blocked, F.concat_ws(":", F.lit("blocked"), "plan_id", "investigation_id")).otherwise(F.col("task_id"))
    attempt = F.when(blocked, "not-scheduled").otherwise(F.coalesce("attempt_id", F.concat(F.lit("unattempted:"), "task_id")))
    made = stable_id("investigation_result", task, F.coalesce("state", F.lit("blocked")), digits=24)
    rows = rows.select("investigation_id", task.alias("task_id"), attempt.alias("attempt_id"), F.coalesce("t_run", "run_id").alias("run_id"), out.alias("state"), error.alias("error"), F.coalesce(F.when(won, F.col("r_result_id")), made).alias("result_id"))
    return rows.where("state is not null")


def snapshot(gaps: DataFrame, entities: DataFrame, contradictions: DataFrame, confidence: DataFrame) -> DataFrame:
    """One row of what is known before an iteration: gaps by falling priority, mean uncertainty, sorted ids."""
    g = gaps.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("priority")).alias("p"), "id"))), lambda s: s["id"]).alias("gap_ids"), F.round(F.coalesce(F.avg("uncertainty"), F.lit(0.0)), 9).alias("mean_uncertainty"))
    ids = lambda df, name: df.agg(F.sort_array(F.collect_set("id")).alias(name))
    key = F.concat_ws(":", "kind", F.least("a", "b"), F.greatest("a", "b"))
    c = contradictions.agg(F.sort_array(F.collect_set(key)).alias("contradiction_keys"))
    return g.crossJoin(ids(entities, "entity_ids")).crossJoin(c).crossJoin(confidence.agg(F.coalesce(F.max("confidence"), F.lit(0.0)).alias("confidence")))
