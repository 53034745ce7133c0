"""Candidates, scores, selection, plans and waves."""

import random

import pytest
from pyspark.sql import functions as F

from gnomon.operators import planning as P

SCORED = "id string, redundancy_key string, cost double, seconds double, score double"


def plain_select(rows, limit, money, seconds, least):
    keys, spent, took, out, chosen = set(), 0.0, 0.0, {}, 0
    for i, k, c, t, s in sorted(rows, key=lambda r: (-r[4], r[0])):
        if chosen >= limit:
            out[i] = "selection_limit"
        elif s < least:
            out[i] = "below_minimum_score"
        elif k in keys:
            out[i] = "redundant_evidence_need"
        elif spent + c > money:
            out[i] = "cost_budget"
        elif took + t > seconds:
            out[i] = "execution_time_budget"
        else:
            out[i], chosen = None, chosen + 1
            keys.add(k)
            spent, took = spent + c, took + t
    return out


@pytest.mark.parametrize("seed", range(4))
def test_select_is_greedy(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"i{n:03d}", f"k{rnd.randint(0, 30)}", float(rnd.randint(1, 9)), float(rnd.choice([30, 60, 120])), round(rnd.random(), 1)) for n in range(60)]
    df = spark.createDataFrame(rows, SCORED)
    workers, cost, seconds, top = rnd.choice([(6, 25.0, 100.0, None), (20, 60.0, 30.0, 9), (30, 1000.0, 1000.0, None), (5, 8.0, 500.0, 3)])
    got = P.select(df, P.Budget(cost=cost, seconds=seconds), workers=workers, top=top, least=0.3, block=7)
    limit = min(workers, top or 99)
    assert {r["id"]: r["reason"] for r in got.collect()} == plain_select(rows, limit, cost, seconds * workers, 0.3)
    with pytest.raises(ValueError):
        P.select(df, P.Budget(), workers=0)
    assert P.select(df.limit(0), P.Budget()).count() == 0


@pytest.mark.parametrize(("limit", "cost"), [(5, 4.0), (4, 100.0)])
def test_select_reads_few_blocks(spark, monkeypatch, limit, cost):
    """What no longer fits, or whose need is taken, is not read block by block: a budget that is used up ends the search."""
    rows = [(f"c{i:03}", "same" if i < 100 else f"k{i % 3}", 2.0, 1.0, 1 - i / 1000) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, redundancy_key string, cost double, seconds double, score double")
    reads, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: reads.append(1) or collect(self))
    got = P.select(df, P.Budget(cost=cost, seconds=1000.0), workers=limit, block=10)
    assert len(reads) <= limit + 1
    monkeypatch.undo()
    assert {r["id"]: r["reason"] for r in got.collect()} == plain_select(rows, limit, cost, 1000.0 * limit, 0.0)


def test_candidates_count_once(spark):
    own = [("x", "Look at it. ", None, 0.0, {"risk": "2", "estimated_duration_seconds": "nan?"}), ("y", "Look at it?", [], 3.0, None)]
    gaps = [("g1", "contradiction", "what", "why", ["a"], 0.5, 0.5, 2.0, 0.4, own), ("g2", "new_kind", " Is it so?.", "why", None, 2.0, 0.5, 0.0, 2.0, []), ("g3", "stale", "d", "r", [], 0.8, 0.1, 1.0, 0.3, None)]
    df = spark.createDataFrame(gaps, f"id string, kind string, description string, reason string, affected_entities array<string>, uncertainty double, importance double, estimated_cost double, priority double, candidates {P.CANDIDATE}")
    got = {r["gap_id"]: r for r in P.candidates(df, "Q").collect()}
    assert len(got) == 3 and P.candidates(df).count() == 3
    one, two = got["g1"], got["g2"]
    assert one["question"] == "Look at it?" and one["target_entities"] == ["a"] and one["risk"] == 1.0 and one["seconds"] == 60.0 and one["cost"] == 2.0 and one["capabilities"] == ["criticism", "verification"]
    assert two["question"] == "Is it so?" and two["reduction"] == 1.0 and two["priority"] == 1.0 and two["capabilities"] == ["search"] and two["gain"] == 0.5
    with pytest.raises(ValueError):
        P.score(P.candidates(df), df.where("id = 'g1'"))
    scored = P.score(P.candidates(df), df)
    assert scored.where("score between 0 and 1").count() == 3
    assert P.forecast(scored.limit(0)).first()["information_gain_per_cost"] == 0


def edges_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "parent string, id string")


def test_plans(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    edges = edges_of(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"))
    assert P.plan_problems(nodes, edges).count() == 0
    assert {r["id"]: r["wave"] for r in P.waves(nodes, edges).collect()} == {"a": 0, "d": 0, "f": 0, "b": 1, "e": 1, "c": 2}
    cyclic = edges_of(spark, ("a", "b"), ("b", "a"), ("b", "c"), ("z", "d"), ("e", "e"))
    assert sorted((r["id"], r["problem"]) for r in P.plan_problems(nodes.unionByName(nodes.where("id = 'f'")), cyclic).collect()) == [("a", "cycle"), ("b", "cycle"), ("c", "cycle"), ("d", "unknown dependency: z"), ("e", "depends on itself"), ("f", "duplicate id")]
    states = lambda **x: spark.createDataFrame(list(x.items()), "id string, state string")
    got = lambda s: {r["id"]: (r["status"], r["blocked_by"]) for r in P.advance(nodes, edges, s).collect()}
    now = got(states(a="SUCCEEDED", d="DEAD_LETTERED", f="RUNNING"))
    assert now == {"a": ("succeeded", None), "b": ("submit", None), "c": ("waiting", None), "d": ("failed", None), "e": ("blocked", "d"), "f": ("running", None)}
    assert got(states(a="CANCELLED"))["c"] == ("blocked", "a, b")


def test_submissions_and_results(spark):
    ready = spark.createDataFrame([("a", 0.67, ["x"]), ("b", 0.33, []), ("c", 0.5, [])], "id string, priority double, capabilities array<string>")
    runs = spark.createDataFrame([(x, f"r{x}") for x in "abc"], "id string, run_id string")
    tasks = spark.createDataFrame([("t1", "ra", "s", "p", "a"), ("t2", "rb", "s", "other", "b")], "task_id string, run_id string, correlation_id string, plan_id string, investigation_id string")
    got = {r["id"]: r for r in P.submissions(ready, "p", "s", runs, tasks).collect()}
    assert [(got[x]["new"], got[x]["priority"]) for x in "abc"] == [(False, 100), (True, 0), (True, 50)] and got["a"]["task_id"] == "t1"
    with pytest.raises(ValueError):
        P.submissions(ready, "p", "s", runs, tasks.unionByName(tasks.withColumn("task_id", F.lit("t9"))))
    execution = spark.createDataFrame([("s", "p", "a", "ra", "t1", None), ("s", "p", "b", "rb", "t2", None), ("s", "p", "c", "rc", None, "b"), ("s", "p", "d", "rd", "t4", None)], "session_id string, plan_id string, investigation_id string, run_id string, task_id string, blocked_by string")
    states = spark.createDataFrame([("t1", "ra", "SUCCEEDED", "at1", "ref1", None), ("t2", "rb", "DEAD_LETTERED", None, None, None), ("t4", "rd", "RUNNING", "at4", None, None)], "task_id string, run_id string, state string, attempt_id string, result_ref string, last_error string")
    results = spark.createDataFrame([("ref1", "s", "a", "t1", "ra", "at1", "res1")], "result_ref string, session_id string, investigation_id string, task_id string, run_id string, attempt_id string, result_id string")
    out = {r["investigation_id"]: r for r in P.collect_results(execution, states, results).collect()}
    assert (out["a"]["state"], out["a"]["result_id"]) == ("COMPLETED", "res1") and (out["b"]["state"], out["b"]["error"], out["b"]["attempt_id"]) == ("FAILED", "dead_lettered", "unattempted:t2")
    assert (out["c"]["error"], out["c"]["task_id"]) == ("dependency failed: b", "blocked:p:c") and "d" not in out
    with pytest.raises(Exception, match="do not agree"):
        P.collect_results(execution, states, results.withColumn("attempt_id", F.lit("other"))).collect()


def test_snapshot(spark):
    gaps = spark.createDataFrame([("g1", 0.2, 0.5), ("g2", 0.9, 0.7), ("g0", 0.9, 0.6)], "id string, priority double, uncertainty double")
    ids = spark.createDataFrame([("b",), ("a",), ("a",)], "id string")
    pairs = spark.createDataFrame([("k", "y", "x")], "kind string, a string, b string")
    row = P.snapshot(gaps, ids, pairs, spark.createDataFrame([(0.5,)], "confidence double")).first()
    assert row["gap_ids"] == ["g0", "g2", "g1"] and row["mean_uncertainty"] == pytest.approx(0.6) and row["entity_ids"] == ["a", "b"] and row["contradiction_keys"] == ["k:x:y"]
