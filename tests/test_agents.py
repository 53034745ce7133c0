"""Agent runs: actions, budgets, policies, checkpoints, delegation, and a worker that runs them."""

import json

import pytest

from gnomon import agents as A
from gnomon.service import Runtime


def make(spark, folder, answers, clock=lambda: 0.0, approval=()):
    left = list(answers)
    slow = A.Tool("slow", "search", lambda given, key: __import__("time").sleep(5), seconds=0.05)
    tools = A.Tools({"find": A.Tool("find", "search", lambda given, key: {"text": given["q"], "key": key}, required=("q",), gives=("text",)), "drop": A.Tool("drop", "search", lambda g, k: {}, "destructive"), "bad": A.Tool("bad", "search", lambda g, k: 1 / 0), "other": A.Tool("other", "admin", lambda g, k: {}), "slow": slow}, {"ann": {"search"}}, set(approval))
    return A.Agents(spark, folder, lambda prompt: left.pop(0), tools, clock=clock, memory=lambda q: [{"id": "m1"}, {}])


def test_actions(spark, tmp_path):
    find = {"action": "tool", "tool": "find", "input": {"q": "x"}, "token_usage": 3}
    a = make(spark, f"file://{tmp_path}", [find, {"action": "finish", "output": {"a": 1}}])
    run = a.create("ann", "look")
    a.step(run.run_id, "p")
    a.recall(run.run_id, "q")
    a.observe(run.run_id, "seen")
    assert run.calls[0]["output"] == {"text": "x", "key": f"{run.run_id}:0"} and run.context == ["m1", "inline"] and run.used == {"tokens": 3, "tool_calls": 1}
    a.step(run.run_id, "p")
    assert run.state == "COMPLETED" and run.outputs == {"a": 1}
    with pytest.raises(A.RunFailed):
        a.transition(run.run_id, "RUNNING", "again")
    other = make(spark, f"file://{tmp_path}", [])
    assert other.resume(run.run_id) == a.load(run.run_id) and other.runs[run.run_id].outputs == {"a": 1}
    with pytest.raises(A.RunFailed):
        other.resume("none")


@pytest.mark.parametrize(
    ("answer", "state", "error"),
    [
        ("text", "FAILED", "malformed agent output"), ({"action": "fly"}, "FAILED", "malformed agent action"), ({"action": "tool"}, "FAILED", "malformed agent action"), ({"action": "tool", "tool": "find", "input": []}, "FAILED", "malformed tool input"),
        ({"action": "tool", "tool": "find"}, "FAILED", "tool input does not match required fields"), ({"action": "tool", "tool": "none"}, "FAILED", "unknown tool: none"), ({"action": "tool", "tool": "bad"}, "FAILED", "tool failed: bad: ZeroDivisionError('division by zero')"), ({"action": "tool", "tool": "slow"}, "FAILED", "tool timed out: slow"),
        ({"action": "tool", "tool": "other"}, "FAILED", "tool denied by policy"), ({"action": "tool", "tool": "drop"}, "WAITING", None), ({"action": "wait"}, "WAITING", None), ({"action": "delegate"}, "WAITING", None), ({"action": "wait", "token_usage": 11}, "PAUSED", "tokens budget exhausted"),
    ],
)
def test_ends_of_a_step(spark, tmp_path, answer, state, error):
    a = make(spark, f"file://{tmp_path}", [answer])
    run = a.create("ann", limits=A.Limits(tokens=10))
    if error is None:
        a.step(run.run_id, "p")
    else:
        with pytest.raises(A.RunFailed, match=error.replace("(", r"\(").replace(")", r"\)")):
            a.step(run.run_id, "p")
    assert run.state == state and a.load(run.run_id).state == state


def test_delegation_and_time(spark, tmp_path):
    now = [0.0]
    a = make(spark, f"file://{tmp_path}", [], clock=lambda: now[0])
    top = a.create("ann")
    a.transition(top.run_id, "RUNNING", "go")
    child = a.delegate(top.run_id, "ann", "sub")
    a.transition(child.run_id, "RUNNING", "go")
    grandchild = a.delegate(child.run_id, "ann", "subsub")
    assert (grandchild.depth, grandchild.root) == (2, top.run_id)
    with pytest.raises(A.RunFailed, match="deeper"):
        a.delegate(child.run_id, "ann", "x", deepest=1)
    b = make(spark, f"file://{tmp_path}", [])
    b.resume(grandchild.run_id)
    assert set(b.runs) == {top.run_id, child.run_id, grandchild.run_id}
    now[0] = 4000.0
    with pytest.raises(A.RunFailed, match="wall-time"):
        a.observe(child.run_id, "late")
    assert child.state == "PAUSED"


def test_worker_runs_tasks(spark, tmp_path):
    now = [0.0]
    rt = Runtime(spark, f"file://{tmp_path}/rt", clock=lambda: now[0], lease=1000.0)
    rt.register("w", "local:w", [], 4)
    find = {"action": "tool", "tool": "find", "input": {"q": "x"}}
    a = make(spark, f"file://{tmp_path}/runs", [find, {"action": "finish", "output": {"done": True}}, {"action": "tool", "tool": "other"}, {"action": "wait"}])
    harness = A.Harness(a, "ann")
    one, two, three = rt.submit("r1", "c", "HIGH", metadata={"question": "q"}), rt.submit("r2", "c"), rt.submit("r3", "c", "LOW")
    assert A.poll_once(rt, "w", harness) == [one, two, three]
    assert rt.task(one)["state"] == "SUCCEEDED" and json.loads(harness.result(rt.task(one)["result_ref"])["output"]) == {"done": True}
    assert (rt.task(two)["state"], rt.task(two)["error"]) == ("DEAD_LETTERED", "tool denied by policy") and rt.task(three)["state"] == "RETRY_WAIT"
    four = rt.submit("r4", "c")

    def cancelled_meanwhile(run_id, task_id, metadata, gone):
        rt.cancel(task_id, "ops")
        assert gone()
        return None, "TRANSIENT", ""

    assert A.poll_once(rt, "w", cancelled_meanwhile) == [four] and rt.task(four)["state"] == "CANCELLED"
    five = rt.submit("r5", "c")
    assert A.poll_once(rt, "w", lambda *x: 1 / 0) == [five] and "ZeroDivisionError" in rt.task(five)["error"]
    assert A.Harness(make(spark, f"file://{tmp_path}/more", [find] * 9), "ann", most_steps=2)("r9", "t9", {}) == (None, "PERMANENT", "run ended as PAUSED")
    assert A.classify("Tokens BUDGET exhausted") == "BUDGET_EXHAUSTED"
