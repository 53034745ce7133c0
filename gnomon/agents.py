"""Agent runs: a loop of reasoning and acting under a budget, tools under a policy, and a worker that runs them for tasks.

A run's state goes to a checkpoint after every change, so that another worker goes on where one was lost. Models and tools are
functions of the caller; the audits of many runs are DataFrame queries (gnomon.operators.tasks).
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gnomon.operators.tasks import RUN_TRANSITIONS
from gnomon.service import Refused, Runtime
from gnomon.sources.stores import Store

ENDED = ("COMPLETED", "FAILED", "CANCELLED")


class RunFailed(Exception):
    """What went wrong in a run; its state says how it ended."""


@dataclass(frozen=True)
class Tool:
    name: str
    capability: str
    run: Callable[[dict, str], dict]
    side_effect: str = "read"
    required: tuple[str, ...] = ()
    gives: tuple[str, ...] = ()
    seconds: float = 30.0


@dataclass
class Tools:
    """Tools by name, what each principal may use, and which capabilities need approval."""

    tools: dict[str, Tool]
    grants: dict[str, set[str]]
    approval: set[str] = field(default_factory=set)

    def decide(self, principal: str, tool: Tool) -> str:
        if tool.capability not in self.grants.get(principal, ()):
            return "DENY"
        return "REQUIRE_APPROVAL" if tool.capability in self.approval or tool.side_effect == "destructive" else "ALLOW"

    def execute(self, principal: str, name: str, given: dict, key: str) -> tuple[str, dict | None]:
        """The decision, and a tool's output if it is allowed."""
        tool = self.tools.get(name)
        if tool is None:
            raise RunFailed(f"unknown tool: {name}")
        _has(given, tool.required, "input")
        decision = self.decide(principal, tool)
        if decision != "ALLOW":
            return decision, None
        pool = ThreadPoolExecutor(1)
        try:
            output = pool.submit(tool.run, given, key).result(timeout=tool.seconds)
        except Late:
            raise RunFailed(f"tool timed out: {name}") from None
        except Exception as e:  # noqa: BLE001
            raise RunFailed(f"tool failed: {name}: {e!r}") from e
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        _has(output, tool.gives, "output")
        return decision, output


def _has(value: object, keys: tuple[str, ...], what: str) -> None:
    if not isinstance(value, dict):
        raise RunFailed(f"tool {what} must be an object")
    if any(k not in value for k in keys):
        raise RunFailed(f"tool {what} does not match required fields")


@dataclass(frozen=True)
class Limits:
    tokens: int = 100_000
    tool_calls: int = 100
    seconds: float = 3600.0


@dataclass
class Run:
    run_id: str
    agent: str
    limits: Limits
    created: float
    task: str = ""
    state: str = "CREATED"
    used: dict = field(default_factory=lambda: {"tokens": 0, "tool_calls": 0})
    steps: list = field(default_factory=list)
    calls: list = field(default_factory=list)
    context: list = field(default_factory=list)
    outputs: dict = field(default_factory=dict)
    parent: str | None = None
    root: str | None = None
    depth: int = 0
    delegations: list = field(default_factory=list)


class Agents:
    """Runs of agents, whose checkpoints are a log in a folder.

    model(prompt) gives {"action": "tool" | "finish" | "delegate" | "wait", ...} with token_usage; memory(query) gives records.
    """

    def __init__(self, spark: SparkSession, folder: str, model: Callable[[str], dict], tools: Tools, memory: Callable[[str], list[dict]] = lambda query: [], clock: Callable[[], float] = time.time):
        self.spark, self.store, self.model, self.tools, self.memory, self.clock = spark, Store(spark, folder), model, tools, memory, clock
        self.runs: dict[str, Run] = {}

    # Runs and checkpoints.
    def create(self, agent: str, task: str = "", limits: Limits = Limits(), run_id: str | None = None) -> Run:
        run_id = run_id or "run_" + hashlib.sha256(f"{agent}\x1f{task}\x1f{len(self.runs)}\x1f{self.clock()}".encode()).hexdigest()[:16]
        run = self.runs[run_id] = Run(run_id, agent, limits, float(self.clock()), task, root=run_id)
        self.checkpoint(run_id)
        return run

    def checkpoint(self, run_id: str) -> int:
        """Writes a run; returns the number of its checkpoint."""
        return self.store.save("runs", self.spark.createDataFrame([(run_id, json.dumps(asdict(self.runs[run_id]), default=str))], "id string, run string"))

    def load(self, run_id: str) -> Run | None:
        try:
            row = self.store.get("runs", run_id).first()
        except KeyError:
            return None
        if row is None:
            return None
        d = json.loads(row["run"])
        return Run(**d | {"limits": Limits(**d["limits"])})

    def resume(self, run_id: str, deepest: int = 4) -> Run:
        """A run from its last checkpoint, with all its ancestors."""
        at, seen = run_id, 0
        while at is not None and at not in self.runs:
            run = self.load(at)
            if run is None:
                raise RunFailed(f"no checkpoint of run {at}")
            if seen > deepest:
                raise RunFailed(f"deeper than {deepest}")
            self.runs[at], at, seen = run, run.parent, seen + 1
        return self.runs[run_id]

    def transition(self, run_id: str, target: str, reason: str) -> Run:
        run = self.runs[run_id]
        if target not in RUN_TRANSITIONS[run.state]:
            raise RunFailed(f"invalid transition: {run.state} -> {target}")
        run.state = target
        run.steps.append(("transition", f"{target}: {reason}"))
        self.checkpoint(run_id)
        return run

    def _running(self, run_id: str) -> Run:
        run = self.runs[run_id]
        if run.state != "RUNNING":
            raise RunFailed(f"agent run is not running: {run.state}")
        if self.clock() - run.created > run.limits.seconds:
            self.transition(run_id, "PAUSED", "wall-time budget exhausted")
            raise RunFailed("wall-time budget exhausted")
        return run

    def _use(self, run: Run, kind: str, amount: int) -> None:
        if amount < 0:
            raise RunFailed("usage cannot be negative")
        run.used[kind] += amount
        if run.used[kind] > getattr(run.limits, kind):
            self.transition(run.run_id, "PAUSED", f"{kind} budget exhausted")
            raise RunFailed(f"{kind} budget exhausted")

    # The loop.
    def observe(self, run_id: str, observation: str) -> None:
        run = self._running(run_id)
        run.steps.append(("observe", observation))

    def recall(self, run_id: str, query: str) -> list[dict]:
        run = self._running(run_id)
        found = self.memory(query)
        run.context += [str(x.get("id", "inline")) for x in found]
        run.steps.append(("recall", f"{len(found)} records"))
        return found

    def reason(self, run_id: str, prompt: str) -> dict:
        run = self._running(run_id)
        answer = self.model(prompt)
        if not isinstance(answer, dict):
            self.transition(run_id, "FAILED", "the model gave no object")
            raise RunFailed("malformed agent output")
        self._use(run, "tokens", int(answer.get("token_usage", 0)))
        run.steps.append(("reason", ", ".join(run.context[-10:])))
        return answer

    def choose(self, run_id: str, answer: dict) -> dict:
        run = self._running(run_id)
        action = answer.get("action")
        if action not in ("tool", "finish", "delegate", "wait") or action == "tool" and not isinstance(answer.get("tool"), str):
            self.transition(run_id, "FAILED", "no such action")
            raise RunFailed("malformed agent action")
        run.steps.append(("choose", action))
        return answer

    def act(self, run_id: str, answer: dict) -> dict | None:
        run = self._running(run_id)
        action = answer["action"]
        if action == "finish":
            run.outputs = dict(answer.get("output", {}))
            self.transition(run_id, "COMPLETED", "finished")
            return run.outputs
        if action in ("delegate", "wait"):
            self.transition(run_id, "WAITING", action)
            return None
        self._use(run, "tool_calls", 1)
        given = answer.get("input", {})
        if not isinstance(given, dict):
            self.transition(run_id, "FAILED", "tool input was no object")
            raise RunFailed("malformed tool input")
        call = {"id": f"{run_id}:{len(run.calls)}", "tool": answer["tool"], "input": given, "decision": "FAILED", "output": None}
        run.calls.append(call)
        try:
            call["decision"], call["output"] = self.tools.execute(run.agent, answer["tool"], given, call["id"])
        except RunFailed:
            self.transition(run_id, "FAILED", "tool failed")
            raise
        if call["decision"] == "REQUIRE_APPROVAL":
            self.transition(run_id, "WAITING", "tool requires approval")
        elif call["decision"] == "DENY":
            self.transition(run_id, "FAILED", "tool denied by policy")
            raise RunFailed("tool denied by policy")
        return call["output"]

    def step(self, run_id: str, prompt: str) -> Run:
        if self.runs[run_id].state == "CREATED":
            self.transition(run_id, "RUNNING", "begin")
        self.act(run_id, self.choose(run_id, self.reason(run_id, prompt)))
        self.checkpoint(run_id)
        return self.runs[run_id]

    def delegate(self, parent_id: str, agent: str, task: str, limits: Limits = Limits(), deepest: int = 4) -> Run:
        parent = self._running(parent_id)
        if parent.depth + 1 > deepest:
            raise RunFailed(f"deeper than {deepest}")
        child = self.create(agent, task, limits)
        child.parent, child.root, child.depth = parent_id, parent.root, parent.depth + 1
        parent.delegations.append(child.run_id)
        self.checkpoint(child.run_id)
        self.checkpoint(parent_id)
        return child


@dataclass
class Harness:
    """Runs an agent for a task, or goes on with the run of a lost worker; results are kept by their reference."""

    agents: Agents
    agent: str
    limits: Limits = Limits()
    most_steps: int = 8

    def __call__(self, run_id: str, task_id: str, metadata: dict, cancelled: Callable[[], bool] = lambda: False) -> tuple[str | None, str, str]:
        """(result reference or None, failure class, error)."""
        a = self.agents
        try:
            run = a.resume(run_id)
        except RunFailed:
            run = a.create(self.agent, json.dumps(metadata, sort_keys=True), self.limits, run_id)
        try:
            if run.state == "CREATED":
                a.transition(run_id, "RUNNING", "begin")
            for _ in range(self.most_steps):
                if run.state != "RUNNING":
                    break
                if cancelled():
                    a.transition(run_id, "CANCELLED", "task cancellation requested")
                    break
                a.step(run_id, self.prompt(run, metadata))
            else:
                if run.state == "RUNNING":
                    a.transition(run_id, "PAUSED", "step limit reached")
        except RunFailed as e:
            return None, classify(str(e)), str(e)
        if run.state == "COMPLETED":
            ref = f"investigation-result://{task_id}"
            row = (ref, task_id, run_id, json.dumps(run.outputs, default=str), json.dumps(run.calls, default=str))
            a.store.save("results", a.spark.createDataFrame([row], "result_ref string, task_id string, run_id string, output string, calls string"))
            return ref, "", ""
        return None, {"CANCELLED": "CANCELLED", "WAITING": "TRANSIENT"}.get(run.state, "PERMANENT"), f"run ended as {run.state}"

    def prompt(self, run: Run, metadata: dict) -> str:
        seen = [{"observation_id": c["id"], "tool": c["tool"], "output": c["output"]} for c in run.calls]
        return json.dumps({"task": metadata, "observations": seen}, default=str, sort_keys=True)

    def result(self, ref: str):
        return self.agents.store.state("results", "result_ref").where(F.col("result_ref") == ref).first()


def classify(error: str) -> str:
    low = error.lower()
    return "POLICY_VIOLATION" if "denied by policy" in low else "BUDGET_EXHAUSTED" if "budget exhausted" in low else "TRANSIENT"


def poll_once(runtime: Runtime, worker: str, harness: Callable[..., tuple[str | None, str, str]]) -> list[str]:
    """One round of a worker: a heartbeat, then every task it can claim is started, run and answered. Returns their ids.

    A task whose lease ran out meanwhile is someone else's by now; its late answer is refused and not an error here.
    """
    runtime.heartbeat(worker)
    out = []
    for claimed in runtime.claim(worker):
        task, lease = claimed["task_id"], claimed["lease"]
        runtime.start(task, worker, lease)
        row = runtime.task(task)
        gone = lambda task=task: runtime.task(task)["state"] == "CANCEL_REQUESTED"
        try:
            ref, failure, error = harness(row["run_id"], task, json.loads(row["metadata"]), gone)
        except Exception as e:  # noqa: BLE001
            ref, failure, error = None, "TRANSIENT", f"harness raised: {e!r}"
        try:
            if gone():
                runtime.acknowledge_cancel(task, worker, lease)
            elif ref is not None:
                runtime.complete(task, worker, lease, ref)
            else:
                runtime.fail(task, worker, lease, failure, error)
        except Refused:
            pass
        out.append(task)
    return out
