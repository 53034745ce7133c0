"""Research sessions: a state machine, and the stages of an iteration from gaps to updated knowledge, each stored as it is done.

A stage reads what the stage before it stored, never what a caller hands it, and stores its own result as an artifact:
a table in the session's folder, named in the artifact log only once it is whole. An application that stops anywhere goes
on from the last artifact of the iteration (see resume_iteration).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.functions.storage import cut_lineage
from gnomon.functions.text import stable_id
from gnomon.operators import evidence as V
from gnomon.operators import planning as P
from gnomon.sources.stores import Store, latest

ACTIVE = ("PLANNING", "EXECUTING", "EVALUATING", "UPDATING")
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")
# The states that may follow each state of a session.
TRANSITIONS = {
    "PLANNING": ["EXECUTING", "COMPLETED", "PAUSED", "FAILED", "CANCELLED"],
    "EXECUTING": ["EVALUATING", "PAUSED", "FAILED", "CANCELLED"],
    "EVALUATING": ["UPDATING", "PLANNING", "COMPLETED", "PAUSED", "FAILED", "CANCELLED"],
    "UPDATING": ["PLANNING", "COMPLETED", "PAUSED", "FAILED", "CANCELLED"],
    "PAUSED": [*ACTIVE, "FAILED", "CANCELLED"],
    "COMPLETED": [],
    "FAILED": [],
    "CANCELLED": [],
}
STAGES = ("observe", "generate", "score", "select", "plan", "execute", "collect", "evaluate", "verify", "update", "finish")


class NotAllowed(Exception):
    """A change of a session that its state does not allow."""


@dataclass
class Session:
    session_id: str
    question: str
    budget: P.Budget
    state: str = "PLANNING"
    iteration: int = 0
    used: P.Budget = P.Budget(0, 0, 0, 0.0, 0.0)
    paused_from: str | None = None
    reason: str | None = None
    updated_at: float = 0.0

    def transition(self, target: str, at: float, reason: str | None = None) -> Session:
        if target not in TRANSITIONS[self.state]:
            raise NotAllowed(f"{self.state} -> {target}")
        if self.state == "PAUSED" and target in ACTIVE and target != self.paused_from:
            raise NotAllowed("a paused session goes on in the state it was paused in")
        if (target in TERMINAL) != (reason is not None):
            raise NotAllowed("a reason is given when a session ends, and only then")
        if target == "CANCELLED" and reason != "user_cancellation" or target == "FAILED" and reason != "system_failure":
            raise NotAllowed(f"{target} does not go with {reason}")
        if at < self.updated_at:
            raise NotAllowed("time cannot go back")
        self.paused_from = self.state if target == "PAUSED" else None
        self.state, self.updated_at, self.reason = target, at, reason
        return self

    def pause(self, at: float) -> Session:
        return self.transition("PAUSED", at)

    def resume(self, at: float) -> Session:
        if self.state != "PAUSED" or self.paused_from is None:
            raise NotAllowed("only a paused session can resume")
        return self.transition(self.paused_from, at)

    def complete_iteration(self, at: float) -> Session:
        if self.state != "UPDATING":
            raise NotAllowed("an iteration ends only from UPDATING")
        self.iteration += 1
        return self.transition("PLANNING", at)

    def use(self, investigations: int = 0, agent_runs: int = 0, cost: float = 0.0, seconds: float = 0.0) -> None:
        if min(investigations, agent_runs, cost, seconds) < 0:
            raise ValueError("usage cannot be negative")
        u = self.used
        self.used = replace(u, investigations=u.investigations + investigations, agent_runs=u.agent_runs + agent_runs, cost=u.cost + cost, seconds=u.seconds + seconds)

    def remaining(self) -> P.Budget:
        b, u = self.budget, self.used
        return P.Budget(max(0, b.iterations - self.iteration), max(0, b.investigations - u.investigations), max(0, b.agent_runs - u.agent_runs), max(0.0, b.cost - u.cost), max(0.0, b.seconds - u.seconds))


def session_usage(usage: DataFrame) -> DataFrame:
    """session_id, seq, used of usage rows (session_id, seq, amount): running sums; no amount is below 0."""
    from pyspark.sql import Window as W

    amount = F.when(F.col("amount") < 0, F.raise_error(F.lit("usage cannot be negative"))).otherwise(F.col("amount"))
    return usage.withColumn("used", F.sum(amount).over(W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))).select("session_id", "seq", "used")


def audit(log: DataFrame) -> DataFrame:
    """session_id, seq, problem of a log of transitions (session_id, seq, state, reason, at) that the machine does not allow."""
    from pyspark.sql import Window as W

    order = W.partitionBy("session_id").orderBy("seq")
    rows = log.withColumns({"was": F.lag("state").over(order), "then": F.lag("at").over(order), "before": F.lag("state", 2).over(order)})
    legal = F.lit(False)
    for state, targets in TRANSITIONS.items():
        legal = legal | ((F.col("was") == state) & F.col("state").isin(*targets)) if targets else legal
    ends = F.col("state").isin(*TERMINAL)
    problem = F.when(F.col("was").isNotNull() & ~legal, "illegal transition").when((F.col("was") == "PAUSED") & F.col("state").isin(*ACTIVE) & (F.col("state") != F.col("before")), "not the state it was paused in")
    problem = problem.when(ends != F.col("reason").isNotNull(), "reason and state do not agree").when((F.col("state") == "CANCELLED") & (F.col("reason") != "user_cancellation") | (F.col("state") == "FAILED") & (F.col("reason") != "system_failure"), "reason and state do not agree")
    problem = problem.when(F.col("at") < F.col("then"), "time goes back")
    return rows.withColumn("problem", problem).where("problem is not null").select("session_id", "seq", "problem")


@dataclass
class Investigations:
    """Sessions over an engine and a runtime. run_ids names the agent run of an investigation; results gives the flat tables
    (results, conclusions, observations) of runs that have ended, by their references."""

    engine: object
    runtime: object
    folder: str
    results: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]]
    clock: Callable[[], float] = time.time
    confidence: float = 0.9
    least: float = 0.05
    store: Store = field(init=False)

    def __post_init__(self):
        self.spark = self.engine.spark
        self.store = Store(self.spark, f"{self.folder}/sessions")

    # Sessions and artifacts.
    def create(self, question: str, budget: P.Budget = P.Budget()) -> str:
        ident = self.spark.range(1).select(stable_id("session", F.lit(question), F.lit(str(len(self.store.versions("sessions")))))).first()[0]
        self._save(Session(ident, question, budget, updated_at=self.clock()))
        self._note(self.status(ident), "created", {"question": question})
        return ident

    def _save(self, s: Session) -> None:
        self.store.save("sessions", self.spark.createDataFrame([(s.session_id, json.dumps(asdict(s)))], "id string, session string"))

    def status(self, session_id: str) -> Session:
        try:
            row = self.store.get("sessions", session_id).first()
        except KeyError:
            row = None
        if row is None:
            raise KeyError(f"unknown session: {session_id}")
        d = json.loads(row["session"])
        return Session(**d | {"budget": P.Budget(**d["budget"]), "used": P.Budget(**d["used"])})

    def _note(self, s: Session, kind: str, payload: dict) -> None:
        n = max(self.store.versions("artifacts"), default=0) + 1
        self.store.save("artifacts", self.spark.createDataFrame([(f"{s.session_id}:{n}", s.session_id, s.iteration, kind, n, json.dumps(payload))], "id string, session_id string, iteration int, kind string, n long, payload string"))

    def artifacts(self, session_id: str) -> DataFrame:
        return self.store.state("artifacts").where(F.col("session_id") == session_id)

    def explain(self, session_id: str, kinds: list[str] | None = None) -> list[dict]:
        rows = self.artifacts(session_id).orderBy("n").collect()
        return [{"iteration": r["iteration"], "kind": r["kind"], **json.loads(r["payload"])} for r in rows if kinds is None or r["kind"] in kinds]

    def _keep(self, s: Session, kind: str, df: DataFrame, **payload) -> DataFrame:
        path = f"{self.folder}/artifacts/{s.session_id}/{s.iteration:06d}/{kind}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._note(s, kind, {"path": path, "schema": df.schema.json(), "rows": out.count(), **payload})
        return out

    def _kept(self, s: Session, kind: str, iteration: int | None = None) -> DataFrame | None:
        from pyspark.sql.types import StructType

        at = s.iteration if iteration is None else iteration
        row = self.artifacts(s.session_id).where((F.col("kind") == kind) & (F.col("iteration") == at)).orderBy(F.desc("n")).first()
        if row is None:
            return None
        p = json.loads(row["payload"])
        return self.spark.read.schema(StructType.fromJson(json.loads(p["schema"]))).parquet(p["path"])

    def _need(self, s: Session, kind: str, *states: str) -> DataFrame:
        if s.state not in states:
            raise NotAllowed(f"{kind} is asked for in state {s.state}")
        df = self._kept(s, kind)
        if df is None:
            raise NotAllowed(f"iteration {s.iteration} has no {kind}")
        return df

    # Planning.
    def observe(self, session_id: str) -> DataFrame:
        s = self.status(session_id)
        if s.state not in ("PLANNING", "UPDATING"):
            raise NotAllowed("knowledge is observed while planning or updating")
        gaps = self._keep(s, "gaps", self.engine.gaps())
        self._keep(s, "contradictions", self.engine.contradictions())
        asked = self.spark.createDataFrame([(0, s.question)], "query_id int, text string")
        sure = self.engine.answer(asked, chunks=False).confidence.first()["confidence"]
        self._note(s, "snapshot", {"gaps": gaps.count(), "confidence": sure})
        return gaps

    def generate(self, session_id: str) -> DataFrame:
        s = self.status(session_id)
        return self._keep(s, "candidates", P.candidates(self._need(s, "gaps", "PLANNING"), s.question, s.session_id))

    def score(self, session_id: str) -> DataFrame:
        s = self.status(session_id)
        scored = self._keep(s, "scores", P.score(self._need(s, "candidates", "PLANNING"), self._need(s, "gaps", "PLANNING")))
        self._note(s, "forecast", P.forecast(scored).first().asDict())
        return scored

    def select(self, session_id: str, workers: int, top: int | None = None) -> DataFrame:
        s = self.status(session_id)
        return self._keep(s, "selection", P.select(self._need(s, "scores", "PLANNING"), s.budget, s.used, workers, top))

    def build_plan(self, session_id: str, dependencies: DataFrame | None = None) -> DataFrame:
        s = self.status(session_id)
        nodes = self._need(s, "selection", "PLANNING").where("selected")
        edges = dependencies if dependencies is not None else self.spark.createDataFrame([], "parent string, id string")
        if nodes.isEmpty():
            raise NotAllowed("nothing was selected")
        problems = P.plan_problems(nodes, edges).collect()
        if problems:
            raise ValueError(f"plan: {problems[0]['problem']} at {problems[0]['id']}")
        self._keep(s, "edges", edges)
        return self._keep(s, "plan", nodes, plan_id=f"plan_{s.session_id}_{s.iteration}")

    def plan_iteration(self, session_id: str, workers: int = 4, top: int | None = None) -> DataFrame | None:
        """All planning stages; without anything worth doing the session ends and there is no plan."""
        self.observe(session_id)
        self.generate(session_id)
        self.score(session_id)
        chosen = self.select(session_id, workers, top)
        if not chosen.where("selected").isEmpty():
            return self.build_plan(session_id)
        snapshot = self.explain(session_id, ["snapshot"])[-1]
        self._end_if(session_id, satisfied=snapshot["gaps"] == 0, gaps=snapshot["gaps"], confidence=snapshot["confidence"], best=None)
        return None

    # Execution.
    def start_execution(self, session_id: str) -> DataFrame:
        """Submits what a plan allows at once. Refused beyond the budget and when it was started before."""
        s = self.status(session_id)
        plan = self._need(s, "plan", "PLANNING")
        if self._kept(s, "execution") is not None:
            raise NotAllowed("plan has already been started")
        n, cost = plan.agg(F.count("*"), F.sum("cost")).first()
        left = s.remaining()
        if n > left.investigations or n > left.agent_runs or cost > left.cost:
            raise NotAllowed("plan exceeds the remaining budget")
        s.transition("EXECUTING", self.clock())
        s.use(investigations=n, agent_runs=n, cost=cost)
        self._save(s)
        return self.advance_execution(session_id)

    def _states(self, s: Session) -> DataFrame:
        tasks = self.runtime.tasks().where(F.col("correlation_id") == s.session_id).where(F.col("plan_id") == f"plan_{s.session_id}_{s.iteration}")
        return tasks.select(F.col("investigation_id").alias("id"), "task_id", "state", "result_ref", "run_id")

    def advance_execution(self, session_id: str) -> DataFrame:
        """Submits every node whose dependencies have succeeded; tasks that exist already are not submitted again."""
        s = self.status(session_id)
        plan, edges = self._need(s, "plan", "EXECUTING"), self._need(s, "edges", "EXECUTING")
        now = P.advance(plan, edges, self._states(s))
        ready = now.where("status = 'submit'").join(plan.select("id", "priority", "capabilities"), "id").orderBy("id").collect()
        names = {0: "LOW", 50: "NORMAL", 100: "HIGH"}
        for r in ready:
            level = 100 if r["priority"] >= 0.67 else 0 if r["priority"] <= 0.33 else 50
            self.runtime.submit(f"run_{r['id']}", s.session_id, names[level], r["capabilities"], plan_id=f"plan_{s.session_id}_{s.iteration}", investigation_id=r["id"])
        return self._keep(s, "execution", P.advance(plan, edges, self._states(s)))

    # Evidence.
    def collect_evidence(self, session_id: str) -> DataFrame:
        """Takes in the results of the tasks that succeeded; once for each iteration, and only once no task is under way."""
        s = self.status(session_id)
        if self._kept(s, "evidence") is not None:
            raise NotAllowed("evidence has already been collected")
        execution = self._need(s, "execution", "EXECUTING")
        now = P.advance(self._need(s, "plan", "EXECUTING"), self._need(s, "edges", "EXECUTING"), self._states(s))
        if not now.where("status in ('running', 'submit', 'waiting')").isEmpty():
            raise NotAllowed("tasks are still under way")
        done = self._states(s).where("state = 'SUCCEEDED'")
        results, conclusions, observations = self.results(done)
        if not results.join(done.select(F.col("task_id")), "task_id", "left_anti").isEmpty():
            raise ValueError("a result is not of a task of this plan")
        found = V.extract_candidates(results, conclusions, observations)
        self._keep(s, "candidate_claims", found.candidates)
        self._keep(s, "diagnostics", found.diagnostics)
        s.use(seconds=max(0.0, self.clock() - s.updated_at))
        self._save(s)
        return self._keep(s, "evidence", found.evidence, tasks=execution.count())

    def evaluate(self, session_id: str) -> DataFrame:
        s = self.status(session_id)
        evidence = self._need(s, "evidence", "EXECUTING", "EVALUATING")
        if s.state == "EXECUTING":
            self._save(s.transition("EVALUATING", self.clock()))
        return self._keep(s, "evaluation", V.evaluate(evidence))

    def verify(self, session_id: str) -> DataFrame:
        s = self.status(session_id)
        decisions = self._keep(s, "decisions", V.verify(self._need(s, "evaluation", "EVALUATING")))
        self._keep(s, "acquisitions", V.acquire(self._need(s, "candidate_claims", "EVALUATING"), decisions))
        return decisions

    def update_knowledge(self, session_id: str) -> dict:
        """Commits eligible claims with their evidence, and assesses those that contradict nothing. A problem with the provenance of
        any of them stops the update before anything is written."""
        s = self.status(session_id)
        decisions, evidence = self._need(s, "decisions", "EVALUATING", "UPDATING"), self._need(s, "evidence", "EVALUATING", "UPDATING")
        e = self.engine
        ready, problems = V.prepare(decisions, evidence, e.table("sources"), e.table("documents"), e.table("chunks"))
        bad = problems.first()
        if bad is not None:
            raise ValueError(f"{bad['problem']}: {bad['evidence_id']}")
        if s.state == "EVALUATING":
            self._save(s.transition("UPDATING", self.clock()))
        claims, records = (cut_lineage(x) for x in V.engine_update(ready))
        receipt = e.commit({"claims": claims, "evidence": records})
        ids = [r["id"] for r in claims.select("id").collect()]
        against = {x for r in e.contradictions().where(F.col("a").isin(*ids) | F.col("b").isin(*ids)).select("a", "b").collect() for x in r} if ids else set()
        free = [i for i in ids if i not in against]
        states = {r["id"]: r["state"] for r in e.assess_claims(F.timestamp_seconds(F.lit(self.clock())), free, commit=True).collect()} if free else {}
        out = {"accepted": receipt.accepted, "rejected": receipt.rejected, "claims": ids, "states": states | {i: "contradicted" for i in ids if i in against}}
        self._note(s, "knowledge_update", out)
        return out

    def finish_iteration(self, session_id: str) -> dict:
        """Measures progress, and ends the session or begins its next iteration. The best score is the one from before the update."""
        s = self.status(session_id)
        if s.state != "UPDATING":
            raise NotAllowed("an iteration is finished while updating")
        before, old = self._kept(s, "gaps"), self._kept(s, "contradictions")
        best = self._kept(s, "scores").agg(F.max("score")).first()[0]
        after, new = cut_lineage(self.engine.gaps()), cut_lineage(self.engine.contradictions())
        report = V.progress(before, after, old, new, cost=s.used.cost, evidence=self._kept(s, "evidence").count()).first().asDict()
        self._note(s, "progress", report)
        sure = self.engine.answer(self.spark.createDataFrame([(0, s.question)], "query_id int, text string"), chunks=False).confidence.first()["confidence"]
        if not self._end_if(session_id, satisfied=False, gaps=after.count(), confidence=sure, best=best, done=1):
            s = self.status(session_id)
            self._save(s.complete_iteration(self.clock()))
        return report

    def _end_if(self, session_id: str, satisfied: bool, gaps: int, confidence: float, best: float | None, done: int = 0) -> bool:
        s = self.status(session_id)
        values = {f"used_{n}": float(getattr(s.used, n)) for n in ("investigations", "agent_runs", "cost", "seconds")} | {f"most_{n}": float(getattr(s.budget, n)) for n in ("investigations", "agent_runs", "cost", "seconds")}
        row = {"state": s.state, "iteration": s.iteration + done, "most_iterations": s.budget.iterations, "cancel": False, "failure": False, "satisfied": satisfied, "gaps": gaps, "confidence": confidence, "contradictions": 0, "resolvable": True, **values}
        df = self.spark.createDataFrame([row]).withColumn("best_score", F.lit(best).cast("double"))
        decision = V.termination(df, self.confidence, self.least).first()
        if decision["reason"] is None:
            return False
        self._save(s.transition(decision["target"], self.clock(), decision["reason"]))
        self._note(s, "termination", {"reason": decision["reason"]})
        return True

    def resume_iteration(self, session_id: str) -> str:
        """Does the next stage of an iteration that was left anywhere; returns its name. Call it until it says `waiting` or an end."""
        s = self.status(session_id)
        if s.state in TERMINAL or s.state == "PAUSED":
            return s.state.lower()
        have = {r["kind"] for r in self.artifacts(session_id).where(F.col("iteration") == s.iteration).select("kind").distinct().collect()}
        if s.state == "PLANNING":
            for kind, stage in (("gaps", self.observe), ("candidates", self.generate), ("scores", self.score), ("selection", lambda i: self.select(i, 4)), ("plan", self.build_plan)):
                if kind not in have:
                    if kind == "plan" and self._kept(s, "selection").where("selected").isEmpty():
                        self._end_if(session_id, False, 1, 0.0, None)
                        return "finish"
                    stage(session_id)
                    return kind
            self.start_execution(session_id)
            return "execution"
        if s.state == "EXECUTING":
            if "evidence" in have:
                self.evaluate(session_id)
                return "evaluation"
            status = {r["status"] for r in self.advance_execution(session_id).select("status").distinct().collect()}
            if status & {"running", "submit", "waiting"}:
                return "waiting"
            self.collect_evidence(session_id)
            return "evidence"
        if s.state == "EVALUATING":
            for kind, stage in (("evaluation", self.evaluate), ("decisions", self.verify), ("knowledge_update", self.update_knowledge)):
                if kind not in have:
                    stage(session_id)
                    return kind
        if "knowledge_update" not in have:
            self.update_knowledge(session_id)
            return "knowledge_update"
        self.finish_iteration(session_id)
        return "finish"

    # Lifecycle.
    def pause(self, session_id: str) -> None:
        self._save(self.status(session_id).pause(self.clock()))

    def resume(self, session_id: str) -> None:
        self._save(self.status(session_id).resume(self.clock()))

    def cancel(self, session_id: str, principal: str = "user") -> None:
        """Ends a session; tasks of its plan that have not ended are cancelled too."""
        s = self.status(session_id)
        for r in self._states(s).where(~F.col("state").isin("SUCCEEDED", "CANCELLED", "DEAD_LETTERED")).collect():
            self.runtime.cancel(r["task_id"], principal)
        self._save(s.transition("CANCELLED", self.clock(), "user_cancellation"))

    def sessions(self) -> DataFrame:
        return latest(self.store.log("sessions").withColumn("seq", F.col("seq").cast("long"))).select("id", "session")
