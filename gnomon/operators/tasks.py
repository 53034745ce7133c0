"""Tasks and workers as state that commands change: claims with leases, late answers, retries, dead letters, cancellation.

A log of commands is folded task by task in the order of `seq`: rows are dealt by task and sorted, and one pass over each
partition carries the state of one task at a time, so a task of any number of commands needs no more memory than another.
The same step() drives the streaming form in gnomon.streaming. Times are seconds since 1970.

Commands: task_id, seq, at, command, worker, lease, failure, text, seconds. `seconds` is the time to the deadline of a
submission (null for none) or the length of a lease; `text` is an error, a result's reference or a checkpoint's.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gnomon.operators.graph import ordered_number
from gnomon.operators.runtime import TRANSITIONS

COMMAND = "task_id string, seq long, at double, command string, worker string, lease string, failure string, text string, seconds double"
OUTCOME = "task_id string, seq long, at double, command string, accepted boolean, note string, state string, version long, attempt long, worker string, lease string, lease_until double, available_at double, deadline double, created double, result_ref string, error string, checkpoint_ref string"
TERMINAL = ("SUCCEEDED", "CANCELLED", "DEAD_LETTERED")
ACTIVE = ("CLAIMED", "RUNNING")
ERROR_CHARS = 4096
_KEPT = [c.split()[0] for c in OUTCOME.split(", ")[6:]]


@dataclass(frozen=True)
class RetryPolicy:
    most_attempts: int = 3
    initial: float = 1.0
    longest: float = 60.0
    factor: float = 2.0
    jitter: float = 0.0

    def __post_init__(self):
        if self.most_attempts < 1 or self.initial < 0 or self.longest < self.initial or self.factor < 1 or not 0 <= self.jitter <= 1:
            raise ValueError("not a retry policy")

    def delay(self, task: str, attempt: int) -> float:
        seconds = min(self.initial * self.factor ** max(0, attempt - 1), self.longest)
        if self.jitter:
            unit = int.from_bytes(hashlib.sha256(f"{task}:{attempt}".encode()).digest()[:8], "big") / ((1 << 64) - 1)
            seconds *= 1 - self.jitter + 2 * self.jitter * unit
        return min(seconds, self.longest)

    def delay_column(self, task: Column, attempt: Column) -> Column:
        seconds = F.least(F.lit(self.initial) * F.pow(F.lit(self.factor), F.greatest(F.lit(0), attempt - 1)), F.lit(self.longest))
        unit = F.conv(F.substring(F.sha2(F.concat_ws(":", task, attempt.cast("string")), 256), 1, 16), 16, 10).cast("double") / F.lit(float((1 << 64) - 1))
        return F.least(seconds * (F.lit(1 - self.jitter) + 2 * self.jitter * unit), F.lit(self.longest)) if self.jitter else seconds


def new_task(at: float, seconds: float | None) -> dict:
    return dict.fromkeys(_KEPT) | {"state": "QUEUED", "version": 0, "attempt": 0, "available_at": at, "created": at, "deadline": None if seconds is None else at + seconds}


class _No(Exception):
    pass


def step(task: dict | None, c: dict, policy: RetryPolicy = RetryPolicy()) -> tuple[dict | None, str | None]:
    """The task after a command, and why the command was refused, which leaves the task as it was."""
    try:
        if c["command"] == "submit":
            if task is not None:
                raise _No("task exists")
            if c["seconds"] is not None and c["seconds"] <= 0:
                raise _No("deadline is not after creation")
            return new_task(c["at"], c["seconds"]), None
        if task is None:
            raise _No("unknown task")
        new, now = dict(task), c["at"]
        change = _COMMANDS.get(c["command"])
        if change is None:
            raise _No(f"unknown command: {c['command']}")
        change(new, c, now, policy)
        if new != task or c["command"] != "cancel":
            new["version"] = task["version"] + 1
        return new, None
    except _No as e:
        return task, str(e)


def _to(task: dict, *states: str) -> None:
    for state in states:
        if state not in TRANSITIONS[task["state"]]:
            raise _No(f"invalid transition: {task['state']} -> {state}")
        task["state"] = state


def _owned(task: dict, c: dict, now: float) -> None:
    if task["worker"] is None or task["worker"] != c["worker"] or task["lease"] != c["lease"]:
        raise _No("worker does not own the current lease")
    if now >= task["lease_until"]:
        raise _No("lease is stale")


def _free(task: dict) -> None:
    task["worker"] = task["lease"] = task["lease_until"] = None


def _failed(task: dict, c: dict, now: float, policy: RetryPolicy, error: str, retry: bool, checkpoint: str | None) -> None:
    _to(task, "FAILED")
    task["error"], task["checkpoint_ref"] = error[:ERROR_CHARS], checkpoint
    if retry and task["attempt"] < policy.most_attempts:
        _to(task, "RETRY_WAIT")
        task["available_at"] = now + policy.delay(c["task_id"], task["attempt"])
    else:
        _to(task, "DEAD_LETTERED")
    _free(task)


def _claim(task: dict, c: dict, now: float, policy: RetryPolicy) -> None:
    if task["state"] != "QUEUED" or task["available_at"] > now or (task["deadline"] is not None and task["deadline"] <= now):
        raise _No("task is not available")
    _to(task, "CLAIMED")
    task.update(attempt=task["attempt"] + 1, worker=c["worker"], lease=c["lease"], lease_until=now + c["seconds"])


def _start(task: dict, c: dict, now: float, policy: RetryPolicy) -> None:
    _owned(task, c, now)
    _to(task, "RUNNING")


def _renew(task: dict, c: dict, now: float, policy: RetryPolicy) -> None:
    _owned(task, c, now)
    if task["state"] not in ACTIVE:
        raise _No("only active tasks can renew a lease")
    task["lease_until"] = now + c["seconds"]


def _complete(task: dict, c: dict, now: float, policy: RetryPolicy) -> None:
    _owned(task, c, now)
    _to(task, "SUCCEEDED")
    task["result_ref"] = c["text"]


def _fail(task: dict, c: dict, now: float, policy: RetryPolicy) -> None:
    _owned(task, c, now)
    if c["failure"] == "CANCELLED":
        _to(task, *(["CANCELLED"] if task["state"] == "CANCEL_REQUESTED" else ["CANCEL_REQUESTED", "CANCELLED"]))
        _free(task)
    else:
        _failed(task, c, now, policy, c["text"] or "", c["failure"] == "TRANSIENT", None)


def _release(task: dict, c: dict, now: float, policy: RetryPolicy) -> None:
    if task["state"] not in (*ACTIVE, "CANCEL_REQUESTED"):
        raise _No("task does not hold an active lease")
    if task["lease_until"] is not None and task["lease_until"] > now:
        raise _No("lease has not expired")
    if task["state"] == "CANCEL_REQUESTED":
        _to(task, "CANCELLED")
        _free(task)
    else:
        _failed(task, c, now, policy, "lease expired", True, task["checkpoint_ref"])


def _cancel(task: dict, c: dict, now: float, policy: RetryPolicy) -> None:
    if task["state"] in (*TERMINAL, "CANCEL_REQUESTED"):
        return
    _to(task, "CANCEL_REQUESTED")
    if task["worker"] is None:
        _to(task, "CANCELLED")


def _cancelled(task: dict, c: dict, now: float, policy: RetryPolicy) -> None:
    _owned(task, c, now)
    if task["state"] != "CANCEL_REQUESTED":
        raise _No("task has no cancellation request")
    _to(task, "CANCELLED")
    _free(task)


def _retry(task: dict, c: dict, now: float, policy: RetryPolicy) -> None:
    if task["state"] != "DEAD_LETTERED":
        raise _No("only dead-lettered tasks can be retried by hand")
    _to(task, "QUEUED")
    task.update(available_at=now, result_ref=None)
    _free(task)


def _due(task: dict, c: dict, now: float, policy: RetryPolicy) -> None:
    if task["state"] != "RETRY_WAIT" or task["available_at"] > now:
        raise _No("retry is not due")
    _to(task, "QUEUED")


def _expire(task: dict, c: dict, now: float, policy: RetryPolicy) -> None:
    if task["state"] not in ("QUEUED", "RETRY_WAIT") or task["deadline"] is None or task["deadline"] > now:
        raise _No("deadline has not expired")
    _to(task, "FAILED", "DEAD_LETTERED")
    task["error"] = "task deadline expired"


def _checkpoint(task: dict, c: dict, now: float, policy: RetryPolicy) -> None:
    _owned(task, c, now)
    task["checkpoint_ref"] = c["text"]


_COMMANDS = {"claim": _claim, "start": _start, "renew": _renew, "complete": _complete, "fail": _fail, "release": _release, "cancel": _cancel, "cancelled": _cancelled, "retry": _retry, "due": _due, "expire": _expire, "checkpoint": _checkpoint}


def outcome(task: dict | None, c: dict, note: str | None) -> tuple:
    kept = task or dict.fromkeys(_KEPT)
    return (c["task_id"], c["seq"], c["at"], c["command"], note is None, note, *[kept[k] for k in _KEPT])


def plain(row: dict) -> dict:
    """A command with None for what pandas calls missing."""
    return {k: None if isinstance(v, float) and v != v else v for k, v in row.items()}


def fold(commands: DataFrame, policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """OUTCOME rows: what became of every command, and the task after it."""
    import pyarrow as pa

    names = [c.split()[0] for c in COMMAND.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in OUTCOME.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, task = None, None
        for batch in batches:
            out = []
            for c in batch.to_pylist():
                if c["task_id"] != at:
                    at, task = c["task_id"], None
                task, note = step(task, c, policy)
                out.append(outcome(task, c, note))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)

    rows = commands.select(*names).where("task_id is not null")
    return rows.repartition("task_id").sortWithinPartitions("task_id", "seq").mapInArrow(run, OUTCOME)


def current(outcomes: DataFrame) -> DataFrame:
    """The state of every task: its last outcome after which there was a task."""
    rest = [c for c in _KEPT]
    one = outcomes.where("state is not null").groupBy("task_id").agg(F.max(F.struct("seq", *rest)).alias("t"))
    return one.select("task_id", *[F.col(f"t.{c}").alias(c) for c in rest])


# Questions about the task table.
def queued(tasks: DataFrame, now: Column) -> DataFrame:
    return tasks.where((F.col("state") == "QUEUED") & (F.col("available_at") <= now) & (F.col("deadline").isNull() | (F.col("deadline") > now)))


def expired(tasks: DataFrame, now: Column) -> DataFrame:
    return tasks.where(F.col("state").isin(*ACTIVE, "CANCEL_REQUESTED") & (F.col("lease_until").isNull() | (F.col("lease_until") <= now)))


def of_worker(tasks: DataFrame, worker: str) -> DataFrame:
    return tasks.where(F.col("worker") == worker)


def queue_stats(tasks: DataFrame) -> DataFrame:
    """state, tasks for all states, zeros included, and `depth`: the tasks that have not ended."""
    names = tasks.sparkSession.createDataFrame([(s,) for s in TRANSITIONS], "state string")
    counts = names.join(tasks.groupBy("state").agg(F.count("*").alias("tasks")), "state", "left").fillna(0, ["tasks"])
    depth = tasks.agg(F.count_if(~F.col("state").isin(*TERMINAL)).alias("tasks")).select(F.lit("depth").alias("state"), "tasks")
    return counts.unionByName(depth)


def runtime_stats(workers: DataFrame) -> DataFrame:
    """workers, capacity, running, utilization of rows (worker, capacity, running)."""
    sums = workers.agg(F.count("*").alias("workers"), F.coalesce(F.sum("capacity"), F.lit(0)).alias("capacity"), F.coalesce(F.sum("running"), F.lit(0)).alias("running"))
    return sums.withColumn("utilization", F.when(F.col("capacity") > 0, F.col("running") / F.col("capacity")).otherwise(0.0))


def valid_tasks(tasks: DataFrame, bytes_of_metadata: int = 64 << 10) -> DataFrame:
    """Adds problem to submissions (run_id, correlation_id, capabilities, metadata as JSON, created, deadline): null if all is well."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    problem = F.when(blank("run_id") | blank("correlation_id"), "run_id and correlation_id are required").when(F.col("deadline") <= F.col("created"), "deadline is not after creation")
    problem = problem.when(F.exists(F.coalesce("capabilities", F.array().cast("array<string>")), lambda c: F.coalesce(F.trim(c), F.lit("")) == ""), "blank capability")
    problem = problem.when(F.col("metadata").isNotNull() & F.try_parse_json("metadata").isNull(), "metadata is not JSON").when(F.octet_length("metadata") > bytes_of_metadata, "metadata is too large")
    return tasks.withColumn("problem", problem)


def admit(submissions: DataFrame, pending: int, most: int, order: str = "seq") -> DataFrame:
    """Submissions of a batch with accepted: the first, in their order, that a queue of at most `most` open tasks has room for."""
    room = max(0, most - pending)
    return ordered_number(submissions, order, "_at").withColumn("accepted", F.col("_at") < room).drop("_at")


def effective_priority(priority: Column, created: Column, now: Column, interval: float, step: int) -> Column:
    """A priority that grows by `step` for each whole interval waited; no wait is below 0."""
    return priority + F.floor(F.greatest(F.lit(0.0), now - created) / F.lit(float(interval))) * step


def rank(tasks: DataFrame, now: Column, capabilities: list[str] | None = None, interval: float = 60.0, step: int = 1, top: int | None = None) -> DataFrame:
    """Tasks that a worker of these capabilities may take, by effective priority, age and id; with `top` only the first.

    tasks: task_id, priority, created, and, where they are given, available_at, deadline and capabilities.
    """
    rows = tasks
    if "available_at" in tasks.columns:
        rows = rows.where(F.col("available_at") <= now)
    if "deadline" in tasks.columns:
        rows = rows.where(F.col("deadline").isNull() | (F.col("deadline") > now))
    if capabilities is not None and "capabilities" in tasks.columns:
        mine = F.array(*[F.lit(c) for c in capabilities]).cast("array<string>")
        rows = rows.where(F.size(F.array_except(F.coalesce("capabilities", F.array().cast("array<string>")), mine)) == 0)
    rows = rows.withColumn("effective", effective_priority(F.col("priority"), F.col("created"), now, interval, step).cast("long"))
    if top is not None:
        return rows.orderBy(F.desc("effective"), "created", "task_id").limit(top)
    rows = rows.withColumn("_key", F.struct((-F.col("effective")).alias("e"), "created", "task_id"))
    return ordered_number(rows, "_key", "_n").withColumn("rank", F.col("_n") + 1).drop("_key", "_n")


def next_claims(tasks: DataFrame, worker: str, capabilities: list[str], slots: int, now: float, lease: float, seq: int, interval: float = 60.0, step: int = 1) -> DataFrame:
    """Claim commands of a worker with free slots for the tasks ranked first."""
    rows = rank(queued(tasks, F.lit(now)), F.lit(now), capabilities, interval, step, max(0, slots))
    ident = F.concat(F.lit("lease_"), F.substring(F.sha2(F.concat_ws("\x1f", "task_id", (F.col("attempt") + 1).cast("string"), F.lit(worker)), 256), 1, 16))
    return rows.select("task_id", F.lit(seq).cast("long").alias("seq"), F.lit(now).alias("at"), F.lit("claim").alias("command"), F.lit(worker).alias("worker"), ident.alias("lease"), F.lit(None).cast("string").alias("failure"), F.lit(None).cast("string").alias("text"), F.lit(float(lease)).alias("seconds"))


def recovery(tasks: DataFrame, now: Column, policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """The task table after a sweep at `now`, with `swept`: due retries are queued, passed deadlines dead-lettered, and
    expired leases released, which queues a task at once where its retry is due already."""
    state, wait = F.col("state"), F.col("available_at")
    # A due retry is queued first, and dead-lettered if its deadline has passed as well.
    due = (state == "RETRY_WAIT") & (wait <= now)
    late = state.isin("QUEUED", "RETRY_WAIT") & (F.col("deadline") <= now)
    lost = state.isin(*ACTIVE, "CANCEL_REQUESTED") & (F.col("lease_until").isNull() | (F.col("lease_until") <= now))
    delay = policy.delay_column(F.col("task_id"), F.col("attempt"))
    swept = F.when(late, "deadline").when(due, "retry").when(lost & (state == "CANCEL_REQUESTED"), "cancelled").when(lost & (F.col("attempt") >= policy.most_attempts), "dead").when(lost & (delay <= 0), "requeued").when(lost, "waits")
    rows = tasks.withColumn("swept", swept)
    s = F.col("swept")
    after = F.when(s.isin("deadline", "dead"), "DEAD_LETTERED").when(s.isin("retry", "requeued"), "QUEUED").when(s == "cancelled", "CANCELLED").when(s == "waits", "RETRY_WAIT").otherwise(state)
    freed = s.isin("cancelled", "dead", "requeued", "waits")
    error = F.when(s == "deadline", "task deadline expired").when(s.isin("dead", "requeued", "waits"), "lease expired").otherwise(F.col("error"))
    changes = {"state": after, "error": error, "available_at": F.when(s.isin("waits", "requeued"), now + delay).otherwise(wait)}
    for name in ("worker", "lease", "lease_until"):
        changes[name] = F.when(~F.coalesce(freed, F.lit(False)), F.col(name))
    # A row's changes are all worked out from what it was before.
    return rows.withColumns(changes)


def update_if(tasks: DataFrame, proposed: DataFrame, protected: tuple[str, ...] = ("state", "attempt", "worker", "lease", "result_ref", "error", "created")) -> tuple[DataFrame, DataFrame]:
    """Tasks after updates that name the version they saw, and the refused ones with a note: another version, or a change to
    a column that only commands may change."""
    p = proposed.select("task_id", "version", F.struct(*[c for c in proposed.columns if c not in ("task_id", "version")]).alias("p"))
    old = tasks.select("task_id", F.struct(*[c for c in tasks.columns if c != "task_id"]).alias("o"))
    rows = p.join(old, "task_id", "left")
    same = F.lit(True)
    for name in protected:
        same = same & F.col(f"p.{name}").eqNullSafe(F.col(f"o.{name}")) if name in proposed.columns else same
    note = F.when(F.col("o").isNull(), "unknown task").when(F.col("o.version") != F.col("version"), "version conflict").when(~same, "coordination fields require a command")
    rows = rows.withColumn("note", note)
    taken = rows.where("note is null").select("task_id", *[(F.col("version") + 1 if c == "version" else F.col(f"p.{c}") if c in proposed.columns else F.col(f"o.{c}")).alias(c) for c in tasks.columns if c != "task_id"])
    rest = tasks.join(taken.select("task_id"), "task_id", "left_anti")
    return rest.unionByName(taken.select(tasks.columns)), rows.where("note is not null").select("task_id", "version", "note")


# Workers. Rows: worker, seq, at, command (register, heartbeat, assign, release, drain, check), text (task or version), number.
WORKER = "worker string, seq long, at double, command string, accepted boolean, note string, status string, last_heartbeat double, capacity long, tasks array<string>"


def worker_step(w: dict | None, c: dict, threshold: float) -> tuple[dict | None, str | None]:
    """A worker after a command, and why it was refused. `check` marks one unhealthy that has been silent for the threshold."""
    kind = c["command"]
    if kind == "register":
        if c["number"] is None or c["number"] < 1:
            return w, "capacity must be positive"
        held = [] if w is None or w["status"] in ("STOPPED", "UNHEALTHY") else w["tasks"]
        return {"status": "BUSY" if held else "READY", "last_heartbeat": c["at"], "capacity": int(c["number"]), "tasks": held}, None
    if w is None:
        return w, "unknown worker"
    new, tasks = dict(w), set(w["tasks"])
    if kind == "heartbeat":
        if w["status"] in ("UNHEALTHY", "STOPPED"):
            return w, "inactive worker must register again"
        new["last_heartbeat"] = c["at"]
        if w["status"] != "DRAINING":
            new["status"] = "BUSY" if tasks else "READY"
    elif kind == "assign":
        if w["status"] not in ("READY", "BUSY"):
            return w, "worker is not accepting tasks"
        if len(tasks) >= w["capacity"]:
            return w, "worker has no available capacity"
        tasks.add(c["text"])
        new["status"] = "BUSY"
    elif kind == "release":
        tasks.discard(c["text"])
        if w["status"] == "DRAINING":
            new["status"] = "DRAINING" if tasks else "STOPPED"
        elif w["status"] not in ("UNHEALTHY", "STOPPED"):
            new["status"] = "BUSY" if tasks else "READY"
    elif kind == "drain":
        new["status"] = "DRAINING" if tasks else "STOPPED"
    elif kind == "check":
        if w["status"] not in ("STOPPED", "UNHEALTHY") and c["at"] - w["last_heartbeat"] >= threshold:
            new["status"] = "UNHEALTHY"
    else:
        return w, f"unknown command: {kind}"
    new["tasks"] = sorted(tasks)
    return new, None


def fold_workers(commands: DataFrame, threshold: float = 30.0) -> DataFrame:
    """WORKER rows: what became of every command, and the worker after it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, w = None, None
        for batch in batches:
            out = []
            for c in map(plain, batch.to_dict("records")):
                if c["worker"] != at:
                    at, w = c["worker"], None
                w, note = worker_step(w, c, threshold)
                kept = w or {"status": None, "last_heartbeat": None, "capacity": None, "tasks": None}
                out.append((c["worker"], c["seq"], c["at"], c["command"], note is None, note, kept["status"], kept["last_heartbeat"], kept["capacity"], kept["tasks"]))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in WORKER.split(", ")]).astype({"capacity": "Int64"})

    rows = commands.select("worker", "seq", "at", "command", "text", "number").where("worker is not null")
    return rows.repartition("worker").sortWithinPartitions("worker", "seq").mapInPandas(run, WORKER)


def authorized(identities: DataFrame, grants: DataFrame) -> DataFrame:
    """Adds authorized to workers (subject, capabilities): whether they have exactly the capabilities granted to them."""
    mine = grants.select("subject", F.sort_array(F.array_distinct("capabilities")).alias("granted"))
    rows = identities.join(mine, "subject", "left")
    return rows.withColumn("authorized", F.coalesce(F.sort_array(F.array_distinct("capabilities")) == F.col("granted"), F.lit(False))).drop("granted")


# Events.
def deliveries(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """event_id, topic, subscription_id: each event to the subscribers of its topic, and of all topics (`*`)."""
    rows = events.withColumn("topic", F.substring_index("event_type", ".", 1))
    return rows.select("event_id", "topic", F.explode(F.array("topic", F.lit("*"))).alias("to")).join(subscriptions.select(F.col("topic").alias("to"), "subscription_id"), "to").select("event_id", "topic", "subscription_id")


def dispatch(events: DataFrame, handlers: dict[str, tuple[str, object]]) -> DataFrame:
    """event_id, subscription_id, ok, reason: handlers {subscription: (topic, function of an event row)} run in the executors;
    one that fails makes a dead letter with its reason, and the others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for event in map(plain, batch.to_dict("records")):
                for name, (topic, handle) in sorted(handlers.items()):
                    if topic in ("*", event["event_type"].split(".", 1)[0]):
                        try:
                            handle(event)
                            out.append((event["event_id"], name, True, None))
                        except Exception as e:  # noqa: BLE001
                            out.append((event["event_id"], name, False, f"subscriber failed: {e!r}"))
            yield pd.DataFrame(out, columns=["event_id", "subscription_id", "ok", "reason"])

    return events.mapInPandas(run, f"event_id {dict(events.dtypes)['event_id']}, subscription_id string, ok boolean, reason string")


# Agent runs and tools.
RUN_TRANSITIONS = {
    "CREATED": ["RUNNING", "CANCELLED"],
    "RUNNING": ["WAITING", "PAUSED", "COMPLETED", "FAILED", "RETRYING", "CANCELLED"],
    "WAITING": ["RUNNING", "CANCELLED"],
    "PAUSED": ["RUNNING", "CANCELLED"],
    "RETRYING": ["RUNNING", "FAILED", "CANCELLED"],
    "COMPLETED": [],
    "FAILED": [],
    "CANCELLED": [],
}


def lineage(runs: DataFrame, deepest: int = 4) -> DataFrame:
    """run_id, root_run_id, depth, path of runs (run_id, parent_run_id), down from those without a parent. RuntimeError where a
    run is deeper than `deepest`, has an unknown parent or is its own ancestor."""
    from gnomon.functions.storage import cut_lineage

    rows = cut_lineage(runs.select("run_id", "parent_run_id"))
    front = rows.where("parent_run_id is null").select("run_id", F.col("run_id").alias("root_run_id"), F.lit(0).alias("depth"), F.array("run_id").alias("path"))
    out = front
    for _ in range(deepest):
        child = rows.withColumnRenamed("run_id", "child").join(front, F.col("parent_run_id") == F.col("run_id"))
        front = cut_lineage(child.select(F.col("child").alias("run_id"), "root_run_id", (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("child")).alias("path")))
        out = out.unionByName(front)
    if not rows.join(out, "run_id", "left_anti").isEmpty():
        raise RuntimeError(f"runs deeper than {deepest}, of unknown parents, or their own ancestors")
    return out


def budget_use(usage: DataFrame, limits: DataFrame) -> DataFrame:
    """run_id, seq, kind, used, paused: running sums of tokens, tool calls or seconds, and whether they are above the limit.

    usage: run_id, seq, kind, amount (none below 0). limits: run_id, kind, most.
    """
    order = W.partitionBy("run_id", "kind").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    amount = F.when(F.col("amount") < 0, F.raise_error(F.lit("usage cannot be negative"))).otherwise(F.col("amount"))
    rows = usage.withColumn("used", F.sum(amount).over(order)).join(limits, ["run_id", "kind"], "left")
    return rows.select("run_id", "seq", "kind", "used", F.coalesce(F.col("used") > F.col("most"), F.lit(False)).alias("paused"))


def delegations(parents: DataFrame, asked: DataFrame, deepest: int = 4) -> DataFrame:
    """Child runs for delegations (parent_run_id, agent_id, task, seq), with problem: a parent that is not running, or too deep."""
    p = parents.select(F.col("run_id").alias("parent_run_id"), F.col("state").alias("p"), F.col("depth").alias("d"), F.coalesce("root_run_id", "run_id").alias("root_run_id"))
    rows = asked.join(p, "parent_run_id", "left")
    problem = F.when(F.col("p").isNull(), "unknown parent run").when(F.col("p") != "RUNNING", "parent run is not running").when(F.col("d") + 1 > deepest, f"deeper than {deepest}")
    ident = lambda kind: F.concat(F.lit(kind + "_"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(kind), "parent_run_id", "agent_id", "task", F.col("seq").cast("string")), 256), 1, 16))
    return rows.select(ident("run").alias("run_id"), "parent_run_id", "root_run_id", ident("delegation").alias("delegation_id"), "agent_id", "task", (F.col("d") + 1).alias("depth"), problem.alias("problem"))


def parse_conclusions(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conclusions and malformed ones (index, reason) of agents' outputs (result_id, output as JSON with a list `conclusions`)."""
    item = "array<struct<i:int,ok:boolean,reason:string,conclusion_id:string,claim_id:string,text:string,subject:string,predicate:string,object:string,confidence:double,ids:array<string>>>"

    @F.pandas_udf(item)
    def parse(texts: pd.Series) -> pd.Series:
        return pd.Series([_conclusions(t) for t in texts], dtype=object)

    rows = outputs.select("result_id", F.explode(parse("output")).alias("c")).select("result_id", "c.*")
    made = F.concat(F.lit("claim_"), F.substring(F.sha2(F.concat_ws("\x1f", "subject", "predicate", "object"), 256), 1, 24))
    named = F.concat(F.lit("conclusion_"), F.substring(F.sha2(F.concat_ws("\x1f", "result_id", F.col("i").cast("string"), "text"), 256), 1, 24))
    good = rows.where("ok").select("result_id", F.col("i").cast("long").alias("seq"), F.coalesce("conclusion_id", named).alias("conclusion_id"), F.coalesce("claim_id", made).alias("claim_id"), "text", "subject", "predicate", "object", "confidence", F.col("ids").alias("supporting_observation_ids"))
    return good, rows.where("not ok").select("result_id", "conclusion_id", F.col("i").alias("index"), "reason")


def _conclusions(text: str | None) -> list[dict]:
    try:
        listed = json.loads(text or "{}")
    except ValueError:
        return []
    listed = listed.get("conclusions") if isinstance(listed, dict) else None
    out = []
    for i, x in enumerate(listed if isinstance(listed, list) else []):
        row = dict.fromkeys(("reason", "conclusion_id", "claim_id", "text", "subject", "predicate", "object", "confidence", "ids")) | {"i": i, "ok": False}
        reason = None
        if not isinstance(x, dict):
            reason = "conclusion must be an object"
        else:
            claim, ids, sure = x.get("claim"), x.get("supporting_observation_ids", []), x.get("confidence", 0.5)
            text_of = lambda d, k: d[k] if isinstance(d.get(k), str) and d[k].strip() else None
            row["conclusion_id"] = text_of(x, "conclusion_id")
            if not isinstance(claim, dict):
                reason = "claim must be an object"
            elif missing := [k for k in ("text", "subject", "predicate", "object") if text_of(claim, k) is None]:
                reason = f"claim {missing[0]} must be a text"
            elif not isinstance(ids, list) or any(not isinstance(v, str) for v in ids):
                reason = "supporting_observation_ids must be a list of strings"
            elif not isinstance(x.get("metadata", {}), dict):
                reason = "conclusion metadata must be an object"
            elif isinstance(sure, bool) or not isinstance(sure, (int, float)) or not 0 <= sure <= 1:
                reason = "conclusion confidence must be numeric"
            else:
                row |= {k: claim[k].strip() for k in ("text", "subject", "predicate", "object")} | {"claim_id": text_of(claim, "claim_id"), "ids": ids, "confidence": float(sure)}
        out.append(row | {"ok": reason is None, "reason": reason})
    return out


def failure_class(error: Column) -> Column:
    low = F.lower(error)
    return F.when(low.contains("denied by policy"), "POLICY_VIOLATION").when(low.contains("budget exhausted"), "BUDGET_EXHAUSTED").otherwise("TRANSIENT")


def tool_calls(calls: DataFrame, tools: DataFrame, grants: DataFrame, approval: list[str]) -> DataFrame:
    """Adds problem and decision to calls (call_id, principal, tool, input as JSON): an unknown tool, input without a required
    key, else what the policy says. tools: tool, capability, side_effect, required (array of keys)."""
    from gnomon.operators.runtime import policy_decisions

    rows = calls.join(tools, "tool", "left")
    keys = F.coalesce(F.json_object_keys("input"), F.array().cast("array<string>"))
    problem = F.when(F.col("capability").isNull(), "unknown tool").when(F.json_object_keys("input").isNull(), "input must be an object").when(F.size(F.array_except("required", keys)) > 0, "input does not match required fields")
    asked = rows.withColumn("problem", problem).withColumn("actor", F.col("principal")).withColumn("destructive", F.col("side_effect") == "destructive")
    decided = policy_decisions(asked, grants.withColumnRenamed("principal", "actor"), approval)
    return decided.withColumn("decision", F.when(F.col("problem").isNull(), F.col("decision"))).drop("actor", "destructive")
