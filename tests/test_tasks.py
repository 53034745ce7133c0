"""Tasks and workers: a plain fold, refused commands, retries, sweeps, and the streaming forms against the batch."""

import random

import pytest
from pyspark.sql import functions as F

from gnomon.operators import tasks as T
from gnomon.streaming import tasks as S


def command(task, seq, at, name, worker=None, lease=None, failure=None, text=None, seconds=None):
    return (task, seq, float(at), name, worker, lease, failure, text, seconds)


def folded(spark, *rows, policy=T.RetryPolicy()):
    return T.fold(spark.createDataFrame(list(rows), T.COMMAND).repartition(3), policy).orderBy("task_id", "seq").collect()


def random_log(seed, tasks=8, length=25):
    rnd, rows = random.Random(seed), []
    for t in range(tasks):
        at = 0.0
        for seq in range(length):
            at += rnd.choice([0, 1, 5, 20])
            name = "submit" if seq == 0 else rnd.choice(["claim", "start", "start", "complete", "fail", "renew", "release", "cancel", "cancelled", "due", "retry", "expire", "claim", "checkpoint", "nonsense"])
            rows.append(command(f"t{t}", seq, at, name, rnd.choice(["w1", "w2"]), f"l{rnd.randint(0, 1)}", rnd.choice(["TRANSIENT", "PERMANENT", "CANCELLED"]), "x", rnd.choice([5.0, 60.0])))
    return rows


def test_life_of_a_task(spark):
    rows = folded(
        spark,
        command("a", 0, 0, "submit"), command("a", 1, 1, "claim", "w", "l1", seconds=10.0), command("a", 2, 2, "start", "w", "l1"), command("a", 3, 5, "complete", "x", "l1"), command("a", 4, 6, "complete", "w", "l1", text="ref"), command("a", 5, 7, "complete", "w", "l1"), command("a", 6, 8, "cancel"),
        command("b", 0, 0, "submit"), command("b", 1, 0, "claim", "w", "l", seconds=10.0), command("b", 2, 10, "start", "w", "l"), command("b", 3, 10, "release"), command("b", 4, 10, "due"), command("b", 5, 11, "due"), command("b", 6, 11, "claim", "w", "m", seconds=1.0), command("b", 7, 11.5, "fail", "w", "m", "PERMANENT", "e" * 5000), command("b", 8, 12, "retry"),
        command("c", 0, 0, "submit", seconds=5.0), command("c", 1, 5, "claim", "w", "l", seconds=9.0), command("c", 2, 5, "expire"), command("d", 1, 0, "start", "w", "l"), command("e", 0, 0, "submit"), command("e", 1, 1, "cancel"),
    )
    notes = {(r["task_id"], r["seq"]): r["note"] for r in rows if not r["accepted"]}
    assert notes == {("a", 3): "worker does not own the current lease", ("a", 5): "invalid transition: SUCCEEDED -> SUCCEEDED", ("b", 2): "lease is stale", ("b", 4): "retry is not due", ("c", 1): "task is not available", ("d", 1): "unknown task"}
    last = {r["task_id"]: r for r in rows}
    assert (last["a"]["state"], last["a"]["result_ref"], last["a"]["attempt"]) == ("SUCCEEDED", "ref", 1)
    assert (last["b"]["state"], len(last["b"]["error"]), last["b"]["attempt"]) == ("QUEUED", 4096, 2)
    assert (last["c"]["state"], last["c"]["error"], last["e"]["state"]) == ("DEAD_LETTERED", "task deadline expired", "CANCELLED")
    current = {r["task_id"]: r["state"] for r in T.current(spark.createDataFrame(rows, T.OUTCOME)).collect()}
    assert current == {"a": "SUCCEEDED", "b": "QUEUED", "c": "DEAD_LETTERED", "e": "CANCELLED"}
    assert folded(spark) == []


def test_fold_is_the_same_in_any_layout(spark):
    rows = random_log(1)
    want, state = [], {}
    names = [c.split()[0] for c in T.COMMAND.split(", ")]
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        c = dict(zip(names, r))
        state[r[0]], note = T.step(state.get(r[0]), c)
        want.append(T.outcome(state[r[0]], c, note))
    random.Random(2).shuffle(rows)
    assert [tuple(r) for r in folded(spark, *rows)] == want


def test_retry_delays():
    p = T.RetryPolicy(initial=1.0, longest=5.0, factor=2.0)
    assert [p.delay("t", n) for n in (0, 1, 2, 3, 4, 9)] == [1, 1, 2, 4, 5, 5]
    j = T.RetryPolicy(jitter=0.5)
    assert 0.5 <= j.delay("t", 1) <= 1.5 and j.delay("t", 1) == j.delay("t", 1) != j.delay("u", 1)
    with pytest.raises(ValueError):
        T.RetryPolicy(most_attempts=0)


def test_sweep_agrees_with_commands(spark):
    """What recovery() says of a table is what the commands of a sweep do to it."""
    log = random_log(3, 30, 8)
    df = spark.createDataFrame(log, T.COMMAND)
    now = 60.0
    table = T.current(T.fold(df))
    swept = {r["task_id"]: r for r in T.recovery(table, F.lit(now)).collect()}
    for r in table.collect():
        task = r.asDict()
        task_id = task.pop("task_id")
        for name in ("due", "expire", "release"):
            task, _ = T.step(task, dict(zip([c.split()[0] for c in T.COMMAND.split(", ")], command(task_id, 99, now, name))))
        assert (task["state"], task["worker"], task["error"]) == (swept[task_id]["state"], swept[task_id]["worker"], swept[task_id]["error"]), task_id


def test_workers(spark):
    rows = [("w", 0, 0.0, "heartbeat", None, None), ("w", 1, 0.0, "register", None, 0), ("w", 2, 0.0, "register", None, 1), ("w", 3, 1.0, "assign", "t1", None), ("w", 4, 1.0, "assign", "t2", None), ("w", 5, 2.0, "drain", None, None), ("w", 6, 3.0, "assign", "t3", None), ("w", 7, 4.0, "release", "t1", None), ("w", 8, 5.0, "heartbeat", None, None), ("v", 1, 0.0, "register", None, 2), ("v", 2, 30.0, "check", None, None), ("v", 3, 31.0, "heartbeat", None, None), ("v", 4, 32.0, "register", None, 3)]
    got = T.fold_workers(spark.createDataFrame(rows, "worker string, seq long, at double, command string, text string, number long"), 30.0).orderBy("worker", "seq").collect()
    assert [(r["worker"], r["status"], r["note"]) for r in got] == [
        ("v", "READY", None), ("v", "UNHEALTHY", None), ("v", "UNHEALTHY", "inactive worker must register again"), ("v", "READY", None),
        ("w", None, "unknown worker"), ("w", None, "capacity must be positive"), ("w", "READY", None), ("w", "BUSY", None), ("w", "BUSY", "worker has no available capacity"), ("w", "DRAINING", None), ("w", "DRAINING", "worker is not accepting tasks"), ("w", "STOPPED", None), ("w", "STOPPED", "inactive worker must register again"),
    ]


def test_ranks_and_claims(spark):
    rows = [("t1", 50, 0.0, 0.0, None, ["a"], "QUEUED", 0), ("t2", 50, 70.0, 0.0, None, [], "QUEUED", 0), ("t3", 51, 100.0, 0.0, None, ["a", "b"], "QUEUED", 0), ("t4", 99, 0.0, 101.0, None, [], "QUEUED", 0), ("t5", 99, 0.0, 0.0, 100.0, [], "QUEUED", 0), ("t6", 50, 500.0, 0.0, None, None, "QUEUED", 0)]
    df = spark.createDataFrame(rows, "task_id string, priority int, created double, available_at double, deadline double, capabilities array<string>, state string, attempt long")
    assert [(r["task_id"], r["rank"]) for r in T.rank(df, F.lit(100.0), ["a"]).orderBy("rank").collect()] == [("t1", 1), ("t2", 2), ("t6", 3)]
    claims = T.next_claims(df, "w", ["a"], 2, 100.0, 30.0, 7).collect()
    assert [r["task_id"] for r in claims] == ["t1", "t2"] and all(r["seconds"] == 30.0 for r in claims)
    assert T.next_claims(df, "w", ["a"], 0, 100.0, 30.0, 7).count() == 0
    assert T.admit(df.withColumn("seq", F.col("created")), 7, 9).where("accepted").count() == 2


def test_lineage_and_budgets(spark):
    runs = lambda *x: spark.createDataFrame(list(x), "run_id string, parent_run_id string")
    got = {r["run_id"]: (r["root_run_id"], r["depth"], r["path"]) for r in T.lineage(runs(("a", None), ("b", "a"), ("c", "b"), ("d", None))).collect()}
    assert got["c"] == ("a", 2, ["a", "b", "c"]) and got["d"] == ("d", 0, ["d"])
    for bad in (runs(("a", None), ("b", "x")), runs(("a", "b"), ("b", "a"))):
        with pytest.raises(RuntimeError):
            T.lineage(bad)
    usage = spark.createDataFrame([("r", 1, "tokens", 5), ("r", 2, "tokens", 6), ("r", 3, "calls", 1)], "run_id string, seq int, kind string, amount int")
    limits = spark.createDataFrame([("r", "tokens", 10)], "run_id string, kind string, most int")
    assert sorted((r["seq"], r["used"], r["paused"]) for r in T.budget_use(usage, limits).collect()) == [(1, 5, False), (2, 11, True), (3, 1, False)]
    with pytest.raises(Exception, match="negative"):
        T.budget_use(usage.withColumn("amount", F.lit(-1)), limits).collect()


# Streams: read from files, drained, and held against the batch form.
def stream(spark, df, folder, files=3):
    df.repartition(files).write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(query, spark, name, mode="append"):
    query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_streamed_tasks_equal_the_fold(spark, tmp_path):
    rows = random_log(5, 6, 12)
    folder = f"file://{tmp_path}/commands"
    for n in range(3):  # one file for each stretch of the log, in order
        spark.createDataFrame([r for r in rows if r[1] // 4 == n], T.COMMAND).coalesce(1).write.mode("append").parquet(folder)
    commands = spark.readStream.schema(T.COMMAND).option("maxFilesPerTrigger", 1).parquet(folder)
    got = drained(S.task_outcomes(commands), spark, "outcomes", "update")
    want = T.fold(spark.createDataFrame(rows, T.COMMAND))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(got.columns).collect()), key=repr)


def test_leases_end_by_timer(spark, tmp_path):
    folder = f"file://{tmp_path}/timed"
    rows = [command("a", 0, 100, "submit"), command("a", 1, 100, "claim", "w", "l", seconds=10.0), command("b", 0, 5000, "submit"), command("c", 0, 9000, "submit")]
    for r in rows:
        df = spark.createDataFrame([r], T.COMMAND).withColumn("ts", F.timestamp_seconds("at"))
        df.coalesce(1).write.mode("append").parquet(folder)
    commands = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = drained(S.task_outcomes(commands, T.RetryPolicy(initial=2.0), timers=True, late="1 second"), spark, "timed")
    mine = [(r["command"], r["state"]) for r in got.where("task_id = 'a'").orderBy("at", "state").collect()]
    assert ("release", "RETRY_WAIT") in mine and ("due", "QUEUED") in mine


def test_streamed_events(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.concat("event_type", F.lit(".x")).alias("event_type"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("worker"), "value")
    twice = events.unionByName(events)
    once = drained(S.record_once(stream(spark, twice, f"file://{tmp_path}/e"), "60 days"), spark, "once")
    assert once.count() == events.count() == once.select("event_id").distinct().count()
    counts = drained(S.topic_counts(stream(spark, events, f"file://{tmp_path}/c"), late="60 days"), spark, "counts", "complete")
    want = events.groupBy(F.substring_index("event_type", ".", 1).alias("topic"), "event_type").agg(F.count("*").alias("events"))
    assert counts.exceptAll(want).count() == 0 == want.exceptAll(counts).count()
    totals = drained(S.metrics(stream(spark, events.select(F.col("event_type").alias("name"), "value"), f"file://{tmp_path}/m")), spark, "totals", "complete")
    assert totals.agg(F.sum("count")).first()[0] == events.count()


def test_silent_workers(spark, tmp_path):
    folder = f"file://{tmp_path}/beats"
    for at, who in ((1000, "a"), (1000, "b"), (1050, "a"), (1090, "c"), (1120, "a"), (1500, "z"), (1900, "z")):
        df = spark.createDataFrame([(who, float(at))], "worker string, at double").select("worker", F.timestamp_seconds("at").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(folder)
    beats = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = drained(S.silent_workers(beats, 100.0, "1 second"), spark, "silent")
    assert {(r["worker"], r["last"], r["unhealthy_at"]) for r in got.collect()} >= {("b", 1000.0, 1100.0), ("a", 1120.0, 1220.0), ("c", 1090.0, 1190.0)}


def test_delivery(spark, tmp_path):
    events = spark.createDataFrame([(i, "task.done" if i % 2 else "run.end") for i in range(10)], "event_id long, event_type string")

    def picky(event):
        if event["event_id"] == 3:
            raise ValueError("three")

    q = S.deliver(stream(spark, events, f"file://{tmp_path}/in"), {"p": ("task", picky), "all": ("*", lambda e: None)}, f"file://{tmp_path}/cp", f"file://{tmp_path}/dead", f"file://{tmp_path}/ok")
    q.awaitTermination()
    assert [tuple(r)[:3] for r in spark.read.parquet(f"file://{tmp_path}/dead").collect()] == [(3, "p", "subscriber failed: ValueError('three')")]
    assert spark.read.parquet(f"file://{tmp_path}/ok").count() == 14
