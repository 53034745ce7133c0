"""Task and event logs: legality of transitions, leases, retries, aging, health, checkpoints, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The states that may follow each state of a task.
TRANSITIONS = {
    "QUEUED": ["CLAIMED", "FAILED", "CANCEL_REQUESTED"],
    "CLAIMED": ["RUNNING", "FAILED", "CANCEL_REQUESTED"],
    "RUNNING": ["SUCCEEDED", "FAILED", "CANCEL_REQUESTED"],
    "FAILED": ["RETRY_WAIT", "DEAD_LETTERED"],
    "RETRY_WAIT": ["QUEUED", "FAILED", "CANCEL_REQUESTED"],
    "CANCEL_REQUESTED": ["CANCELLED"],
    "DEAD_LETTERED": ["QUEUED"],
    "SUCCEEDED": [],
    "CANCELLED": [],
}


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)


def illegal_transitions(log: DataFrame, transitions: dict[str, list[str]] = TRANSITIONS) -> DataFrame:
    """task, seq, previous, state: rows of a log (task, seq, state) that may not follow the row before."""
    previous = F.lag("state").over(W.partitionBy("task").orderBy("seq"))
    legal = F.lit(False)
    for source, targets in transitions.items():
        legal = legal | ((F.col("previous") == source) & F.col("state").isin(*targets)) if targets else legal
    return log.withColumn("previous", previous).where(F.col("previous").isNotNull() & ~legal).select("task", "seq", "previous", "state")


def state_counts(log: DataFrame, states: list[str]) -> DataFrame:
    """state, tasks: how many tasks stand in each state now, zeros included."""
    now = log.groupBy("task").agg(F.max_by("state", "seq").alias("state")).groupBy("state").agg(F.count("*").alias("tasks"))
    every = log.sparkSession.createDataFrame([(s,) for s in states], "state string")
    return every.join(now, "state", "left").select("state", F.coalesce("tasks", F.lit(0)).alias("tasks"))


def expired_leases(log: DataFrame, lease: float) -> DataFrame:
    """task, seq, held: claims whose next row comes `lease` seconds later or more, or never."""
    after = F.lead("ts").over(W.partitionBy("task").orderBy("seq"))
    rows = log.withColumn("held", F.round(_seconds(after, F.col("ts")), 3)).where(F.col("state").isin("CLAIMED", "RUNNING"))
    return rows.where(F.col("held").isNull() | (F.col("held") >= lease)).select("task", "seq", "held")


def unhealthy_workers(log: DataFrame, as_of: Column, threshold: float) -> DataFrame:
    last = log.groupBy("worker").agg(F.max("ts").alias("last"))
    return last.where(_seconds(as_of, F.col("last")) >= threshold).select("worker", "last")


def checkpoint_latest(log: DataFrame) -> DataFrame:
    """run, version, payload: the highest version, counting each run's rows in order of seq."""
    return log.groupBy("run").agg(F.count("*").alias("version"), F.max_by("payload", "seq").alias("payload"))


def metrics_snapshot(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(F.count("*").alias("count"), F.round(F.sum("value"), 4).alias("sum"), F.round(F.avg("value"), 6).alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"))


def policy_decisions(requests: DataFrame, grants: DataFrame, approval: list[str]) -> DataFrame:
    """Adds decision to requests (actor, capability, destructive): DENY without a grant, REQUIRE_APPROVAL for what is
    destructive or listed, else ALLOW."""
    held = grants.select("actor", "capability").distinct().withColumn("granted", F.lit(True))
    ask = F.col("destructive") | F.col("capability").isin(*approval)
    return requests.join(held, ["actor", "capability"], "left").withColumn("decision", F.when(F.col("granted").isNull(), "DENY").when(ask, "REQUIRE_APPROVAL").otherwise("ALLOW")).drop("granted")


def counters(increments: DataFrame, won: str, tried: str) -> DataFrame:
    """name, value: sums of increments (name, amount, none below 0), and `success_rate`, the quotient of two of them, 0 of none."""
    amount = F.when(F.col("amount") < 0, F.raise_error(F.lit("increments cannot be negative"))).otherwise(F.col("amount"))
    rows = increments.groupBy("name").agg(F.sum(amount).cast("double").alias("value"))
    total = lambda name: F.coalesce(F.sum(F.when(F.col("name") == name, F.col("value"))), F.lit(0.0))
    rate = rows.agg(total(won).alias("w"), total(tried).alias("t")).select(F.lit("success_rate").alias("name"), F.round(F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(0.0), 9).alias("value"))
    return rows.unionByName(rate)
