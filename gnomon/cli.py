"""Commands for an engine's folder: ingest, retrieve, answer, gaps, score, stats, bench; tasks of the runtime; research sessions.

python -m gnomon.cli --folder file:///data/kb ingest --repository /docs --gazetteer names.json
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon import corpus
from gnomon.engine import KnowledgeEngine
from gnomon.investigation import Investigations
from gnomon.operators.extraction import Gazetteer, gazetteer_of
from gnomon.operators.planning import Budget
from gnomon.service import PRIORITIES, Refused, Runtime
from gnomon.sources.adapters import gazetteer_file


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gnomon")
    top.add_argument("--folder", required=True, help="a folder that driver and executors share")
    top.add_argument("--gazetteer", help="a JSON file {type: [names]}")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple, **options) -> None:
        p = sub.add_parser(name, **options)
        for flag, *rest in arguments:
            p.add_argument(flag, **(rest[0] if rest else {}))

    n = lambda default: {"type": int, "default": default}
    command("ingest", ("--text",), ("--reference", {"default": "cli"}), ("--kind", {"default": "text"}), ("--repository",))
    command("retrieve", ("query",), ("--top", n(10)))
    command("answer", ("query",), ("--top", n(8)), ("--depth", n(2)))
    command("gaps", ("--top", n(20)))
    command("score", ("--top", n(20)), ("--by", {"default": "gain", "choices": ["gain", "random", "centrality"]}))
    command("stats")
    command("bench")
    command("submit", ("run_id",), ("correlation_id",), ("--priority", {"default": "NORMAL", "choices": list(PRIORITIES)}), ("--capability", {"action": "append", "default": []}), ("--metadata", {"default": "{}"}))
    command("task", ("task_id",))
    for name in ("cancel-task", "retry"):
        command(name, ("task_id",), ("--principal", {"default": "cli"}))
    command("workers")
    command("worker-drain", ("worker",), ("--principal", {"default": "cli"}))
    for name in ("queue", "status", "recover"):
        command(name)
    command("research-create", ("question",), ("--iterations", n(10)), ("--cost", {"type": float, "default": 1000.0}))
    for name in ("research-status", "research-pause", "research-resume", "research-cancel", "research-explain", "research-evidence", "research-gaps", "research-plan", "research-iterations", "research-step"):
        command(name, ("session_id",))
    return top


def shown(df: DataFrame, top: int | None = None) -> list[dict]:
    """Rows as JSON objects; a report, so it is bounded."""
    return [json.loads(x) for x in df.limit(top or 1000).toJSON().collect()]


def _results(done: DataFrame):
    raise ValueError("this command needs an agent's results; use gnomon.investigation with a function that gives them")


def dispatch(spark: SparkSession, a: argparse.Namespace) -> object:
    names = gazetteer_of(gazetteer_file(spark, a.gazetteer)) if a.gazetteer else Gazetteer()
    engine, runtime = KnowledgeEngine(spark, f"{a.folder}/knowledge", names), Runtime(spark, f"{a.folder}/runtime")
    research = Investigations(engine, runtime, f"{a.folder}/research", _results)
    asked = lambda: spark.createDataFrame([(0, a.query)], "query_id int, text string")
    c = a.command
    if c == "ingest":
        return engine.ingest_repository(a.repository, a.reference) if a.repository else engine.ingest_text(a.reference, a.text or "", kind=a.kind)
    if c == "retrieve":
        return shown(engine.retrieve(asked(), a.top).orderBy("position"))
    if c == "answer":
        found = engine.answer(asked(), a.top, a.depth)
        return {"entities": shown(found.entities.select("name").orderBy("name")), "relations": shown(found.relations.select("subject_id", "predicate", "object_id")), "claims": shown(found.claims.select("text")), "evidence": found.evidence.count(), "sources": shown(found.sources.select("reference")), "paths": shown(found.paths.orderBy("place").select("path", "weight")), "confidence": found.confidence.first()["confidence"]}
    if c == "gaps":
        return shown(engine.gaps().orderBy(F.desc("priority"), "id").select("kind", "description", "priority"), a.top)
    if c == "score":
        return shown(engine.score_investigations(a.top, a.by))
    if c == "stats":
        return shown(engine.statistics())
    if c == "bench":
        rows = [*corpus.quality(spark).collect(), *[("graph", *r) for r in corpus.graph_quality(spark).collect()], *[("claims", *r) for r in corpus.claim_quality(spark).collect()]]
        return [{"configuration": r[0], "metric": r[1], "value": r[2]} for r in rows]
    if c == "submit":
        return {"task_id": runtime.submit(a.run_id, a.correlation_id, a.priority, a.capability, json.loads(a.metadata))}
    if c == "task":
        return runtime.task(a.task_id).asDict()
    if c == "cancel-task":
        return runtime.cancel(a.task_id, a.principal).asDict()
    if c == "retry":
        return runtime.retry(a.task_id, a.principal).asDict()
    if c == "workers":
        return shown(runtime.workers())
    if c == "worker-drain":
        return runtime.drain(a.worker, a.principal).asDict()
    if c == "queue":
        return runtime.queue_stats()
    if c == "status":
        return runtime.runtime_stats()
    if c == "recover":
        return runtime.recover()
    if c == "research-create":
        return {"session_id": research.create(a.question, Budget(iterations=a.iterations, cost=a.cost))}
    if c == "research-status":
        return vars(research.status(a.session_id)) | {"budget": vars(research.status(a.session_id).budget), "used": vars(research.status(a.session_id).used)}
    if c in ("research-pause", "research-resume", "research-cancel"):
        getattr(research, c.split("-")[1])(a.session_id)
        return {"state": research.status(a.session_id).state}
    if c == "research-step":
        return {"stage": research.resume_iteration(a.session_id)}
    kinds = {"research-explain": None, "research-evidence": ["evidence", "evaluation", "decisions"], "research-gaps": ["gaps", "snapshot"], "research-plan": ["selection", "plan", "execution"], "research-iterations": ["progress", "termination"]}
    return [{k: v for k, v in x.items() if k != "schema"} for x in research.explain(a.session_id, kinds[c])]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("gnomon").getOrCreate()
    try:
        print(json.dumps(dispatch(spark, a), default=str, indent=1))
        return 0
    except (Refused, ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
