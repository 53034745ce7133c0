"""Stores, the engine, the runtime service, research sessions and commands, each in a folder of its own."""

import json

import pytest
from pyspark.sql import functions as F

from gnomon import corpus
from gnomon import investigation as I
from gnomon.cli import main
from gnomon.engine import checked_update, create_engine, of_type
from gnomon.operators import planning as P
from gnomon.operators.tasks import RetryPolicy
from gnomon.service import Refused, Runtime, simulate
from gnomon.sources import stores as S


def people(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, name string, tags map<string,string>")


def test_store_keeps_the_last_of_each_key(spark, tmp_path):
    s = S.Store(spark, f"file://{tmp_path}")
    with pytest.raises(KeyError):
        s.state("people")
    s.save("people", people(spark, ("a", "A", {"k": "1"}), ("b", "B", None)))
    s.save("people", people(spark, ("a", "A2", {"k": "2"}), ("c", "C", None)))
    assert sorted((r["id"], r["name"]) for r in s.state("people").collect()) == [("a", "A2"), ("b", "B"), ("c", "C")]
    assert s.delete("people", spark.createDataFrame([("b",), ("zz",)], "id string")) == 1
    assert s.count("people") == 2 and s.get("people", "a").first()["tags"] == {"k": "2"} and s.get("people", "b").count() == 0
    # A version without its mark of success is not there.
    people(spark, ("d", "D", None)).withColumn("deleted", F.lit(False)).write.parquet(f"file://{tmp_path}/people/seq=000000000009")
    (tmp_path / "people" / "seq=000000000009" / "_SUCCESS").unlink()
    assert s.count("people") == 2
    S.save_snapshot({"people": s.state("people")}, f"file://{tmp_path}/snap")
    assert S.load_snapshot(spark, f"file://{tmp_path}/snap")["people"].count() == 2


def test_codec(spark):
    rows = spark.createDataFrame([("a", 1.5, ["x"], None)], "id string, c double, l array<string>, n string")
    plain = S.to_plain(rows, "Thing")
    assert json.loads(plain.first()[0]) == {"$type": "Thing", "id": "a", "c": 1.5, "l": ["x"], "n": None}
    schema = {"Thing": "id string, c double, l array<string>, n string"}
    assert S.from_plain(plain, schema, "Thing").collect() == rows.collect()
    with pytest.raises(Exception, match="unknown record type: Other"):
        S.from_plain(S.to_plain(rows, "Other"), schema, "Thing").collect()


def test_merges(spark):
    schema = "seq int, id string, subject_id string, predicate string, object_id string, confidence double, verification_state string, provenance array<string>, source_ids array<string>"
    log = spark.createDataFrame([(1, "r1", "a", "p", "b", 0.5, "verified", ["c2", "c1"], ["s"]), (2, "r2", "a", "p", "b", 0.9, "verified", ["c1", "c3"], None), (3, "r3", "a", "q", "b", 0.1, "verified", None, ["s"])], schema)
    got = {r["id"]: r for r in S.merge_relations(log).collect()}
    assert set(got) == {"r1", "r3"} and got["r1"]["confidence"] == 0.9 and got["r1"]["provenance"] == ["c1", "c2", "c3"] and got["r1"]["verification_state"] == "unverified"
    assert got["r3"]["verification_state"] == "verified" and got["r3"]["provenance"] == []


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = create_engine(spark, f"file://{tmp_path_factory.mktemp('kb')}", corpus.GAZETTEER)
    e.ingest(corpus.sources(spark))
    return e


def test_engine(spark, engine):
    counts = {r["table"]: r["rows"] for r in engine.healthcheck().collect()}
    assert counts == {"sources": 7, "documents": 7, "chunks": 7, "entities": 17, "claims": 18, "evidence": 18, "relations": 18, "embeddings": 7}
    engine.ingest(corpus.sources(spark))  # again: nothing new
    assert {r["table"]: r["rows"] for r in engine.healthcheck().collect()} == counts
    ids = {r["name"]: r["id"] for r in engine.table("entities").collect()}
    assert engine.query_graph(predicate="works_at").count() == 4 and engine.query_graph(predicate="works_at", entity_type="City").count() == 0 and engine.query_graph(limit=3).count() == 3
    entities, met = engine.subgraph([ids["Initech"], "unknown"])
    assert {r["name"] for r in entities.collect()} >= {"Initech", "Menlo Park", "Grace Hopper", "database systems"} and met.count() >= 3
    assert engine.neighbors([ids["London"]], "in").count() == 3 and engine.neighbors([ids["London"]]).count() == 0
    path = engine.paths(ids["Ada Lovelace"], ids["London"]).first()
    assert path["hops"] == 2 and path["weight"] == 1.0
    claim = engine.table("claims").where("subject = 'Marie Curie' and predicate = 'studied_at'").first()
    why = engine.provenance([claim["id"]]).first()
    assert why["references"] == ["corpus-05"] and len(why["evidence_ids"]) == 1
    with pytest.raises(KeyError):
        engine.provenance(["none"])
    assert engine.validate_chain(why["source_ids"][0], why["document_ids"][0], why["chunk_ids"][0], "corpus-05") and not engine.validate_chain(why["source_ids"][0], why["document_ids"][0], why["chunk_ids"][0], "other")


def test_engine_changes(spark, tmp_path):
    e = create_engine(spark, f"file://{tmp_path}/kb", {"P": ["Ada", "Bob"], "C": ["Acme", "Zed"]})
    assert e.gaps().count() == 0 and e.table("claims").count() == 0
    e.ingest_text("one", "Ada works at Acme. Bob works at Acme.")
    e.ingest_text("two", "Ada works at Zed.")
    kinds = {r["kind"]: r["count"] for r in e.gaps().groupBy("kind").count().collect()}
    assert kinds["contradiction"] == 2 and kinds["low_diversity"] == 3 and kinds["missing_relation"] == 2
    assert [r["score"] for r in e.score_investigations(3).collect()] == sorted((r["score"] for r in e.score_investigations(3).collect()), reverse=True)
    schema = "text string, subject string, predicate string, object string, confidence double, source_ref string"
    new = e.propose_claims(spark.createDataFrame([("Bob is at Zed", "Bob", "works_at", "Zed", 0.3, "probe"), ("x", "Bob", "likes", "Ada", 0.3, "one")], schema)).collect()
    assert {r["source_ids"][0] for r in new} >= {e.table("sources").where("reference = 'one'").first()["id"]} and e.table("sources").count() == 3
    with pytest.raises(Exception, match="confidence out of range"):
        e.propose_claims(spark.createDataFrame([("x", "a", "b", "c", 1.5, "")], schema))
    now, ident = F.lit("2026-01-01").cast("timestamp"), new[0]["id"]
    a = e.assess_claims(now, [ident]).first()
    assert a["state"] in ("uncertain", "unverified") and e.assess_claims(now, [ident]).first() == a
    e.assess_claims(now, [ident], commit=True)
    assert e.table("claims").where(F.col("id") == ident).first()["confidence"] == a["confidence"]
    update = {
        "entities": spark.createDataFrame([("ent_new", "New"), ("", "Bad")], "id string, name string"),
        "relations": e.table("relations").limit(1).withColumn("confidence", F.lit(0.25)).withColumn("id", F.lit("other")),
        "claims": spark.createDataFrame([("c9", ""), ("c8", "said")], "id string, text string"),
        "evidence": spark.createDataFrame([("e9", "c8", None)], "id string, claim_id string, chunk_id string"),
    }
    before = e.table("relations").count()
    receipt = e.commit(update)
    assert (receipt.accepted, receipt.rejected) == (3, 3) and sorted(receipt.errors) == ["empty claim rejected", "entity without id rejected", "evidence without claim/chunk rejected"]
    assert e.table("relations").count() == before and e.table("relations").where("confidence = 0.25 and id <> 'other'").count() == 1
    ada = e.table("entities").where("name = 'Ada'").first()["id"]
    assert e.remove_entities([ada, "none"]) == 1 and e.table("relations").where((F.col("subject_id") == ada) | (F.col("object_id") == ada)).count() == 0
    e.save_snapshot(f"file://{tmp_path}/snap")
    other = create_engine(spark, f"file://{tmp_path}/kb2")
    other.load_snapshot(f"file://{tmp_path}/snap")
    assert other.healthcheck().exceptAll(e.healthcheck()).count() == 0
    good, bad = checked_update({"documents": e.table("documents")})
    assert good["documents"].count() == 2 and bad is None
    assert of_type(e.table("relations"), e.table("entities"), "C").count() == e.table("relations").count()


def test_simulated_runs():
    assert (lambda r: (r.succeeded, r.cycles, r.retries))(simulate(1000)) == (1000, 100, 0)
    r = simulate(100, run=lambda task, attempt: "TRANSIENT" if task < 10 and attempt < 3 else "PERMANENT" if task == 50 else "TRANSIENT" if task == 60 else None)
    assert (r.succeeded, r.dead, r.retries) == (98, 2, 22)


def test_runtime(spark, tmp_path):
    now = [1000.0]
    r = Runtime(spark, f"file://{tmp_path}", clock=lambda: now[0], policy=RetryPolicy(most_attempts=2, initial=5.0), lease=10.0, most_pending=3, silent=60.0, principals={"ops": ["runtime.task.cancel", "runtime.task.retry"]})
    with pytest.raises(Refused):
        r.register("w", "remote:x", ["search"], 1)
    r.register("w", "local:x", ["search"], 1)
    a, b = r.submit("r1", "c", "HIGH", ["search"]), r.submit("r2", "c", "LOW", seconds=500.0)
    r.submit("r3", "c", capabilities=["rare"])
    with pytest.raises(Refused, match="backpressure"):
        r.submit("r4", "c")
    got = r.claim("w")
    assert [x["task_id"] for x in got] == [a] and r.claim("w") == []
    r.start(a, "w", got[0]["lease"])
    now[0] += 8
    r.heartbeat("w")
    now[0] += 8  # beyond the first lease, within the renewed one
    with pytest.raises(Refused):
        r.complete(a, "other", got[0]["lease"])
    assert r.fail(a, "w", got[0]["lease"], "TRANSIENT", "broken")["state"] == "RETRY_WAIT"
    now[0] += 5
    assert r.recover() == [a] and r.task(a)["state"] == "QUEUED"
    lease = r.claim("w")[0]["lease"]
    now[0] += 30
    assert r.recover() == [a] and r.task(a)["state"] == "DEAD_LETTERED" and r.worker("w")["tasks"] == []
    with pytest.raises(Refused):
        r.complete(a, "w", lease)
    assert r.retry(a, "ops")["state"] == "QUEUED" and r.cancel(a, "ops")["state"] == "CANCELLED"
    for bad in (lambda: r.cancel(b, "guest"), lambda: r.drain("w", "ops"), lambda: r.task("none"), lambda: r.cancel(b, " ")):
        with pytest.raises(Refused):
            bad()
    now[0] += 1000
    assert r.recover() == [b] and r.task(b)["error"] == "task deadline expired" and r.worker("w")["status"] == "UNHEALTHY"
    assert r.queue_stats()["depth"] == 1 and r.runtime_stats()["workers"]["capacity"] == 1


def test_session_machine(spark):
    s = I.Session("s", "q", P.Budget(iterations=2, cost=5.0))
    for bad in (lambda: s.transition("UPDATING", 1), lambda: s.transition("COMPLETED", 1), lambda: s.transition("EXECUTING", 1, "why"), lambda: s.transition("CANCELLED", 1, "system_failure"), lambda: s.resume(1), lambda: s.complete_iteration(1)):
        with pytest.raises(I.NotAllowed):
            bad()
    s.transition("EXECUTING", 1).pause(2)
    with pytest.raises(I.NotAllowed):
        s.transition("PLANNING", 3)
    s.resume(3).transition("EVALUATING", 4).transition("UPDATING", 5)
    with pytest.raises(I.NotAllowed):
        s.transition("PLANNING", 4)
    s.complete_iteration(6)
    s.use(investigations=3, cost=7.0)
    assert s.state == "PLANNING" and s.iteration == 1 and s.remaining().cost == 0.0 and s.remaining().iterations == 1
    with pytest.raises(ValueError):
        s.use(cost=-1)
    log = [("s", 1, "PLANNING", None, 1.0), ("s", 2, "PAUSED", None, 2.0), ("s", 3, "EXECUTING", None, 3.0), ("s", 4, "EVALUATING", None, 2.0), ("s", 5, "COMPLETED", None, 5.0), ("t", 1, "PLANNING", None, 1.0), ("t", 2, "UPDATING", None, 1.0)]
    rows = spark.createDataFrame(log, "session_id string, seq int, state string, reason string, at double")
    assert sorted((r["session_id"], r["seq"], r["problem"]) for r in I.audit(rows).collect()) == [("s", 3, "not the state it was paused in"), ("s", 4, "time goes back"), ("s", 5, "reason and state do not agree"), ("t", 2, "illegal transition")]


def test_an_iteration_from_gaps_to_knowledge(spark, engine, tmp_path):
    now = [1000.0]

    def clock():
        now[0] += 1
        return now[0]

    runtime = Runtime(spark, f"file://{tmp_path}/rt", clock=clock, lease=10_000.0)
    runtime.register("w", "local:w", ["search", "verification", "graph_reasoning", "document_analysis", "criticism"], 5)
    docs = engine.table("chunks").join(engine.table("sources").select(F.col("id").alias("source_id"), "reference"), "source_id").limit(2).collect()

    def results(done):
        """Every run concludes the same from two chunks that the base holds."""
        runs = done.select(F.col("result_ref").alias("result_id"), F.lit("s").alias("session_id"), F.col("id").alias("investigation_id"), "task_id", F.lit("a").alias("attempt_id"), "run_id")
        conclusions = runs.select("result_id", F.lit(1).alias("seq"), F.lit("c").alias("conclusion_id"), F.lit("k-new").alias("claim_id"), F.lit("Globex works").alias("text"), F.lit("Globex").alias("subject"), F.lit("does").alias("predicate"), F.lit("work").alias("object"), F.lit(0.9).alias("confidence"), F.array(F.lit("o0"), F.lit("o1")).alias("supporting_observation_ids"))
        seen = [(f"o{i}", "read", "{}", json.dumps({"text": f"said {i}"}), {"source_id": d["source_id"], "document_id": d["document_id"], "chunk_id": d["id"], "source_reference": d["reference"], "source_quality": "0.9"}, None) for i, d in enumerate(docs)]
        observations = runs.select("result_id").crossJoin(spark.createDataFrame(seen, "observation_id string, tool_name string, input string, output string, metadata map<string,string>, source_reference string"))
        return runs, conclusions, observations

    app = I.Investigations(engine, runtime, f"file://{tmp_path}/research", results, clock=clock)
    ident = app.create("what does Globex do?", P.Budget(iterations=3, investigations=10, agent_runs=10))
    stages = []
    for _ in range(20):
        stages.append(app.resume_iteration(ident))
        if stages[-1] in ("execution", "waiting"):
            for x in runtime.claim("w"):
                runtime.start(x["task_id"], "w", x["lease"])
                runtime.complete(x["task_id"], "w", x["lease"], f"res-{x['task_id']}")
        if stages[-1] == "finish":
            break
    assert stages == ["gaps", "candidates", "scores", "selection", "plan", "execution", "evidence", "evaluation", "decisions", "knowledge_update", "finish"]
    s = app.status(ident)
    assert s.state == "PLANNING" and s.iteration == 1 and s.used.investigations == 4
    told = {x["kind"]: x for x in app.explain(ident)}
    assert told["knowledge_update"]["claims"] == ["k-new"] and told["knowledge_update"]["states"] == {"k-new": "verified"}
    assert engine.table("claims").where("id = 'k-new'").first()["source_ids"] == sorted({d["source_id"] for d in docs})
    with pytest.raises(I.NotAllowed):
        app.start_execution(ident)
    app.pause(ident)
    assert app.resume_iteration(ident) == "paused"
    app.resume(ident)
    app.cancel(ident)
    assert app.status(ident).reason == "user_cancellation" and app.resume_iteration(ident) == "cancelled"
    with pytest.raises(KeyError):
        app.status("none")


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "g.json").write_text(json.dumps({"P": ["Ada"], "C": ["Acme"]}))

    def run(*argv):
        code = main(["--folder", f"file://{tmp_path}/x", "--gazetteer", f"file://{tmp_path}/g.json", *argv], spark)
        out = capsys.readouterr()
        return json.loads(out.out) if code == 0 else (code, out.err)

    assert run("ingest", "--text", "Ada works at Acme.")["relations"] == 1
    assert run("retrieve", "Ada", "--top", "1")[0]["position"] == 1
    assert run("stats")[0]["relations"] == 1
    assert {x["kind"] for x in run("gaps")} == {"low_diversity"}
    task = run("submit", "r", "c", "--metadata", '{"a": 1}')["task_id"]
    assert run("task", task)["state"] == "QUEUED" and run("cancel-task", task)["state"] == "CANCELLED" and run("queue")["CANCELLED"] == 1
    assert run("retry", task)[0] == 2 and run("task", "none")[0] == 2
    ident = run("research-create", "why?")["session_id"]
    assert run("research-step", ident)["stage"] == "gaps" and run("research-pause", ident)["state"] == "PAUSED"
    assert [x["kind"] for x in run("research-gaps", ident)] == ["gaps", "snapshot"]
