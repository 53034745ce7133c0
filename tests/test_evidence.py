"""Conclusions to knowledge: identity, roles, thresholds, decisions, lifecycle, updates, progress and ends."""

import pytest
from pyspark.sql import functions as F

from gnomon.operators import evidence as V
from gnomon.operators import knowledge as K

PROVENANCE = "struct<" + ",".join(f"{n}:string" for n in V.PROVENANCE) + ">"
EVIDENCE = f"evidence_id string, seq long, claim_id string, text string, subject string, predicate string, object string, role string, confidence double, source_quality double, excerpt string, payload string, provenance {PROVENANCE}"


def piece(i, subject, obj, source="s1", role="supporting", c=0.9, q=0.9, said=None, claim=None):
    p = {n: f"{n}{i}" for n in V.PROVENANCE} | {"source_id": source}
    return (f"e{i}", i, claim or f"c-{subject}-{obj}", f"{subject} {obj}", subject, "is", obj, role, c, q, said or f"x{i}", None, p)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), EVIDENCE)


def test_spellings_are_one_claim(spark):
    rows = table(spark, piece(1, "Acme", "Big"), piece(2, " acme ", "big", "s2"), piece(3, "ACME", "BIG  ", "s3"), piece(4, "Other", "big"))
    got = {r["identity"]: r for r in V.evaluate(rows).collect()}
    assert len(got) == 2
    one = got["acme\x1fis\x1fbig"]
    assert one["sources"] == 3 and one["conflicts"] == 0 and one["claim_id"] == "c- acme -big" and one["supporting"] == ["e1", "e2", "e3"]


def test_duplicates_count_once(spark):
    rows = table(spark, piece(1, "a", "b", said="Same  text"), piece(2, "a", "b", said="same text", c=0.7), piece(3, "a", "b", "s2", said="same text"), piece(4, "a", "b", role="contradicting", said="same text"))
    got = {r["evidence_id"]: r["duplicate_of"] for r in V.with_duplicates(rows).collect()}
    assert got == {"e1": None, "e2": "e1", "e3": None, "e4": None}
    assert V.evaluate(rows).first()["duplicates"] == 1
    tied = table(spark, piece(1, "a", "b", said="t"), (*piece(1, "a", "b", said="t"),)[:0] or ("e0", 1, *piece(1, "a", "b", said="t")[2:]))
    assert {r["evidence_id"]: r["duplicate_of"] for r in V.with_duplicates(tied).collect()} == {"e0": None, "e1": "e0"}


def test_decisions(spark):
    rows = table(
        spark,
        piece(1, "yes", "x"), piece(2, "yes", "x", "s2"),
        piece(3, "one", "x"),
        piece(4, "against", "x"), piece(5, "against", "x", "s2"), piece(6, "against", "x", "s3", "contradicting"),
        piece(7, "split", "x"), piece(8, "split", "x", "s2"), piece(9, "split", "y"),
        piece(10, "weak", "x", c=0.4), piece(11, "weak", "x", "s2", c=0.4),
        piece(12, "maybe", "x", c=0.7, q=0.8), piece(13, "maybe", "x", "s2", c=0.7, q=0.8),
        piece(14, "no", "x", role="neutral"),
        piece(15, "edge", "x", c=0.5, q=0.5), piece(16, "edge", "x", "s2", c=0.5, q=0.5),
    )
    got = {r["identity"].replace("\x1fis\x1f", " "): (r["status"], r["eligible"]) for r in V.verify(V.evaluate(rows)).collect()}
    assert got == {
        "yes x": ("confirmed", True), "one x": ("insufficient_evidence", False), "against x": ("contradicted", False), "split x": ("contradicted", False), "split y": ("contradicted", False),
        "weak x": ("insufficient_evidence", False), "maybe x": ("probable", False), "no x": ("insufficient_evidence", False), "edge x": ("uncertain", False),
    }
    assert V.verify(V.evaluate(rows, strength=0.95)).where("eligible").count() == 0
    assert V.evaluate(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        V.evaluate(rows, confidence=2)
    pairs = {(r["claim_a"], r["claim_b"]) for r in V.conflicts(V.fuse(rows)).collect()}
    assert pairs == {("c-split-x", "c-split-y")}


def test_candidates(spark):
    results = spark.createDataFrame([("r", *"abcde")], "result_id string, session_id string, investigation_id string, task_id string, attempt_id string, run_id string")
    claim = lambda i: (f"k{i}", f"t{i}", "s", "p", f"o{i}")
    rows = [("r", 1, "c1", *claim(1), 0.8, ["o1", "o2"]), ("r", 2, "c1", *claim(9), 0.8, ["o1"]), ("r", 3, "c2", *claim(2), 0.8, []), ("r", 4, "c3", *claim(3), 0.8, ["o1", "zz", "aa"]), ("r", 5, "c4", *claim(1), 0.8, ["o1", "o2"]), ("r", 6, "c5", *claim(2), 0.6, None)]
    conclusions = spark.createDataFrame(rows, "result_id string, seq long, conclusion_id string, claim_id string, text string, subject string, predicate string, object string, confidence double, supporting_observation_ids array<string>")
    observations = spark.createDataFrame([("r", "o1", "find", '{"q": 1}', '{"excerpt": " said ", "text": "t"}', {"source_id": "s9", "source_quality": "7"}, None), ("r", "o2", "look", "{}", '{"b": 1, "a": [2]}', {"source_id": " "}, "ref://x")], "result_id string, observation_id string, tool_name string, input string, output string, metadata map<string,string>, source_reference string")
    malformed = spark.createDataFrame([("r", None, 3, " "), ("r", "cx", 1, "bad")], "result_id string, conclusion_id string, index int, reason string")
    found = V.extract_candidates(results, conclusions, observations, malformed)
    assert [r["conclusion_id"] for r in found.candidates.collect()] == ["c1"]
    got = {r["provenance"]["tool_call_id"]: r for r in found.evidence.collect()}
    assert got["o1"]["excerpt"] == "said" and got["o1"]["provenance"]["source_id"] == "s9" and got["o1"]["source_quality"] == 1.0 and got["o1"]["provenance"]["source_reference"] == "tool://find"
    assert got["o2"]["excerpt"] == '{"a":[2],"b":1}' and got["o2"]["provenance"]["source_id"] == "tool:look" and got["o2"]["source_quality"] == 0.5 and got["o2"]["provenance"]["source_reference"] == "ref://x"
    assert sorted((r["conclusion_id"], r["code"], r["message"]) for r in found.diagnostics.collect()) == [
        ("c1", "duplicate_conclusion", "duplicate conclusion discarded"),
        ("c2", "no_supporting_observations", "conclusion does not reference any observation"),
        ("c3", "unknown_observation_reference", "unknown observation reference: aa, zz"),
        ("c4", "duplicate_candidate", "conclusion duplicates an already extracted candidate claim"),
        ("c5", "no_supporting_observations", "conclusion does not reference any observation"),
        ("cx", "malformed_conclusion", "bad"),
        ("index:3", "malformed_conclusion", "malformed conclusion"),
    ]
    assert V.extract_candidates(results, conclusions.limit(0), observations).candidates.count() == 0


def test_scale_of_the_pipeline(spark):
    """200 claims of two pieces of evidence each: 200 candidates, 400 pieces, all confirmed."""
    rows = [piece(2 * i + j, f"s{i}", "o", f"src{j}", claim=f"k{i}") for i in range(200) for j in range(2)]
    decided = V.verify(V.evaluate(table(spark, *rows)))
    assert decided.where("status = 'confirmed'").count() == 200
    candidates = spark.createDataFrame([(f"S{i}", "is", "O") for i in range(201)], "subject string, predicate string, object string")
    assert {r["lifecycle"]: r["count"] for r in V.acquire(candidates, decided).groupBy("lifecycle").count().collect()} == {"verified": 200, "rejected": 1}


def test_updates_need_whole_provenance(spark):
    rows = table(spark, piece(1, "a", "x"), piece(2, "a", "x", "s2"))
    decided = V.verify(V.evaluate(rows))
    p = rows.select("provenance.*")
    sources = p.select(F.col("source_id").alias("id"), F.col("source_reference").alias("reference"))
    documents, chunks = p.select(F.col("document_id").alias("id"), "source_id"), p.select(F.col("chunk_id").alias("id"), "document_id")
    ready, problems = V.prepare(decided, rows, sources, documents, chunks)
    assert problems.count() == 0
    claims, records = V.engine_update(ready)
    row = claims.first()
    assert row["source_ids"] == ["s1", "s2"] and row["supporting_evidence"] == ["e1", "e2"] and records.count() == 2
    bad = rows.withColumn("provenance", F.col("provenance").withField("chunk_id", F.lit(" ")))
    said = lambda e, c=chunks: sorted(r["problem"] for r in V.prepare(decided, e, sources, documents, c)[1].collect())
    assert said(bad) == ["incomplete provenance"] * 2 and said(rows.where("seq = 1")) == ["missing evidence"] and said(rows, chunks.where("id = 'chunk_id1'")) == ["unresolved provenance"]


def test_progress(spark):
    gaps = lambda *x: spark.createDataFrame(list(x), "id string, uncertainty double")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    row = V.progress(gaps(("a", 0.5), ("b", 0.8), ("c", 0.7)), gaps(("b", 0.6), ("c", 0.9), ("d", 0.4)), ids("x", ""), ids("y"), cost=3.0).first()
    assert (row["resolved"], row["discovered"], row["introduced"], row["settled"]) == (["a"], ["d"], ["y"], ["x"])
    assert row["uncertainty_reduced"] == pytest.approx(0.7) and row["information_gain"] == pytest.approx((0.7 - 0.4) / 2.0 - 0.25 / 2) and row["cost_per_resolved_gap"] == 3.0
    empty = V.progress(gaps(), gaps(), ids(), ids()).first()
    assert (empty["gaps_before"], empty["information_gain"], empty["cost_per_resolved_gap"]) == (0, 0.0, None)


def test_ends_in_order(spark):
    base = {"state": "PLANNING", "iteration": 0, "most_iterations": 5, "cancel": False, "failure": False, "satisfied": False, "gaps": 2, "confidence": 0.95, "contradictions": 0, "resolvable": True, "best_score": 0.5} | {f"{a}_{n}": float(a == "most") for a in ("used", "most") for n in ("investigations", "agent_runs", "cost", "seconds")}
    cases = [({}, None), ({"best_score": 0.05}, None), ({"best_score": 0.049}, "no_valuable_investigation"), ({"contradictions": 1}, None), ({"contradictions": 1, "resolvable": False}, "unresolvable_contradiction"), ({"used_cost": 1.0}, "budget_exhausted"), ({"iteration": 5}, "maximum_iterations_reached"), ({"gaps": 0}, "confidence_threshold_reached"), ({"gaps": 0, "confidence": 0.89}, None), ({"satisfied": True, "iteration": 5}, "objective_satisfied"), ({"failure": True, "satisfied": True}, "system_failure"), ({"cancel": True, "failure": True}, "user_cancellation"), ({"state": "CANCELLED"}, "user_cancellation")]
    rows = spark.createDataFrame([base | c | {"n": i} for i, (c, _) in enumerate(cases)])
    assert [r["reason"] for r in V.termination(rows).orderBy("n").collect()] == [x for _, x in cases]


def test_claims_and_contradictions(spark):
    schema = "id string, subject string, predicate string, object string, confidence double, evidence int, state string"
    rows = spark.createDataFrame([("c1", "A", "p", "x", 1.0, 2, "stale"), ("c2", "a", "p", "X", 1.0, 0, ""), ("c3", "a ", "p", "y", 0.5, 0, ""), ("c4", "a", "q", "z", 1.0, 0, ""), ("c5", "", "p", "z", 1.0, 0, ""), ("c6", "a", "p", " ", 1.0, 0, "")], schema)
    assert [tuple(r) for r in K.conflicting_claims(rows).collect()] == [("a", "p", "c1", "c3", 0.5)]
    relations = rows.where("false").drop("state")
    assert sorted((r["kind"], r["a"], r["b"]) for r in K.contradictions(rows, relations).collect()) == [("conflicting_claims", "c1", "c3"), ("stale_claim", "c1", "c1")]
    # Ids are compared as they are: only (a, p) has two objects.
    assert [(r["subject"], r["a"], r["b"]) for r in K.exclusive_relations(rows).collect()] == [("a", "c2", "c6")]
    assert K.contradictions(rows, relations).exceptAll(K.contradictions(rows, relations)).count() == 0
