"""From agents' conclusions to knowledge: candidate claims, fusion, evaluation, verification, acquisition, update, progress.

Evidence rows: evidence_id, seq, claim_id, text, subject, predicate, object, role (supporting, contradicting, neutral),
confidence, source_quality, excerpt, payload, and a provenance struct of ten ids. Claims are known by their identity, so
that spellings which differ in case or blanks are one claim. Values are compared unrounded and rounded only where shown.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gnomon.functions import text as X

PROVENANCE = ("session_id", "investigation_id", "task_id", "attempt_id", "run_id", "tool_call_id", "source_id", "document_id", "chunk_id", "source_reference")
CLAIM = ("claim_id", "text", "subject", "predicate", "object")


# Scalars.
def hint(metadata: Column, key: str, default: Column) -> Column:
    """A text of a map, or the default where it is absent or blank."""
    return F.coalesce(F.nullif(F.trim(F.try_element_at(metadata, F.lit(key))), F.lit("")), default)


def number_hint(metadata: Column, key: str, default: float, unit: bool = True) -> Column:
    """A number of a map, between 0 and 1 with unit; the default where it is absent or no number."""
    value = F.coalesce(F.try_element_at(metadata, F.lit(key)).try_cast("double"), F.lit(default))
    return X.clamp(value) if unit else value


def excerpt(tool: Column, given: Column, output: Column) -> Column:
    """What an observation says: the first text that is not blank of output.excerpt and output.text, else the output, else
    the input, as JSON with sorted keys, else that the tool ran. given and output are JSON texts."""
    data = F.try_parse_json(output)

    def said(name: str) -> Column:
        part = F.try_variant_get(data, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(part) == "STRING", F.nullif(F.trim(F.try_variant_get(data, f"$.{name}", "string")), F.lit("")))

    def whole(text: Column) -> Column:
        return F.nullif(F.nullif(F.to_json(F.try_parse_json(text)), F.lit("{}")), F.lit("null"))

    return F.coalesce(said("excerpt"), said("text"), whole(output), whole(given), F.concat(tool, F.lit(" executed")))


def provenance_complete(p: Column) -> Column:
    """Whether all ten ids are there and not blank."""
    out = F.lit(True)
    for name in PROVENANCE:
        out = out & (F.coalesce(F.trim(p[name]), F.lit("")) != "")
    return out


def fingerprint(identity: Column, source_id: Column, said: Column, payload: Column, role: Column) -> Column:
    """What makes two pieces of evidence one, whoever found them and however sure they were."""
    plain = F.lower(F.regexp_replace(F.trim(said), r"\s+", " "))
    parts = [F.coalesce(c, F.lit("")) for c in (identity, source_id, plain, payload, role)]
    return F.sha2(F.concat_ws("\x1e", *parts), 256)


def identities(rows: DataFrame) -> DataFrame:
    """Adds identity (of the claim) and topic (its subject and predicate, under which other objects contradict)."""
    s, p, o = (F.lower(F.regexp_replace(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""), r"\s+", " ")) for c in ("subject", "predicate", "object"))
    return rows.withColumn("identity", F.concat_ws("\x1f", s, p, o)).withColumn("topic", F.concat_ws("\x1f", s, p))


def grades(evidence: DataFrame, by: list[str]) -> DataFrame:
    """by, strong, moderate, weak, mean_strength of evidence sets."""
    rows = evidence.withColumn("strength", X.strength(F.col("confidence"), F.col("source_quality"))).withColumn("grade", X.grade(F.col("strength")))
    return rows.groupBy(*by).agg(*[F.count_if(F.col("grade") == g).alias(g) for g in ("strong", "moderate", "weak")], F.coalesce(F.avg("strength"), F.lit(0.0)).alias("mean_strength"))


def investigation_ids(evidence: DataFrame, by: list[str]) -> DataFrame:
    return evidence.select(*by, F.col("provenance.investigation_id").alias("i")).distinct().groupBy(*by).agg(F.sort_array(F.collect_list("i")).alias("investigation_ids"))


# Candidates.
@dataclass
class Extraction:
    candidates: DataFrame
    evidence: DataFrame
    diagnostics: DataFrame


def extract_candidates(results: DataFrame, conclusions: DataFrame, observations: DataFrame, malformed: DataFrame | None = None) -> Extraction:
    """Candidate claims with their evidence, and what is wrong with the other conclusions.

    results: result_id, session_id, investigation_id, task_id, attempt_id, run_id. conclusions: result_id, seq,
    conclusion_id, the claim's columns, confidence, supporting_observation_ids. observations: result_id, observation_id,
    tool_name, input, output (JSON), metadata, source_reference. malformed: result_id, conclusion_id, index, reason.

    A conclusion counts once for each result. It becomes a candidate only if it names observations and all of them are
    known; of conclusions that make the same candidate the first by id is kept.
    """
    order = W.partitionBy("result_id", "conclusion_id").orderBy("seq")
    rows = conclusions.withColumn("nth", F.row_number().over(order))
    say = lambda df, code, message, recovered: df.select("result_id", "conclusion_id", F.lit(code).alias("code"), message.alias("message"), F.lit(recovered).alias("recovered"))
    notes = say(rows.where("nth > 1"), "duplicate_conclusion", F.lit("duplicate conclusion discarded"), True)
    rows = rows.where("nth = 1").drop("nth")
    named = F.size(F.coalesce("supporting_observation_ids", F.array().cast("array<string>")))
    notes = notes.unionByName(say(rows.where(named == 0), "no_supporting_observations", F.lit("conclusion does not reference any observation"), False))

    columns = ["result_id", "conclusion_id", *CLAIM, "confidence", "supporting_observation_ids"]
    asked = rows.where(named > 0).select(*columns, F.posexplode("supporting_observation_ids").alias("place", "observation_id"))
    seen = observations.groupBy("result_id", "observation_id").agg(F.min(F.struct("tool_name", "input", "output", "source_reference", F.map_entries("metadata").alias("metadata"))).alias("o"))
    joined = asked.join(seen, ["result_id", "observation_id"], "left")
    unknown = joined.where("o is null").groupBy("result_id", "conclusion_id").agg(F.sort_array(F.collect_list("observation_id")).alias("ids"))
    notes = notes.unionByName(say(unknown, "unknown_observation_reference", F.concat(F.lit("unknown observation reference: "), F.array_join("ids", ", ")), False))

    good = rows.where(named > 0).join(unknown, ["result_id", "conclusion_id"], "left_anti").select(columns)
    ident = X.stable_id("candidate", F.col("claim_id"), F.array_join("supporting_observation_ids", "\x1f"), digits=24)
    good = good.withColumn("candidate_id", ident).withColumn("nth", F.row_number().over(W.partitionBy("result_id", "candidate_id").orderBy("conclusion_id")))
    notes = notes.unionByName(say(good.where("nth > 1"), "duplicate_candidate", F.lit("conclusion duplicates an already extracted candidate claim"), True))
    kept = good.where("nth = 1").drop("nth")
    if malformed is not None:
        reference = F.coalesce(F.nullif(F.trim("conclusion_id"), F.lit("")), F.concat(F.lit("index:"), F.coalesce(F.col("index").cast("string"), F.lit("?"))))
        reason = F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("malformed conclusion"))
        notes = notes.unionByName(say(malformed.select("result_id", reference.alias("conclusion_id"), reason.alias("reason")), "malformed_conclusion", F.col("reason"), False))

    o, meta, tool = F.col("o"), F.map_from_entries(F.col("o.metadata")), F.col("o.tool_name")
    found = joined.join(kept.select("result_id", "conclusion_id", "candidate_id"), ["result_id", "conclusion_id"]).join(results, "result_id")
    reference = hint(meta, "source_reference", F.coalesce(F.nullif(o["source_reference"], F.lit("")), F.concat(F.lit("tool://"), tool)))
    values = {"tool_call_id": F.col("observation_id"), "source_id": hint(meta, "source_id", F.concat(F.lit("tool:"), tool)), "document_id": hint(meta, "document_id", F.concat(F.lit("document:"), tool)), "chunk_id": hint(meta, "chunk_id", F.concat(F.lit("chunk:"), tool)), "source_reference": reference}
    provenance = F.struct(*[values.get(n, F.col(n)).alias(n) for n in PROVENANCE]).alias("provenance")
    evidence = found.select(
        X.stable_id("evidence", F.col("claim_id"), F.col("observation_id"), digits=24).alias("evidence_id"), "candidate_id", "result_id", F.concat_ws("\x1f", "conclusion_id", F.lpad(F.col("place").cast("string"), 9, "0")).alias("seq"),
        *CLAIM, F.lit("supporting").alias("role"), "confidence", number_hint(meta, "source_quality", 0.5).alias("source_quality"), excerpt(tool, o["input"], o["output"]).alias("excerpt"), o["input"].alias("payload"), provenance,
    )
    first = evidence.withColumn("nth", F.row_number().over(W.partitionBy("result_id", "evidence_id").orderBy("seq"))).where("nth = 1").drop("nth")
    sessions = results.select("result_id", "session_id")
    return Extraction(kept.join(sessions, "result_id"), first, notes)


# Fusion and evaluation.
def with_duplicates(evidence: DataFrame) -> DataFrame:
    """Adds identity, topic, fingerprint, and duplicate_of: the first evidence_id by (seq, evidence_id) of its fingerprint."""
    rows = identities(evidence)
    rows = rows.withColumn("fingerprint", fingerprint(F.col("identity"), F.col("provenance.source_id"), F.col("excerpt"), F.col("payload"), F.col("role")))
    first = rows.groupBy("fingerprint").agg(F.min(F.struct("seq", "evidence_id")).alias("first"))
    same = F.struct("seq", "evidence_id") == F.col("first")
    return rows.join(first, "fingerprint").withColumn("duplicate_of", F.when(~same, F.col("first.evidence_id"))).drop("first")


def fuse(evidence: DataFrame) -> DataFrame:
    """One row for each claim identity: identity, topic, the claim of least id, and the sorted evidence ids of each role,
    without duplicates."""
    unique = with_duplicates(evidence).where("duplicate_of is null")
    ids = lambda role: F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("evidence_id")))).alias(role)
    return unique.groupBy("identity", "topic").agg(F.min(F.struct(*CLAIM)).alias("claim"), *[ids(r) for r in ("supporting", "contradicting", "neutral")]).select("identity", "topic", "claim.*", "supporting", "contradicting", "neutral")


def conflicts(fused: DataFrame) -> DataFrame:
    """topic, claim_a, claim_b, evidence_a, evidence_b: claims of one topic that both have support. A row for each pair, so
    it grows with the square of a topic's objects; evaluate() works with sums instead."""
    one = fused.where(F.size("supporting") > 0).select("topic", "identity", "claim_id", "supporting")
    pair = one.alias("x").join(one.alias("y"), "topic").where(F.col("x.identity") < F.col("y.identity"))
    return pair.select("topic", F.col("x.claim_id").alias("claim_a"), F.col("y.claim_id").alias("claim_b"), F.col("x.supporting").alias("evidence_a"), F.col("y.supporting").alias("evidence_b"))


def evaluate(evidence: DataFrame, confidence: float = 0.5, quality: float = 0.5, strength: float = 0.0) -> DataFrame:
    """Claims by identity: the evidence that passes all three thresholds, without duplicates, and what it amounts to.

    What supports another object of the same topic counts against a claim that has support itself, as evidence in the
    role `contradicting` does. confidence: the mean weight (confidence times quality) of support times its share of all weight.
    Sums by topic are joined back to the claims, so no topic's rows meet in one window.
    """
    for value in (confidence, quality, strength):
        if not 0 <= value <= 1:
            raise ValueError("thresholds lie between 0 and 1")
    rows = with_duplicates(evidence)
    many = rows.where("duplicate_of is not null").groupBy("identity").agg(F.count("*").alias("duplicates"))
    power = X.strength(F.col("confidence"), F.col("source_quality"))
    rows = rows.where("duplicate_of is null").withColumn("good", F.coalesce((F.col("confidence") >= confidence) & (F.col("source_quality") >= quality) & (power >= strength), F.lit(False)))
    weight, good = F.col("confidence") * F.col("source_quality"), F.col("good")
    role = lambda r: good & (F.col("role") == r)
    ids = lambda when, name: F.sort_array(F.collect_list(F.when(when, F.col("evidence_id")))).alias(name)
    zero = lambda when, value: F.coalesce(F.sum(F.when(when, value)), F.lit(0.0))
    one = rows.groupBy("identity", "topic").agg(
        F.min(F.struct(*CLAIM)).alias("claim"), ids(role("supporting"), "supporting"), ids(role("contradicting"), "contradicting"), ids(role("neutral"), "neutral"), ids(~good, "low_quality"),
        zero(role("supporting"), weight).alias("support"), zero(role("contradicting"), weight).alias("explicit"), F.coalesce(F.avg(F.when(role("supporting"), F.col("source_quality"))), F.lit(0.0)).alias("mean_quality"),
        F.count_distinct(F.when(role("supporting"), F.col("provenance.source_id"))).alias("sources"),
    )
    backed = F.size("supporting") > 0
    topics = one.where(backed).groupBy("topic").agg(F.sum("support").alias("all_support"), F.count("*").alias("backed"))
    one = one.join(topics, "topic", "left").join(many, "identity", "left")
    conflicts = F.when(backed, F.col("backed") - 1).otherwise(0).cast("long")
    one = one.withColumn("conflicts", conflicts).withColumn("against", F.col("explicit") + F.when(F.col("conflicts") > 0, F.col("all_support") - F.col("support")).otherwise(0.0))
    total = F.when(F.col("support") > 0, X.clamp(F.col("support") / F.size("supporting") * F.col("support") / (F.col("support") + F.col("against")))).otherwise(0.0)
    return one.select("identity", "topic", "claim.*", "supporting", "contradicting", "neutral", "low_quality", F.coalesce("duplicates", F.lit(0)).alias("duplicates"), "sources", "mean_quality", "conflicts", "support", "against", total.alias("confidence"))


def verify(evaluated: DataFrame, sources: int = 2, confirmed: float = 0.7, probable: float = 0.5, quality: float = 0.5, allow_probable: bool = False) -> DataFrame:
    """Adds status, reason and eligible: contradicted claims, then those without support, of too few sources or of low
    quality, are out; the rest is confirmed, probable or uncertain by its confidence."""
    c = F.col("confidence")
    cases = [
        ((F.col("conflicts") > 0) | (F.size("contradicting") > 0), "contradicted", "unresolved contradiction", False),
        (F.size("supporting") == 0, "insufficient_evidence", "no acceptable supporting evidence", False),
        (F.col("sources") < sources, "insufficient_evidence", f"independent source count below {sources}", False),
        (F.col("mean_quality") < quality, "uncertain", "average source quality below threshold", False),
        (c >= confirmed, "confirmed", "verification criteria satisfied", True),
        (c >= probable, "probable", "confidence supports a probable conclusion", allow_probable),
        (F.lit(True), "uncertain", "confidence below verification threshold", False),
    ]
    def pick(i: int) -> Column:
        out = F.when(cases[0][0], F.lit(cases[0][i]))
        for case in cases[1:]:
            out = out.when(case[0], F.lit(case[i]))
        return out

    return evaluated.withColumns({"status": pick(1), "reason": pick(2), "eligible": pick(3)})


def acquire(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with lifecycle (verified, rejected or deferred) and reason, by the decision on their claim's identity."""
    rows = identities(candidates).join(decisions.select("identity", "status", "eligible", F.col("reason").alias("why")), "identity", "left")
    state = F.when(F.col("status").isNull(), "rejected").when(F.col("eligible"), "verified").when(F.col("status") == "contradicted", "rejected").otherwise("deferred")
    reason = F.coalesce("why", F.lit("no verification decision was produced for the candidate claim"))
    return rows.withColumn("lifecycle", state).withColumn("lifecycle_reason", reason).drop("why", "topic")


# Update of the knowledge base.
def resolves(evidence: DataFrame, sources: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence with `resolves`: whether its chunk is of its document, that of its source, and that has its reference."""
    chain = chunks.select(F.col("id").alias("c"), F.col("document_id").alias("d")).join(documents.select(F.col("id").alias("d"), F.col("source_id").alias("s")), "d").join(sources.select(F.col("id").alias("s"), F.col("reference").alias("r")), "s").distinct().withColumn("resolves", F.lit(True))
    p = F.col("provenance")
    keyed = evidence.withColumns({"s": p["source_id"], "d": p["document_id"], "c": p["chunk_id"], "r": p["source_reference"]})
    return keyed.join(chain, ["s", "d", "c", "r"], "left").drop("s", "d", "c", "r").fillna(False, ["resolves"])


def prepare(decisions: DataFrame, evidence: DataFrame, sources: DataFrame, documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Eligible decisions by piece of evidence, and problems (claim_id, evidence_id, problem): evidence that is missing, of
    incomplete provenance, or that the knowledge base does not hold. An update is in order if there are no problems."""
    wanted = decisions.where("eligible").select("claim_id", "identity", "status", F.col("confidence").alias("aggregate"), "supporting", "contradicting", F.explode("supporting").alias("evidence_id"))
    known = resolves(evidence, sources, documents, chunks).withColumn("complete", provenance_complete(F.col("provenance"))).drop("claim_id", "identity")
    rows = wanted.join(known, "evidence_id", "left")
    problem = F.when(F.col("role").isNull(), "missing evidence").when(~F.col("complete"), "incomplete provenance").when(~F.col("resolves"), "unresolved provenance")
    return rows.where(problem.isNull()), rows.withColumn("problem", problem).where("problem is not null").select("claim_id", "evidence_id", "problem")


def engine_update(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and evidence records of prepared decisions; id lists are sorted and distinct."""
    ids = lambda c: F.sort_array(F.collect_set(c))
    one = prepared.groupBy("claim_id").agg(F.min(F.struct("text", "subject", "predicate", "object")).alias("c"), F.first("aggregate").alias("confidence"), ids("provenance.chunk_id").alias("provenance"), ids("provenance.source_id").alias("source_ids"), F.first("supporting").alias("supporting_evidence"), F.first("contradicting").alias("contradicting_evidence"))
    claims = one.select(F.col("claim_id").alias("id"), "c.*", "confidence", "provenance", "source_ids", "supporting_evidence", "contradicting_evidence", F.lit("unverified").alias("verification_state"))
    role = F.when(F.array_contains("contradicting", F.col("evidence_id")), "contradict").otherwise("support")
    records = prepared.select(F.col("evidence_id").alias("id"), "claim_id", F.col("provenance.chunk_id").alias("chunk_id"), F.col("provenance.document_id").alias("document_id"), F.coalesce(F.nullif("excerpt", F.lit("")), F.col("payload")).alias("text"), role.alias("role"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.col("source_quality").alias("quality"))
    return claims, records


# Progress and the end of an investigation.
def progress(before: DataFrame, after: DataFrame, contradictions_before: DataFrame, contradictions_after: DataFrame, cost: float = 0.0, evidence: int = 0, updates: int = 0) -> DataFrame:
    """One row: gaps and contradictions that came and went, uncertainty, gain between -1 and 1, cost of a resolved gap.

    Gaps are rows (id, uncertainty), contradictions rows (id). Lists are sorted; they hold one iteration's changes.
    """
    b = before.groupBy("id").agg(F.max("uncertainty").alias("u"))
    a = after.groupBy("id").agg(F.max("uncertainty").alias("v"))
    rows = b.join(a, "id", "full")
    resolved, fresh = F.col("v").isNull(), F.col("u").isNull()
    ids = lambda when, name: F.sort_array(F.collect_list(F.when(when, F.col("id")))).alias(name)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    gaps = rows.agg(
        F.count("u").alias("gaps_before"), F.count("v").alias("gaps_after"), ids(resolved, "resolved"), ids(fresh, "discovered"), ids(F.col("v").isNotNull(), "remaining"), total("u").alias("base"),
        total(F.when(resolved, F.col("u")).when(~fresh, F.greatest(F.lit(0.0), F.col("u") - F.col("v")))).alias("reduced"), total(F.when(fresh, F.col("v"))).alias("added"),
    )
    x = contradictions_before.select("id").distinct().withColumn("was", F.lit(1)).join(contradictions_after.select("id").distinct().withColumn("is", F.lit(1)), "id", "full").where("id <> ''")
    pairs = x.agg(F.count("was").alias("conflicts_before"), ids(F.col("was").isNull(), "introduced"), ids(F.col("is").isNull(), "settled"))
    many = F.size("introduced")
    penalty = many / F.greatest(F.lit(1), F.col("conflicts_before") + many)
    gain = (F.col("reduced") - F.col("added")) / F.greatest(F.lit(1.0), F.col("base")) - 0.25 * penalty
    each = F.when(F.size("resolved") > 0, F.lit(float(cost)) / F.size("resolved"))
    return gaps.crossJoin(pairs).select("gaps_before", "gaps_after", "resolved", "discovered", "remaining", F.round("reduced", 9).alias("uncertainty_reduced"), "introduced", "settled", F.lit(evidence).alias("evidence_collected"), F.lit(updates).alias("knowledge_updates"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), gain)), 9).alias("information_gain"), F.lit(float(cost)).alias("cost"), each.alias("cost_per_resolved_gap"))


def budget_exhausted() -> Column:
    """Of rows with used_ and most_ columns: whether investigations, runs, cost or seconds are used up."""
    out = F.lit(False)
    for name in ("investigations", "agent_runs", "cost", "seconds"):
        out = out | (F.col(f"used_{name}") >= F.col(f"most_{name}"))
    return out


def termination(contexts: DataFrame, confidence: float = 0.9, least: float = 0.05) -> DataFrame:
    """Adds reason and target to sessions: the first condition that holds, in this order; both null to go on.

    contexts: state, iteration, most_iterations, used_ and most_ columns, cancel, failure, satisfied, gaps, confidence,
    contradictions, resolvable, best_score (null for none).
    """
    f = F.col
    cases = [
        (f("cancel") | (f("state") == "CANCELLED"), "user_cancellation", "CANCELLED"),
        (f("failure") | (f("state") == "FAILED"), "system_failure", "FAILED"),
        (f("satisfied"), "objective_satisfied", "COMPLETED"),
        ((f("gaps") == 0) & (f("confidence") >= confidence), "confidence_threshold_reached", "COMPLETED"),
        (f("iteration") >= f("most_iterations"), "maximum_iterations_reached", "COMPLETED"),
        (budget_exhausted(), "budget_exhausted", "COMPLETED"),
        ((f("contradictions") > 0) & ~f("resolvable"), "unresolvable_contradiction", "COMPLETED"),
        (f("best_score").isNull() | (f("best_score") < least), "no_valuable_investigation", "COMPLETED"),
    ]
    reason, target = F.when(cases[0][0], cases[0][1]), F.when(cases[0][0], cases[0][2])
    for when, name, state in cases[1:]:
        reason, target = reason.when(when, name), target.when(when, state)
    return contexts.withColumn("reason", reason).withColumn("target", target)
