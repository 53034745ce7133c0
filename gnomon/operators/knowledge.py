"""Claims: uncertainty, states, contradictions, gaps with their importance, and scores of investigations.

Values are compared unrounded and rounded only where they are shown. Evidence is in gnomon.operators.evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gnomon.functions.storage import cut_lineage
from gnomon.functions.text import clamp, recency, stable_id


def uncertainty(claims: DataFrame, as_of: Column) -> DataFrame:
    """Adds score, uncertainty and state to claims with confidence, supporting, contradicting (counts), quality, sources (distinct), observed."""
    diversity = F.least(F.lit(1.0), F.col("sources") / F.lit(3.0))
    score = clamp(F.col("confidence") + 0.15 * F.least(F.lit(5), "supporting") - 0.35 * F.least(F.lit(5), "contradicting") + 0.15 * (2 * F.col("quality") - 1) + 0.10 * diversity + 0.10 * (recency(F.col("observed"), as_of) - 0.5))
    rows = claims.withColumn("raw", score).withColumn("state", state(F.col("raw"), F.col("supporting"), F.col("contradicting")))
    return rows.withColumns({"score": F.round("raw", 6), "uncertainty": F.round(1 - F.col("raw"), 6)}).drop("raw")


def parsed_time(text: Column) -> Column:
    """A time of one of three forms, as UTC; null for others."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")])


def last_seen(observed: Column, updated: Column, created: Column) -> Column:
    """The first of a claim's times that can be read, in this order, not the latest."""
    return F.coalesce(*[parsed_time(c) for c in (observed, updated, created)])


def source_signals(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """id, quality, sources of claims (id, source_ids): the mean quality of distinct sources between 0 and 1 (0.5 for a source
    that is unknown or gives none, and for a claim without any) and their number."""
    quality = sources.select(F.col("id").alias("s"), clamp(F.coalesce(F.try_element_at("metadata", F.lit("quality")).try_cast("double"), F.lit(0.5))).alias("q"))
    rows = claims.select("id", F.explode(F.array_distinct("source_ids")).alias("s")).join(quality, "s", "left")
    got = rows.groupBy("id").agg(F.avg(F.coalesce("q", F.lit(0.5))).alias("quality"), F.count("*").alias("sources"))
    return claims.select("id").join(got, "id", "left").select("id", F.coalesce("quality", F.lit(0.5)).alias("quality"), F.coalesce("sources", F.lit(0)).alias("sources"))


def assess(claims: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """id, confidence, uncertainty, state and what they come from, of claim records (with id lists and times as text)."""
    when = last_seen(*[F.col(c) if c in claims.columns else F.lit(None).cast("string") for c in ("observed_at", "updated_at", "created_at")])
    rows = claims.select("id", "confidence", F.size("supporting_evidence").alias("supporting"), F.size("contradicting_evidence").alias("contradicting"), when.alias("observed")).join(source_signals(claims, sources), "id")
    return uncertainty(rows, as_of).select("id", F.col("score").alias("confidence"), "uncertainty", "state", "supporting", "contradicting", "quality", "sources")


def state(confidence: Column, supporting: Column, contradicting: Column) -> Column:
    against = (contradicting > 0) & (contradicting >= supporting)
    return F.when(against & (supporting == 0), "refuted").when(against, "contradicted").when((supporting > 0) & (confidence >= 0.7), "verified").when(supporting > 0, "supported").when(confidence < 0.4, "uncertain").otherwise("unverified")


def pair_strength(x: Column, y: Column) -> Column:
    """Of two records (confidence, evidence): min(1, both confidences times a third of one more than their evidence)."""
    return F.least(F.lit(1.0), x["confidence"] * y["confidence"] * (1 + x["evidence"] + y["evidence"]) / 3)


def _opposed(one: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs x, y of rows (keys, o, c) that agree in keys and not in o."""
    pair = one.alias("x").join(one.alias("y"), keys).where(F.col("x.o") < F.col("y.o"))
    return pair.select(*keys, F.col("x.c").alias("x"), F.col("y.c").alias("y"))


def conflicting_claims(claims: DataFrame) -> DataFrame:
    """subject, predicate, a, b, strength: pairs of distinct objects under one subject and predicate, each by its first claim.

    claims: id, subject, predicate, object, confidence, evidence (count). Objects are reduced to one row each before the
    pairs are made, so the pairs grow with the distinct objects of a subject and not with its claims.
    """
    key = [F.lower(F.trim("subject")).alias("s"), F.col("predicate"), F.lower(F.trim("object")).alias("o")]
    one = claims.where((F.trim("subject") != "") & (F.trim("object") != "")).groupBy(*key).agg(F.min_by(F.struct("id", "confidence", "evidence"), "id").alias("c"))
    pair = _opposed(one, ["s", "predicate"])
    return pair.select(F.col("s").alias("subject"), "predicate", F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.round(pair_strength(F.col("x"), F.col("y")), 6).alias("strength"))


def exclusive_relations(relations: DataFrame) -> DataFrame:
    """subject, predicate, a, b, strength: pairs of relations (id, subject, predicate, object, confidence, evidence) that differ in
    the object alone, each object by its first relation."""
    one = relations.groupBy("subject", "predicate", F.col("object").alias("o")).agg(F.min_by(F.struct("id", "confidence", "evidence"), "id").alias("c"))
    pair = _opposed(one, ["subject", "predicate"])
    return pair.select("subject", "predicate", F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.round(pair_strength(F.col("x"), F.col("y")), 6).alias("strength"))


def stale_claims(claims: DataFrame) -> DataFrame:
    """a, b, strength: claims (id, state) that are marked stale, against themselves."""
    return claims.where(F.col("state") == "stale").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.5).alias("strength"))


def contradictions(claims: DataFrame, relations: DataFrame) -> DataFrame:
    """id, kind, a, b, strength: all three kinds, with ids that are the same whenever they are found again."""
    kinds = [("conflicting_claims", conflicting_claims(claims)), ("mutually_exclusive_relations", exclusive_relations(relations)), ("stale_claim", stale_claims(claims))]
    out = None
    for kind, rows in kinds:
        rows = rows.select(F.lit(kind).alias("kind"), "a", "b", "strength")
        out = rows if out is None else out.unionByName(rows)
    return out.select(stable_id("contra", F.col("kind"), F.col("a"), F.col("b")).alias("id"), "kind", "a", "b", "strength")


def priority(importance: Column, doubt: Column) -> Column:
    return importance * (1 - doubt) * 0.5 + doubt * 0.5


def gaps(claims: DataFrame) -> DataFrame:
    """claim_id, kind, uncertainty, cost: claims of low confidence, without support, without evidence, of few sources, stale."""
    def kind(name: str, when: Column, doubt: Column, cost: float = 1.0) -> DataFrame:
        return claims.where(when).select(F.col("id").alias("claim_id"), F.lit(name).alias("kind"), F.round(doubt, 6).alias("uncertainty"), F.lit(cost).alias("cost"))

    half = F.lit(0.5)
    out = kind("low_confidence", F.col("confidence") < 0.4, 1 - F.col("confidence"))
    for more in (kind("unsupported_claim", F.col("supporting") == 0, 1 - F.col("confidence")), kind("stale", F.col("state") == "stale", F.lit(0.8)), kind("missing_evidence", F.col("evidence") < 1, F.lit(0.6)), kind("low_diversity", F.col("sources") < 2, half)):
        out = out.unionByName(more)
    return out


def expected_gain(kind: Column, importance: Column, doubt: Column) -> Column:
    i, u = importance, doubt
    out = F.when(kind == "missing_relation", 0.3 + 0.7 * i).when(kind == "low_confidence", 0.2 + 0.8 * u).when(kind == "unsupported_claim", 0.4 * u + 0.4 * i + 0.2).when(kind == "contradiction", 0.6 * u)
    out = out.when(kind == "missing_evidence", 0.3 + 0.7 * u).when(kind == "low_diversity", 0.25 + 0.75 * u).otherwise(0.5)
    return clamp(out)


def investigation_score(rows: DataFrame) -> DataFrame:
    """Adds gain and score to gaps with kind, importance, uncertainty, cost."""
    gain = expected_gain(F.col("kind"), F.col("importance"), F.col("uncertainty"))
    return rows.withColumn("gain", F.round(gain, 6)).withColumn("score", F.round(gain * F.col("importance") * clamp(F.col("uncertainty")) / F.greatest(F.col("cost"), F.lit(1e-6)), 6))


def random_score(ident: Column, seed: int) -> Column:
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), ident), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def centrality_score(importance: Column, cost: Column) -> Column:
    return importance / F.greatest(cost, F.lit(1e-6))


def calibration_error(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """error: of rows (p, label 0/1) the mean distance of bins' mean p and mean label, weighted by their rows."""
    rows = predictions.groupBy(F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("label").alias("y"))
    return rows.agg(F.round(F.coalesce(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), F.lit(0.0)), 6).alias("error"))


def mean(values: DataFrame, column: str) -> DataFrame:
    """One row: the mean of a column, 0 without rows."""
    return values.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias("mean"))


def share_true(rows: DataFrame, condition: Column) -> DataFrame:
    """One row: the share of rows that meet a condition, 0 without rows: accuracy of claims, correctness of provenance."""
    return rows.agg(F.round(F.coalesce(F.avg(condition.cast("int")), F.lit(0.0)), 6).alias("share"))


def set_recall(found: DataFrame, relevant: DataFrame, key: list[str], by: str = "query_id") -> DataFrame:
    """by, recall, precision: of each query's relevant entities, relations, ways or evidence the share found, and of those
    found the share that is relevant; both count each once, and are 0 of nothing."""
    got, want = found.select(by, *key).distinct(), relevant.select(by, *key).distinct()
    hit = got.join(want, [by, *key]).groupBy(by).agg(F.count("*").alias("hits"))
    rows = want.groupBy(by).agg(F.count("*").alias("many")).join(got.groupBy(by).agg(F.count("*").alias("found")), by, "full").join(hit, by, "left")
    ratio = lambda c: F.round(F.coalesce(F.col("hits") / F.col(c), F.lit(0.0)), 6)
    return rows.select(by, ratio("many").alias("recall"), ratio("found").alias("precision"))


# Gaps with their importance.
def named_entities(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """id (of the claim), entity_id: entities that are called like a claim's subject or object, but for case."""
    canonical = F.lower(F.coalesce(F.nullif(F.col("canonical_name"), F.lit("")), F.col("name")))
    known = entities.select(F.col("id").alias("entity_id"), canonical.alias("key"))
    return claims.select("id", F.explode(F.array_distinct(F.array(F.lower("subject"), F.lower("object")))).alias("key")).join(known, "key").select("id", "entity_id").distinct()


def normal_centrality(rows: DataFrame, ranks: DataFrame, by: list[str], entity: str = "entity_id") -> DataFrame:
    """by, centrality: the sum of the ranks of entities over the greatest rank, 1 at most; 0.5 if there are no ranks."""
    top = ranks.agg(F.max("rank").alias("top"))
    sums = rows.join(ranks.select(F.col("id").alias(entity), "rank"), entity, "left").groupBy(*by).agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("s"))
    value = F.when(F.col("top").isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.col("s") / F.when(F.col("top") == 0, 1.0).otherwise(F.col("top"))))
    return sums.crossJoin(F.broadcast(top)).select(*by, value.alias("centrality"))


def claim_importance(claims: DataFrame, entities: DataFrame, ranks: DataFrame) -> DataFrame:
    """id, importance, entities (sorted): min(1, the centrality of the entities named times the confidence, and 0.2)."""
    named = named_entities(claims, entities)
    central = normal_centrality(named, ranks, ["id"])
    lists = named.groupBy("id").agg(F.sort_array(F.collect_list("entity_id")).alias("entities"))
    base = F.lit(0.5) if ranks.isEmpty() else F.lit(0.0)
    rows = claims.select("id", "confidence").join(central, "id", "left").join(lists, "id", "left")
    return rows.select("id", F.least(F.lit(1.0), F.coalesce("centrality", base) * F.col("confidence") + 0.2).alias("importance"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))


#: What an investigation of each kind costs, and what it is to do.
COSTS = {"verify": 1.0, "evidence": 1.0, "relation": 1.5, "entity": 2.0}
_TASKS = {"low_confidence": "verify claim ", "unsupported_claim": "find evidence for claim ", "stale": "refresh stale claim ", "missing_evidence": "gather evidence for claim ", "low_diversity": "find independent confirmation for claim "}


def find_gaps(claims: DataFrame, relations: DataFrame, entities: DataFrame, found: DataFrame, ranks: DataFrame, pairs: DataFrame, low: float = 0.4, evidence: int = 1, sources: int = 2) -> DataFrame:
    """All gaps of a knowledge base: id, kind, description, reason, affected_entities, affected_claims, uncertainty, importance,
    estimated_cost, priority, candidates (one investigation each).

    claims: records with id lists and verification_state; relations: (subject_id, object_id); found: contradictions();
    ranks: PageRank (id, rank); pairs: open triads (a, b, shared), the best of them. Ids are hashes, so a gap that is found
    again is the same one. Order by priority where it is shown.
    """
    claims = cut_lineage(claims.select("id", "text", "subject", "object", "confidence", "supporting_evidence", "source_ids", "verification_state").join(claim_importance(claims, entities, ranks), "id"))
    none, f = F.array().cast("array<string>"), F.col
    support, distinct = F.size("supporting_evidence"), F.size(F.array_distinct("source_ids"))
    said = F.substring("text", 1, 80)
    kinds = [
        ("low_confidence", f("confidence") < low, F.concat(F.lit("claim has low confidence: "), said), F.concat(F.lit("confidence "), F.format_number("confidence", 2), F.lit(f" below threshold {low}")), 1 - f("confidence"), F.lit(COSTS["verify"])),
        ("unsupported_claim", support == 0, F.concat(F.lit("claim has no supporting evidence: "), said), F.lit("claim is asserted without any supporting evidence"), 1 - f("confidence"), F.lit(COSTS["evidence"])),
        ("stale", f("verification_state") == "stale", F.concat(F.lit("stale claim: "), said), F.lit("claim verification state is stale"), F.lit(0.8), F.lit(COSTS["evidence"])),
        ("missing_evidence", support < evidence, F.concat(F.lit("claim has "), support.cast("string"), F.lit(" evidence item(s): "), said), F.lit(f"fewer than {evidence} supporting evidence items"), F.lit(0.6), F.lit(COSTS["evidence"]) * F.greatest(F.lit(1), evidence - support)),
        ("low_diversity", distinct < sources, F.concat(F.lit("claim rests on a single source: "), said), F.lit(f"fewer than {sources} independent sources support the claim"), F.lit(0.5), F.lit(COSTS["evidence"])),
    ]
    columns = lambda kind, description, reason, ents, ids, doubt, importance, cost, task, task_cost: [F.lit(kind).alias("kind"), description.alias("description"), reason.alias("reason"), ents.alias("affected_entities"), ids.alias("affected_claims"), doubt.cast("double").alias("uncertainty"), importance.cast("double").alias("importance"), cost.cast("double").alias("estimated_cost"), task.alias("task"), task_cost.cast("double").alias("task_cost")]
    parts = []
    for kind, when, description, reason, doubt, cost in kinds:
        parts.append(claims.where(when).select(*columns(kind, description, reason, f("entities"), F.array("id"), doubt, f("importance"), cost, F.concat(F.lit(_TASKS[kind]), F.substring("id", 1, 8)), cost)))

    names = entities.select(f("id").alias("e"), F.coalesce(F.nullif(f("canonical_name"), F.lit("")), f("name")).alias("n"))
    pairs = cut_lineage(pairs)
    central = normal_centrality(pairs.select("a", "b", F.explode(F.array("a", "b")).alias("entity_id")), ranks, ["a", "b"])
    rows = pairs.join(central, ["a", "b"]).join(names.withColumnsRenamed({"e": "a", "n": "x"}), "a", "left").join(names.withColumnsRenamed({"e": "b", "n": "y"}), "b", "left")
    short = lambda c: F.substring(c, 1, 8)
    about = F.concat(F.lit("no observed relation between "), F.coalesce("x", short("a")), F.lit(" and "), F.coalesce("y", short("b")))
    relation = F.lit(COSTS["relation"])
    parts.append(rows.select(*columns("missing_relation", about, F.lit("entities co-occur around shared neighbors with no direct edge"), F.array("a", "b"), none, F.lit(0.5), f("centrality"), relation * (1.0 + 0.5 * f("shared")), F.concat(F.lit("investigate relation between "), short("a"), F.lit(" and "), short("b")), relation)))

    linked = relations.select(F.explode(F.array("subject_id", "object_id")).alias("id")).distinct()
    alone = entities.select("id", F.coalesce(F.nullif(f("canonical_name"), F.lit("")), f("name")).alias("n")).join(linked, "id", "left_anti")
    central = normal_centrality(alone.select("id", f("id").alias("entity_id")), ranks, ["id"])
    entity = F.lit(COSTS["entity"])
    parts.append(alone.join(central, "id").select(*columns("disconnected_entity", F.concat(F.lit("entity has no relations: "), "n"), F.lit("entity appears in no relation, isolating it from the graph"), F.array("id"), none, F.lit(1.0), f("centrality"), entity, F.concat(F.lit("study entity "), "n"), entity)))

    ends = found.select("id", F.explode(F.array_distinct(F.array("a", "b"))).alias("c")).join(claims.select(f("id").alias("c"), F.explode("entities").alias("e")), "c").groupBy("id").agg(F.sort_array(F.collect_set("e")).alias("targets"))
    rows = found.join(ends, "id", "left").withColumn("targets", F.coalesce("targets", none))
    verify = F.lit(COSTS["verify"])
    parts.append(rows.select(*columns("contradiction", F.concat(F.lit("conflict of kind "), "kind", F.lit(" between "), "a", F.lit(" and "), "b"), F.lit("conflicting knowledge was detected and preserved"), f("targets"), F.array_distinct(F.array("a", "b")), F.least(F.lit(1.0), 1.5 * f("strength")), f("strength"), verify, F.lit("resolve contradiction by gathering decisive evidence"), verify)))

    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    ident = stable_id("gap", f("kind"), F.to_json("affected_entities"), F.to_json("affected_claims"))
    task = F.struct(stable_id("inv", ident, f("task")).alias("id"), f("task").alias("description"), f("affected_entities").alias("target_entities"), f("task_cost").alias("estimated_cost"), F.create_map(F.lit("kind"), "kind").alias("metadata"))
    return out.select(ident.alias("id"), "kind", "description", "reason", "affected_entities", "affected_claims", "uncertainty", "importance", "estimated_cost", priority(f("importance"), f("uncertainty")).alias("priority"), F.array(task).alias("candidates"))


def score_gaps(gaps: DataFrame, by: str = "gain", seed: int = 0, top: int | None = None) -> DataFrame:
    """Investigations of gaps with gain, reduction, importance and score: by expected gain, at random, or by centrality."""
    rows = gaps.select(F.col("id").alias("gap_id"), "kind", "importance", "uncertainty", F.explode("candidates").alias("c")).select("gap_id", "kind", "importance", "uncertainty", F.col("c.id").alias("id"), F.col("c.description").alias("description"), F.col("c.target_entities").alias("target_entities"), F.col("c.estimated_cost").alias("cost"))
    zero = F.lit(0.0)
    if by == "gain":
        gain, reduction, weight = expected_gain(F.col("kind"), F.col("importance"), F.col("uncertainty")), clamp(F.col("uncertainty")), clamp(F.col("importance"))
        score = gain * weight * reduction / F.greatest(F.col("cost"), F.lit(1e-6))
    elif by == "random":
        gain, reduction, weight, score = zero, zero, zero, random_score(F.col("id"), seed)
    elif by == "centrality":
        gain, reduction, weight, score = zero, zero, F.col("importance"), centrality_score(F.col("importance"), F.col("cost"))
    else:
        raise ValueError(f"no such score: {by}")
    rows = rows.withColumns({"gain": gain, "reduction": reduction, "importance": weight, "score": score})
    return rows if top is None else rows.orderBy(F.desc("score"), "id").limit(top)
