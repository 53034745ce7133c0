"""Retrieval over a knowledge base for batches of queries: linking of names, entity and graph retrieval, features, reranking,
fusion, and answers with the graph around them.

Queries are rows (query_id, text). Each method gives rows (query_id, method, object_id, rank, score); object_id is a
chunk. All ties go to the smaller id. What a query asks of a method (`pool`) bounds what leaves its ranking.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gnomon.functions.storage import cut_lineage
from gnomon.functions.text import tokenize
from gnomon.operators import graph as G
from gnomon.operators import retrieval as R
from gnomon.operators.extraction import name_key

METHODS = ("lexical", "vector", "entity", "graph")
#: What each feature counts in reranking.
WEIGHTS = {"fused_score": 1.0, "evidence_count": 0.4, "claim_count": 0.2, "entity_centrality": 0.3, "source_diversity": 0.1}


def ranked(rows: DataFrame, method: str, top: int) -> DataFrame:
    """query_id, method, object_id, rank, score of rows (query_id, object_id, score)."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "object_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.lit(method).alias("method"), "object_id", "rank", "score")


def terms_of(entities: DataFrame) -> DataFrame:
    """key, id, entity_type: the names of entities, canonical ones and aliases; of two entities with a name the smaller id."""
    canonical = F.coalesce(F.nullif(F.col("canonical_name"), F.lit("")), F.col("name"))
    names = entities.select("id", "entity_type", F.explode(F.concat(F.array(canonical), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    return names.withColumn("key", name_key(F.col("name"))).where("key <> ''").groupBy("key").agg(F.min(F.struct("id", "entity_type")).alias("e")).select("key", "e.*")


def link(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """query_id, entity_id, place: the entities that queries name, from left to right, the longest name at each place, each
    entity once. Queries bring their runs of words to the names, so the names are neither collected nor broadcast."""
    terms = terms_of(entities)
    widest = terms.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 0
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[^\s,.;:()?!]+"), F.lit(0))
    rows = queries.where("text is not null").select("query_id", words.alias("w")).where(F.size("w") > 0).select("query_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("at"))
    width = F.least(F.lit(widest), F.size("w") - F.col("at") + 1)
    runs = rows.where(width > 0).select("query_id", "w", "at", F.explode(F.sequence(F.lit(1), width)).alias("width")).select("query_id", "at", "width", F.array_join(F.slice("w", F.col("at"), F.col("width")), " ").alias("key"))
    found = runs.join(terms, "key").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("at", (-F.col("width")).alias("less"), "id"))).alias("c"))
    # Of names in the order of place and falling width, each that begins behind the one taken before.
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("ids"))
    take = lambda s, c: F.when(c["at"] >= s["next"], F.struct((c["at"] - c["less"]).alias("next"), F.array_append(s["ids"], c["id"]).alias("ids"))).otherwise(s)
    taken = found.select("query_id", F.array_distinct(F.aggregate("c", start, take)["ids"]).alias("ids"))
    return taken.select("query_id", F.posexplode("ids").alias("place", "entity_id")).select("query_id", "entity_id", "place")


def analyze(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """query_id, text, tokens, entity_ids: the ids in the order in which they are named."""
    ids = link(queries, entities).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "entity_id"))), lambda s: s["entity_id"]).alias("entity_ids"))
    rows = queries.select("query_id", F.trim("text").alias("text")).withColumn("tokens", tokenize(F.col("text")))
    return rows.join(ids, "query_id", "left").withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<string>")))


def lexical(chunks: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    found = R.bm25(chunks.select("id", "text"), queries.where("text is not null"), top, ident="id")
    return found.select("query_id", F.lit("lexical").alias("method"), F.col("id").alias("object_id"), "rank", "score").withColumn("rank", F.col("rank").cast("int"))


def embedding_records(rows: DataFrame, model: str = "feature-hash", version: str = "1", dims: int = 256) -> DataFrame:
    """id, object_id, model, version, dimensionality, vector of rows (id, text)."""
    from gnomon.functions.text import embedding_id

    named = R.embed(rows, "id", dims).select(F.col("id").alias("object_id"), F.lit(model).alias("model"), F.lit(version).alias("version"), F.lit(dims).alias("dimensionality"), "vector")
    return named.select(embedding_id(F.col("object_id").cast("string"), F.col("model"), F.col("version")).alias("id"), *named.columns)


def matching(embeddings: DataFrame, wanted: dict[str, str] | None) -> DataFrame:
    """Embeddings whose metadata agrees with every key and value wanted."""
    for key, value in (wanted or {}).items():
        embeddings = embeddings.where(F.try_element_at("metadata", F.lit(key)) == value)
    return embeddings


def dense(embeddings: DataFrame, queries: DataFrame, top: int = 10, wanted: dict[str, str] | None = None) -> DataFrame:
    """By cosine of hashed embeddings. A negative `top` is an error, 0 gives nothing."""
    if top < 0:
        raise ValueError("top must not be negative")
    mine = matching(embeddings, wanted).select(F.col("object_id").alias("vec_id"), F.col("vector").alias("embedding"))
    asked = R.embed(queries.where("text is not null"), "query_id").withColumnRenamed("vector", "q")
    found = R.cosine_top(cut_lineage(mine), cut_lineage(asked), top) if top else mine.crossJoin(asked).limit(0).select("query_id", "vec_id", F.lit(0).alias("rank"), F.lit(0.0).alias("score"))
    return found.select("query_id", F.lit("vector").alias("method"), F.col("vec_id").alias("object_id"), F.col("rank").cast("int"), "score")


def by_entity(relations: DataFrame, linked: DataFrame, top: int = 10) -> DataFrame:
    """Chunks by the confidence of the relations that name a query's entities, from either end; a loop counts twice."""
    ends = relations.select(F.col("subject_id").alias("entity_id"), "confidence", "provenance").unionByName(relations.select(F.col("object_id").alias("entity_id"), "confidence", "provenance"))
    hits = ends.join(linked.select("query_id", "entity_id").distinct(), "entity_id").select("query_id", "confidence", F.explode("provenance").alias("object_id"))
    return ranked(hits.groupBy("query_id", "object_id").agg(F.round(F.sum("confidence"), 9).alias("score")), "entity", top)


def by_graph(relations: DataFrame, entities: DataFrame, linked: DataFrame, top: int = 10, depth: int = 2, rounds: int = 100) -> DataFrame:
    """Chunks by the relations around a query's entities, each with its confidence times the personal rank of its ends, once
    for every time that the walk sees it."""
    seeds = linked.select("query_id", F.col("entity_id").alias("id")).distinct()
    edges = G.edges_of(relations)
    rank = G.personal_ranks(edges, seeds, entities.select("id"), rounds=rounds)
    walked = G.walk(edges, seeds, depth)[1].groupBy("query_id", "id").agg(F.count("*").alias("times"))
    rows = walked.join(relations.select("id", "subject_id", "object_id", "confidence", "provenance"), "id")
    end = lambda c: rank.select("query_id", F.col("id").alias(c), F.col("rank").alias("r_" + c))
    rows = rows.join(end("subject_id"), ["query_id", "subject_id"], "left").join(end("object_id"), ["query_id", "object_id"], "left").fillna(0.0, ["r_subject_id", "r_object_id"])
    part = F.col("times") * F.col("confidence") * (F.col("r_subject_id") + F.col("r_object_id"))
    hits = rows.select("query_id", part.alias("part"), F.explode("provenance").alias("object_id"))
    return ranked(hits.groupBy("query_id", "object_id").agg(F.round(F.sum("part"), 9).alias("score")), "graph", top)


def chunk_features(kb, ranks: DataFrame | None = None) -> DataFrame:
    """object_id, evidence_count, claim_count, source_diversity, entity_centrality of every chunk that a record cites."""
    ranks = G.pagerank(G.edges_of(kb.relations), 100, tolerance=1e-6, verts=kb.entities.select("id")) if ranks is None else ranks
    chunk = F.explode("provenance").alias("object_id")
    cited = kb.relations.select("subject_id", "object_id", "source_ids", F.col("provenance")).withColumnRenamed("object_id", "target")
    cited = cited.select("subject_id", "target", "source_ids", chunk)
    ends = cited.select("object_id", F.explode(F.array("subject_id", "target")).alias("id")).distinct().join(ranks, "id").groupBy("object_id").agg(F.max("rank").alias("entity_centrality"))
    sources = cited.select("object_id", F.explode("source_ids").alias("s")).groupBy("object_id").agg(F.count_distinct("s").alias("source_diversity"))
    claims = kb.claims.select(chunk).groupBy("object_id").agg(F.count("*").alias("claim_count"))
    evidence = kb.evidence.groupBy(F.col("chunk_id").alias("object_id")).agg(F.count("*").alias("evidence_count"))
    out = evidence.join(claims, "object_id", "full").join(sources, "object_id", "full").join(ends, "object_id", "full")
    return out.fillna(0).select("object_id", *[F.col(c).cast("double").alias(c) for c in ("evidence_count", "claim_count", "source_diversity", "entity_centrality")])


def no_features(spark) -> DataFrame:
    """What chunk_features() gives for a knowledge base without records."""
    return spark.createDataFrame([], "object_id string, evidence_count double, claim_count double, source_diversity double, entity_centrality double")


def normalized(key: str, value: Column) -> Column:
    """A feature between 0 and 1: fused scores times 60, counts of claims and evidence by ten."""
    one = F.lit(1.0)
    if key == "fused_score":
        return F.least(one, value * 60.0)
    return F.least(one, value / 10.0) if key.endswith("_count") else F.least(one, F.greatest(F.lit(0.0), value))


def rerank(candidates: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds rerank_score and position: the weighted sum of normal features, ties in the order of the fused score."""
    total = F.lit(0.0)
    for key, weight in (WEIGHTS if weights is None else weights).items():
        total = total + weight * F.coalesce(normalized(key, F.col(key)), F.lit(0.0)) if key in candidates.columns else total
    rows = candidates.withColumn("rerank_score", F.round(total, 9))
    return rows.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc(F.round("fused_score", 12)), "object_id")))


@dataclass
class Trace:
    """How long building and running each method took, and how many rows it gave."""

    rows: list[tuple[str, int, float]] = field(default_factory=list)

    def timed(self, method: str, make) -> DataFrame:
        began = time.perf_counter()
        found = cut_lineage(make())
        self.rows.append((method, found.count(), (time.perf_counter() - began) * 1000))
        return found


def retrieve(kb, queries: DataFrame, top: int = 10, wanted: dict[str, str] | None = None, methods: tuple[str, ...] = METHODS, weights: dict[str, float] | None = None, features: DataFrame | None = None, trace: Trace | None = None, rounds: int = 100) -> DataFrame:
    """query_id, object_id, position, score (fused), rerank_score, contributions and features of the `top` chunks of each query.

    Every method is asked for max(4 top, 20) chunks; entity and graph retrieval serve queries that name an entity. The
    filter on metadata holds for vectors only.
    """
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"no such methods: {sorted(unknown)}")
    trace, pool = trace or Trace(), max(4 * top, 20)
    linked = cut_lineage(link(queries, kb.entities)) if {"entity", "graph"} & set(methods) else None
    make = {
        "lexical": lambda: lexical(kb.chunks, queries, pool),
        "vector": lambda: dense(kb.embeddings, queries, pool, wanted),
        "entity": lambda: by_entity(kb.relations, linked, pool),
        "graph": lambda: by_graph(kb.relations, kb.entities, linked, pool, rounds=rounds),
    }
    found = None
    for method in METHODS:
        if method in methods:
            rows = trace.timed(method, make[method]).select("query_id", "method", "object_id", F.col("rank").cast("int").alias("rank"))
            found = rows if found is None else found.unionByName(rows)
    fused = R.reciprocal_rank_fusion(found, weights=weights, contributions=True).withColumn("fused_score", F.col("score"))
    fused = fused.join(kb.chunks.select(F.col("id").alias("object_id")), "object_id", "left_semi")
    features = chunk_features(kb) if features is None else features
    names = [c for c in features.columns if c != "object_id"]
    rows = rerank(fused.join(features, "object_id", "left").fillna(0.0, names))
    return rows.where(F.col("position") <= top).select("query_id", "object_id", "position", "score", "rerank_score", "contributions", *names)


@dataclass
class Answers:
    """The graph around each query, one table for each kind of record; all have query_id."""

    retrieval: DataFrame | None
    entities: DataFrame
    relations: DataFrame
    claims: DataFrame
    evidence: DataFrame
    sources: DataFrame
    paths: DataFrame
    confidence: DataFrame


def answer(kb, queries: DataFrame, top: int = 8, depth: int = 2, features: DataFrame | None = None, rounds: int = 100, chunks: bool = True) -> Answers:
    """What a knowledge base holds around the entities that queries name.

    A walk of `depth` steps, of 200 nodes and 800 edges at most, gives entities and relations; claims are those from the
    relations' chunks or about one of the entities; evidence and sources are what these name. `top` bounds the retrieval
    alone, and without `chunks` there is none. The confidence is the mean of the claims', without claims twice the personal rank
    of all, 1 at most.
    """
    retrieval = retrieve(kb, queries, top, features=features, rounds=rounds) if chunks else None
    linked = cut_lineage(link(queries, kb.entities))
    seeds = linked.select("query_id", F.col("entity_id").alias("id"))
    edges = G.edges_of(kb.relations)
    nodes, walked = G.walk(edges, seeds, depth, 200, 800)
    entities = cut_lineage(nodes.select("query_id", "id").join(kb.entities, "id"))
    relations = cut_lineage(walked.select("query_id", "id").distinct().join(kb.relations, "id"))
    cited = relations.select("query_id", F.explode("provenance").alias("chunk_id")).distinct()
    by_chunk = kb.claims.select("id", F.explode("provenance").alias("chunk_id")).join(cited, "chunk_id").select("query_id", "id")
    about = entities.where("name <> ''").select("query_id", F.lower("name").alias("key")).distinct()
    by_subject = kb.claims.select("id", F.lower("subject").alias("key")).join(about, "key").select("query_id", "id")
    claims = cut_lineage(by_chunk.unionByName(by_subject).distinct().join(kb.claims, "id"))
    named = claims.select("query_id", F.explode(F.concat("supporting_evidence", "contradicting_evidence")).alias("id")).distinct()
    sources = claims.select("query_id", F.explode("source_ids").alias("id")).unionByName(relations.select("query_id", F.explode("source_ids").alias("id"))).distinct()
    mean = claims.groupBy("query_id").agg(F.avg("confidence").alias("mean"))
    # Ranks are worked out only for queries that name an entity and meet no claim.
    bare = cut_lineage(seeds.join(claims.select("query_id").distinct(), "query_id", "left_anti"))
    sure = queries.select("query_id").distinct().join(mean, "query_id", "left")
    if bare.isEmpty():
        sure = sure.withColumn("mass", F.lit(0.0))
    else:
        mass = personal_ranks_sum(edges, bare, kb.entities.select("id"), rounds)
        sure = sure.join(mass, "query_id", "left")
    confidence = sure.select("query_id", F.coalesce("mean", "mass", F.lit(0.0)).alias("confidence"))
    return Answers(retrieval, entities, relations, claims, named.join(kb.evidence, "id"), sources.join(kb.sources, "id"), ranked_paths(edges, linked), confidence)


def personal_ranks_sum(edges: DataFrame, seeds: DataFrame, verts: DataFrame, rounds: int) -> DataFrame:
    """query_id, mass: twice the personal ranks of all nodes, 1 at most."""
    return G.personal_ranks(edges, seeds, verts, rounds=rounds).groupBy("query_id").agg(F.least(F.lit(1.0), 2 * F.sum("rank")).alias("mass"))


def ranked_paths(edges: DataFrame, linked: DataFrame, longest: int = 4, each: int = 10, top: int = 10) -> DataFrame:
    """query_id, source, target, path, hops, weight: ways between the entities that a query names, from the one named first;
    `each` for a pair in the order of their nodes, distinct, and of all the `top` of greatest weight."""
    a, b = (linked.select("query_id", F.col("entity_id").alias(c), F.col("place").alias("p_" + c)) for c in ("source", "target"))
    pairs = a.join(b, "query_id").where("p_source < p_target").select("query_id", "source", "target")
    found = G.paths_between(edges, pairs.select("source", "target").distinct(), longest, each)
    rows = pairs.join(found, ["source", "target"]).dropDuplicates(["query_id", "path"])
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("weight"), "path"))
    return rows.withColumn("place", place).where(F.col("place") <= top).select("query_id", "source", "target", "path", "hops", "weight", "place")
