"""A knowledge engine over tables in a folder: ingestion, retrieval, graph queries, analysis, claims, provenance and updates.

Tables are logs (see gnomon.sources.stores): writes append, reads take the last row of each key. Methods return DataFrames;
those that change something say so. A commit writes each table once; a reader sees a table's old or new state, never half.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.functions.storage import cut_lineage
from gnomon.functions.text import stable_id
from gnomon.operators import extraction as E
from gnomon.operators import graph as G
from gnomon.operators import hybrid as H
from gnomon.operators import ingestion as I
from gnomon.operators import knowledge as K
from gnomon.sources import adapters as A
from gnomon.sources import stores as S

_STRINGS = "array<string>"
SCHEMAS = {
    "sources": "id string, title string, kind string, reference string, metadata map<string,string>",
    "documents": "id string, source_id string, ordinal int, title string, content_type string, text string, raw string, metadata map<string,string>",
    "chunks": "id string, document_id string, source_id string, index int, start int, end int, text string",
    "entities": f"id string, name string, entity_type string, canonical_name string, aliases {_STRINGS}",
    "claims": f"id string, text string, subject string, predicate string, object string, confidence double, provenance {_STRINGS}, source_ids {_STRINGS}, supporting_evidence {_STRINGS}, contradicting_evidence {_STRINGS}, verification_state string, observed_at string, updated_at string, created_at string",
    "evidence": "id string, claim_id string, chunk_id string, document_id string, text string, role string, start int, end int, quality double",
    "relations": f"id string, subject_id string, predicate string, object_id string, confidence double, provenance {_STRINGS}, source_ids {_STRINGS}, supporting_evidence {_STRINGS}, contradicting_evidence {_STRINGS}, verification_state string",
    "embeddings": "object_id string, vector array<double>, metadata map<string,string>",
}
KEYS = {"embeddings": "object_id"}


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the columns of a schema; those it lacks are null."""
    columns = [c.strip().split(" ", 1) for c in _split(schema)]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in columns])


def _split(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def provenance(claims: DataFrame, evidence: DataFrame, chunks: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """claim_id, text, evidence_ids, chunk_ids, document_ids, source_ids, references: why each claim is believed.

    Lists keep the order of a claim's own lists; chunks that the base does not hold are listed, but lead to no document.
    """
    known = evidence.select(F.col("id").alias("e"))
    e = claims.select("id", F.posexplode("supporting_evidence").alias("n", "e")).join(known, "e", "left_semi").groupBy("id").agg(_ordered("n", "e").alias("evidence_ids"))
    c = claims.select("id", F.posexplode("provenance").alias("n", "c")).join(chunks.select(F.col("id").alias("c"), F.col("document_id").alias("d")), "c", "left").join(documents.select(F.col("id").alias("d"), F.col("source_id").alias("s")), "d", "left").join(sources.select(F.col("id").alias("s"), F.col("reference").alias("r")), "s", "left")
    c = c.groupBy("id").agg(_ordered("n", "c").alias("chunk_ids"), F.array_distinct(_ordered("n", "d")).alias("document_ids"), F.array_distinct(_ordered("n", "s")).alias("source_ids"), F.array_distinct(_ordered("n", "r")).alias("references"))
    none = F.array().cast(_STRINGS)
    rows = claims.select("id", "text").join(e, "id", "left").join(c, "id", "left")
    return rows.select(F.col("id").alias("claim_id"), "text", *[F.coalesce(n, none).alias(n) for n in ("evidence_ids", "chunk_ids", "document_ids", "source_ids", "references")])


def _ordered(place: str, value: str) -> Column:
    """Values in the order of their places, without nulls."""
    pairs = F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(place, F.col(value).alias("v")))))
    return F.transform(pairs, lambda s: s["v"])


def valid_chains(asked: DataFrame, chunks: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds valid to rows (source_id, document_id, chunk_id, source_reference): whether the chain is there and agrees."""
    chain = chunks.select(F.col("id").alias("chunk_id"), "document_id").join(documents.select(F.col("id").alias("document_id"), "source_id"), "document_id").join(sources.select(F.col("id").alias("source_id"), F.col("reference").alias("source_reference")), "source_id").distinct()
    return asked.join(chain.withColumn("valid", F.lit(True)), ["source_id", "document_id", "chunk_id", "source_reference"], "left").fillna(False, ["valid"])


#: What a record of an update must have, and what is said of one that has not.
_NEEDS = {
    "entities": (("id",), "entity without id rejected"),
    "relations": (("subject_id", "object_id"), "relation without subject/object rejected"),
    "claims": (("text",), "empty claim rejected"),
    "evidence": (("claim_id", "chunk_id"), "evidence without claim/chunk rejected"),
    "documents": ((), ""),
}


def checked_update(update: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """The records of an update that may be written, and a row (table, error, n) for those that may not."""
    good, bad = {}, None
    for table, rows in update.items():
        needs, error = _NEEDS[table]
        whole = F.lit(True)
        for name in needs:
            whole = whole & (F.coalesce(F.col(name), F.lit("")) != "")
        good[table] = rows.where(whole)
        if needs:
            one = rows.where(~whole).agg(F.count("*").alias("n")).where("n > 0").select(F.lit(table).alias("table"), F.lit(error).alias("error"), "n")
            bad = one if bad is None else bad.unionByName(one)
    return good, bad


@dataclass
class Receipt:
    accepted: int
    rejected: int
    errors: list[str]


class KnowledgeEngine:
    """An engine whose tables lie below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, gazetteer: E.Gazetteer | None = None, patterns: list[tuple[str, str]] | None = None, extractor=None, transport=None):
        self.spark, self.store = spark, S.Store(spark, folder)
        self.gazetteer, self.patterns, self.extractor, self.transport = gazetteer or E.Gazetteer(), patterns, extractor, transport

    def table(self, name: str) -> DataFrame:
        try:
            return shaped(self.store.state(name, KEYS.get(name, "id")), SCHEMAS[name])
        except KeyError:
            return self.spark.createDataFrame([], SCHEMAS[name])

    def base(self) -> I.KnowledgeBase:
        return I.KnowledgeBase(**{name: self.table(name) for name in I.TABLES})

    def save(self, name: str, rows: DataFrame) -> int:
        return self.store.save(name, shaped(rows, SCHEMAS[name]))

    # Ingestion.
    def ingest(self, sources: DataFrame, adapter: Column | None = None) -> dict[str, int]:
        """Ingests sources (id, title, kind, reference, payload), each by the adapter of its kind; returns how many rows each table gained."""
        return self._write(sources, A.read_sources(sources, adapter))

    def ingest_text(self, reference: str, text: str, title: str = "", kind: str = "text") -> dict[str, int]:
        ident = self.spark.range(1).select(stable_id("src", F.lit(reference))).first()[0]
        return self.ingest(self.spark.createDataFrame([(ident, title or reference, kind, reference, text)], "id string, title string, kind string, reference string, payload string"))

    def ingest_repository(self, folder: str, title: str) -> dict[str, int]:
        ident = self.spark.range(1).select(stable_id("src", F.lit(folder))).first()[0]
        rows = A.repository_sources(self.spark, folder, ident, title)
        return self._write(rows.select("id", "title", F.lit("repository").alias("kind"), "reference").distinct(), A.read_sources(rows))

    def _write(self, sources: DataFrame, raw: DataFrame) -> dict[str, int]:
        kb = I.ingest(sources.select("id", "title", "kind", "reference"), raw, self.gazetteer, self.patterns, extractor=self.extractor)
        out = {r["table"]: r["rows"] for r in kb.summary().collect()}
        old = self.table("relations")
        log = old.withColumn("seq", F.lit(0)).unionByName(kb.relations.select(old.columns).withColumn("seq", F.lit(1)))
        for name, rows in kb.tables().items():
            if name == "entities":
                rows = rows.join(self.table("entities").select("id"), "id", "left_anti")
            self.save(name, S.merge_relations(log) if name == "relations" else rows)
        return out

    # Questions.
    def retrieve(self, queries: DataFrame, top: int = 10, wanted: dict[str, str] | None = None, methods: tuple[str, ...] = H.METHODS, trace: H.Trace | None = None) -> DataFrame:
        return H.retrieve(self.base(), queries, top, wanted, methods, trace=trace)

    def answer(self, queries: DataFrame, top: int = 8, depth: int = 2, chunks: bool = True) -> H.Answers:
        return H.answer(self.base(), queries, top, depth, chunks=chunks)

    def query_graph(self, predicate: str | None = None, subject: str | None = None, obj: str | None = None, entity_type: str | None = None, limit: int = 100) -> DataFrame:
        """Relations that agree with all that is given, the first `limit` by id; of these, with a type, those that touch an entity of it."""
        rows = self.table("relations")
        for column, value in (("predicate", predicate), ("subject_id", subject), ("object_id", obj)):
            rows = rows if not value else rows.where(F.col(column) == value)
        rows = rows.orderBy("id").limit(limit)
        if entity_type is None:
            return rows
        return of_type(rows, self.table("entities"), entity_type)

    def edges(self) -> DataFrame:
        return G.edges_of(self.table("relations"))

    def subgraph(self, ids: list[str], depth: int = 1, most_nodes: int = 100, most_edges: int = 500) -> tuple[DataFrame, DataFrame]:
        """Entities and relations around some entities; unknown ids have no record."""
        seeds = self.spark.createDataFrame([(0, i) for i in ids], "query_id int, id string")
        nodes, met = G.walk(self.edges(), seeds, depth, most_nodes, most_edges)
        return self.table("entities").join(nodes.select("id"), "id", "left_semi"), met.drop("query_id")

    def neighbors(self, ids: list[str], direction: str = "out") -> DataFrame:
        return G.neighbors(self.edges(), self.spark.createDataFrame([(i,) for i in ids], "id string"), direction)

    def paths(self, source: str, target: str, longest: int = 4, most: int = 20) -> DataFrame:
        return G.paths_between(self.edges(), self.spark.createDataFrame([(source, target)], "source string, target string"), longest, most).orderBy(F.desc("weight"), "path")

    def statistics(self) -> DataFrame:
        return G.full_statistics(self.edges(), self.table("entities"))

    def centrality(self, kind: str = "pagerank", seeds: list[str] | None = None) -> DataFrame:
        """By pagerank (personal with seeds), degree or betweenness."""
        edges, verts = self.edges(), self.table("entities").select("id")
        if kind == "degree":
            return G.degree_centrality(edges)
        if kind == "betweenness":
            return G.betweenness(edges, verts)
        start = None if seeds is None else self.spark.createDataFrame([(i,) for i in seeds], "id string")
        return G.pagerank(edges, 100, seeds=start, tolerance=1e-6, verts=verts)

    def communities(self) -> DataFrame:
        return G.communities(self.edges(), self.table("entities").select("id"))

    # Analysis.
    def contradictions(self) -> DataFrame:
        count = F.size("supporting_evidence").alias("evidence")
        claims = self.table("claims").select("id", "subject", "predicate", "object", "confidence", count, F.col("verification_state").alias("state"))
        return K.contradictions(claims, self.table("relations").select("id", F.col("subject_id").alias("subject"), "predicate", F.col("object_id").alias("object"), "confidence", count))

    def gaps(self) -> DataFrame:
        ranks = self.centrality()
        return K.find_gaps(self.table("claims"), self.table("relations"), self.table("entities"), self.contradictions(), ranks, G.missing_relations(self.edges()))

    def score_investigations(self, top: int = 20, by: str = "gain") -> DataFrame:
        return K.score_gaps(self.gaps(), by, top=top)

    # Claims.
    def propose_claims(self, claims: DataFrame) -> DataFrame:
        """Writes claims (text, subject, predicate, object, confidence, source_ref, observed_at) as unverified; sources are found by their
        reference or made. Returns the records."""
        refs = claims.where(F.coalesce("source_ref", F.lit("")) != "").select(F.col("source_ref").alias("reference")).distinct()
        known = self.table("sources").groupBy("reference").agg(F.min("id").alias("id"))
        found = cut_lineage(refs.join(known, "reference", "left").select("reference", F.coalesce("id", stable_id("src", F.col("reference"))).alias("id"), F.col("id").isNull().alias("new")))
        self.save("sources", found.where("new").select("id", F.col("reference").alias("title"), F.lit("other").alias("kind"), "reference"))
        none = F.array().cast(_STRINGS)
        rows = claims.join(found.select(F.col("reference").alias("source_ref"), F.col("id").alias("s")), "source_ref", "left")
        checked = F.when(F.col("confidence").between(0, 1), F.col("confidence")).otherwise(F.raise_error(F.lit("confidence out of range")))
        rows = rows.select(stable_id("claim", F.col("subject"), F.col("predicate"), F.col("object"), F.coalesce("s", F.lit(""))).alias("id"), "text", "subject", "predicate", "object", checked.alias("confidence"), none.alias("provenance"), F.array_compact(F.array("s")).alias("source_ids"), none.alias("supporting_evidence"), none.alias("contradicting_evidence"), F.lit("unverified").alias("verification_state"), F.col("observed_at") if "observed_at" in claims.columns else F.lit(None).cast("string").alias("observed_at"))
        rows = cut_lineage(shaped(rows, SCHEMAS["claims"]))
        self.store.save("claims", rows)
        return rows

    def assess_claims(self, as_of: Column, ids: list[str] | None = None, commit: bool = False) -> DataFrame:
        """Confidence, uncertainty and state of claims. Only with commit are they written back, which changes what a later call finds."""
        claims = self.table("claims")
        claims = claims if ids is None else claims.where(F.col("id").isin(*ids))
        found = K.assess(claims, self.table("sources"), as_of)
        if commit:
            found = cut_lineage(found)
            new = claims.drop("confidence", "verification_state").join(found.select("id", "confidence", F.col("state").alias("verification_state")), "id")
            self.save("claims", new)
        return found

    def provenance(self, ids: list[str]) -> DataFrame:
        claims = self.table("claims").where(F.col("id").isin(*ids))
        if claims.count() < len(set(ids)):
            raise KeyError("unknown claim")
        return provenance(claims, self.table("evidence"), self.table("chunks"), self.table("documents"), self.table("sources"))

    def validate_chain(self, source_id: str, document_id: str, chunk_id: str, reference: str) -> bool:
        asked = self.spark.createDataFrame([(source_id, document_id, chunk_id, reference)], "source_id string, document_id string, chunk_id string, source_reference string")
        return valid_chains(asked, self.table("chunks"), self.table("documents"), self.table("sources")).first()["valid"]

    def commit(self, update: dict[str, DataFrame]) -> Receipt:
        """Writes what an update may write: entities, relations (merged with those of equal ends), claims, evidence, documents."""
        good, bad = checked_update({k: cut_lineage(v) for k, v in update.items()})
        accepted = 0
        for table, rows in good.items():
            accepted += rows.count()
            if table == "relations":
                rows = shaped(rows, SCHEMAS[table])
                old = self.table("relations").join(rows.select("subject_id", "predicate", "object_id"), ["subject_id", "predicate", "object_id"], "left_semi")
                rows = S.merge_relations(old.select(rows.columns).withColumn("seq", F.lit(0)).unionByName(rows.withColumn("seq", F.lit(1))))
            self.save(table, rows)
        errors = [] if bad is None else bad.collect()
        return Receipt(accepted, sum(r["n"] for r in errors), [r["error"] for r in errors for _ in range(r["n"])])

    def remove_entities(self, ids: list[str]) -> int:
        """Deletes entities and all relations that touch one; returns how many entities there were."""
        gone = self.spark.createDataFrame([(i,) for i in ids], "id string")
        touched = self.table("relations").where(F.col("subject_id").isin(*ids) | F.col("object_id").isin(*ids)).select("id")
        if self.store.versions("relations"):
            self.store.delete("relations", touched)
        return self.store.delete("entities", gone)

    # Whole tables.
    def healthcheck(self) -> DataFrame:
        return S.healthcheck({n: self.table(n) for n in I.TABLES})

    def save_snapshot(self, folder: str) -> None:
        S.save_snapshot({n: self.table(n) for n in I.TABLES}, folder)

    def load_snapshot(self, folder: str) -> None:
        """Writes a snapshot's tables over the present ones, row by row."""
        for name, rows in S.load_snapshot(self.spark, folder).items():
            self.save(name, rows)

    def ask_model(self, prompts: list[str], limit: int = 1) -> DataFrame:
        """What the engine's transport says to prompts, as output of a tool."""
        if self.transport is None:
            raise ValueError("no transport")
        rows = self.spark.createDataFrame([(p,) for p in prompts], "prompt string")
        return A.tool_output(A.query_model(rows, self.transport, limit), "model")


def of_type(relations: DataFrame, entities: DataFrame, entity_type: str) -> DataFrame:
    """Relations that touch an entity of a type."""
    ids = entities.where(F.col("entity_type") == entity_type).select("id").distinct()
    ends = relations.select("id", F.explode(F.array("subject_id", "object_id")).alias("e")).join(ids.withColumnRenamed("id", "e"), "e", "left_semi")
    return relations.join(ends.select("id"), "id", "left_semi")


def create_engine(spark: SparkSession, folder: str, gazetteer: dict[str, list[str]] | None = None, **options) -> KnowledgeEngine:
    return KnowledgeEngine(spark, folder, E.Gazetteer((n, k) for k, names in (gazetteer or {}).items() for n in names), **options)


__all__ = ["KnowledgeEngine", "Receipt", "checked_update", "create_engine", "provenance", "valid_chains"]
