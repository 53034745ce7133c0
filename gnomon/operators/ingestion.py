"""From raw documents to a knowledge base: documents, chunks, entities, claims, evidence, relations and embeddings.

Extraction runs once over the chunks and is written to the shared folder; every table is a projection of it. All ids are
hashes of content, so that ingesting the same documents again gives the same rows, and a lost executor changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.functions.storage import cut_lineage
from gnomon.functions.text import clamp, normalize_text, stable_id
from gnomon.operators import extraction as E
from gnomon.operators.retrieval import embed
from gnomon.sources.stores import merge_relations

TABLES = ("sources", "documents", "chunks", "entities", "claims", "evidence", "relations", "embeddings")


@dataclass
class KnowledgeBase:
    """Tables of a knowledge base, as DataFrames."""

    sources: DataFrame
    documents: DataFrame
    chunks: DataFrame
    entities: DataFrame
    claims: DataFrame
    evidence: DataFrame
    relations: DataFrame
    embeddings: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}

    def summary(self) -> DataFrame:
        """table, rows, of all tables but the sources."""
        from gnomon.sources.stores import healthcheck

        return healthcheck({k: v for k, v in self.tables().items() if k != "sources"})


def documents_of(raw: DataFrame) -> DataFrame:
    """Documents from raw ones, with normal white space: id, source_id, ordinal, title, content_type, text, raw, metadata."""
    path = F.coalesce(F.col("metadata")["path"], F.lit(""))
    ident = stable_id("doc", F.col("source_id"), path, F.col("ordinal"), F.col("title"))
    return raw.select(ident.alias("id"), "source_id", "ordinal", "title", "content_type", normalize_text(F.col("text")).alias("text"), F.col("text").alias("raw"), "metadata")


def ingest(sources: DataFrame, raw: DataFrame, gazetteer: E.Gazetteer, patterns: list[tuple[str, str]] | None = None, most: int = E.MOST, overlap: int = E.OVERLAP, strict: bool = False, extractor=None) -> KnowledgeBase:
    """Sources (id, title, kind, reference) and their raw documents as a knowledge base.

    extractor: a function from chunks to chunks with entities and relations, in the place of gazetteer and patterns.
    """
    documents = cut_lineage(documents_of(raw))
    chunks = E.chunk(documents, most, overlap)
    chunks = chunks.join(documents.select(F.col("id").alias("document_id"), "source_id"), "document_id")
    found = cut_lineage(extractor(chunks) if extractor else E.extract(chunks, gazetteer, patterns, strict))
    entities = cut_lineage(E.entities(E.mentions(found)))
    ent = lambda c: stable_id("ent", E.name_key(F.col(c)))

    # Claim, evidence and relation of each match, in the order of document, chunk and match.
    links = found.select("document_id", "source_id", F.col("id").alias("chunk_id"), "index", F.col("text").alias("chunk"), F.posexplode("relations").alias("n", "r")).select("*", "r.*").drop("r")
    named = F.concat_ws("\x1f", "chunk_id", "n", "subject", "predicate", "object")
    whole = F.when(F.col("start").isNull(), F.col("chunk")).otherwise(F.substring("chunk", F.col("start") + 1, F.col("end") - F.col("start")))
    links = links.select("*", stable_id("claim", named).alias("claim_id"), stable_id("ev", named).alias("evidence_id"), stable_id("rel", named).alias("relation_id"), whole.alias("quote"), ent("subject").alias("subject_id"), ent("object").alias("object_id"))
    known = lambda c: entities.select(F.col("id").alias(c))
    links = cut_lineage(links.join(known("subject_id"), "subject_id", "left_semi").join(known("object_id"), "object_id", "left_semi"))

    one = lambda c: F.array(F.col(c))
    none = F.array().cast("array<string>")
    lists = [one("chunk_id").alias("provenance"), one("source_id").alias("source_ids"), one("evidence_id").alias("supporting_evidence"), none.alias("contradicting_evidence")]
    state = F.lit("unverified").alias("verification_state")
    claims = links.select(F.col("claim_id").alias("id"), F.concat_ws(" ", "subject", "predicate", "object").alias("text"), "subject", "predicate", "object", "confidence", *lists, state)
    evidence = links.select(F.col("evidence_id").alias("id"), "claim_id", "chunk_id", "document_id", F.col("quote").alias("text"), F.lit("support").alias("role"), "start", "end", clamp(F.col("confidence")).alias("quality"))
    log = links.select(F.col("relation_id").alias("id"), "subject_id", "predicate", "object_id", "confidence", *lists, state, F.struct("document_id", "index", "n").alias("seq"))
    relations = cut_lineage(merge_relations(log))
    embeddings = embed(found.select("id", "text"), "id").join(chunks.select("id", "document_id", "source_id"), "id").select(F.col("id").alias("object_id"), "vector", F.create_map(F.lit("chunk_id"), "id", F.lit("document_id"), "document_id", F.lit("source_id"), "source_id").alias("metadata"))
    return KnowledgeBase(sources, documents, found.select("id", "document_id", "source_id", "index", "start", "end", "text"), entities, claims, evidence, relations, embeddings)
