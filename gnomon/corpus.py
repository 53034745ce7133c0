"""A labelled corpus of seven documents with known names, relations, relevant documents and claims, for tests and quality figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The labelled corpus.
GAZETTEER = {
    "Company": ["Acme Corp", "Globex", "Initech", "Umbrella Corp", "Sterling Labs"],
    "Person": ["Ada Lovelace", "Alan Turing", "Grace Hopper", "Nikola Tesla", "Marie Curie"],
    "City": ["London", "Cambridge", "Menlo Park", "Manhattan", "Vienna"],
    "Technology": ["analytics software", "quantum computing", "database systems", "cryptography"],
    "Field": ["computing", "mathematics", "physics"],
}
DOCUMENTS = {
    "corpus-01": "Ada Lovelace works at Acme Corp. Acme Corp is located in London. Acme Corp develops analytics software.",
    "corpus-02": "Alan Turing works at Acme Corp. Acme Corp is headquartered in London. Alan Turing studied at Cambridge.",
    "corpus-03": "Grace Hopper works at Initech. Initech is located in Menlo Park. Grace Hopper is a type of person.",
    "corpus-04": "Nikola Tesla works at Umbrella Corp. Umbrella Corp is headquartered in Manhattan. Umbrella Corp develops quantum computing.",
    "corpus-05": "Ada Lovelace studied at Cambridge. Marie Curie studied at Vienna. Marie Curie is a type of person.",
    "corpus-06": "Acme Corp is a type of company. Sterling Labs is a type of company. Sterling Labs is located in London.",
    "corpus-07": "Grace Hopper is a type of person. Alan Turing is a type of person. Initech develops database systems.",
}
RELATIONS = [
    ("ada lovelace", "works_at", "acme corp"),
    ("alan turing", "works_at", "acme corp"),
    ("grace hopper", "works_at", "initech"),
    ("nikola tesla", "works_at", "umbrella corp"),
    ("acme corp", "located_in", "london"),
    ("acme corp", "headquartered_in", "london"),
    ("initech", "located_in", "menlo park"),
    ("umbrella corp", "headquartered_in", "manhattan"),
    ("ada lovelace", "studied_at", "cambridge"),
    ("alan turing", "studied_at", "cambridge"),
    ("marie curie", "studied_at", "vienna"),
    ("sterling labs", "located_in", "london"),
    ("acme corp", "develops", "analytics software"),
    ("umbrella corp", "develops", "quantum computing"),
    ("initech", "develops", "database systems"),
]
#: Query, relevant documents, entities and relations (their numbers above).
QUERIES = [
    ("who works at Acme Corp?", ["corpus-01", "corpus-02"], ["acme corp"], [0, 1]),
    ("where is Initech located?", ["corpus-03"], ["initech"], [6]),
    ("people who studied at Cambridge", ["corpus-02", "corpus-05"], ["cambridge"], [8, 9]),
    ("companies in London", ["corpus-01", "corpus-02", "corpus-06"], ["london"], [4, 5, 11]),
    ("what does Umbrella Corp develop?", ["corpus-04"], ["umbrella corp"], [13]),
]
CLAIMS = [
    ("Ada Lovelace works at Acme Corp", "Ada Lovelace", "works_at", "Acme Corp", True),
    ("Alan Turing works at Acme Corp", "Alan Turing", "works_at", "Acme Corp", True),
    ("Nikola Tesla works at Initech", "Nikola Tesla", "works_at", "Initech", False),
    ("Grace Hopper works at Umbrella Corp", "Grace Hopper", "works_at", "Umbrella Corp", False),
    ("Acme Corp is located in London", "Acme Corp", "located_in", "London", True),
    ("Umbrella Corp is located in Cambridge", "Umbrella Corp", "located_in", "Cambridge", False),
]


def sources(spark: SparkSession) -> DataFrame:
    rows = [(f"src-{ref}", ref, "text", ref, text) for ref, text in DOCUMENTS.items()]
    return spark.createDataFrame(rows, "id string, title string, kind string, reference string, payload string")


def raw_documents(spark: SparkSession) -> DataFrame:
    from gnomon.sources.adapters import read_sources

    return read_sources(sources(spark))


def queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q[0]) for i, q in enumerate(QUERIES)], "query_id int, text string")


def judgements(spark: SparkSession) -> DataFrame:
    """query_id, reference of each relevant document."""
    return spark.createDataFrame([(i, d) for i, q in enumerate(QUERIES) for d in q[1]], "query_id int, reference string")


def relevant_entities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, e) for i, q in enumerate(QUERIES) for e in q[2]], "query_id int, name string")


def relevant_relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *RELATIONS[n]) for i, q in enumerate(QUERIES) for n in q[3]], "query_id int, subject string, predicate string, object string")


def claims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CLAIMS)], "id int, text string, subject string, predicate string, object string, is_true boolean")


def knowledge_base(spark: SparkSession):
    from gnomon.operators.extraction import Gazetteer
    from gnomon.operators.ingestion import ingest

    return ingest(sources(spark).drop("payload"), raw_documents(spark), Gazetteer((n, k) for k, names in GAZETTEER.items() for n in names))


def quality(spark: SparkSession, methods: dict[str, tuple[str, ...]] | None = None, live: bool = True) -> DataFrame:
    """configuration, metric, value: recall, precision, reciprocal rank and nDCG at 5 of each configuration of methods.

    live: rank with features of the graph as it is now; else with none, as before anything is ingested.
    """
    from gnomon.operators import hybrid as H
    from gnomon.operators import retrieval as R

    kb = knowledge_base(spark)
    judged = judgements(spark).join(kb.documents.select(F.col("title").alias("reference"), F.col("id").alias("document_id")), "reference")
    relevant = judged.join(kb.chunks.select(F.col("id").alias("object_id"), "document_id"), "document_id").select("query_id", "object_id")
    features = H.cut_lineage(H.chunk_features(kb)) if live else H.no_features(spark)
    out = None
    for name, chosen in (methods or {"lexical": ("lexical",), "vector": ("vector",), "graph": ("graph",), "hybrid": H.METHODS}).items():
        found = H.retrieve(kb, queries(spark), 5, methods=chosen, features=features).withColumnRenamed("position", "rank")
        means = R.retrieval_metrics(found, relevant).agg(*[F.round(F.avg(c), 4).alias(c) for c in ("recall", "precision", "reciprocal_rank", "ndcg")])
        rows = means.select(F.lit(name).alias("configuration"), F.expr("stack(4, 'recall', recall, 'precision', precision, 'mrr', reciprocal_rank, 'ndcg', ndcg) as (metric, value)"))
        out = rows if out is None else out.unionByName(rows)
    return out


def graph_quality(spark: SparkSession) -> DataFrame:
    """metric, value: mean recall of entities and relations, and precision of evidence, of the answers to all queries."""
    from gnomon.operators import hybrid as H
    from gnomon.operators.knowledge import set_recall

    kb = knowledge_base(spark)
    found = H.answer(kb, queries(spark), chunks=False)
    name = lambda c: kb.entities.select(F.col("id").alias(c + "_id"), F.lower("name").alias(c))
    links = found.relations.join(name("subject"), "subject_id").join(name("object"), "object_id")
    good = judgements(spark).join(kb.documents.select(F.col("title").alias("reference"), F.col("id").alias("document_id")), "reference")
    evidence = found.evidence.select("query_id", "id", "document_id")
    mine = evidence.join(good, ["query_id", "document_id"]).select("query_id", "id")
    parts = [
        ("entity_recall", set_recall(found.entities.select("query_id", F.lower("name").alias("name")), relevant_entities(spark), ["name"]).select("recall")),
        ("relation_recall", set_recall(links, relevant_relations(spark), ["subject", "predicate", "object"]).select("recall")),
        ("evidence_precision", set_recall(evidence, mine, ["id"]).select("precision")),
    ]
    out = None
    for metric, rows in parts:
        one = rows.agg(F.round(F.avg(rows.columns[0]), 4).alias("value")).select(F.lit(metric).alias("metric"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def claim_quality(spark: SparkSession, as_of=None) -> DataFrame:
    """metric, value: each labelled claim takes the evidence of the relation that says the same, and is assessed; accuracy, error
    of calibration, and the share of supported claims whose chain of chunks, documents and sources is whole."""
    from gnomon.operators import knowledge as K

    kb = knowledge_base(spark)
    now = F.lit("2026-01-01T00:00:00Z") if as_of is None else as_of
    known = kb.entities.select("id", F.lower("name").alias("key"))
    rows = claims(spark).withColumnRenamed("id", "claim")
    rows = rows.join(known.select(F.col("id").alias("subject_id"), F.col("key").alias("s")), F.lower("subject") == F.col("s"), "left").join(known.select(F.col("id").alias("object_id"), F.col("key").alias("o")), F.lower("object") == F.col("o"), "left")
    rows = rows.join(kb.relations.select("subject_id", "predicate", "object_id", "supporting_evidence", "contradicting_evidence", "provenance", "source_ids"), ["subject_id", "predicate", "object_id"], "left")
    backed = rows.where("supporting_evidence is not null").select(F.col("claim").alias("id"), F.lit(0.5).alias("confidence"), "supporting_evidence", "contradicting_evidence", "provenance", "source_ids", now.alias("created_at"))
    state = K.assess(backed, kb.sources.withColumn("metadata", F.create_map().cast("map<string,string>")), now.cast("timestamp")).select(F.col("id").alias("claim"), F.col("confidence").alias("p"), F.col("state").isin("verified", "supported").alias("yes"))
    judged = rows.select("claim", "is_true").join(state, "claim", "left").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("yes", F.lit(False)).alias("yes"), F.col("is_true").cast("int").alias("label"))
    chain = backed.select("id", F.explode("provenance").alias("c")).join(kb.chunks.select(F.col("id").alias("c"), "document_id"), "c", "left").join(kb.documents.select(F.col("id").alias("document_id"), F.col("source_id").alias("d_source")), "document_id", "left")
    whole = chain.groupBy("id").agg((F.max("document_id").isNotNull() & F.max("d_source").isNotNull()).alias("ok"))
    parts = [("claim_accuracy", K.share_true(judged, F.col("yes") == (F.col("label") == 1))), ("calibration_error", K.calibration_error(judged.select("p", "label"))), ("provenance_correctness", K.share_true(whole, F.col("ok")))]
    out = None
    for metric, one in parts:
        one = one.select(F.lit(metric).alias("metric"), F.col(one.columns[0]).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
