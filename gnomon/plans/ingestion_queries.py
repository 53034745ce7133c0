"""Queries of sources, chunks, extraction and the labelled corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from gnomon import corpus
from gnomon.functions import text as X
from gnomon.functions.text import normalize_text
from gnomon.operators import extraction as E
from gnomon.operators import hybrid as H
from gnomon.operators import retrieval as R
from gnomon.operators.knowledge import last_seen
from gnomon.plans.registry import query
from gnomon.sources import adapters as A

_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


def _sources(t, payload):
    return t("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.lit("text").alias("kind"), F.col("source").alias("reference"), payload.alias("payload"))


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS source_id, CASE WHEN source = '' THEN 'untitled' ELSE source END AS title, {_NORMAL.format("text")} AS text FROM documents""")
def text_documents(t):
    return A.text_documents(_sources(t, F.col("text").cast("binary"))).select("source_id", "title", "text")


@query(f"""WITH p AS (SELECT doc_id, source, 'about ' || lang || chr(10) || '# ' || doc_id || ' ' || chr(10) || text || chr(10) || '# ' || chr(10) || '# end' AS payload FROM documents),
l AS (SELECT doc_id, source, unnest(string_split(payload, chr(10))) AS line, unnest(range(len(string_split(payload, chr(10))))) AS i FROM p),
h AS (SELECT *, starts_with(line, '# ') AS head, sum(CAST(starts_with(line, '# ') AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM l),
s AS (SELECT doc_id, source, sec, coalesce(max(CASE WHEN head THEN trim(substr(line, 3)) END), '') AS heading, string_agg(line, chr(10) ORDER BY i) FILTER (NOT head) AS body FROM h GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS INTEGER) AS ordinal FROM s WHERE heading <> '' OR body IS NOT NULL)
SELECT CAST(doc_id AS VARCHAR) AS source_id, ordinal, CASE WHEN heading = '' THEN source || ' #' || (ordinal + 1) ELSE heading END AS title, heading, {_NORMAL.format("coalesce(body, '')")} AS text FROM k""")
def markdown_sections(t):
    payload = F.concat(F.lit("about "), "lang", F.lit("\n# "), F.col("doc_id").cast("string"), F.lit(" \n"), "text", F.lit("\n# \n# end"))
    return A.markdown_documents(_sources(t, payload)).select("source_id", "ordinal", "title", F.col("metadata")["heading"].alias("heading"), "text")


@query("""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events)
SELECT event_id || 'x' AS source_id, 0 AS ordinal, 'e #1' AS title, 'a.b: ' || k || chr(10) || 'c: 1' || chr(10) || 'c[1].d: ' || event_type || chr(10) || 'n: None' AS text FROM e
UNION ALL SELECT event_id || 'x', 1, 'e #3', 'z: True' FROM e UNION ALL SELECT event_id || 'y', 0, 'document', 'value: ' || k FROM e UNION ALL SELECT event_id || 'z', 0, 'untitled', 'not {json ' || k FROM e""")
def json_documents(t):
    k, ident = F.from_json("props", "k bigint")["k"].cast("string"), F.col("event_id").cast("string")
    listed = F.concat(F.lit('[{"a": {"b": '), k, F.lit('}, "c": [1, {"d": "'), "event_type", F.lit('"}], "n": null}, 5, {"z": true}]'))
    parts = F.array(*[F.struct(F.concat(ident, F.lit(s)).alias("id"), F.lit(title).alias("title"), payload.alias("payload")) for s, title, payload in (("x", "e", listed), ("y", "", k), ("z", "", F.concat(F.lit("not {json "), k)))])
    rows = t("events").select(F.inline(parts)).withColumn("reference", F.lit("events"))
    return A.json_documents(rows).select("source_id", "ordinal", "title", "text")


_CUTS = r"""c AS (SELECT doc_id, text, 0 AS start, CASE WHEN length(text) <= 800 THEN length(text) ELSE 0 + w END AS stop FROM (SELECT doc_id, text, CASE WHEN greatest(length(regexp_extract(substr(text, 1, 800), '(?s)^.*[.!?]\s+')), length(regexp_extract(substr(text, 1, 800), '(?s)^.*\n'))) > 0
 THEN greatest(length(regexp_extract(substr(text, 1, 800), '(?s)^.*[.!?]\s+')), length(regexp_extract(substr(text, 1, 800), '(?s)^.*\n'))) ELSE 800 END AS w FROM documents)
UNION ALL SELECT doc_id, text, stop, stop + CASE WHEN b > 0 THEN b ELSE length(v) END FROM (SELECT doc_id, text, stop, v, greatest(length(regexp_extract(v, '(?s)^.*[.!?]\s+')), length(regexp_extract(v, '(?s)^.*\n'))) AS b
 FROM (SELECT doc_id, text, stop, substr(text, stop + 1, 800) AS v FROM c WHERE stop < length(text))))"""


@query(f"""WITH RECURSIVE {_CUTS}, n AS (SELECT doc_id, text, start, stop, row_number() OVER p - 1 AS i, coalesce(greatest(0, lag(stop) OVER p - 100), start) AS begin FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY start))
SELECT 'chunk_' || substr(sha256(doc_id || chr(31) || i), 1, 16) AS id, CAST(doc_id AS VARCHAR) AS document_id, CAST(i AS INTEGER) AS index, CAST(begin AS INTEGER) AS start, CAST(stop AS INTEGER) AS end, substr(text, begin + 1, stop - begin) AS text FROM n""")
def chunk_spans(t):
    return E.chunk(t("documents"), ident="doc_id")


_WORDS = r"regexp_extract_all(lower(text), '[^\s,.;:()?!]+')"
_NAMES = f"g AS (SELECT DISTINCT w AS key, CASE WHEN length(w) % 2 = 0 THEN 'Even' ELSE 'Odd' END AS kind FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) WHERE length(w) >= 6)"


def _gazetteer(t):
    words = t("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\s,.;:()?!]+"), F.lit(0))).alias("name")).where("length(name) >= 6").distinct()
    return E.gazetteer_of(words.withColumn("entity_type", F.when(F.length("name") % 2 == 0, "Even").otherwise("Odd")).withColumn("seq", F.col("name")))


def _extracted(t):
    docs = t("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("document_id"), F.lit(0).alias("index"), "text")
    return E.extract(docs, _gazetteer(t), [])


@query(f"""WITH {_NAMES}, m AS (SELECT doc_id, w FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) JOIN g ON w = key) SELECT CAST(doc_id AS VARCHAR) AS chunk_id, w AS name, kind AS entity_type, count(*) AS mentions FROM m JOIN g ON w = key GROUP BY ALL""")
def gazetteer_mentions(t):
    return E.mentions(_extracted(t)).groupBy("chunk_id", F.lower("name").alias("name"), "entity_type").agg(F.count("*").alias("mentions"))


@query(rf"""WITH {_NAMES}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\s,.;:()?!]+')) AS name, unnest(range(len(regexp_extract_all(text, '[^\s,.;:()?!]+')))) AS i FROM documents)
SELECT 'ent_' || substr(sha256(key), 1, 16) AS id, arg_min(name, (doc_id, i)) AS name, kind AS entity_type FROM m JOIN g ON lower(name) = key GROUP BY key, kind""")
def entity_upsert(t):
    return E.entities(E.mentions(_extracted(t))).select("id", "name", "entity_type")


# The labelled corpus: what is extracted from it, and how well queries are answered.
_EXTRA = [("acme corp", "type_of", "sterling labs"), ("grace hopper", "type_of", "alan turing"), ("alan turing", "type_of", "initech")]


def _values(rows) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows)


@query(f"SELECT * FROM (VALUES {_values([*corpus.RELATIONS, *_EXTRA])}) v(subject, predicate, object)")
def corpus_relations(t):
    return corpus.knowledge_base(t.spark).claims.select(F.lower("subject").alias("subject"), "predicate", F.lower("object").alias("object"))


@query(f"SELECT * FROM (VALUES {_values([('documents', 7), ('chunks', 7), ('entities', 17), ('claims', 18), ('evidence', 18), ('relations', 18), ('embeddings', 7)])}) v(\"table\", n)")
def corpus_summary(t):
    return corpus.knowledge_base(t.spark).summary().select("table", F.col("rows").cast("int").alias("n"))


@query(f"SELECT configuration, metric, CAST(value AS DOUBLE) AS value FROM (VALUES {_values([('lexical', 'mrr', 1.0), ('lexical', 'ndcg', 1.0), ('lexical', 'precision', 0.37), ('lexical', 'recall', 1.0), ('vector', 'mrr', 1.0), ('vector', 'ndcg', 0.984), ('vector', 'precision', 0.36), ('vector', 'recall', 1.0)])}) v(configuration, metric, value)")
def corpus_quality(t):
    """Lexical and vector retrieval without features from the graph, as the published figures have it."""
    got = corpus.quality(t.spark, {"lexical": ("lexical",), "vector": ("vector",)}, live=False)
    return got.select("configuration", "metric", F.round("value", 3).alias("value"))


@query("SELECT * FROM (VALUES (0, 0, 'Acme Corp'), (1, 0, 'Initech'), (2, 0, 'Cambridge'), (3, 0, 'London'), (4, 0, 'Umbrella Corp')) v(query_id, place, name)")
def corpus_links(t):
    kb = corpus.knowledge_base(t.spark)
    return H.link(corpus.queries(t.spark), kb.entities).join(kb.entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").select("query_id", "place", "name")


@query(f"""WITH a AS (SELECT item_id, {_NORMAL.format("text")} AS text FROM benchmark), c AS (SELECT text AS prompt, item_id FROM a WHERE item_id % 2 = 0)
SELECT a.item_id, CASE WHEN c.item_id IS NULL THEN 'unknown' ELSE 'answer ' || c.item_id END AS answer FROM a LEFT JOIN c ON prompt = text""")
def llm_lookup(t):
    b = t("benchmark").select("item_id", normalize_text(F.col("text")).alias("prompt"))
    answers = b.where("item_id % 2 = 0").select("prompt", F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("answer"), F.col("item_id").alias("seq"))
    return A.answer_prompts(b, answers, "unknown").select("item_id", "answer")


# Scalars.
@query("SELECT doc_id, substr(text, 11, 20) AS slice, 'emb_' || substr(sha256(doc_id || chr(31) || 'm' || chr(31) || '1'), 1, 16) AS embedding_id FROM documents")
def text_scalars(t):
    doc = F.col("doc_id").cast("string")
    return t("documents").select("doc_id", X.span_slice(F.col("text"), F.lit(10), F.lit(30)).alias("slice"), X.embedding_id(doc, F.lit("m"), F.lit("1")).alias("embedding_id"))


@query("""WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text, event_id % 4 AS n, date_trunc('second', ts) AS s FROM events)
SELECT event_id, CASE n WHEN 0 THEN s WHEN 1 THEN s WHEN 2 THEN date_trunc('day', s) END AS seen, text FROM e""")
def time_scalars(t):
    """Times of three forms, and one that is none."""
    e, n = t("events"), F.col("event_id") % 4
    ts = F.col("ts").cast("timestamp")
    form = F.when(n == 0, X.time_text(ts)).when(n == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(n == 2, F.date_format(ts, "yyyy-MM-dd")).otherwise("yesterday")
    return e.select("event_id", last_seen(F.lit(None).cast("string"), form, F.lit("never")).cast("timestamp_ntz").alias("seen"), X.time_text(X.time_of(X.time_text(ts))).alias("text"))


_DENSE = """WITH w AS (SELECT item_id, unnest(list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda x: lower(x))) AS t FROM benchmark),
s AS (SELECT item_id, CAST(('0x' || substr(md5(t), 7, 2) || substr(md5(t), 5, 2) || substr(md5(t), 3, 2) || substr(md5(t), 1, 2)) AS BIGINT) % 100 AS dim, sum(CASE WHEN CAST(('0x' || substr(md5(t), 9, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS s FROM w GROUP BY ALL)"""


@query(f"{_DENSE} SELECT item_id AS object_id, CAST(dim AS INTEGER) AS dim, round(s / sqrt(sum(s * s) OVER (PARTITION BY item_id)), 6) AS weight FROM s WHERE s <> 0")
def embedding_batch(t):
    rows = H.embedding_records(t("benchmark").select(F.col("item_id").alias("id"), "text"), dims=100)
    return rows.select("object_id", F.posexplode("vector").alias("dim", "w")).where("w <> 0").select("object_id", "dim", F.round("w", 6).alias("weight"))


@query("""WITH m AS (SELECT vec_id, embedding FROM embeddings WHERE label = 3), s AS (SELECT q.vec_id AS query_id, m.vec_id AS object_id, round(coalesce(list_cosine_similarity(m.embedding::DOUBLE[], q.embedding::DOUBLE[]), 0), 6) AS score FROM m, embeddings q WHERE q.vec_id % 50 = 0)
SELECT query_id, object_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, object_id) AS INTEGER) AS rank, score FROM s QUALIFY rank <= 5""")
def vector_topk_filtered(t):
    """By cosine among the vectors of one label: the filter comes before the scores."""
    v = t("embeddings")
    records = v.select(F.col("vec_id").alias("object_id"), F.col("embedding").cast("array<double>").alias("vector"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    mine = H.matching(records, {"label": "3"}).select(F.col("object_id").alias("vec_id"), F.col("vector").alias("embedding"))
    found = R.cosine_top(mine, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q")), 5)
    return found.select("query_id", F.col("vec_id").alias("object_id"), F.col("rank").cast("int"), "score")


@query("""WITH w AS (SELECT o_orderkey % 40 AS query_id, o_custkey AS object_id, row_number() OVER (PARTITION BY o_orderkey % 40 ORDER BY o_totalprice DESC, o_custkey, o_orderkey) AS rank FROM orders), k AS (SELECT * FROM w WHERE rank <= 20),
f AS (SELECT query_id, object_id, sum(CASE WHEN rank % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0 END / (59 + rank)) AS s FROM k GROUP BY ALL),
z AS (SELECT *, least(1, s * 60) + 0.4::DOUBLE * least(1, (object_id % 13) / 10.0::DOUBLE) + 0.2::DOUBLE * least(1, (object_id % 7) / 10.0::DOUBLE) + 0.3::DOUBLE * (object_id % 5) / 5.0::DOUBLE + 0.1::DOUBLE * least(1, object_id % 3) AS r FROM f)
SELECT query_id, object_id, round(s, 9) AS fused_score, round(r, 9) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(r, 9) DESC, round(s, 12) DESC, object_id) AS INTEGER) AS position FROM z""")
def fused_and_reranked(t):
    """Weighted fusion of two methods' rankings, and the order that features give it."""
    from pyspark.sql import Window as W

    q = F.col("o_orderkey") % 40
    ranked = t("orders").select(q.alias("query_id"), F.col("o_custkey").alias("object_id"), F.row_number().over(W.partitionBy(q).orderBy(F.desc("o_totalprice"), "o_custkey", "o_orderkey")).alias("rank")).where("rank <= 20")
    ranked = ranked.withColumn("method", F.when(F.col("rank") % 2 == 0, "even").otherwise("odd"))
    fused = R.reciprocal_rank_fusion(ranked, weights={"even": 2.0}, contributions=True).withColumn("fused_score", F.col("score"))
    i = F.col("object_id")
    rows = fused.withColumns({"evidence_count": (i % 13).cast("double"), "claim_count": (i % 7).cast("double"), "entity_centrality": (i % 5) / 5.0, "source_diversity": (i % 3).cast("double")})
    return H.rerank(rows).select("query_id", "object_id", F.round("fused_score", 9).alias("fused_score"), "rerank_score", "position")
