"""Chunks of documents, and the entities and relations named in them.

Where a chunk ends, and which names match, depends on what was decided to the left of it, so both are worked out in
Arrow batches, one text at a time; everything that follows is rows and columns. Offsets are 0-based and half-open, in
characters; a relation's span is in its chunk, `at` tells where its chunk begins in the document.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gnomon.functions.storage import spread
from gnomon.functions.text import stable_id

MOST, OVERLAP = 800, 100
_BREAK = re.compile(r"[.!?]\s+|\n")
_SENTENCE = re.compile(r"[.!?]\s+")
_TOKEN = re.compile(r"[^\s,.;:()?!]+")
_ENTITY = "struct<start:int,end:int,name:string,entity_type:string,confidence:double>"
_RELATION = "struct<start:int,end:int,subject:string,predicate:string,object:string,confidence:double>"

#: Patterns of relations and their predicates, in the order in which they are tried.
PATTERNS = [
    (r"works?\s+at", "works_at"),
    (r"is?\s+the?\s+founder\s+of", "founded"),
    (r"founded", "founded"),
    (r"located\s+in", "located_in"),
    (r"is?\s+part\s+of", "part_of"),
    (r"headquartered\s+in", "headquartered_in"),
    (r"discovered\s+by", "discovered_by"),
    (r"developed\s+by", "developed_by"),
    (r"develops", "develops"),
    (r"caused\s+by", "caused_by"),
    (r"invented", "invented_by"),
    (r"studied\s+at", "studied_at"),
    (r"produced\s+by", "produced_by"),
    (r"is?\s+a?\s+type\s+of", "type_of"),
]


def cuts(text: str, most: int = MOST) -> list[tuple[int, int]]:
    """Pieces of a text without overlap: whole if it is short; else its paragraphs, long ones cut behind the last sentence
    or line that ends within `most` characters, or there."""
    if len(text) <= most:
        return [(0, len(text))]
    out, at = [], 0
    for paragraph in text.split("\n\n"):
        end = at + len(paragraph)
        if end - at <= most:
            out += [(at, end)] if end > at else []
        else:
            here = at
            while here < end:
                window = text[here : min(here + most, end)]
                last = max((m.end() for m in _BREAK.finditer(window)), default=0)
                out.append((here, here + (last or len(window))))
                here = out[-1][1]
        at = end + 2
    return out


def spans(text: str, most: int = MOST, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """cuts(), each but the first drawn back to `overlap` characters before the end of the one before."""
    found = cuts(text, most)
    return found[:1] + [(max(0, before[1] - overlap), end) for before, (_, end) in zip(found, found[1:])] if overlap else found


def chunk(docs: DataFrame, most: int = MOST, overlap: int = OVERLAP, ident: str = "id", text: str = "text") -> DataFrame:
    """id, document_id, index, start, end, text. An empty text is one empty chunk; a null text has none."""
    if most <= 0 or not 0 <= overlap < most:
        raise ValueError("overlap must be smaller than the size of a chunk")

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"start": a, "end": b} for a, b in spans(t, most, overlap)] for t in texts], dtype=object)

    rows = docs.select(F.col(ident).cast("string").alias("document_id"), F.col(text).alias("whole")).select("document_id", "whole", F.posexplode(found("whole")).alias("index", "s"))
    part = F.substring("whole", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return rows.select(stable_id("chunk", F.col("document_id"), F.col("index")).alias("id"), "document_id", "index", F.col("s.start").alias("start"), F.col("s.end").alias("end"), part.alias("text"))


class Gazetteer:
    """Names by their lower-case words; of a name with two types the first counts."""

    def __init__(self, names: Iterable[tuple[str, str]] = ()):
        self.types: dict[str, str] = {}
        self.widths: dict[str, list[int]] = {}
        for name, kind in names:
            self.add(name, kind)

    def add(self, name: str, kind: str) -> None:
        words = name.lower().split()
        if not words or " ".join(words) in self.types:
            return
        self.types[" ".join(words)] = kind
        widths = self.widths.setdefault(words[0], [])
        if len(words) not in widths:
            widths.append(len(words))
            widths.sort(reverse=True)

    def mentions(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, type), left to right, the longest name at each place, without overlap."""
        tokens = [(m.start(), m.end(), m.group().lower()) for m in _TOKEN.finditer(text)]
        out, i = [], 0
        while i < len(tokens):
            for width in self.widths.get(tokens[i][2], ()):
                kind = self.types.get(" ".join(t[2] for t in tokens[i : i + width])) if i + width <= len(tokens) else None
                if kind is not None:
                    out.append((tokens[i][0], tokens[i + width - 1][1], kind))
                    i += width - 1
                    break
            i += 1
        return out


def relations(text: str, entities: list[tuple[int, int, str]], patterns: list[tuple[re.Pattern, str]], strict: bool = False) -> list[tuple[int, int, int, int, str]]:
    """(start, end, subject's number, object's number, predicate) of each pattern between two entities.

    The subject is the last entity that ends before the pattern and begins in its sentence, the object the first one that
    begins behind it: anywhere to the end of the text, or with strict only in the sentence.
    """
    begins, ends = [e[0] for e in entities], [e[1] for e in entities]
    sentences = [0, *(m.end() for m in _SENTENCE.finditer(text))]
    out = []
    for pattern, predicate in patterns:
        for m in pattern.finditer(text):
            a, b = bisect_right(ends, m.start()) - 1, bisect_left(begins, m.end())
            sentence = bisect_right(sentences, m.start()) - 1
            stop = sentences[sentence + 1] if strict and sentence + 1 < len(sentences) else len(text)
            if a >= 0 and begins[a] >= sentences[sentence] and b < len(entities) and ends[b] <= stop and text[slice(*entities[a][:2])] != text[slice(*entities[b][:2])]:
                out.append((m.start(), m.end(), a, b, predicate))
    return out


def gazetteer_of(names: DataFrame, most: int = 1_000_000) -> Gazetteer:
    """A gazetteer from rows (name, entity_type, seq). It is sent to all executors, so more than `most` names are an error."""
    rows = names.orderBy("seq").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} names")
    return Gazetteer((r["name"], r["entity_type"]) for r in rows)


def extract(chunks: DataFrame, gazetteer: Gazetteer, patterns: list[tuple[str, str]] | None = None, strict: bool = False, text: str = "text") -> DataFrame:
    """Chunks with `entities` (start, end, name, entity_type, confidence) and `relations` (start, end, subject, predicate, object, confidence)."""
    compiled = [(re.compile(p, re.IGNORECASE), name) for p, name in (PATTERNS if patterns is None else patterns)]
    shared = chunks.sparkSession.sparkContext.broadcast(gazetteer)

    @F.pandas_udf(f"struct<entities:array<{_ENTITY}>,relations:array<{_RELATION}>>")
    def found(texts: pd.Series) -> pd.DataFrame:
        entities, links = [], []
        for t in texts:
            here = shared.value.mentions(t or "")
            entities.append([{"start": a, "end": b, "name": t[a:b], "entity_type": k, "confidence": 1.0} for a, b, k in here])
            links.append([{"start": a, "end": b, "subject": entities[-1][s]["name"], "predicate": p, "object": entities[-1][o]["name"], "confidence": 1.0} for a, b, s, o, p in relations(t or "", here, compiled, strict)])
        return pd.DataFrame({"entities": pd.Series(entities, dtype=object), "relations": pd.Series(links, dtype=object)})

    return spread(chunks).withColumn("found", found(F.col(text))).select(*chunks.columns, "found.entities", "found.relations")


def _number(value: object) -> float:
    number = float(value)
    if not 0 <= number <= 1:
        raise ValueError(f"confidence out of range: {number}")
    return number


def extract_with(chunks: DataFrame, entities: Callable[[str], list[dict]], relations: Callable[[str, list[dict]], list[dict]] | None = None, text: str = "text") -> DataFrame:
    """As extract(), by functions of the caller, which run in the executors; rows with a blank name are left out.

    Without a span, a mention's and a relation's start and end are null.
    """

    @F.pandas_udf(f"struct<entities:array<{_ENTITY}>,relations:array<{_RELATION}>>")
    def found(texts: pd.Series) -> pd.DataFrame:
        names, links = [], []
        for t in texts:
            here = [{"start": None, "end": None, "name": str(x.get("name", "")).strip(), "entity_type": str(x.get("entity_type", "unknown")), "confidence": _number(x.get("confidence", 1.0))} for x in entities(t or "")]
            here = [x for x in here if x["name"]]
            got = relations(t or "", [{k: x[k] for k in ("name", "entity_type", "confidence")} for x in here]) if relations else []
            rows = [{"start": None, "end": None, **{k: str(x.get(k, "")).strip() for k in ("subject", "predicate", "object")}, "confidence": _number(x.get("confidence", 1.0))} for x in got]
            names.append(here)
            links.append([x for x in rows if x["subject"] and x["predicate"] and x["object"]])
        return pd.DataFrame({"entities": pd.Series(names, dtype=object), "relations": pd.Series(links, dtype=object)})

    return chunks.withColumn("found", found(F.col(text))).select(*chunks.columns, "found.entities", "found.relations")


def mentions(extracted: DataFrame, ident: str = "id") -> DataFrame:
    """chunk_id, n (the place among the chunk's entities), start, end, name, entity_type, confidence."""
    rows = extracted.select(F.col(ident).alias("chunk_id"), *[c for c in ("document_id", "index") if c in extracted.columns], F.posexplode("entities").alias("n", "e"))
    return rows.select("chunk_id", *[c for c in ("document_id", "index") if c in extracted.columns], "n", "e.*")


def name_key(name: Column) -> Column:
    """What makes two names one entity: the words in lower case, without the marks that part tokens."""
    return F.array_join(F.regexp_extract_all(F.lower(name), F.lit(r"[^\s,.;:()?!]+"), F.lit(0)), " ")


def entities(found: DataFrame) -> DataFrame:
    """id, name, entity_type, canonical_name, aliases: one entity for each name key, called and typed as at its first
    mention in the order of document, chunk and place."""
    place = F.struct("document_id", "index", "n")
    one = found.withColumn("key", name_key(F.col("name"))).where("key <> ''").groupBy("key").agg(F.min_by("name", place).alias("name"), F.min_by("entity_type", place).alias("entity_type"))
    return one.select(stable_id("ent", F.col("key")).alias("id"), "name", "entity_type", F.col("name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"))
