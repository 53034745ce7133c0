"""Sources, chunks, names and relations against small values and plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gnomon import corpus
from gnomon.operators import extraction as E
from gnomon.sources import adapters as A

SOURCE = "id string, title string, kind string, reference string, payload string"


def docs(df):
    return [(r["source_id"], r["ordinal"], r["title"], r["text"]) for r in df.orderBy("source_id", "ordinal").collect()]


def test_adapters(spark):
    rows = [("a", "", "text", "r", " x \t y\r\n\n\n\nz "), ("b", "T", "markdown", "r", "intro\n# One\nbody\n## sub\n# \n# Two"), ("c", "T", "markdown", "r", ""), ("d", "T", "json", "r", '[{"k": {"m": 1}, "l": [1, {"z": true}]}, 7, {"q": null}]'), ("e", "", "json", "r", "5"), ("f", "", "json", "r", "{bad"), ("g", "T", "web", "r", None)]
    got = docs(A.read_sources(spark.createDataFrame(rows, SOURCE)))
    assert got == [
        ("a", 0, "untitled", "x y\n\nz"),
        ("b", 0, "T #1", "intro"), ("b", 1, "One", "body\n## sub"), ("b", 2, "Two", ""),
        ("c", 0, "T", ""),
        ("d", 0, "T #1", "k.m: 1\nl: 1\nl[1].z: True"), ("d", 1, "T #3", "q: None"),
        ("e", 0, "document", "value: 5"), ("f", 0, "untitled", "{bad"), ("g", 0, "T", ""),
    ]


def test_repository(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.md").write_text("# H\ntext")
    (tmp_path / "sub" / "a.JSON").write_text('{"a": 1}')
    (tmp_path / "c.txt").write_text("plain")
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "e.py").write_text("no")
    got = {(r["metadata"]["path"], r["content_type"], r["text"]) for r in A.repository_documents(spark, f"file://{tmp_path}", "s", "T").collect()}
    assert got == {("b.md", "markdown", "text"), ("sub/a.JSON", "json", "a: 1"), ("c.txt", "text", "plain")}


def test_gazetteer_file_and_prompts(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"City": ["London", "Vienna"], "Person": ["London"]}))
    names = A.gazetteer_file(spark, f"file://{tmp_path}/g.json")
    assert E.gazetteer_of(names).types == {"london": "City", "vienna": "City"}
    with pytest.raises(ValueError):
        E.gazetteer_of(names, 1)
    prompts = spark.createDataFrame([("a",), ("b",), ("",)], "prompt string")
    answers = spark.createDataFrame([("a", "x", 2), ("a", "y", 1)], "prompt string, answer string, seq int")
    assert sorted(map(tuple, A.answer_prompts(prompts, answers, "z").collect())) == [("", "z"), ("a", "y"), ("b", "z")]
    assert A.answer_prompts(prompts, answers).count() == 1

    def transport(prompt):
        if prompt == "b":
            raise OSError("closed")
        return [" ", "one ", "two", "three"]

    got = A.query_model(prompts, transport, 2)
    assert sorted((r["prompt"], r["n"], r["answer"], r["error"]) for r in got.collect()) == [("a", 0, "one", None), ("a", 1, "two", None), ("b", 0, None, "OSError: closed")]
    assert [r["text"] for r in A.tool_output(got, "p").collect()] == ["one"]


def test_chunks():
    assert E.spans("") == [(0, 0)] and E.spans("x" * 800) == [(0, 800)] and E.spans("x" * 801, overlap=0) == [(0, 800), (800, 801)]
    text = "A sentence here. Another one!\n" * 60 + "\n\n" + "short"
    spans = E.spans(text, 100, 10)
    assert spans[0] == (0, 90) and all(text[b - 1] in "\n t!." or b == len(text) for _, b in spans) and spans[-1][1] == len(text)
    assert all(a == max(0, p[1] - 10) for p, (a, _) in zip(spans, spans[1:]))
    rnd = random.Random(1)
    for _ in range(200):
        t = "".join(rnd.choice("ab. !\n") for _ in range(rnd.randint(0, 200)))
        cuts = E.cuts(t, 20)
        assert all(b - a <= 20 for a, b in cuts) and "".join(t[a:b] for a, b in cuts).replace("\n", "") == t.replace("\n", "")


def test_chunk_rows(spark):
    rows = spark.createDataFrame([("a", "x " * 600), ("b", ""), ("c", None)], "id string, text string")
    got = E.chunk(rows, 500, 50).collect()
    assert {r["document_id"] for r in got} == {"a", "b"} and len({r["id"] for r in got}) == len(got)
    with pytest.raises(ValueError):
        E.chunk(rows, 10, 10)


def test_names_and_relations():
    g = E.Gazetteer([("Acme", "Company"), ("Acme Corp", "Org"), ("Ada Lovelace", "Person"), ("Alan Turing", "Person"), ("Initech", "Company"), ("  ", "x"), ("acme", "Other")])
    assert g.mentions("X Ada Lovelace Y") == [(2, 14, "Person")]
    assert g.mentions("Acme Corp is a company") == [(0, 9, "Org")] and g.mentions("ACME, Acme. Corp") == [(0, 4, "Company"), (6, 16, "Org")]
    import re

    patterns = [(re.compile(p, re.I), n) for p, n in E.PATTERNS]
    text = "Ada Lovelace is a person. Alan Turing founded Initech."
    found = g.mentions(text)
    assert [(text[slice(*found[s][:2])], p, text[slice(*found[o][:2])]) for _, _, s, o, p in E.relations(text, found, patterns)] == [("Alan Turing", "founded", "Initech")]
    loose = "Alan Turing invented. Initech was."
    found = g.mentions(loose)
    assert E.relations(loose, found, patterns) and not E.relations(loose, found, patterns, strict=True)
    assert not E.relations("Acme founded Acme", g.mentions("Acme founded Acme"), patterns)


def test_extractors_of_the_caller(spark):
    rows = spark.createDataFrame([("c1", "Ada met Bob"), ("c2", None)], "id string, text string")
    got = E.extract_with(rows, lambda t: [{"name": w, "entity_type": "P", "confidence": 0.5} for w in t.split()] + [{"name": " "}], lambda t, e: [{"subject": e[0]["name"], "predicate": "met", "object": e[-1]["name"]}, {"subject": "", "predicate": "p", "object": "o"}] if e else [])
    first = got.where("id = 'c1'").first()
    assert [e["name"] for e in first["entities"]] == ["Ada", "met", "Bob"] and len(first["relations"]) == 1
    assert got.where("id = 'c2'").first()["entities"] == []


def test_ingestion_is_repeatable(spark):
    a, b = corpus.knowledge_base(spark), corpus.knowledge_base(spark)
    for name in ("documents", "chunks", "entities", "claims", "evidence", "relations"):
        one, two = a.tables()[name].drop("metadata"), b.tables()[name].drop("metadata")
        assert one.count() > 0 and one.exceptAll(two).count() == 0, name
    e = a.evidence.join(a.chunks.select(F.col("id").alias("chunk_id"), F.col("text").alias("chunk")), "chunk_id").first()
    assert e["chunk"][e["start"] : e["end"]] == e["text"]
