"""Raw documents from payloads of text, Markdown and JSON, from folders of such files, and from prompted sources.

A source is a row (id, title, kind, reference, payload); payload is a string or UTF-8 bytes. Every adapter returns rows
(source_id, ordinal, title, content_type, text, metadata). Null payloads count as empty. All but JSON flattening, whose
depth is open, are Column expressions within one row, so no adapter shuffles.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.functions.text import normalize_text

RAW = "source_id string, ordinal int, title string, content_type string, text string, metadata map<string,string>"
#: Line ends as Unicode has them.
_LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"
_SUFFIXES = {"txt": "text", "md": "markdown", "json": "json"}
_RECORD = "array<struct<title:string,text:string,record:string>>"


def payload_text(payload: Column) -> Column:
    """A payload as a string: bytes are UTF-8."""
    return F.coalesce(payload.cast("string"), F.lit(""))


def _raw(rows: DataFrame, ordinal: Column, title: Column, kind: str, text: Column, *extra: Column) -> DataFrame:
    metadata = F.map_filter(F.create_map(F.lit("source_reference"), F.col("reference"), *extra, *([F.lit("path"), F.col("path")] if "path" in rows.columns else [])), lambda k, v: v.isNotNull())
    return rows.select(F.col("id").cast("string").alias("source_id"), ordinal.cast("int").alias("ordinal"), title.alias("title"), F.lit(kind).alias("content_type"), normalize_text(text).alias("text"), metadata.alias("metadata"))


def text_documents(sources: DataFrame) -> DataFrame:
    """One document for each source; without a title it is `untitled`."""
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("untitled"))
    return _raw(sources, F.lit(0), title, "text", payload_text(F.col("payload")))


def markdown_documents(sources: DataFrame) -> DataFrame:
    """One document for each section that a line beginning with `# ` opens, and one for what stands before the first.

    A section without a heading is called by the source's title and its number; an empty payload is one document.
    """
    lines = F.split(payload_text(F.col("payload")), _LINE_END)
    rows = sources.withColumn("lines", F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines))
    place = F.when(F.size("lines") > 0, F.sequence(F.lit(1), F.size("lines"))).otherwise(F.array().cast("array<int>"))
    heads = F.filter(place, lambda i: F.element_at("lines", i).startswith("# "))
    rows = rows.withColumn("heads", heads)
    # Each section: the place of its heading (0 for none) and of the next one.
    rows = rows.withColumn("begins", F.concat(F.array(F.lit(0)), "heads")).withColumn("ends", F.concat("heads", F.array(F.size("lines") + 1)))
    def section(b: Column, e: Column) -> Column:
        heading = F.when(b > 0, F.trim(F.regexp_replace(F.substring(F.element_at("lines", F.greatest(b, F.lit(1))), F.lit(3), F.lit(1 << 30)), r"^\s+|\s+$", ""))).otherwise("")
        return F.struct(heading.alias("heading"), F.slice("lines", b + 1, F.greatest(F.lit(0), e - b - 1)).alias("body"))

    sections = F.filter(F.zip_with("begins", "ends", section), lambda s: (F.size(s["body"]) > 0) | (s["heading"] != ""))
    rows = rows.select("id", "title", "reference", *[c for c in ("path",) if c in sources.columns], F.posexplode_outer(sections).alias("n", "s"))
    heading, number = F.coalesce(F.col("s.heading"), F.lit("")), F.coalesce("n", F.lit(0))
    title = F.when(F.col("s").isNull(), F.col("title")).when(heading != "", heading).otherwise(F.concat(F.coalesce("title", F.lit("")), F.lit(" #"), (number + 1).cast("string")))
    return _raw(rows, number, title, "markdown", F.coalesce(F.array_join("s.body", "\n"), F.lit("")), F.lit("heading"), F.when(F.col("s").isNotNull(), heading))


def flatten_json(record: dict) -> str:
    """Lines `a.b[0].c: value` of a record, in its own order; a list of plain values repeats its label."""
    lines, todo = [], [("", record)]
    while todo:
        label, value = todo.pop()
        if isinstance(value, dict):
            todo += [(f"{label}.{k}" if label else str(k), v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            todo += [(f"{label}[{i}]", v) if isinstance(v, dict) else (label, (v,)) for i, v in reversed(list(enumerate(value)))]
        else:
            lines.append(f"{label}: {value[0] if isinstance(value, tuple) else value}")
    return "\n".join(lines)


def _records(title: str | None, payload: str) -> list[dict] | None:
    """The records of a JSON text; None where it is not JSON."""
    try:
        data = json.loads(payload)
    except ValueError:
        return None
    if isinstance(data, list):
        found = [(f"{title or ''} #{i + 1}", x) for i, x in enumerate(data) if isinstance(x, dict)]
    else:
        found = [(title or "document", data if isinstance(data, dict) else {"value": data})]
    return [{"title": t, "text": flatten_json(x), "record": json.dumps(x, ensure_ascii=False)} for t, x in found]


def json_documents(sources: DataFrame) -> DataFrame:
    """An object is one document, a list one for each object in it, a plain value `value: x`; other text is a text document."""

    @F.pandas_udf(_RECORD)
    def records(title: pd.Series, payload: pd.Series) -> pd.Series:
        return pd.Series([_records(t, p) for t, p in zip(title, payload)], dtype=object)

    rows = sources.withColumn("found", records(F.col("title"), payload_text(F.col("payload"))))
    plain = text_documents(rows.where("found is null"))
    kept = rows.where("found is not null").select("id", "reference", *[c for c in ("path",) if c in sources.columns], F.posexplode("found").alias("n", "r"))
    return _raw(kept, F.col("n"), F.col("r.title"), "json", F.col("r.text"), F.lit("record_index"), F.col("n").cast("string"), F.lit("record"), F.col("r.record")).unionByName(plain)


class SearchProvider(Protocol):
    """A search service of the caller's: results as raw documents, and one document by its reference."""

    def search(self, queries: DataFrame, limit: int) -> DataFrame: ...

    def document(self, references: DataFrame) -> DataFrame: ...


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"text": text_documents, "markdown": markdown_documents, "json": json_documents}


def read_sources(sources: DataFrame, adapter: Column | None = None) -> DataFrame:
    """Every source by the adapter of its kind (or of the column given); other kinds are text."""
    kind = F.coalesce(F.col("kind") if adapter is None else adapter, F.lit("text"))
    kind = F.when(kind.isin(*ADAPTERS), kind).otherwise("text")
    rows, out = sources.withColumn("by", kind), None
    for name, read in ADAPTERS.items():
        part = read(rows.where(F.col("by") == name).drop("by"))
        out = part if out is None else out.unionByName(part)
    return out


def repository_sources(spark: SparkSession, folder: str, source_id: str, title: str, reference: str | None = None) -> DataFrame:
    """The .txt, .md and .json files below a folder as sources with `path` (relative); files that are not UTF-8 are left out.

    Spark's own reader lists the folder, so it may be in any store that Spark reads. Order is by path and ordinal.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    root = folder.rstrip("/").split("://", 1)[-1].lstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*", "")
    rows = files.where(suffix.isin(*_SUFFIXES)).where(F.is_valid_utf8(F.col("content").cast("string")))
    kind = F.when(suffix == "md", "markdown").when(suffix == "json", "json").otherwise("text")
    return rows.select(F.lit(source_id).alias("id"), F.lit(title).alias("title"), kind.alias("kind"), F.lit(reference or folder).alias("reference"), F.col("content").alias("payload"), F.substring_index(path, root, -1).alias("path"))


def repository_documents(spark: SparkSession, folder: str, source_id: str, title: str, reference: str | None = None) -> DataFrame:
    return read_sources(repository_sources(spark, folder, source_id, title, reference))


def gazetteer_file(spark: SparkSession, path: str) -> DataFrame:
    """entity_type, name, seq: a JSON file {type: [names]} in its own order."""
    text = spark.read.text(path, wholetext=True)
    kinds = text.select(F.from_json("value", "map<string,array<string>>").alias("m")).select(F.posexplode(F.map_entries("m")).alias("i", "e"))
    return kinds.select(F.col("e.key").alias("entity_type"), "i", F.posexplode("e.value").alias("j", "name")).select("entity_type", "name", (F.col("i").cast("long") * (1 << 32) + F.col("j")).alias("seq"))


def answer_prompts(prompts: DataFrame, answers: DataFrame, default: str | None = None, limit: int = 1) -> DataFrame:
    """prompt rows with answer: the canned answer of exactly this prompt (least seq first), else the default, else none.

    Every answer counts up to `limit`; prompts without any give no row unless there is a default.
    """
    from pyspark.sql import Window as W

    ranked = answers.withColumn("n", F.row_number().over(W.partitionBy("prompt").orderBy("seq"))).where(F.col("n") <= limit).select("prompt", "answer")
    rows = prompts.join(ranked, "prompt", "left").withColumn("answer", F.coalesce("answer", F.lit(default)))
    return rows.where("answer is not null")


def query_model(prompts: DataFrame, transport: Callable[[str], list[str]], limit: int = 1) -> DataFrame:
    """prompt, n, answer, error: what a transport (prompt to choices) says, blank choices dropped, `limit` at most.

    The transport runs in the executors, is called once for each distinct prompt of a batch, and may be called again when a
    task is repeated. A failure becomes an error row, not a failed job.
    """
    if limit < 1:
        raise ValueError("limit must be positive")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for prompt in batch["prompt"]:
                try:
                    kept = [x.strip() for x in transport(prompt) if x and x.strip()][:limit]
                    out += [(prompt, i, x, None) for i, x in enumerate(kept)]
                except Exception as e:  # noqa: BLE001
                    out.append((prompt, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["prompt", "n", "answer", "error"])

    return prompts.where(F.trim("prompt") != "").select("prompt").distinct().mapInPandas(run, "prompt string, n int, answer string, error string")


def tool_output(answers: DataFrame, provider: str) -> DataFrame:
    """Answers of query_model() as the output of a tool: the first answer's fields and ids on top, all answers below."""
    one = answers.where("error is null").groupBy("prompt").agg(F.sort_array(F.collect_list(F.struct("n", "answer"))).alias("results"))
    ident = F.concat(F.lit("llm_"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(provider), "prompt", F.col("results")[0]["answer"]), 256), 1, 24))
    return one.select(F.col("prompt").alias("query"), F.col("results")[0]["answer"].alias("text"), ident.alias("source_id"), F.concat(F.lit("document:"), ident).alias("document_id"), F.concat(F.lit("chunk:"), ident).alias("chunk_id"), F.lit(provider).alias("provider"), F.transform("results", lambda r: r["answer"]).alias("results"))
