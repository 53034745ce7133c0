"""Record stores as append-only logs: upserts, deletes, lookups, merges, snapshots and a JSON form of records.

A log has one row for each write, with `seq` in the order of writes. The state of a table is the last row of each key; it
is worked out when it is read, by one aggregate with partial results, and nothing is rewritten in place.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LISTS = ("provenance", "source_ids", "supporting_evidence", "contradicting_evidence")


def latest(log: DataFrame, key: str | list[str] = "id", seq: str = "seq", first: bool = False) -> DataFrame:
    """One row for each key: the one with the greatest seq (the least with first). Ties go to the greater (smaller) row."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in log.columns if c not in keys]
    # Maps have no order of their own; as JSON they have.
    order = F.struct(seq, *[F.to_json(c) if "map<" in k else F.col(c) for c, k in log.dtypes if c not in (*keys, seq)])
    pick = (F.min_by if first else F.max_by)(F.struct(*rest), order)
    return log.groupBy(*keys).agg(pick.alias("row")).select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest]).select(log.columns)


def upsert(state: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """State with rows in the place of those of equal key. Of rows with one key the last by `seq`, if there is one."""
    if "seq" in rows.columns:
        rows = latest(rows, key)
    return state.join(rows.select(key), key, "left_anti").select(state.columns).unionByName(rows.select(state.columns))


def insert_absent(state: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """State with those rows whose key it does not hold yet; of equal new keys the first by `seq`."""
    if "seq" in rows.columns:
        rows = latest(rows, key, first=True)
    return state.unionByName(rows.join(state.select(key), key, "left_anti").select(state.columns))


def delete(state: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return state.join(gone.select(F.col(gone.columns[0]).alias(key)).distinct(), key, "left_anti").select(state.columns)


def existed(state: DataFrame, asked: DataFrame, key: str = "id") -> DataFrame:
    """key, existed: whether the state holds each key asked for."""
    held = state.select(key).distinct().withColumn("existed", F.lit(True))
    return asked.select(F.col(asked.columns[0]).alias(key)).distinct().join(held, key, "left").fillna(False, ["existed"])


def remove_entities(entities: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities without those gone (id), and relations without those that touch one."""
    ids = gone.select(F.col(gone.columns[0]).alias("id")).distinct()
    kept = relations.join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_anti").join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_anti")
    return delete(entities, ids), kept.select(relations.columns)


def by_name(entities: DataFrame, names: DataFrame) -> DataFrame:
    """name asked, id: the least id of an entity whose name, canonical name or alias is this name, but for case and blanks."""
    key = lambda c: F.lower(F.trim(c))
    canonical = F.coalesce(F.nullif(F.col("canonical_name"), F.lit("")), F.col("name"))
    known = entities.select("id", F.explode(F.array_distinct(F.transform(F.concat(F.array("name", canonical), F.coalesce("aliases", F.array().cast("array<string>"))), key))).alias("key")).groupBy("key").agg(F.min("id").alias("id"))
    return names.select("name").distinct().withColumn("key", key(F.col("name"))).join(known, "key").select("name", "id")


def where_equal(state: DataFrame, **values: object) -> DataFrame:
    """Rows that agree with every value given: lookups by source, document, subject or claim."""
    for name, value in values.items():
        state = state.where(F.col(name) == value)
    return state


def healthcheck(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def merge_relations(log: DataFrame) -> DataFrame:
    """One relation for each (subject_id, predicate, object_id) of a log with seq: the first write's id and creation, the
    last one's confidence, the sorted union of all id lists; what was merged is unverified again.

    Ids are made rows and distinct before they are collected, so a relation of many writes moves each id once.
    """
    key = ["subject_id", "predicate", "object_id"]
    first, last = (lambda c: F.min_by(c, "seq")), (lambda c: F.max_by(c, "seq"))
    rest = [c for c in log.columns if c not in (*key, *LISTS, "seq", "id", "confidence", "verification_state")]
    state = F.when(F.count("*") > 1, "unverified").otherwise(F.min_by("verification_state", "seq")) if "verification_state" in log.columns else None
    one = log.groupBy(*key).agg(first("id").alias("id"), last("confidence").alias("confidence"), *[first(c).alias(c) for c in rest], *([state.alias("verification_state")] if state is not None else []))
    lists = [c for c in LISTS if c in log.columns]
    if lists:
        items = log.select(*key, F.inline(F.array(*[F.struct(F.lit(c).alias("list"), F.col(c).alias("ids")) for c in lists])))
        items = items.select(*key, "list", F.explode("ids").alias("item")).distinct()
        sets = items.groupBy(*key).agg(*[F.sort_array(F.collect_list(F.when(F.col("list") == c, F.col("item")))).alias(c) for c in lists])
        one = one.join(sets, key, "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})
    return one.select([c for c in log.columns if c != "seq"])


def record_once(log: DataFrame, events: DataFrame, key: str = "event_id") -> DataFrame:
    """Events of a batch that the log does not hold; of equal ids the first by seq."""
    return latest(events, key, first=True).join(log.select(key), key, "left_anti").select(events.columns)


def checkpoints(log: DataFrame) -> DataFrame:
    """run, version, payload: every write of a run numbered from 1 in the order of seq."""
    from pyspark.sql import Window as W

    return log.withColumn("version", F.row_number().over(W.partitionBy("run").orderBy("seq")).cast("long")).select("run", "version", "payload")


# Records as JSON, with their type.
def to_plain(df: DataFrame, kind: str) -> DataFrame:
    """plain: each row as a JSON object with `$type` and all fields, nulls included."""
    text = F.to_json(F.struct(F.lit(kind).alias("$type"), *[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(text.alias("plain"))


def from_plain(rows: DataFrame, schemas: dict[str, str], kind: str, column: str = "plain") -> DataFrame:
    """Records of one type from JSON. A `$type` that schemas does not name is an error."""
    given = F.get_json_object(column, "$['$type']")
    checked = rows.withColumn("kind", F.when(given.isin(*schemas), given).otherwise(F.raise_error(F.concat(F.lit("unknown record type: "), F.coalesce(given, F.lit("none"))))))
    return checked.where(F.col("kind") == kind).select(F.from_json(column, schemas[kind]).alias("r")).select("r.*")


class Store:
    """Named tables below a folder, each a log of versions; state() is the last row of each key, without deleted ones.

    One writer at a time: every write is one new version folder, so a failed job leaves what was there before, and a job
    that is run again replaces its own folder.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, table: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, table: str) -> list[int]:
        path, fs = self._path(table)
        if not fs.exists(path):
            return []
        done = [s.getPath() for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("seq=")]
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()[4:]) for p in done if fs.exists(jpath(p, "_SUCCESS")))

    def save(self, table: str, rows: DataFrame, deleted: bool = False) -> int:
        version = max(self.versions(table), default=0) + 1
        rows.withColumn("deleted", F.lit(deleted)).write.mode("overwrite").parquet(f"{self.folder}/{table}/seq={version:012d}")
        return version

    def delete(self, table: str, gone: DataFrame, key: str = "id") -> int:
        """Marks keys as deleted; returns how many were there."""
        held = self.state(table, key).join(gone.select(F.col(gone.columns[0]).alias(key)).distinct(), key, "left_semi")
        many = held.count()
        if many:
            self.save(table, held, deleted=True)
        return many

    def log(self, table: str) -> DataFrame:
        paths = [f"{self.folder}/{table}/seq={v:012d}" for v in self.versions(table)]
        if not paths:
            raise KeyError(f"no such table: {table}")
        return self.spark.read.option("basePath", f"{self.folder}/{table}").option("mergeSchema", True).parquet(*paths)

    def state(self, table: str, key: str = "id") -> DataFrame:
        rows = latest(self.log(table).withColumn("seq", F.col("seq").cast("long")), key)
        return rows.where(~F.col("deleted")).drop("seq", "deleted")

    def get(self, table: str, ident: object, key: str = "id") -> DataFrame:
        return where_equal(self.state(table, key), **{key: ident})

    def count(self, table: str, key: str = "id") -> int:
        return self.state(table, key).count()


def save_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as Parquet; the list of tables is written last, so that a snapshot without it is not whole."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    schemas = [(name, df.schema.json()) for name, df in tables.items()]
    spark.createDataFrame(schemas, "name string, schema string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/_tables")


def load_snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    from pyspark.sql.types import StructType

    listed = spark.read.parquet(f"{folder}/_tables").collect()
    return {r["name"]: spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).parquet(f"{folder}/{r['name']}") for r in listed}


# Artifacts of an investigation: (session_id, iteration, kind, seq, payload).
def artifacts_latest(artifacts: DataFrame, kind: Column | str | None = None) -> DataFrame:
    """session_id, kind, payload: the last artifact of each kind."""
    rows = artifacts if kind is None else artifacts.where(F.col("kind") == kind)
    return rows.groupBy("session_id", "kind").agg(F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq"))


def artifacts_of(artifacts: DataFrame, iteration: int) -> DataFrame:
    return artifacts.where(F.col("iteration") == iteration)
