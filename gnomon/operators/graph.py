"""Graph operators over edges (subject, predicate, object, confidence)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gnomon.functions.packed import pack, unpack
from gnomon.functions.storage import cut_lineage


def star_schema_graph(tables) -> DataFrame:
    """The edges of the driver's star schema; tables: a function from a name to a DataFrame."""
    node = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    edge = lambda df, s, p, o, w=None: df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), (F.lit(1.0) if w is None else w).alias("confidence"))
    supplies = tables("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.round(1 - F.avg("l_discount"), 6).alias("w"))
    return (
        edge(tables("supplier"), node("supplier", "s_suppkey"), "located_in", node("nation", "s_nationkey"))
        .unionByName(edge(tables("customer"), node("customer", "c_custkey"), "located_in", node("nation", "c_nationkey")))
        .unionByName(edge(tables("nation"), node("nation", "n_nationkey"), "part_of", node("region", "n_regionkey")))
        .unionByName(edge(supplies, node("supplier", "l_suppkey"), "supplies", node("part", "l_partkey"), F.col("w")))
    )


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("subject").alias("id")).unionByName(edges.select(F.col("object").alias("id"))).distinct()


def degree_centrality(edges: DataFrame) -> DataFrame:
    """id, degree, centrality = degree / (n - 1): parallel edges count each."""
    ends = edges.select(F.col("subject").alias("id")).unionByName(edges.select(F.col("object").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    n = ends.agg(F.count("*").alias("n"))
    return ends.crossJoin(F.broadcast(n)).select("id", "degree", F.round(F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0), 8).alias("centrality"))


def statistics(edges: DataFrame) -> DataFrame:
    n = nodes(edges).agg(F.count("*").alias("entities"))
    e = edges.agg(F.count("*").alias("relations"), F.count_distinct("subject", "predicate", "object").alias("unique_edges"))
    many, rel = F.col("entities"), F.col("relations")
    return n.crossJoin(e).select("entities", "relations", "unique_edges", F.round(F.when(many > 1, rel / (many * (many - 1))).otherwise(0.0), 10).alias("density"), F.round(F.when(many > 0, 2 * rel / many).otherwise(0.0), 6).alias("average_degree"))


def full_statistics(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """statistics() of edges and of entities (id) that no edge touches, with components and isolated nodes: those that are
    alone in their component, with a loop or without."""
    labels = cut_lineage(components(edges))
    alone = entities.select("id").distinct().join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))
    sizes = labels.unionByName(alone).groupBy("component").agg(F.count("*").alias("size"))
    counts = sizes.agg(F.count("*").alias("components"), F.count_if(F.col("size") == 1).alias("isolated"), F.coalesce(F.sum("size"), F.lit(0)).alias("entities"))
    e = edges.agg(F.count("*").alias("relations"), F.count_distinct("subject", "predicate", "object").alias("unique_edges"))
    many, rel = F.col("entities"), F.col("relations")
    return counts.crossJoin(e).select("entities", "relations", "unique_edges", F.round(F.when(many > 1, rel / (many * (many - 1))).otherwise(0.0), 10).alias("density"), F.round(F.when(many > 0, 2 * rel / many).otherwise(0.0), 6).alias("average_degree"), "components", "isolated")


def neighbors(edges: DataFrame, seeds: DataFrame, direction: str = "both") -> DataFrame:
    """seed, neighbor, predicate, confidence, direction; a loop is seen from both ends."""
    out = edges.join(seeds.withColumnRenamed("id", "seed"), F.col("subject") == F.col("seed")).select("seed", F.col("object").alias("neighbor"), "predicate", "confidence", F.lit("out").alias("direction"))
    back = edges.join(seeds.withColumnRenamed("id", "seed"), F.col("object") == F.col("seed")).select("seed", F.col("subject").alias("neighbor"), "predicate", "confidence", F.lit("in").alias("direction"))
    if direction not in ("out", "in", "both"):
        raise ValueError(f"no such direction: {direction}")
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def edges_of(relations: DataFrame) -> DataFrame:
    """Edges of relation records: id, subject, predicate, object, confidence."""
    return relations.select("id", F.col("subject_id").alias("subject"), "predicate", F.col("object_id").alias("object"), F.col("confidence").cast("double").alias("confidence"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, seeds: DataFrame | None = None, tolerance: float | None = None, verts: DataFrame | None = None, every: int = 3) -> DataFrame:
    """id, rank after `rounds` rounds, or earlier once a round moves less than `tolerance` in all (looked at with each
    write): weighted by confidence; what dangling nodes hold is spread evenly, also when ranks are personal.

    seeds: personalized, restarting evenly at these ids. verts: nodes besides those that edges touch. The edges are written
    by subject once; ranks are written after every few rounds, since each round reads them twice.
    """
    ranks = _ranks(edges, None if seeds is None else seeds.select(F.lit(0).alias("query_id"), "id").distinct(), verts, rounds, damping, tolerance, every)
    return ranks.select("id", F.round("rank", 8).alias("rank"))


def personal_ranks(edges: DataFrame, seeds: DataFrame, verts: DataFrame | None = None, rounds: int = 100, damping: float = 0.85, tolerance: float | None = 1e-6, every: int = 3) -> DataFrame:
    """query_id, id, rank: personalized ranks for all queries of a batch at once; seeds are rows (query_id, id).

    Seeds that the graph does not hold still count in the sum that a restart is shared among. Nodes that get nothing but
    the even share of dangling nodes are in the result as well, so a batch makes as many rows as queries times nodes:
    take queries in batches that allow it.
    """
    return _ranks(edges, seeds.select("query_id", "id").distinct(), verts, rounds, damping, tolerance, every).select("query_id", "id", "rank")


def _ranks(edges: DataFrame, seeds: DataFrame | None, verts: DataFrame | None, rounds: int, damping: float, tolerance: float | None, every: int) -> DataFrame:
    edges = cut_lineage(edges.select("subject", "object", "confidence"))
    verts = nodes(edges) if verts is None else nodes(edges).unionByName(verts.select("id")).distinct()
    out = edges.groupBy("subject").agg(F.sum(F.abs("confidence")).alias("total")).where("total > 0")
    share = edges.join(out, "subject").select("subject", "object", (F.greatest(F.lit(0.0), F.col("confidence")) / F.col("total")).alias("share")).groupBy("subject", "object").agg(F.sum("share").alias("share"))
    share = cut_lineage(share)
    verts = cut_lineage(verts.join(out.select(F.col("subject").alias("id"), F.lit(True).alias("sends")), "id", "left"))
    n = max(verts.count(), 1)
    if seeds is None:
        base = verts.select(F.lit(0).alias("query_id"), "id", "sends", F.lit(1.0 / n).alias("base"))
    else:
        many = seeds.groupBy("query_id").agg(F.count("*").alias("many"))
        mine = seeds.join(many, "query_id").select("query_id", "id", (1.0 / F.col("many")).alias("at"))
        base = many.select("query_id").crossJoin(verts).join(mine, ["query_id", "id"], "left").select("query_id", "id", "sends", F.coalesce("at", F.lit(0.0)).alias("base"))
    base = cut_lineage(base)
    ranks, done = base.select("query_id", "id", "sends", F.col("base").alias("rank")), 0
    while done < rounds:
        for _ in range(min(every, rounds - done)):
            last = ranks
            moved = share.join(ranks.select("query_id", F.col("id").alias("subject"), "rank"), "subject").groupBy("query_id", F.col("object").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
            lost = ranks.where("sends is null").groupBy("query_id").agg(F.sum("rank").alias("lost"))
            zero = F.lit(0.0)
            new = (1 - damping) * F.col("base") + damping * (F.coalesce("got", zero) + F.coalesce("lost", zero) / n)
            ranks = base.join(moved, ["query_id", "id"], "left").join(lost, "query_id", "left").select("query_id", "id", "sends", new.alias("rank"))
            done += 1
        if tolerance is not None:
            before = last.select("query_id", "id", F.col("rank").alias("before"))
            ranks = cut_lineage(ranks.join(before, ["query_id", "id"]))
            moved = ranks.groupBy("query_id").agg(F.sum(F.abs(F.col("rank") - F.col("before"))).alias("m")).agg(F.max("m")).first()[0]
            ranks = ranks.drop("before")
            if moved is None or moved < tolerance:
                break
        else:
            ranks = cut_lineage(ranks)
    return ranks


def merge_edges(events: DataFrame) -> DataFrame:
    """Edges by (subject, predicate, object) from rows in order of seq: the first id, the latest confidence, all sources sorted."""
    return events.groupBy("subject", "predicate", "object").agg(F.min_by("id", "seq").alias("id"), F.max_by("confidence", "seq").alias("confidence"), F.concat_ws(",", F.sort_array(F.collect_set("source"))).alias("sources"))


def missing_relations(edges: DataFrame, top: int = 60, seeds: int = 400) -> DataFrame:
    """a, b, shared: the `top` pairs without a direct edge that share most neighbours, without all pairs of a hub.

    Pairs among the `seeds` nodes of highest degree give a count that the last of the top pairs has at least (floor). Nodes
    of lower degree are out. Each other node leaves out some of its most frequent neighbours (at most floor - 1), in one
    order for all nodes: what two nodes share beyond their counted neighbours is at most what one of them left out, so
    every pair that may reach the floor is found, and few are counted in full. Only without `top` pairs among the seeds
    is every pair of a group made.
    """
    named = cut_lineage(undirected(edges))
    # Numbers in the order of the names stand for them until the end: rows of texts are shuffled twice only.
    nodes_ = cut_lineage(ordered_number(named.groupBy(F.col("x").alias("id")).agg(F.count("*").alias("degree")), "id", "n"))
    number = lambda name: nodes_.select(F.col("id").alias(name), F.col("n").cast("long").alias("n_" + name))
    both = cut_lineage(named.join(number("x"), "x").select("n_x", "y").join(number("y"), "y").select(F.col("n_x").alias("x"), F.col("n_y").alias("y")))
    degree = nodes_.select(F.col("n").cast("long").alias("x"), "degree")
    side = lambda df, name: df.select("y", F.col("x").alias(name))
    unlinked = lambda pairs: pairs.join(both.select(F.col("x").alias("a"), F.col("y").alias("b")), ["a", "b"], "left_anti")
    first = both.join(F.broadcast(degree.orderBy(F.desc("degree"), "x").limit(seeds).select("x")), "x")
    tried = unlinked(side(first, "a").join(side(first, "b"), "y").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")))
    least = lambda pairs, column: pairs.orderBy(F.desc(column)).limit(top).agg(F.count("*"), F.min(column)).first()
    many, floor = least(tried, "shared")
    floor = floor if many == top else 1

    light = (F.col("degree") < 4 * floor).alias("light")
    loose = (floor - 1, (floor - 1) // 4)  # of light nodes, and of others
    rows = both.join(degree.where(F.col("degree") >= floor).select("x", light), "x").join(degree.select(F.col("x").alias("y"), "degree"), "y")
    place = F.row_number().over(W.partitionBy("x").orderBy(F.desc("degree"), "y"))
    kept = cut_lineage(rows.withColumn("place", place).where(F.col("place") > F.when(F.col("light"), loose[0]).otherwise(loose[1])).select("x", "y", "light"))
    pairs = cut_lineage(unlinked(_counted_pairs(kept, nodes_.count(), loose, floor)))
    many, better = least(pairs, "counted")
    pairs = pairs.where(F.col("counted") + F.col("more") >= (max(floor, better) if many == top else floor)).select("a", "b")
    shared = pairs.join(both.withColumnRenamed("x", "a"), "a").join(both.withColumnRenamed("x", "b"), ["b", "y"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    found = shared.orderBy(F.desc("shared"), "a", "b").limit(top)
    ids = lambda name: nodes_.select(F.col("n").cast("long").alias(name), F.col("id").alias("id_" + name))
    found = found.join(ids("a"), "a").join(ids("b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "shared")
    return found.orderBy(F.desc("shared"), "a", "b")


def _counted_pairs(kept: DataFrame, nodes_: int, loose: tuple[int, int], floor: int, most: int = 8_000_000) -> DataFrame:
    """a, b, counted, more: pairs of numbers x (below nodes_) of kept (x, y, light) that share `counted` y, where this and what
    one of them left out (more) reach the floor.

    Pairs are never shuffled. The x are dealt into groups; each two groups meet in one task, as sorted, packed numbers, and
    their pairs (about `most`) are made and counted there.
    """
    wedges = kept.groupBy("y").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0] or 0
    groups = max(1, math.ceil(math.sqrt(2 * wedges / most)))

    def deal(batches):
        def out(parts):
            x, y, light = (np.concatenate(c) for c in zip(*parts, strict=True))
            key = ((y * nodes_ + x) * 2 + light).astype(np.uint64)
            for g in range(groups):
                data = pack(np.sort(key[x % groups == g]))
                if data:
                    to = [(min(g, h), max(g, h)) for h in range(groups)]
                    yield pa.RecordBatch.from_arrays([pa.array([i * groups + j for i, j in to], pa.int32()), pa.array([g] * groups, pa.int32()), pa.array([data] * groups, pa.binary())], ["task", "part", "data"])

        parts, n = [], 0
        for b in batches:
            parts.append((b.column("x").to_numpy(), b.column("y").to_numpy(), b.column("light").to_numpy(zero_copy_only=False).astype(np.int64)))
            n += b.num_rows
            if n >= 1 << 20:
                yield from out(parts)
                parts, n = [], 0
        if n:
            yield from out(parts)

    def count(group: pa.Table) -> pa.Table:
        task, part = group.column("task")[0].as_py(), np.array(group.column("part"))
        data = group.column("data").to_pylist()
        sides = []
        for g in sorted({task // groups, task % groups}):
            key = np.sort(np.concatenate([np.empty(0, np.uint64), *[unpack(data[i]) for i in np.flatnonzero(part == g)]])).astype(np.int64)
            sides.append((key // 2 // nodes_, key // 2 % nodes_, key % 2))
        (ya, xa, la), (yb, xb, lb) = sides[0], sides[-1]
        # Within one group each x goes with those behind it.
        begin = np.arange(1, len(ya) + 1) if len(sides) == 1 else np.searchsorted(yb, ya)
        size = np.searchsorted(yb, ya, "right") - begin
        own = np.repeat(np.arange(len(ya)), size)
        other = np.arange(len(own)) + np.repeat(begin - (np.cumsum(size) - size), size)
        p, q = xa[own], xb[other]
        more = np.where(la[own] | lb[other], loose[0], loose[1])
        pair = (np.minimum(p, q) * nodes_ + np.maximum(p, q)) * 2 + (more == loose[0])
        del own, other, p, q, more
        pair, counted = np.unique(pair, return_counts=True)
        more = np.where(pair % 2, loose[0], loose[1])
        good = counted + more >= floor
        pair, counted, more = pair[good] // 2, counted[good], more[good]
        return pa.table({"a": pair // nodes_, "b": pair % nodes_, "counted": counted.astype(np.int64), "more": more.astype(np.int64)})

    dealt = kept.select("x", "y", "light").mapInArrow(deal, "task int, part int, data binary")
    return dealt.groupBy("task").applyInArrow(count, "a long, b long, counted long, more long")


def undirected(edges: DataFrame) -> DataFrame:
    """x, y: both directions of every edge once, without loops."""
    return edges.select(F.col("subject").alias("x"), F.col("object").alias("y")).unionByName(edges.select(F.col("object").alias("x"), F.col("subject").alias("y"))).where("x <> y").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """id, component: the smallest id that edges reach in either direction.

    Each round takes the neighbours' least label and then the label of that label, so the rounds grow with the logarithm
    of the longest way. Labels are written each round; RuntimeError if they still change after `rounds`.
    """
    both = cut_lineage(undirected(edges))
    labels = cut_lineage(nodes(edges).withColumn("component", F.col("id")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("y"), "component"), "y").groupBy(F.col("x").alias("id")).agg(F.min("component").alias("got"))
        least = cut_lineage(labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("got", "component")).alias("component")))
        jump = least.select(F.col("id").alias("component"), F.col("component").alias("next"))
        moved = cut_lineage(least.join(jump, "component").select("id", "old", F.col("next").alias("component")))
        labels = moved.select("id", "component")
        if moved.where("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"components still change after {rounds} rounds")


def traversal(edges: DataFrame, seeds: DataFrame, depth: int = 2, direction: str = "both") -> DataFrame:
    """id, depth: what is reached from the seeds (id) in at most `depth` steps, with the fewest steps; seeds at 0."""
    out = edges.select(F.col("subject").alias("x"), F.col("object").alias("y"))
    back = edges.select(F.col("object").alias("x"), F.col("subject").alias("y"))
    if direction not in ("out", "in", "both"):
        raise ValueError(f"no such direction: {direction}")
    moves = (out if direction == "out" else back if direction == "in" else out.unionByName(back)).distinct()
    front = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    seen = front
    for step in range(1, depth + 1):
        reached = moves.join(front.select(F.col("id").alias("x")), "x").select(F.col("y").alias("id")).distinct()
        front = cut_lineage(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(step)))
        seen = seen.unionByName(front)
    return seen


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """The edges between nodes that a traversal in both directions reaches."""
    inside = cut_lineage(traversal(edges, seeds, depth).select("id"))
    kept = edges.join(inside.withColumnRenamed("id", "subject"), "subject", "left_semi")
    return kept.join(inside.withColumnRenamed("id", "object"), "object", "left_semi").select(edges.columns)


def paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, longest: int = 4) -> DataFrame:
    """source, target, path, hops, weight: directed paths without repeated nodes, of at most `longest` edges.

    Of parallel edges the one with the smallest predicate counts; the weight is the product of confidences.
    """
    hop = edges.groupBy("subject", "object").agg(F.min_by("confidence", "predicate").alias("c"))
    rows = sources.select(F.col("id").alias("source"), F.array("id").alias("path"), F.col("id").alias("subject"), F.lit(1.0).alias("weight"))
    ends = targets.select(F.col("id").alias("subject")).distinct()
    found = None
    for length in range(longest + 1):
        if length:
            rows = rows.join(hop, "subject").where(~F.array_contains("path", F.col("object"))).select("source", F.array_append("path", F.col("object")).alias("path"), F.col("object").alias("subject"), (F.col("weight") * F.col("c")).alias("weight"))
        here = rows.join(ends, "subject", "left_semi").select("source", F.col("subject").alias("target"), F.array_join("path", ">").alias("path"), F.lit(length).alias("hops"), F.round("weight", 6).alias("weight"))
        found = here if found is None else found.unionByName(here)
    return found


def query_edges(edges: DataFrame, predicate: str | None = None, subject: str | None = None, obj: str | None = None, top: int = 100) -> DataFrame:
    """The first `top` edges, in order of their three names, that agree with every name given."""
    for column, value in (("predicate", predicate), ("subject", subject), ("object", obj)):
        edges = edges if value is None else edges.where(F.col(column) == value)
    return edges.orderBy("subject", "predicate", "object").limit(top)


def disconnected(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities (id) that no edge touches, as gaps: id, kind, uncertainty, cost."""
    return entities.select("id").distinct().join(nodes(edges), "id", "left_anti").select("id", F.lit("disconnected_entity").alias("kind"), F.lit(1.0).alias("uncertainty"), F.lit(2.0).alias("cost"))


def walk(edges: DataFrame, seeds: DataFrame, depth: int = 2, most_nodes: int = 100, most_edges: int = 500, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Nodes (query_id, id, depth) and edges (query_id, id, subject, predicate, object, confidence, at) that walks from the
    seeds (query_id, id) meet, of all queries at once.

    Each step takes the new nodes in the order of their ids, and of each its edges, outgoing ones first, in the order of
    edge ids. An edge counts whenever it is met, so one between two nodes of the walk is there twice, and so is a loop. At
    most_edges the walk of a query ends; at most_nodes it takes no new nodes. Only what the bounds admit is kept.
    """
    if direction not in ("out", "in", "both"):
        raise ValueError(f"no such direction: {direction}")
    columns = ["id", "subject", "predicate", "object", "confidence"]
    ways = []
    if direction != "in":
        ways.append(edges.select(*columns, F.col("subject").alias("here"), F.lit(0).alias("side"), F.col("object").alias("other")))
    if direction != "out":
        ways.append(edges.select(*columns, F.col("object").alias("here"), F.lit(1).alias("side"), F.col("subject").alias("other")))
    moves = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])
    seen = cut_lineage(seeds.select("query_id", "id").distinct().withColumn("depth", F.lit(0)))
    front, met = seen, None
    for step in range(1, depth + 1):
        order = W.partitionBy("query_id").orderBy("here", "side", "id")
        rows = front.select("query_id", F.col("id").alias("here")).join(moves, "here").withColumn("at", F.row_number().over(order))
        had = None if met is None else met.groupBy("query_id").agg(F.count("*").alias("had"))
        rows = rows.withColumn("had", F.lit(0)) if had is None else rows.join(had, "query_id", "left").fillna(0, ["had"])
        rows = cut_lineage(rows.where(F.col("at") <= most_edges).where(F.col("at") + F.col("had") <= most_edges).withColumn("at", (F.col("at") + F.col("had")).cast("int")))
        new = rows.groupBy("query_id", F.col("other").alias("id")).agg(F.min("at").alias("at")).join(seen, ["query_id", "id"], "left_anti")
        known = seen.groupBy("query_id").agg(F.count("*").alias("known"))
        new = new.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("at", "id"))).join(known, "query_id").where(F.col("n") + F.col("known") <= most_nodes)
        front = cut_lineage(new.select("query_id", "id", F.lit(step).alias("depth")))
        seen = cut_lineage(seen.unionByName(front))
        kept = rows.select("query_id", *columns, "at")
        met = cut_lineage(kept if met is None else met.unionByName(kept))
        if step < depth and front.isEmpty():
            break
    return seen, met if met is not None else moves.limit(0).select(F.lit(None).cast(dict(seeds.dtypes)["query_id"]).alias("query_id"), *columns, F.lit(0).alias("at"))


def paths_between(edges: DataFrame, pairs: DataFrame, longest: int = 4, most: int = 20) -> DataFrame:
    """source, target, path, hops, weight, place: of each pair the first `most` directed ways without repeated nodes, of at
    most `longest` edges, in the order of their nodes. Of parallel edges the one with the least id (else predicate) counts.

    Half-built ways that cannot reach their target any more are left out: each step keeps nodes from which the target is
    no further than the steps that are left.
    """
    key = "id" if "id" in edges.columns else "predicate"
    hop = cut_lineage(edges.groupBy("subject", "object").agg(F.min_by("confidence", key).alias("c")))
    pairs = cut_lineage(pairs.select("source", "target").distinct())
    # Distances to each target, backwards.
    front = pairs.select("target", F.col("target").alias("id")).distinct().withColumn("far", F.lit(0))
    near = front
    for step in range(1, longest + 1):
        back = front.select("target", F.col("id").alias("object")).join(hop, "object").select("target", F.col("subject").alias("id")).distinct()
        front = cut_lineage(back.join(near, ["target", "id"], "left_anti").withColumn("far", F.lit(step)))
        near = cut_lineage(near.unionByName(front))
    rows = pairs.join(near, (F.col("source") == F.col("id")) & (pairs["target"] == near["target"])).select(pairs["source"], pairs["target"], F.array("source").alias("path"), F.col("source").alias("subject"), F.lit(1.0).alias("weight"))
    found = rows.where("subject = target")
    for length in range(1, longest + 1):
        step = rows.where("subject <> target").join(hop, "subject").where(~F.array_contains("path", F.col("object")))
        step = step.join(near.withColumnRenamed("id", "object"), ["target", "object"]).where(F.col("far") <= longest - length)
        rows = cut_lineage(step.select("source", "target", F.array_append("path", F.col("object")).alias("path"), F.col("object").alias("subject"), (F.col("weight") * F.col("c")).alias("weight")))
        found = found.unionByName(rows.where("subject = target"))
    place = F.row_number().over(W.partitionBy("source", "target").orderBy("path"))
    ranked = found.withColumn("place", place).where(F.col("place") <= most)
    return ranked.select("source", "target", F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops"), F.round("weight", 6).alias("weight"), "place")


def betweenness(edges: DataFrame, verts: DataFrame | None = None, sources: DataFrame | None = None, most_rounds: int = 1000) -> DataFrame:
    """id, centrality: shares of shortest directed ways, by (n - 1)(n - 2); parallel edges count as ways of their own.

    All sources go at once, level by level: rows (source, node, distance, ways) grow forwards, and dependencies come back
    from the last level. That is as many rows as pairs of nodes that reach each other; `sources` takes a part of them.
    """
    verts = cut_lineage(nodes(edges) if verts is None else nodes(edges).unionByName(verts.select("id")).distinct())
    hop = cut_lineage(edges.groupBy("subject", "object").agg(F.count("*").alias("parallel")))
    n = verts.count()
    origin = verts if sources is None else sources.select("id").distinct()
    front = cut_lineage(origin.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("ways")))
    levels, seen = [front], front.select("source", "id")
    for _ in range(most_rounds):
        step = front.withColumnRenamed("id", "subject").join(hop, "subject").groupBy("source", F.col("object").alias("id")).agg(F.sum(F.col("ways") * F.col("parallel")).alias("ways"))
        front = cut_lineage(step.join(seen, ["source", "id"], "left_anti"))
        if front.isEmpty():
            break
        levels.append(front)
        seen = cut_lineage(seen.unionByName(front.select("source", "id")))
    else:
        raise RuntimeError(f"ways longer than {most_rounds}")
    total, later = None, None
    for here, behind in zip(reversed(levels[:-1]), reversed(levels[1:])):
        behind = behind.withColumn("own", F.lit(0.0)) if later is None else behind.join(later, ["source", "id"], "left").fillna(0.0, ["own"])
        sent = here.withColumnRenamed("id", "subject").withColumnRenamed("ways", "mine").join(hop, "subject").join(behind.select("source", F.col("id").alias("object"), "ways", "own"), ["source", "object"])
        later = cut_lineage(sent.groupBy("source", F.col("subject").alias("id")).agg(F.sum(F.col("parallel") * F.col("mine") / F.col("ways") * (1 + F.col("own"))).alias("own")))
        part = later.where("source <> id").select("id", "own")
        total = part if total is None else total.unionByName(part)
    scale = float(max((n - 1) * (n - 2), 1))
    if total is None:
        return verts.select("id", F.lit(0.0).alias("centrality"))
    sums = total.groupBy("id").agg(F.sum("own").alias("s"))
    return verts.join(sums, "id", "left").select("id", F.round(F.coalesce("s", F.lit(0.0)) / scale, 9).alias("centrality"))


def communities(edges: DataFrame, verts: DataFrame | None = None, rounds: int = 20) -> DataFrame:
    """id, community (0, 1, ...): each node in the order of ids takes the label that most of its neighbours have, the
    smallest of equals, and later nodes of the round see it.

    Every decision needs the ones before it in the round, so each connected component is one task's work; components run
    side by side. A graph that is one large component needs synchronous_communities().
    """
    import pandas as pd

    both = undirected(edges)
    verts = nodes(edges) if verts is None else nodes(edges).unionByName(verts.select("id")).distinct()
    labels = components(edges)
    numbered = cut_lineage(ordered_number(verts, "id", "n"))
    rows = both.join(labels.withColumnRenamed("id", "x"), "x").join(numbered.select(F.col("id").alias("x"), F.col("n").alias("a")), "x").join(numbered.select(F.col("id").alias("y"), F.col("n").alias("b")), "y")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        near = {int(a): sorted(int(b) for b in g) for a, g in part.groupby("a")["b"]}
        label = {a: a for a in near}
        for _ in range(rounds):
            changed = False
            for a in sorted(near):
                votes: dict[int, int] = {}
                for b in near[a]:
                    votes[label[b]] = votes.get(label[b], 0) + 1
                most = max(votes.values())
                best = min(k for k, v in votes.items() if v == most)
                changed |= best != label[a]
                label[a] = best
            if not changed:
                break
        return pd.DataFrame({"n": list(label), "label": list(label.values())})

    found = rows.select("component", "a", "b").groupBy("component").applyInPandas(run, "n long, label long")
    every = cut_lineage(numbered.join(found, "n", "left").select("id", F.coalesce("label", "n").alias("label")))
    ids = ordered_number(every.select("label").distinct(), "label", "community")
    return every.join(ids, "label").select("id", F.col("community").cast("long"))


def synchronous_communities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """id, community: as communities(), but all nodes of a round decide on the labels of the round before, so that no part
    of the graph must be in one task. The result differs from communities(); a label is the smallest id that carried it.
    """
    both = cut_lineage(undirected(edges).unionByName(nodes(edges).select(F.col("id").alias("x"), F.col("id").alias("y"))))
    labels = cut_lineage(nodes(edges).withColumn("community", F.col("id")))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id"), "community").agg(F.count("*").alias("votes"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("votes")).alias("v"), "community")).alias("b")).select("id", F.col("b.community").alias("community"))
        new = cut_lineage(best.join(labels.withColumnRenamed("community", "old"), "id"))
        labels = new.select("id", "community")
        if new.where("community <> old").isEmpty():
            break
    return labels


def ordered_number(df: DataFrame, key: str, name: str) -> DataFrame:
    """df (with distinct keys) numbered from 0 in the order of key, without one task that sees all rows: ranges are numbered
    side by side, behind the counts of those before."""
    parts = cut_lineage(df.repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id()))
    before = parts.groupBy("_range").agg(F.count("*").alias("_rows")).withColumn("_before", F.coalesce(F.sum("_rows").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = parts.withColumn("_place", F.row_number().over(W.partitionBy("_range").orderBy(key)))
    return rows.join(F.broadcast(before), "_range").withColumn(name, F.col("_place") - 1 + F.col("_before")).drop("_range", "_place", "_rows", "_before")
