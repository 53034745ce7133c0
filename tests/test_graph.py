"""Graph algorithms against plain versions on small random graphs."""

import random
from collections import defaultdict, deque

import pytest

from gnomon.operators import graph as G
from gnomon.operators import hybrid as H

EDGES = "id string, subject string, predicate string, object string, confidence double"


def some_graph(seed, nodes=12, edges=26):
    rnd = random.Random(seed)
    names = [f"n{i:02d}" for i in range(nodes)]
    return names, [(f"e{i:02d}", rnd.choice(names), rnd.choice("pq"), rnd.choice(names), rnd.choice([0.25, 0.5, 1.0])) for i in range(edges)]


def brandes(names, edges):
    out = defaultdict(list)
    for _, s, _, o, _ in edges:
        out[s].append(o)
    total = dict.fromkeys(names, 0.0)
    for source in names:
        order, before, ways, far, queue = [], defaultdict(list), defaultdict(float, {source: 1.0}), {source: 0}, deque([source])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    ways[w] += ways[v]
                    before[w].append(v)
        own = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                own[v] += ways[v] / ways[w] * (1 + own[w])
            if w != source:
                total[w] += own[w]
    n = len(names)
    return {k: round(v / ((n - 1) * (n - 2)), 9) for k, v in total.items()}


def voting(names, edges, rounds=20):
    near = {n: set() for n in names}
    for _, s, _, o, _ in edges:
        if s != o:
            near[s].add(o)
            near[o].add(s)
    label = {n: i for i, n in enumerate(sorted(names))}
    for _ in range(rounds):
        old = dict(label)
        for n in sorted(names):
            if near[n]:
                votes = defaultdict(int)
                for m in near[n]:
                    votes[label[m]] += 1
                label[n] = min(votes, key=lambda k: (-votes[k], k))
        if old == label:
            break
    number = {x: i for i, x in enumerate(sorted(set(label.values())))}
    return {n: number[x] for n, x in label.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_and_communities(spark, seed):
    names, rows = some_graph(seed)
    edges = spark.createDataFrame(rows, EDGES)
    verts = spark.createDataFrame([(n,) for n in names], "id string")
    assert {r["id"]: r["centrality"] for r in G.betweenness(edges, verts).collect()} == pytest.approx(brandes(names, rows))
    assert {r["id"]: r["community"] for r in G.communities(edges, verts).collect()} == voting(names, rows)


def test_walk_has_limits_and_repeats(spark):
    names, rows = some_graph(3)
    edges = spark.createDataFrame(rows, EDGES)
    seeds = spark.createDataFrame([(0, "n00"), (1, "n05"), (2, "none")], "query_id int, id string")
    for most_nodes, most_edges in ((100, 500), (4, 500), (100, 7)):
        want_nodes, want_edges = set(), []
        for q, start in ((0, "n00"), (1, "n05"), (2, "none")):
            seen, front, met = {start}, [start], []
            for _ in range(2):
                new = []
                for v in sorted(front):
                    out = sorted(r for r in rows if r[1] == v)
                    for r, other in [(r, r[3]) for r in out] + [(r, r[1]) for r in sorted(rows) if r[3] == v]:
                        if len(met) < most_edges:
                            met.append(r[0])
                            if other not in seen and len(seen) < most_nodes:
                                seen.add(other)
                                new.append(other)
                front = new
            want_nodes |= {(q, n) for n in seen}
            want_edges += [(q, e) for e in met]
        nodes, found = G.walk(edges, seeds, 2, most_nodes, most_edges)
        assert {(r["query_id"], r["id"]) for r in nodes.collect()} == want_nodes
        assert sorted((r["query_id"], r["id"]) for r in found.collect()) == sorted(want_edges)
    with pytest.raises(ValueError):
        G.walk(edges, seeds, 1, direction="up")


def test_paths(spark):
    names, rows = some_graph(4)
    hop = {}
    for i, s, _, o, c in sorted(rows):
        hop.setdefault((s, o), c)
    pairs = [(a, b) for a in names[:4] for b in names[:4]]
    want = set()
    for a, b in pairs:
        found, todo = [], [([a], 1.0)]
        while todo:
            path, w = todo.pop()
            if path[-1] == b:
                found.append((path, w))
            elif len(path) <= 3:
                todo += [([*path, o], w * c) for (s, o), c in hop.items() if s == path[-1] and o not in path]
        want |= {(a, b, ">".join(p), round(w, 6)) for p, w in sorted(found)[:5]}
    got = G.paths_between(spark.createDataFrame(rows, EDGES), spark.createDataFrame(pairs, "source string, target string"), 3, 5)
    assert {(r["source"], r["target"], r["path"], r["weight"]) for r in got.collect()} == want


def test_ranks(spark):
    names, rows = some_graph(5)
    edges = spark.createDataFrame(rows, EDGES)
    verts = spark.createDataFrame([(n,) for n in [*names, "alone"]], "id string")
    out = defaultdict(float)
    for _, s, _, _, c in rows:
        out[s] += c
    ids = [*names, "alone"]
    for seeds in (None, ["n01", "n02", "missing"]):
        base = {n: 1 / len(ids) if seeds is None else (n in seeds) / 3 for n in ids}
        rank = dict(base)
        for _ in range(200):
            lost = sum(rank[n] for n in ids if not out[n])
            new = {n: 0.15 * base[n] + 0.85 * lost / len(ids) for n in ids}
            for _, s, _, o, c in rows:
                new[o] += 0.85 * rank[s] * c / out[s]
            rank = new
        start = None if seeds is None else spark.createDataFrame([(s,) for s in seeds], "id string")
        got = {r["id"]: r["rank"] for r in G.pagerank(edges, 100, seeds=start, tolerance=1e-9, verts=verts).collect()}
        assert got == pytest.approx(rank, abs=1e-6) and got["alone"] > 0
    both = G.personal_ranks(edges, spark.createDataFrame([(1, "n01"), (2, "n02")], "query_id int, id string"), verts)
    assert {r["q"]: round(r["s"], 5) for r in both.groupBy("query_id").agg({"rank": "sum"}).toDF("q", "s").collect()} == {1: 1.0, 2: 1.0}


def test_statistics_and_numbers(spark):
    edges = spark.createDataFrame([("1", "a", "p", "b", 1.0), ("2", "c", "p", "c", 1.0)], EDGES)
    row = G.full_statistics(edges, spark.createDataFrame([("a",), ("d",)], "id string")).first()
    assert (row["entities"], row["components"], row["isolated"]) == (4, 3, 2)
    rows = spark.createDataFrame([(f"{i * 7919 % 1000:04d}",) for i in range(1000)], "k string").repartition(5)
    assert [r["n"] for r in G.ordered_number(rows, "k", "n").orderBy("k").collect()] == list(range(1000))
    assert G.ordered_number(rows.limit(0), "k", "n").count() == 0


def test_links_take_the_longest_name(spark):
    entities = spark.createDataFrame([("e1", "Acme", "C", "", ["the firm"]), ("e2", "Acme Corp", "C", "", None), ("e3", "x", "C", "London", []), ("e4", "acme", "C", "", [])], "id string, name string, entity_type string, canonical_name string, aliases array<string>")
    asked = spark.createDataFrame([(1, "Acme. Corp in LONDON, acme"), (2, "The Firm"), (3, "nothing"), (4, ""), (5, None)], "query_id int, text string")
    assert sorted((r["query_id"], r["place"], r["entity_id"]) for r in H.link(asked, entities).collect()) == [(1, 0, "e2"), (1, 1, "e3"), (1, 2, "e1"), (2, 0, "e1")]
    assert H.link(asked, entities.limit(0)).count() == 0
    assert {r["query_id"]: r["entity_ids"] for r in H.analyze(asked, entities).collect()}[3] == []


def test_answers(spark):
    """What is around a query's entities; queries without any get nothing, and unknown ones no confidence."""
    from gnomon import corpus

    kb = corpus.knowledge_base(spark)
    asked = spark.createDataFrame([(1, "Ada Lovelace and London"), (2, "nothing here"), (3, "Cambridge?")], "query_id int, text string")
    a = H.answer(kb, asked, chunks=False)
    sure = {r["query_id"]: r["confidence"] for r in a.confidence.collect()}
    assert sure == {1: 1.0, 2: 0.0, 3: 1.0} and a.retrieval is None
    names = {r["id"]: r["name"] for r in kb.entities.collect()}
    paths = [(">".join(names[x] for x in r["path"].split(">")), r["weight"]) for r in a.paths.where("query_id = 1").orderBy("place").collect()]
    assert ("Ada Lovelace>Acme Corp>London", 1.0) in paths and a.entities.where("query_id = 2").count() == 0
    got = H.retrieve(kb, asked, 3, methods=("entity", "lexical"), rounds=5)
    assert got.where("query_id = 2 and array_contains(map_keys(contributions), 'entity')").count() == 0 and got.groupBy("query_id").count().where("count > 3").count() == 0
    with pytest.raises(ValueError):
        H.retrieve(kb, asked, methods=("magic",))
    filtered = H.dense(kb.embeddings, asked, 5, {"source_id": "src-corpus-01"})
    assert filtered.select("object_id").distinct().count() == 1
    with pytest.raises(ValueError):
        H.dense(kb.embeddings, asked, -1)
    assert H.dense(kb.embeddings, asked, 0).count() == 0


def test_pairs_are_counted_in_packed_groups(spark):
    """The pairs of two groups of nodes are made and counted in one task from packed numbers, never shuffled one by one."""
    rows = sorted({(i * i % 41, i * 7 % 19, i * i % 41 % 3 == 0) for i in range(400)})
    got = G._counted_pairs(spark.createDataFrame(rows, "x long, y long, light boolean"), 41, (3, 1), 5, most=60)
    near, light = {}, {x: b for x, _, b in rows}
    for x, y, _ in rows:
        near.setdefault(x, set()).add(y)
    more = lambda a, b: 3 if light[a] or light[b] else 1
    want = [(a, b, len(near[a] & near[b]), more(a, b)) for a in near for b in near if a < b and near[a] & near[b] and len(near[a] & near[b]) + more(a, b) >= 5]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want
