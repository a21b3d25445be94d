import pytest
from pyspark.sql import functions as F

from quern.operators import graph as G


def seeds(rows, *ids):
    return rows("node string", *[(i,) for i in ids])


def test_neighborhood_decays(rows):
    e = rows("src string, dst string, weight double", ("mem1", "router", 1.0), ("mem1", "form", 0.8), ("mem2", "form", 1.0))
    got = {r.node: (r.depth, r.weight) for r in G.neighborhood(e, seeds(rows, "router"), 2).collect()}
    assert got == {"mem1": (1, 1.0), "form": (2, 0.48)}


def test_reach_ends_on_cycles(rows):
    e = rows("src string, dst string", ("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"))
    assert {(r.node, r.depth) for r in G.reach(e, seeds(rows, "a"), 50).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert G.reach(e, seeds(rows), 3).count() == 0


def test_cascade_marks_both(rows):
    e = rows("src string, dst string, edge_type string", ("v1", "service.py", "applies_to"), ("v1", "v2", "supersedes"))
    m = rows("id string, confidence double", ("v1", 0.9), ("v2", 0.1), ("v3", 0.5))
    got = {r.id: r for r in G.stale_cascade(e, m, "service.py", "rewritten").collect()}
    assert set(got) == {"v1", "v2"} and got["v1"].confidence == 0.45 and got["v2"].confidence == 0.1
    assert "rewritten" in got["v1"].stale_reason


def test_tree_means_and_uct(rows):
    n = rows("id string, parent_id string, reward double", ("r", None, 0.0), ("c1", "r", 8.0), ("c2", "r", -5.0))
    back = {x.id: (x.visits, x.value) for x in G.backpropagate(n).collect()}
    assert back["r"] == (3, 1.0)
    uct = {x.id: x.uct for x in G.ucb_tree(n.join(G.backpropagate(n), "id").select("id", "parent_id", "visits", "value")).collect()}
    assert uct["c1"] == pytest.approx(9.4823, abs=1e-3) and uct["c2"] == pytest.approx(-3.5177, abs=1e-3)


def test_communities_keep_components_apart(rows):
    e = rows(
        "src string, dst string, weight double",
        ("a1", "a2", 0.9), ("a2", "a3", 0.85), ("a1", "a3", 0.95), ("l1", "l2", 0.9), ("l2", "l3", 0.8), ("b1", "b2", 0.9), ("b2", "b3", 0.85),
    )
    labels = {r.node: r.community for r in G.communities(e).collect()}
    assert all(labels[n][0] == n[0] for n in labels) and len(set(labels.values())) >= 3
    assert labels["a1"] == labels["a2"] == labels["a3"]
    change = rows("change int, node string", (1, "a1"), (1, "a2"), (2, "a1"), (2, "b1"))
    alerts = {r.change: r.alert for r in G.crosses_domains(change, G.communities(e)).collect()}
    assert alerts == {1: False, 2: True}


def plain_communities(edges, rounds=4, least=0.3):
    weight = {}
    for a, b, w in edges:
        if a != b:
            weight[a, b] = weight[b, a] = max(w, weight.get((a, b), 0))
    labels = {a: a for a, _ in weight}
    for k in range(rounds):
        after = {}
        for n, own in labels.items():
            pull = {}
            for (a, b), w in weight.items():
                if a == n:
                    pull[labels[b]] = pull.get(labels[b], 0) + w
            strong = {label: round(p, 9) for label, p in pull.items() if p > least}
            stay, moved = round(pull.get(own, 0), 9), own
            if strong:
                label = min(x for x in strong if strong[x] == max(strong.values()))
                if strong[label] > stay or (strong[label] == stay and label < own):
                    moved = label
            after[n] = moved if k % 2 else min(moved, own)
        labels = after
    return labels


def test_communities_equal_brute_force(rows):
    import random

    rng = random.Random(8)
    edges = [(rng.randrange(40), rng.randrange(40), rng.randrange(1, 10) / 10) for _ in range(90)]
    got = {r.node: r.community for r in G.communities(rows("src long, dst long, weight double", *edges)).collect()}
    assert got == plain_communities(edges) and len(set(got.values())) > 3


def test_topological_order_puts_cycles_last(rows):
    n = seeds(rows, "app", "core", "util", "x", "y")
    e = rows("src string, dst string", ("app", "core"), ("core", "util"), ("app", "util"), ("x", "y"), ("y", "x"))
    got = [(r.node, r.level) for r in G.topological_order(n, e).orderBy("place").collect()]
    assert got == [("util", 0), ("core", 1), ("app", 2), ("x", None), ("y", None)]


def test_simple_paths_shortest_first(rows):
    e = rows("src string, dst string", ("a", "b"), ("b", "d"), ("a", "c"), ("c", "b"), ("b", "a"))
    got = [r.path for r in G.simple_paths(e, "a", "d", 5, None).collect()]
    assert got == [["a", "b", "d"], ["a", "c", "b", "d"]]
    assert G.simple_paths(e, "a", "d").count() == 1


def test_contract_drift_kinds(rows):
    served = rows("path string, method string, tagged boolean, file string", ("/a", "GET", True, "s"), ("/b", "GET", False, "s"))
    used = rows("id int, path string, method string, tagged boolean, file string", (1, "/a", "GET", False, "c"), (2, "/b", "POST", False, "c"), (3, "/x", "GET", False, "c"), (4, "/b", "GET", False, "c"))
    assert {(r.id, r.drift) for r in G.contract_drift(served, used).collect()} == {(1, "UNSYNCHRONIZED"), (2, "METHOD_MISMATCH"), (3, "ORPHAN")}
    assert {(r.src, r.dst) for r in G.cross_edges(served, used).collect()} == {("c", "s")}


def test_cone_falls_back_to_nearest(rows):
    e = rows("src string, dst string", ("a", "b"))
    ripples = rows("id int, node string, gradient double, s double", (1, "far", 0.9, 0.5), (2, "far", 0.1, 0.9))
    got = G.cone_search(e, seeds(rows, "a"), ripples, F.col("s")).collect()
    assert [(r.id, r.depth) for r in got] == [(1, -1)]
    near = ripples.unionAll(rows("id int, node string, gradient double, s double", (3, "b", 0.9, 0.5)))
    assert [(r.id, r.depth) for r in G.cone_search(e, seeds(rows, "a"), near, F.col("s")).collect()] == [(3, 1)]


def test_mermaid(rows):
    assert G.mermaid(rows("src string, dst string", ("a", "b"))).splitlines() == ["graph LR", '    n0["a"]', '    n1["b"]', "    n0 --> n1"]


CHAIN = 1500


def chain(rows, edge_type=None):
    return rows("src long, dst long, edge_type string", *[(k, k + 1, edge_type) for k in range(CHAIN)])


def test_stale_cascade_reaches_the_end_of_a_chain(rows):
    memories = rows("id long, confidence double", *[(k, 0.9) for k in range(1, CHAIN + 1)])
    edges = chain(rows, "derived_from").unionAll(rows("src long, dst long, edge_type string", (0, 1, "applies_to")))
    got = {r.id: r.depth for r in G.stale_cascade(edges.where("not (src = 0 and edge_type = 'derived_from')"), memories, 0, "x").collect()}
    assert got == {k: k - 1 for k in range(1, CHAIN + 1)}


def plain_depths(edges, start):
    depth, frontier = dict.fromkeys(start, 0), list(start)
    while frontier:
        frontier = list(dict.fromkeys(b for a in frontier for x, b in edges if x == a and b not in depth))
        depth |= {b: max(depth.values()) + 1 for b in frontier}
    return depth


def test_reach_with_nulls_at_every_depth(rows, monkeypatch):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("d", None), (None, "a"), ("d", "e"), ("e", "f")]
    edges, some = rows("src string, dst string", *pairs), rows("node string", ("a",), ("q",), (None,), ("a",))
    want = {("a", 0), ("q", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4), ("f", 5)}
    for hops in (8, 2):
        monkeypatch.setattr(G, "HOPS", hops)
        for depth in (None, 20, 8, 3, 0):
            got = {(r.node, r.depth) for r in G.reach(edges, some, depth).collect()}
            assert got == {(n, d) for n, d in want if depth is None or d <= depth}


def test_reach_over_chains_ladders_and_loops(rows, monkeypatch):
    import random

    rng = random.Random(7)
    monkeypatch.setattr(G, "HOPS", 3)
    pairs = [(k, k + 1) for k in range(60)] + [(100 + k, 101 + k) for k in range(40)] + [(140, 100), (20, 100), (120, 30), (5, 50)]
    pairs += [(200 + k, 200 + rng.randrange(40)) for k in range(40)] + [(60, 200), (300, 301), (301, 300), (301, 302), (301, 0)]
    edges = rows("src long, dst long", *pairs)
    got = {r.node: r.depth for r in G.reach(edges, rows("node long", (0,), (110,))).collect()}
    assert got == plain_depths(pairs, [0, 110])


def test_bounded_walks_are_one_plan(spark, rows):
    """No table is written and nothing is counted before the result is asked for."""
    edges = rows("src long, dst long, weight double", *[(k, (k * 7 + 3) % 50, 1.0) for k in range(50)], *[(k, (k * 3 + 1) % 50, 1.0) for k in range(50)])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("walks", "")
    walks = [G.incoming(edges, rows("node long", (1,)), 5), G.blast_edges(edges, rows("node long", (1,)), 5), G.neighborhood(edges, rows("node long", (1,)), 3)]
    assert len(tracker.getJobIdsForGroup("walks")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    pairs = [(r.dst, r.src) for r in edges.collect()]
    assert {(r.node, r.depth) for r in walks[0].collect()} == {(n, d) for n, d in plain_depths(pairs, [1]).items() if 0 < d <= 5}


def plain_levels(nodes, pairs):
    deps, level = {n: {b for a, b in pairs if a == n and b in nodes and b != n} for n in nodes}, {}
    while True:
        ready = [n for n in nodes if n not in level and all(d in level for d in deps[n])]
        if not ready:
            return level | dict.fromkeys(set(nodes) - set(level))
        level |= {n: max((level[d] + 1 for d in deps[n]), default=0) for n in ready}


def test_topological_order_of_a_long_chain_and_cycles(rows):
    nodes = rows("node long", *[(k,) for k in range(CHAIN + 4)])
    loop = rows("src long, dst long, edge_type string", (CHAIN + 1, CHAIN + 2, None), (CHAIN + 2, CHAIN + 1, None), (CHAIN + 3, CHAIN + 1, None))
    got = {r.node: r.level for r in G.topological_order(nodes, chain(rows).unionAll(loop)).collect()}
    assert got == {k: CHAIN - k for k in range(CHAIN + 1)} | dict.fromkeys(range(CHAIN + 1, CHAIN + 4))


def test_topological_order_equals_peeling(rows, monkeypatch):
    import random

    rng = random.Random(3)
    monkeypatch.setattr(G, "HOPS", 2)
    for seed in (0, 2):
        nodes = list(range(80))
        pairs = [(k, k - 1) for k in range(1, 40)] + [(k, rng.randrange(k)) for k in rng.choices(range(10, 80), k=40)] + [(k, rng.randrange(80)) for k in rng.choices(nodes, k=3 * seed)]
        if seed == 2:
            pairs += [(70, 71), (71, 72), (72, 70), (73, 70), (5, 5)]
        edges = rows("src long, dst long", *pairs, (1, 999), (None, 2), (3, None))
        got = {r.node: r.level for r in G.topological_order(rows("node long", *[(n,) for n in nodes], (None,), (1,)), edges).collect()}
        assert got == plain_levels(nodes, pairs)


def test_cycles_are_told_from_nodes_around_them(rows):
    import random

    rng = random.Random(5)
    ring = [(1000 + k, 1000 + (k + 1) % 60) for k in range(60)]
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("z", "a"), ("e", "q"), ("m", "m"), ("m", "n"), (None, "a"), ("a", None)]
    got = {r.node: r.cycle for r in G.cycles(rows("src string, dst string", *pairs)).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c", "m": "m"}
    some = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)]
    down = {n: set(plain_depths(some, [n])) for n in range(60)}
    want = {n: min(m for m in down[n] if n in down[m]) for n in range(60) if any(m != n and n in down[m] for m in down[n]) or (n, n) in some}
    got = {r.node: r.cycle for r in G.cycles(rows("src long, dst long", *some, *ring, (5, 1000))).collect()}
    assert got == want | {k: 1000 for k in range(1000, 1060)}
    assert G.cycles(rows("src long, dst long", (1, 2))).count() == 0


def test_sums_and_ancestors_of_deep_trees(rows):
    import random

    rng = random.Random(2)
    parent = {k: rng.randrange(k) if k > 700 else k - 1 for k in range(1, 900)} | {0: None, 5000: 4999}
    tree = rows("id long, parent_id long, reward double", *[(k, p, float(k % 7)) for k, p in parent.items()])
    visits, total = dict.fromkeys(parent, 0), dict.fromkeys(parent, 0.0)
    for k in parent:
        up = k
        while up in parent:
            visits[up], total[up] = visits[up] + 1, total[up] + k % 7
            up = parent[up]
    got = {r.id: (r.visits, r.value) for r in G.backpropagate(tree).collect()}
    assert {k: v for k, (v, _) in got.items()} == visits and all(abs(got[k][1] - total[k] / visits[k]) < 1e-6 for k in parent)
    small = tree.where("id <= 40")
    pairs = {(r.node, r.ancestor, r.distance) for r in G.ancestors(small).collect()}
    assert pairs == {(a, b, a - b) for a in range(41) for b in range(a + 1)}
    with pytest.raises(ValueError):
        G.backpropagate(rows("id long, parent_id long, reward double", (1, 2, 0.0), (2, 1, 0.0), (3, None, 1.0)))


def test_speculative_contracts_of_a_lonely_file(rows):
    files = rows("node long, path string", (1, "a/x.py"), (2, "a/y.py"), (3, "b/z.py"))
    symbols = rows("node long, name string, start_line long", (2, "f", 1), (3, "g", 1))
    none = rows("src long, dst long", (3, 3))
    assert [r.name for r in G.speculative_contracts(none, symbols, 1, files=files).collect()] == ["f"]


def test_cross_edges_exchange_no_pairs(rows):
    """Files that share several paths are one edge, told without a distinct over the pairs."""
    served = rows("path string, file string", *[(f"/p{k % 3}", f"s{k % 7}") for k in range(60)], (None, "s0"), ("/x", None))
    used = rows("path string, file string", *[(f"/p{k % 4}", f"c{k % 9}") for k in range(60)], (None, "c0"), ("/x", "c0"))
    pairs = served.withColumnRenamed("file", "dst").join(used.withColumnRenamed("file", "src"), "path").select("src", "dst")
    for block in (2, 4096):
        got = G.cross_edges(served, used, block)
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == {tuple(r) for r in pairs.collect()}
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert not plan.startswith(("Aggregate", "Deduplicate", "Distinct"))


def test_cross_edges_deal_pairs_of_blocks_to_tasks(rows):
    """Few callers and servers make many pairs: these are the work of many tasks, however small the tables."""
    served = rows("path string, file string", *[("/p", f"s{k}") for k in range(40)], ("/q", "s1"), ("/q", None), ("/p", None))
    used = rows("path string, file string", *[("/p", f"c{k}") for k in range(40)], ("/q", "c1"), ("/q", None))
    got = G.cross_edges(served, used, 8)
    assert got.rdd.getNumPartitions() >= 50
    found = [tuple(r) for r in got.collect()]
    want = {(f"c{k}", s) for k in range(40) for s in [None, *(f"s{n}" for n in range(40))]} | {(None, "s1"), (None, None)}
    assert len(found) == len(set(found)) and set(found) == want


def test_long_walks_broadcast_nothing(rows, monkeypatch):
    plans, write = [], G.materialize

    def seen(df, label, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label, *more)

    monkeypatch.setattr(G, "materialize", seen)
    edges = rows("src long, dst long", *[(k, k + 1) for k in range(20)], (20, 11))
    assert {r.node: r.depth for r in G.reach(edges, rows("node long", (0,))).collect()} == {k: k for k in range(21)}
    assert len(plans) > 2 and not any("BroadcastHashJoin" in p for p in plans)
