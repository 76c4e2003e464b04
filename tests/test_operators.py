import collections
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from codequarry.operators import budget, fulltext, graph, lookup, resolve, state, stats

SYMBOLS = "symbol_id long, path string, name string, qualified_name string, kind string, start_line long, end_line long, is_private boolean"


@pytest.fixture(scope="module")
def symbols(spark):
    rows = [(1, "src/a.py", "logIn", "A.logIn", "method", 1, 9, False), (2, "src/a.py", "login", "login", "function", 12, 20, False), (3, "tests/t.py", "loginTest", "loginTest", "function", 1, 5, False), (4, "src/b.py", "Service", "Service", "class", 1, 50, False), (5, "src/b.py", "run", "Service.run", "function", 3, 10, True)]
    return spark.createDataFrame(rows, SYMBOLS)


def edge_table(spark, rows):
    full = [(k, a, b, c, "resolved", "lexical") for k, (a, b, c) in enumerate(rows)]
    return spark.createDataFrame(full, "edge_id long, source_symbol_id long, target_symbol_id long, confidence double, status string, backend string")


def test_find_symbols(symbols):
    ids = lambda df: [r.symbol_id for r in df.collect()]
    assert ids(lookup.find_symbols(symbols, "login")) == [2, 1, 3]
    assert ids(lookup.find_symbols(symbols, "log??")) == [1, 2] or set(ids(lookup.find_symbols(symbols, "log??"))) == {1, 2}
    assert ids(lookup.find_symbols(symbols, "run", kind="method")) == [5]
    assert lookup.count_symbols(symbols, "*in").first().n == 2


def test_innermost_and_parents(spark, symbols):
    points = spark.createDataFrame([("src/b.py", 4), ("src/b.py", 40), ("src/b.py", 99)], "path string, line long")
    assert {r.line: r.symbol_id for r in lookup.innermost(points, symbols).collect()} == {4: 5, 40: 4, 99: None}
    h = spark.createDataFrame([(9, "x.Service"), (9, "nothing")], "class_symbol_id long, parent_name string")
    assert {r.parent_name: r.parent_symbol_id for r in lookup.parents(h, symbols).collect()} == {"x.Service": 4, "nothing": None}


def test_differences(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(tuple(r) for r in lookup.multiset_diff(a, b).collect()) == [(1, "left"), (2, "left"), (3, "right")]
    old = spark.createDataFrame([("a", "m", 1), ("b", "m", 2), ("b", "m", 3)], "q string, k string, id int")
    new = spark.createDataFrame([("a", "m", 7), ("b", "m", 8)], "q string, k string, id int")
    assert [tuple(r) for r in lookup.unique_remap(old, new, ["q", "k"], "id").collect()] == [("a", "m", 1, 7)]


def test_bm25(spark):
    docs = spark.createDataFrame([("1", "red fox", "the red fox runs"), ("2", "blue", "red red red"), ("3", "grey", "nothing here"), ("4", "x", "y"), ("5", "z", "fox")], "id string, name string, body string")
    fields = {"name": 10.0, "body": 1.0}
    n, avg = fulltext.corpus_size(docs, list(fields))
    got = {r.id: r.score for r in fulltext.bm25(fulltext.inverted_index(docs, "id", fields), n, avg, ["red", "fox"]).collect()}
    want = {}
    rows = [(r.id, r.name.split(), r.body.split()) for r in docs.collect()]
    for term in ("red", "fox"):
        df = sum(term in a + b for _, a, b in rows)
        idf = max(math.log((5 - df + 0.5) / (df + 0.5)), 1e-6)
        for i, a, b in rows:
            f = 10 * a.count(term) + b.count(term)
            if f:
                want[i] = want.get(i, 0) - idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * (len(a) + len(b)) / avg))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_traversal(spark):
    e = edge_table(spark, [(1, 2, 0.9), (1, 3, 0.9), (2, 4, 0.9), (3, 5, 0.9), (4, 6, 0.9), (7, 1, 0.9)])
    nodes, kept, limited = graph.bounded_bfs(e, 1, "callees", 2, 100)
    assert {r.symbol_id: r.level for r in nodes.collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 2} and kept.count() == 4 and not limited
    nodes, kept, limited = graph.bounded_bfs(e, 1, "callees", 2, 3)
    assert sorted(r.symbol_id for r in nodes.collect()) == [1, 2, 3] and kept.count() == 4 and limited
    nodes, _, _ = graph.bounded_bfs(e, 1, "both", 1, 100)
    assert sorted(r.symbol_id for r in nodes.collect()) == [1, 2, 3, 7]


def test_edges_of_a_walk_need_no_unique_ids(spark):
    e = edge_table(spark, [(1, 2, 0.9), (2, 3, 0.9), (4, 5, 0.9), (3, 1, 0.9), (2, 1, 0.9)]).withColumn("edge_id", F.lit(0).cast("long"))
    ends = lambda kept: sorted((r.source_symbol_id, r.target_symbol_id) for r in kept.collect())
    assert ends(graph.levels(e, 3, "callers", 2)[1]) == [(1, 2), (2, 3)] and ends(graph.levels(e, 1, "callees", 2)[1]) == [(1, 2), (2, 1), (2, 3)]
    assert ends(graph.levels(e, 1, "both", 1)[1]) == [(1, 2), (2, 1), (3, 1)]
    assert ends(graph.bounded_bfs(e, 1, "both", 1, 9)[1]) == [(1, 2), (2, 1), (3, 1)] and ends(graph.bounded_bfs(e, 3, "callers", 1, 9)[1]) == [(2, 3)]


def test_pagerank(spark):
    rng = random.Random(1)
    ids = list(range(30))
    rows = sorted({(rng.choice(ids[:20]), rng.choice(ids[:20])) for _ in range(60)})
    rows = [(a, b, rng.choice([0.5, 0.7, 0.9])) for a, b in rows]
    s = spark.createDataFrame([(i,) for i in ids], "symbol_id long")
    weight = {}
    for a, b, c in rows:
        if c >= 0.6:
            weight[a, b] = weight.get((a, b), 0) + c
            weight[b, a] = weight.get((b, a), 0) + 0.3 * c
    out = {i: sum(w for (a, _), w in weight.items() if a == i) for i in ids}
    p = {i: 1 / 30 for i in ids}
    for _ in range(30):
        lost = sum(p[i] for i in ids if not out[i])
        p = {i: 0.15 / 30 + 0.85 * lost / 30 + 0.85 * sum(p[a] * w / out[a] for (a, b), w in weight.items() if b == i) for i in ids}
    got = {r.symbol_id: r["rank"] for r in graph.pagerank(s, edge_table(spark, rows)).collect()}
    assert all(abs(got[i] - 30 * p[i]) < 1e-9 for i in ids)


def test_expansion_and_hubs(spark):
    rows = [(1, 2, 0.9), (2, 3, 0.8), (4, 1, 0.7), (1, 5, 0.5)] + [(k, 2, 0.9) for k in range(20, 40)]
    s = spark.createDataFrame([(k, "tests/x.py" if k == 4 else f"src/{k}.py", f"name{k}", f"name{k}", "function", 1, 2, False) for k in range(1, 60)], SYMBOLS)
    e = edge_table(spark, rows)
    assert [r.symbol_id for r in graph.hubs(s, e).collect()] == [2]
    found = {r.symbol_id: (r.relation, round(r.score, 6)) for r in graph.expand(s, e, [1], [], k=50).collect()}
    assert found[2] == ("callee", 0.45) and found[3] == ("callee", 0.72) and found[4] == ("test", 0.35) and 5 not in found and found[20] == ("callee", 0.81)


def test_closure_of_a_deep_chain(spark):
    h = spark.createDataFrame([(f"c{k}", f"c{k + 1}") for k in range(20)], "class_name string, parent_name string")
    assert sorted(tuple(r) for r in graph.ancestors(h).collect()) == sorted((f"c{a}", f"c{b}", b - a) for a in range(21) for b in range(a + 1, 21))


def test_closure_and_communities(spark):
    h = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("A", "C")], "class_name string, parent_name string")
    assert sorted(tuple(r) for r in graph.ancestors(h).filter("class_name = 'A'").collect()) == [("A", "B", 1), ("A", "C", 1)]
    assert graph.label_propagation(["a", "b", "c", "d", "e"], [("a", "b"), ("b", "c"), ("d", "e")]) == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1}


def test_label_propagation():
    """Against the definition, on graphs with hubs, loops, repeated and unknown links."""
    rng = random.Random(2)
    for _ in range(60):
        paths = [f"p{k:02}" for k in range(rng.randint(1, 25))]
        links = [(rng.choice(paths + ["none"]), rng.choice(paths[:5])) for _ in range(rng.randint(0, 40))]
        label = {p: p for p in paths}
        for _ in range(20):
            moved = False
            for p in sorted(paths):
                near = {b if a == p else a for a, b in links if p in (a, b) and a != b and {a, b} <= set(paths)}
                if near:
                    votes = collections.Counter(label[q] for q in near)
                    new = min(x for x in votes if votes[x] == max(votes.values()))
                    moved |= new != label[p]
                    label[p] = new
            if not moved:
                break
        order = list(dict.fromkeys(label[p] for p in sorted(paths)))
        assert graph.label_propagation(paths, links) == {p: order.index(label[p]) for p in paths}


def test_local_push(spark):
    """Against the same pushes in plain Python; the rest left is below its bound, so ranks are near the exact ones."""
    rng = random.Random(3)
    ids = list(range(40))
    rows = [(rng.choice(ids[:30]), rng.choice(ids[:30]), rng.choice([0.4, 0.6, 0.9])) for _ in range(70)]
    weight = {}
    for a, b, c in rows:
        if c >= 0.5:
            weight[a, b] = weight.get((a, b), 0) + c
            weight[b, a] = weight.get((b, a), 0) + c
    degree = {i: sum(w for (a, _), w in weight.items() if a == i) for i in ids}
    seeds = {1: 1.0, 2: 2.25, 35: 1.75}
    p, r = {i: 0.0 for i in ids}, {i: seeds.get(i, 0) / 5 for i in ids}
    for i in ids:
        if not degree[i]:
            p[i], r[i] = r[i], 0.0
    while any(degree[i] and r[i] >= 1e-4 * degree[i] for i in ids):
        ready = {i: r[i] for i in ids if degree[i] and r[i] >= 1e-4 * degree[i]}
        for i, x in ready.items():
            p[i] += 0.15 * x
            r[i] -= x
        for (a, b), w in weight.items():
            if a in ready:
                r[b] += 0.85 * ready[a] * w / degree[a]
    s = spark.createDataFrame([(i,) for i in ids], "symbol_id long")
    got = {x.symbol_id: x["rank"] for x in graph.local_push_ppr(s, edge_table(spark, rows), spark.createDataFrame(list(seeds.items()), "symbol_id long, weight double")).collect()}
    mean = sum(p.values()) / len(ids)
    assert got.keys() == set(ids) and all(abs(got[i] - p[i] / mean) < 1e-9 for i in ids) and got[35] > 0 and got[39] == p[39] / mean
    assert {x["rank"] for x in graph.local_push_ppr(s, edge_table(spark, rows), spark.createDataFrame([], "symbol_id long, weight double")).collect()} == {1.0}


def test_resolution(spark):
    rows = [
        (1, "src/a.py", "self", "A.go", None, 1, 10, "A.f", "src/a.py", 5, 1), (1, "src/a.py", "self", "A.go", None, 1, 11, "B.f", "src/b.py", 5, 1),
        (2, "src/a.py", None, "go", None, 1, 12, "g", "src/c.py", 5, 1), (2, "src/a.py", None, "go", None, 1, 13, "h.g", "src/d.py", 5, 1),
        (3, "x/a.py", None, "go", None, 2, 14, "o", "y/c.py", 5, 1), (3, "x/a.py", None, "go", None, 2, 15, "o", "y/c.py", 9, 2),
        (4, "x/a.py", None, "go", ["pkg.m"], 2, 16, "i", "z/m.py", 5, 1), (4, "x/a.py", None, "go", ["pkg.m"], 2, 17, "i", "q/m.py", 5, 1),
    ]
    c = spark.createDataFrame(rows, "call_id int, call_path string, receiver string, caller_qualified string, imported array<string>, arg_count int, symbol_id long, qualified_name string, path string, start_line int, n_params int")
    c = c.withColumns({"receiver_type": F.lit(None).cast("string"), "namespace": F.lit(None).cast("string"), "call_namespace": F.lit(None).cast("string"), "candidate_modules": F.when(F.col("path") == "z/m.py", F.array(F.lit("pkg.m"))).otherwise(F.array(F.lit("other")))})
    got = {r.call_id: (r.target_symbol_id, r.status, r["scope"], r.confidence) for r in resolve.decide(c, ["call_id"], resolve.scopes()).collect()}
    assert got == {1: (10, "resolved", "same_class", 0.95), 2: (None, "ambiguous", "ambiguous", 0.10), 3: (15, "resolved", "overload_arity", 0.85), 4: (16, "resolved", "import_match", 0.90)}


def test_budgets(spark):
    taken = lambda xs, b: spark.range(1).select(budget.first_fit(F.array(*[F.lit(x).cast("long") for x in xs]), b)).first()[0]
    assert taken([5, 9, 2, 4], 10) == [True, False, True, False] and taken([50, 1], 10) == [True, False]
    items = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 2)], "g string, o int, c int")
    assert [r.o for r in budget.pack_first_fit(items, "g", "o", "c", 10).filter("taken").collect()] == [1, 3]
    assert [r.o for r in budget.prefix_fit(items, "g", [F.col("o")], "c", 10).collect()] == [1]
    e = budget.envelope(items, [F.col("o")], "c", 14, repo_id="r").first()
    assert (e.used_tokens, e.truncated, e.data.count("\n"), e.repo_id) == (14, True, 1, "r")
    p = budget.packet({"target": [("t", 20)], "callees": [("c", 60), ("d", 60)]}, 100)
    assert p["target"] == ["t"] and p["callees"] == [] or sum(map(len, p.values())) >= 1


def test_rate_limit_and_locks(spark):
    e = spark.createDataFrame([("a", float(t), k) for k, t in enumerate([0, 1, 2, 61, 62])], "agent string, t double, id long")
    assert [r.accepted for r in state.rate_limit(e, "agent", "t", 2, 60.0).orderBy("id").collect()] == [True, True, False, True, True]
    q = spark.createDataFrame([("k", 0.0, 1, "x"), ("k", 5.0, 2, "y"), ("k", 6.0, 3, "x"), ("k", 16.0, 4, "y"), ("k", 17.0, 5, "x")], "resource_key string, at double, seq long, agent_id string")
    assert [r.acquired for r in state.locks(q, 10.0).orderBy("seq").collect()] == [True, False, True, True, False]


def test_ledger(spark):
    rows = [("s1", 1, "r1", "a"), ("s1", 2, "r1", "a"), ("s1", 3, "r2", "a"), ("s2", 1, "r1", "a"), ("s2", 2, "r2", "b"), ("s2", 3, "r3", "a"), ("s3", 1, "r1", "a"), ("s3", 2, "r1", "b"), ("s3", 3, "r2", "b")]
    got = {r.sig_hash: (r.status, r.confirmations) for r in state.ledger(spark.createDataFrame(rows, "sig_hash string, seq long, run_id string, answer string")).collect()}
    assert got == {"s1": ("confirmed", 2), "s2": ("conflicted", 1), "s3": ("confirmed", 2)}
    rows = [("s1", 1, "r1", ["a"], ["b"], None), ("s1", 2, "r2", ["b"], [], None), ("s2", 1, "r1", ["a"], [], None), ("s2", 2, "r1", [], [], True), ("s2", 3, "r2", ["c"], [], None), ("s3", 1, "r1", ["a"], [], None), ("s3", 2, "r1", ["a"], ["a"], None), ("s4", 1, "r1", ["a", "b"], [], None), ("s4", 2, "r2", ["b", "a"], [], None)]
    got = {r.sig_hash: (r.status, r.confirmations, r.n_submissions) for r in state.ledger(spark.createDataFrame(rows, "sig_hash string, seq long, run_id string, answers array<string>, decoys array<string>, retire boolean")).collect()}
    assert got == {"s1": ("conflicted", 1, 2), "s2": ("asserted", 1, 3), "s3": ("conflicted", 1, 2), "s4": ("confirmed", 2, 2)}


def test_memory(spark):
    old = spark.createDataFrame([("s", "n", "a", 1, "x"), ("s", "n", "b", 1, "y")], "scope string, namespace string, key string, seq int, value string")
    new = spark.createDataFrame([("s", "n", "b", 2, None), ("s", "n", "c", 2, "z")], "scope string, namespace string, key string, seq int, value string")
    assert {r.key: (r.seq, r.value) for r in state.merge(old, new, state.KEY).collect()} == {"a": (1, "x"), "b": (2, None), "c": (2, "z")}
    assert {r.key: r.value for r in state.merge(old, new, state.KEY, keep_if_null=True).collect()}["b"] == "y"
    agents = spark.createDataFrame([("a", "paused", "full", None), ("b", "active", "read_only", None), ("c", "active", "custom", ["t"])], "agent_id string, status string, policy string, custom_tools array<string>")
    requests = spark.createDataFrame([("a", "x", True), ("b", "write", True), ("b", "read", True), ("c", "u", True), ("c", "t", False), ("d", "t", True)], "agent_id string, tool_name string, accepted boolean")
    reasons = [r.reason for r in state.access(requests, agents, False, ["read"]).orderBy("agent_id", "tool_name").collect()]
    assert reasons == ["agent_paused", None, "policy_read_only", "rate_limited", "policy_custom", None]


def test_statistics(spark):
    assert stats.bootstrap([]) is None
    for n in (1, 2, 7, 64, 100):
        values = sorted(random.Random(n).random() for _ in range(n))
        for name, fn in (("median", statistics.median), ("mean", statistics.fmean)):
            rng = random.Random(0)
            found = sorted(fn([values[rng.randrange(n)] for _ in range(n)]) for _ in range(300))
            want = found[int(0.025 * 299)], found[int(0.975 * 299)]
            assert all(abs(a - b) < 1e-12 for a, b in zip(stats.bootstrap(values, name, 300), want)), (n, name)
    ranked = spark.createDataFrame([("t", "a", 1), ("t", "b", 2), ("t", "c", 7)], "task_id string, item string, rank int")
    gold = spark.createDataFrame([("t", "b"), ("t", "c"), ("u", "z")], "task_id string, item string")
    got = {r.task_id: r for r in stats.retrieval(ranked, gold).collect()}
    assert (got["t"].acc1, got["t"].acc3, got["t"].mrr, got["t"].recall5, got["t"].recall10, got["u"].mrr) == (0, 1, 0.5, 0.5, 1.0, 0.0)
    graded = spark.createDataFrame([("t", 1, 3), ("t", 2, 0), ("t", 3, 2)], "task_id string, rank int, grade int")
    want = (7 + 3 / math.log2(4)) / (7 + 3 / math.log2(3))
    assert abs(stats.ndcg(graded).first().ndcg - want) < 1e-12


def test_decisions_of_contexts_and_classes(spark):
    """Calls of one context and candidates that no rule tells apart meet once; parts of a context may be null."""
    call = "call_id long, call_path string, receiver string, receiver_type string, caller_qualified string, call_namespace string, imported array<string>, name string, arg_count int"
    symbol = "symbol_id long, name string, qualified_name string, path string, start_line long, n_params long, namespace string, candidate_modules array<string>"
    rng = random.Random(7)
    one = lambda *xs: rng.choice(xs)
    calls = spark.createDataFrame([(k, one("x/a.py", "y/b.py"), one("self", "A", None), one("B", None), one("A.f", "f"), one("n", None), one(["x.a"], []), one("f", "g"), one(0, 1)) for k in range(300)], call)
    symbols = spark.createDataFrame([(k, n := one("f", "g"), one("A.", "B.", "") + n, one("x/a.py", "y/b.py", "x/c.py"), one(5, 9), one(0, 1, None), one("n", None), one(["x.a"], [])) for k in range(40)], symbol)
    context = [c for c in calls.columns if c != "call_id"]
    columns = ["call_id", "target_symbol_id", "status", "scope", "n_candidates"]
    want = resolve.decide(calls.join(symbols, "name"), ["call_id"], resolve.scopes()).select(columns)
    assert sorted(want.collect(), key=str) == sorted(resolve.by_context(calls, symbols, "name", context, resolve.scopes()).select(columns).collect(), key=str)
    rules = {"same_file": F.col("call_path") == F.col("path"), "global": F.lit(True)}
    want = resolve.decide(calls.join(symbols, "name"), ["call_id"], rules).select(columns)
    assert sorted(want.collect(), key=str) == sorted(resolve.by_context(calls, symbols, "name", context, rules, near=("call_path", "path")).select(columns).collect(), key=str)
    met = resolve.classes(symbols)
    assert met.count() < 40 and met.selectExpr("sum(aggregate(same, 0L, (n, x) -> n + x.n))").first()[0] == 40


def test_typed_contexts(spark):
    """Members, overloads and extension methods per call, against plain loops over calls and members."""
    from codequarry.operators import typed

    rng = random.Random(11)
    one = lambda *xs: rng.choice(xs)
    calls = [(k, one("MyApe", "MyBpe", "MyCpe", None), one("f", "g"), n := one(0, 1, None), ["int"] * (n or 0)) for k in range(200)]
    members = [(k, one("MyApe", "MyBpe", "MyCpe", "MyDpe"), one("f", "g"), one(["int"], ["MyApe"], ["Object"], ["MyDpe"], []), one(0, 1), one(1, None), one(5, 6), one(True, False)) for k in range(60)]
    closure = [("MyApe", "MyBpe", 1), ("MyApe", "MyDpe", 2), ("MyBpe", "MyDpe", 1)]
    c = spark.createDataFrame(calls, "call_id long, receiver_type string, name string, arg_count int, arg_types array<string>")
    m = spark.createDataFrame(members, "symbol_id long, owner string, name string, param_types array<string>, n_least int, n_most int, start_line long, is_extension boolean")
    h = spark.createDataFrame(closure, "class_name string, ancestor string, depth int")
    want, extended = set(), set()
    for call, kind, name, n, _ in calls:
        level = {kind: 0} | {b: d for a, b, d in closure if a == kind}
        best = {}
        for k, owner, own_name, types, _, _, line, _ in members:
            if own_name == name and owner in level:
                best[tuple(types)] = min(best.get(tuple(types), (9, 0, 0)), (level[owner], line, k))
        want |= {(call, k, at, ",".join(types)) for types, (at, _, k) in best.items()}
        takes = [(line, k) for k, _, own_name, types, least, most, line, e in members if e and own_name == name and types and n is not None and least <= n <= (n if most is None else most) and (types[0] in level or types[0] == "Object")]
        if takes:
            extended.add((call, min(takes)[1], "extension_method" if len(takes) == 1 else "overload_group"))
    found = typed.members_by_level(c, m, h)
    rows = found.select("call_id", "symbol_id", "level", F.array_join("param_types", ",")).collect()
    assert len(rows) == len(want) and set(map(tuple, rows)) == want
    assert sorted(map(tuple, typed.extension_methods(c, m, h).collect())) == sorted(extended)
    picked = sorted(map(tuple, typed.overloads(c, m, h).collect()))
    assert picked == sorted(map(tuple, typed.pick_overload(found, h).collect())) and len(picked) == len({r[0] for r in want})


def test_sums_of_packed_links():
    """Sums over links in rows of arrays, from two blocks of values, against one plain sum."""
    import types

    import numpy as np
    import pyarrow as pa

    rng, n = np.random.default_rng(5), (1 << graph.BLOCK_BITS) + 500
    src, dst, w, back = np.sort(rng.integers(n - 2000, n, 3000)), rng.integers(70, 900, 3000), rng.random(3000), rng.random(3000)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[k : k + 700]) for x in (src.astype(np.int32), dst.astype(np.int32), w, back)], ["src", "dst", "w", "back"]) for k in range(0, 3000, 700)]
    values = rng.random(n)
    blocks = [types.SimpleNamespace(value=values[: 1 << graph.BLOCK_BITS]), types.SimpleNamespace(value=values[1 << graph.BLOCK_BITS :])]
    packed = list(graph._packed(iter(batches), 100))
    want = np.bincount(dst, w * values[src], 900)
    (got,) = graph._incoming(blocks)(iter(packed))
    low, sums = got["start"][0].as_py(), np.frombuffer(got["values"][0].as_py())
    assert len(packed) > 20 and low >= 70 and np.allclose(want[low : low + len(sums)], sums) and np.isclose(want.sum(), sums.sum())
    assert not list(graph._incoming(blocks)(iter([]))) and not list(graph._packed(iter([])))


def test_a_hot_name_is_matched_once(spark):
    """Rows that meet grow with kinds of calls and of methods, not with calls times methods: this many pairs (2.5 billion) would not end."""
    from codequarry.operators import typed

    c = spark.range(50_000).select(F.col("id").alias("call_id"), F.lit("A").alias("receiver_type"), F.lit("f").alias("name"), F.lit(1).alias("arg_count"), F.array(F.lit("int")).alias("arg_types"))
    m = spark.range(50_000).select(F.col("id").alias("symbol_id"), F.lit("A").alias("owner"), F.lit("f").alias("name"), F.array(F.lit("Object")).alias("param_types"), F.lit(0).alias("n_least"), F.lit(2).alias("n_most"), F.col("id").alias("start_line"), F.lit(True).alias("is_extension"))
    h = spark.createDataFrame([("A", "B", 1)], "class_name string, ancestor string, depth int")
    for found in (typed.members_by_level(c, m, h), typed.overloads(c, m, h), typed.extension_methods(c, m, h)):
        assert found.agg(F.count("*"), F.max("symbol_id")).first() == (50_000, 0)
