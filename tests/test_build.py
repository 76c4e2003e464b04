import os

import pytest
from pyspark.sql import functions as F

from codequarry.plans import answers, api, build
from codequarry.sources.snapshot import Store

APP = "from pkg.util import shout\n\nclass Base:\n    pass\n\nclass App(Base):\n    def run(self, x):\n        return self.stop(x) + shout(x)\n\n    def stop(self, x):\n        return len(x)\n\ndef main():\n    App().run('x')\n"


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "src" / "pkg").mkdir(parents=True)
    (tmp_path / "src" / "app.py").write_text(APP)
    (tmp_path / "src" / "pkg" / "util.py").write_text("password = 'hunter22'\n\ndef shout(x):\n    return quiet(x)\n\ndef quiet(x):\n    return x\n")
    (tmp_path / "tests").mkdir()
    (tmp_path / "tests" / "test_app.py").write_text("from app import main\n\ndef test_main():\n    main()\n")
    (tmp_path / "pyproject.toml").write_text('[project.scripts]\nrun = "app:main"\n')
    return tmp_path


def test_incremental_equals_full_and_answers(spark, tree, tmp_path_factory):
    store = Store(spark, f"file://{tmp_path_factory.mktemp('store')}", "repo")
    build.index(spark, str(tree), store)
    (tree / "src" / "pkg" / "util.py").write_text("def shout(x):\n    return loud(x)\n\ndef loud(x):\n    return x\n")
    (tree / "src" / "new.py").write_text("from pkg.util import loud\n\ndef fresh():\n    return loud('a')\n")
    second = build.index(spark, str(tree), store)
    assert store.metadata(second)["incremental"]
    third = build.index(spark, str(tree), store, full=True)
    assert not store.metadata(third)["incremental"]
    assert build.differences(store, second, third) == {t: 0 for t in build.TABLES}

    snap = api.Snapshot(store)
    assert [r.name for r in snap.find_symbols("sh*").collect()] == ["shout"]
    status = snap.index_status().first()
    assert status.n_files == 5 and status.n_symbols == 9
    main = snap.table("symbols").filter("name = 'main'").first()
    assert main.roles == ["declared_entry_point"]
    nodes, edges, limited = snap.impact_slice(main.symbol_id, "callees", 2)
    names = {r.symbol_id: r.qualified_name for r in snap.table("symbols").collect()}
    assert {names[r.symbol_id] for r in nodes.collect()} == {"main", "App", "App.run", "App.stop", "shout"} and not limited
    ref = snap.table("symbols").filter("name = 'main'").select(F.expr("substring(sha2(symbol_id, 256), 1, 8)")).first()[0]
    assert snap.resolve_ref(ref) == main.symbol_id
    assert [r.name for r in snap.search_source("loud", limit=3).collect()][0] == "loud"
    assert {r.relation for r in snap.search_source("loud", limit=1, expand=True).collect()} == {"match", "caller"}
    assert "imported_by" in {r.relation for r in snap.module_dependents("src/pkg/util.py").collect()}
    assert "def shout" in snap.file_skeleton("src/pkg/util.py")
    packed = snap.repo_map("shout", 64).collect()
    assert packed and sum(r.cost for r in packed) <= 64 and "shout" in packed[0].line
    assert any("return loud(x)" in (r.body or "") for r in snap.symbol_context(next(k for k, v in names.items() if v == "loud"), 1).collect())
    for bad in (0, 101, True):
        with pytest.raises(ValueError):
            snap.find_symbols("x", limit=bad)


def test_composite_answers(spark, tree, tmp_path_factory):
    store = Store(spark, f"file://{tmp_path_factory.mktemp('store')}", "repo")
    build.index(spark, str(tree), store)
    snap = api.Snapshot(store)
    plain = answers.inspect_symbol(snap, "App.run", "minimal")
    assert plain["status"] == "resolved" and set(plain["symbol"]) == {"symbol_id", "name", "kind", "path", "start_line", "signature"}
    assert ("callee", "src/app.py") in {(r["relation"], r["path"]) for r in plain["relationships"]}
    full = answers.inspect_symbol(snap, "App.run", "full", 400)
    assert full["packet"]["target"][0].startswith("    def run") and full["omitted_lines"] == 0 and any("App.stop" in x for x in full["packet"]["callees"])
    assert answers.inspect_symbol(snap, "App.run", "full", 32)["omitted_lines"] > 0 and answers.inspect_symbol(snap, "zzz")["status"] == "not_found"
    done = answers.batch(snap, [{"op": "find_symbols", "args": {"pattern": "shout"}}, {"op": "symbol_context", "args": {"symbol_id": "$prev[0].symbol_id"}}, {"op": "find_symbols", "args": {"pattern": "x", "limit": 0}}, {"op": "find_symbols", "args": {"pattern": "$0[0].name"}}])
    assert any("return quiet(x)" in r["body"] for r in done[1]["rows"]) and "ValueError" in done[2]["error"] and done[3]["rows"][0]["name"] == "shout"
    for bad in ([], [{"op": "find_symbols"}] * 11, [{"op": "drop"}]):
        with pytest.raises(ValueError):
            answers.batch(snap, bad)
    names = [r.name for r in answers.tools(spark).collect()]
    assert {"find_symbols", "search_source", "repo_map"} <= set(names) and answers.tool_schema(spark, "search_source")["query"]["required"]
    rows = snap.table("symbols")
    assert answers.finalize(rows, "text", ["name"], ["name"]).count() == answers.finalize(rows, "compact_text", ["name"], ["name", "symbol_id"]).count() == rows.count()
    # The receiver's type is known from its class, so the call is bound to the method of that class.
    calls = {r.target_name: r.evidence for r in snap.table("edges").collect()}
    assert calls["run"] == ["exact_receiver_type"] and calls["stop"] == ["same_class"]


def test_unchanged_files_are_not_read_again(spark, tree, tmp_path_factory):
    store = Store(spark, f"file://{tmp_path_factory.mktemp('store')}", "repo")
    util = tree / "src" / "pkg" / "util.py"
    for f in tree.rglob("*.py"):
        os.utime(f, (1_600_000_000, 1_600_000_000))
    build.index(spark, str(tree), store)
    # The same size and time: the build must not notice, since it must not look.
    util.write_text(util.read_text().replace("quiet", "loudx"))
    os.utime(util, (1_600_000_000, 1_600_000_000))
    (tree / "src" / "app.py").write_text(APP + "\ndef more():\n    return shout(1)\n")
    (tree / "src" / "odd [name].py").write_text("def odd():\n    return 1\n")
    (tree / "tests" / "test_app.py").unlink()
    build.index(spark, str(tree), store)
    snap = api.Snapshot(store)
    assert sorted(r.name for r in snap.table("symbols").collect() if not r.name.startswith("<")) == ["App", "Base", "main", "more", "odd", "quiet", "run", "shout", "stop"]
    assert {r.path for r in snap.table("files").collect()} == {"pyproject.toml", "src/app.py", "src/odd [name].py", "src/pkg/util.py"}
    assert "quiet" in [r.text for r in snap.table("module_text").collect() if r.path == "src/pkg/util.py"][0]


def test_memory(spark, tmp_path):
    memory = api.Memory(Store(spark, f"file://{tmp_path}", "memory"))
    rows = [("s", "n", "a", 1, "red fox", 0.0, None), ("s", "n", "a", 2, "red fox runs", 1.0, 50.0), ("s", "n", "b", 1, "token = abcdefgh", 0.0, None)]
    memory.put(spark.createDataFrame(rows, api.Memory.SCHEMA))
    asked = spark.createDataFrame([("s", "n", k) for k in "abc"], "scope string, namespace string, key string")
    assert {r.key: r.status for r in memory.get(asked, 10.0).collect()} == {"a": "found", "b": "found", "c": "not_found"}
    assert {r.key: r.status for r in memory.get(asked, 60.0).collect()}["a"] == "expired"
    assert {r.key: r.value for r in memory.get(asked, 10.0).collect()}["b"].startswith("[REDACTED")
    assert [r.key for r in memory.search('"red fox" runs', 10.0).collect()] == ["a"] and memory.search("red", 60.0).isEmpty()
    memory.put(spark.createDataFrame([("s", "n", "c", 1, "x", 2.0, None)], api.Memory.SCHEMA))
    memory.sweep(60.0)
    memory.delete(asked.filter("key = 'b'"))
    assert {r.key: r.status for r in memory.get(asked, 10.0).collect()} == {"a": "not_found", "b": "not_found", "c": "found"}
