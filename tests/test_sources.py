import datetime
import json

import pytest
from pyspark.sql import functions as F

from codequarry.operators import lookup, resolve
from codequarry.sources import parse, scan, snapshot
from codequarry.streaming import audit, debounce

APP = '''import os
from pkg.helpers import shout

class Base:
    def _hid(self):
        return 1

class App(Base):
    def run(self, x):
        return self.stop(x) + shout(x)

    def stop(self, x):
        return len(x)

def main():
    App().run("x")
'''


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "src" / "pkg").mkdir(parents=True)
    (tmp_path / "src" / "app.py").write_text(APP)
    (tmp_path / "src" / "pkg" / "helpers.py").write_text("def shout(x):\n    return x\n")
    (tmp_path / "src" / "bad.py").write_text("def (")
    (tmp_path / "src" / "w.ts").write_text('import { x } from "./lib";\nexport class W extends V {\n}\nexport function go(a) {\n  return help(a, 1);\n}\n')
    (tmp_path / ".env").write_text("KEY=1")
    (tmp_path / "blob.py").write_bytes(b"a\0b")
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "x.py").write_text("x = 1")
    (tmp_path / "README.md").write_text("hello")
    return tmp_path


def test_scan_parse_resolve(spark, tree):
    found = scan.tree(spark, str(tree), ["build/", "# note", "*.log"])
    assert sorted(r.path for r in found.collect()) == ["README.md", "src/app.py", "src/bad.py", "src/pkg/helpers.py", "src/w.ts"]
    files = {r.path: r for r in scan.files_table(found).collect()}
    assert files["README.md"].parse_status == "unsupported" and files["src/w.ts"].language == "typescript"
    parsed = parse.facts(found)
    assert {r.path: r.status for r in parsed.collect()} == {"README.md": "unsupported", "src/app.py": "parsed", "src/bad.py": "parse_error", "src/pkg/helpers.py": "parsed", "src/w.ts": "parsed"}
    t = parse.tables(parsed)
    names = {(r.qualified_name, r.kind, r.is_private) for r in t["symbols"].filter("path = 'src/app.py'").collect()}
    assert names == {("Base", "class", False), ("Base._hid", "method", True), ("App", "class", False), ("App.run", "method", False), ("App.stop", "method", False), ("main", "function", False)}
    assert {(r.class_name, r.parent_name) for r in t["class_hierarchy"].collect()} == {("App", "Base"), ("W", "V")}
    assert "pkg.helpers.shout" in {r.module for r in t["imports"].collect()} and "./lib" in {r.module for r in t["imports"].collect()}
    edges = resolve.build_edges(t["calls"], t["symbols"], t["imports"])
    names = {r.symbol_id: r.qualified_name for r in t["symbols"].collect()}
    got = {(names[r.source_symbol_id], names.get(r.target_symbol_id), r.evidence[0]) for r in edges.collect()}
    assert {("App.run", "App.stop", "same_class"), ("App.run", "shout", "import_match"), ("main", "App.run", "exact_receiver_type"), ("main", "App", "same_file")} <= got
    with pytest.raises(ValueError):
        scan.count_guard(found, 2)


def test_other_sources(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps({"id": i, "v": v}) for i, v in (("a", 1), ("b", 2), ("a", 3))))
    assert {r.key: r.v for r in scan.jsonl(spark, str(tmp_path / "r.jsonl")).collect()} == {"a": 3, "b": 2}
    run = {"arm": "A", "task_id": "t", "seed": 1, "total_tokens": 5, "latency_seconds": 1.5, "task_success": True}
    (tmp_path / "ok.jsonl").write_text(json.dumps(run))
    (tmp_path / "bad.jsonl").write_text(json.dumps(run | {"mcp_errors": 2}))
    assert scan.benchmark_runs(spark, str(tmp_path / "ok.jsonl")).count() == 1
    with pytest.raises(Exception, match="tool errors"):
        scan.benchmark_runs(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "c.toml").write_text('[repositories.x]\nroot = "/a"\n')
    assert scan.registry(spark, str(tmp_path / "c.toml")).first().root == "/a"
    (tmp_path / "pyproject.toml").write_text('[project.scripts]\nb = "m:g"\na = "m:f"\n')
    assert [r.name for r in scan.entry_points(spark, str(tmp_path)).collect()] == ["a", "b"]
    assert scan.safe_path(str(tmp_path), "a/b.py") == "a/b.py"
    for bad in ("../x", "/etc/passwd", "a/../../x"):
        with pytest.raises(ValueError):
            scan.safe_path(str(tmp_path), bad)
    assert scan.vcs_head(str(tmp_path)) is None
    assert parse.compress(APP, "x") == APP and "..." in parse.skeleton(APP, parse.parse("a.py", APP, "python")["symbols"])


def test_snapshots(spark, tmp_path):
    store = snapshot.Store(spark, f"file://{tmp_path}", "repo")
    v1 = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    store.write("r1", {"files": v1}, {"fingerprint": "p1"})
    assert store.current() is None
    store.publish("r1")
    v2 = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256 string")
    old = store.previous("p1", ["files"])["files"]
    assert store.previous("p2", ["files"]) is None
    assert {r.path: r.state for r in snapshot.freshness(old, v2).collect()} == {"a": "fresh", "b": "changed", "c": "missing"}
    assert snapshot.repo_state(old, v2).first().state == "stale" and snapshot.repo_state(old, v1).first().state == "fresh"
    changed, kept = v2.join(old, ["path", "sha256"], "left_anti"), v2.join(old, ["path", "sha256"], "left_semi")
    store.write("r2", {"files": snapshot.delta(old, kept, changed, "path")}, {"fingerprint": "p1"})
    store.publish("r2")
    assert lookup.multiset_diff(store.table("files"), v2).isEmpty()
    assert {r["class"]: r.n for r in store.storage().collect()} == {"ACTIVE": 1, "SUPERSEDED": 1}
    assert store.collect_garbage(keep=0) == ["r1"] and store.runs() == ["r2"]
    listing = v1.withColumns({"size": F.lit(1), "mtime_ns": F.lit(5)})
    assert snapshot.tree_signature(listing).first()[0] == snapshot.tree_signature(listing.repartition(3)).first()[0]


def test_streams(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda s: t0 + datetime.timedelta(seconds=s)
    batch = spark.createDataFrame([("f", at(0)), ("f", at(1)), ("f", at(5))], "path string, ts timestamp")
    assert sorted(r.n for r in debounce.sessions(batch, ["path"], "ts").collect()) == [1, 2]
    events = [("a", k, float(t)) for k, t in enumerate([0, 1, 2, 61, 62])]
    spark.createDataFrame(events, "agent_id string, id long, t double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("agent_id string, id long, t double").parquet(f"{tmp_path}/in")
    q = audit.limited(stream, 2, 60.0).writeStream.format("memory").queryName("accepted").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert [r.accepted for r in spark.sql("SELECT * FROM accepted ORDER BY id").collect()] == [True, True, False, True, True]
    asked = [("k", 1, 0.0, "x"), ("k", 2, 5.0, "y"), ("k", 3, 16.0, "y")]
    spark.createDataFrame(asked, "resource_key string, seq long, at double, agent_id string").coalesce(1).write.parquet(f"{tmp_path}/locks")
    q = audit.leased(spark.readStream.schema("resource_key string, seq long, at double, agent_id string").parquet(f"{tmp_path}/locks"), 10.0).writeStream.format("memory").queryName("leases").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert [r.acquired for r in spark.sql("SELECT * FROM leases ORDER BY seq").collect()] == [True, False, True]


TYPED = """
class Store: pass

def make() -> Store:
    return Store()

class App:
    cache: Cache

    def __init__(self, log: Logger):
        self.store, self.two = Store(), 2
        self.own = Store()
        self.log = log
        self.odd = Store()

    def reset(self):
        self.odd = 3

    def run(self, x, y: "pkg.Path"):
        s = Store()
        s.a1()
        self.own.a2()
        self.log.a3()
        self.odd.a4()
        y.a5()
        t = make()
        t.a6()
        if ready() and isinstance(x, Item):
            x.a7()
        else:
            x.a8()
        for k in []:
            k.a9()
        u = Store()
        u = 5
        u.b1()
        with Store() as w:
            w.b2()
        make().b3()
        self.cache.b4()
        self.store.b5()
"""


def test_types_of_receivers():
    p = parse.parse("a.py", TYPED, "python")
    found = {c["name"]: c["receiver_type"] for c in p["calls"] if c["name"][0] in "ab" and len(c["name"]) == 2}
    assert found == {"a1": "Store", "a2": "Store", "a3": "Logger", "a4": None, "a5": "Path", "a6": "Store", "a7": "Item", "a8": None, "a9": None, "b1": None, "b2": "Store", "b3": "Store", "b4": "Cache", "b5": None}
    assert [c["name"] for c in p["calls"]].count("isinstance") == 1 and [c["name"] for c in p["calls"]].count("ready") == 1


def test_namespaces_and_bindings():
    assert parse.parse("A.cs", "using System;\nnamespace My.App\n{ class A { } }", "c_sharp")["namespaces"] == ["My.App"]
    assert parse.parse("A.java", "package my.app;\nclass A { }", "java")["namespaces"] == ["my.app"]
    js = "const fs = require('fs')\nconst { join, resolve: r } = require('path')\nimport React, { useState as s } from 'react'\nimport * as all from './all'\n"
    assert [(b["name"], b["module"]) for b in parse.parse("a.js", js, "javascript")["bindings"]] == [("fs", "fs"), ("join", "path"), ("r", "path"), ("React", "react"), ("s", "react"), ("all", "./all")]


def test_expiry_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    schema = "key string, ts timestamp, value string, expires_at timestamp"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/puts")
    q = audit.expiring(spark.readStream.schema(schema).parquet(f"{tmp_path}/puts")).writeStream.format("memory").queryName("expiry").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        for rows in ([("a", at(0), "1", at(10)), ("b", at(1), "2", None)], [("a", at(5), "3", at(30))], [("c", at(20), "4", None)], [("c", at(60), "5", None)], [("c", at(61), "6", None)]):
            spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/puts")
            q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(tuple(r) for r in spark.table("expiry").collect()) == [("a", "expired", "3"), ("a", "put", "1"), ("a", "put", "3"), ("b", "put", "2"), ("c", "put", "4"), ("c", "put", "5"), ("c", "put", "6")]


def test_policies_are_read_anew(spark, tmp_path):
    schema, seen = "agent_id string, tool_name string, accepted boolean", []
    agents = [spark.createDataFrame([("a", s, "full", None)], "agent_id string, status string, policy string, custom_tools array<string>") for s in ("active", "paused")]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/asked")
    q = audit.decided(spark.readStream.schema(schema).parquet(f"{tmp_path}/asked"), lambda: agents[min(len([x for x in seen if x]), 1)], [], lambda df, k: seen.append([r.reason for r in df.collect()]), f"{tmp_path}/c")
    try:
        for _ in range(2):
            spark.createDataFrame([("a", "t", True)], schema).write.mode("append").parquet(f"{tmp_path}/asked")
            q.processAllAvailable()
    finally:
        q.stop()
    assert [x for x in seen if x] == [[None], ["agent_paused"]]
