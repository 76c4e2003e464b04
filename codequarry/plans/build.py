"""Building a snapshot from a source tree, in full or from the one before."""

from __future__ import annotations

import sys
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence, graph, lookup, resolve
from ..operators.checkpoints import cut
from ..sources import parse, scan
from ..sources.snapshot import Store, reusable

#: Bonuses of roles and demotions of top folders in ranks.
ROLE_BONUS = {"declared_entry_point": 3.0, "registry_wiring": 2.4, "protocol_definition": 2.1}
DEMOTIONS = {"scripts": 1.5, "evaluation": 1.0}
RESOLVER = 2
TABLES = ["files", "facts", "symbols", "edges", "imports", "class_hierarchy", "symbol_rank", "module_text"]


def fingerprint() -> str:
    """Facts may be reused only by the same parsers and resolver."""
    return f"python-{sys.version_info.major}.{sys.version_info.minor}/patterns-2/resolver-{RESOLVER}"


def index(spark: SparkSession, root: str, store: Store, ignore: list[str] | None = None, full: bool = False) -> str:
    """Writes and publishes a snapshot; returns its run id. Files whose size and time are as in the last scan are not read again, and files whose
    content is as before keep their facts and are not parsed."""
    started = time.time_ns()
    listed = scan.listing(spark, root, ignore)
    scan.count_guard(listed)
    old = None if full else store.previous(fingerprint(), ["files", "facts", "module_text"])
    text_of = lambda f: f.select("path", F.decode("content", "UTF-8").alias("text")).withColumn("text", T.redact(F.col("text")))
    if old:
        unread = cut(reusable(old["files"].filter(F.col("parse_status") != "failed"), listed, F.lit(store.metadata().get("scanned_ns", 0))), "unread")
        # What has changed since the last scan: as many paths as an edit touches.
        found = scan.tree(spark, root, ignore, only=[r.path for r in listed.join(unread, "path", "left_anti").select("path").collect()])
        files = scan.files_table(found)
        same = files.join(old["files"].select("path", "sha256", "language"), ["path", "sha256", "language"], "left_semi").select("path")
        facts = old["facts"].join(unread.unionByName(same), "path", "left_semi").unionByName(parse.facts(found.join(same, "path", "left_anti")))
        files = files.unionByName(old["files"].join(unread, "path", "left_semi").select(*files.columns))
        text = text_of(found).unionByName(old["module_text"].join(unread, "path", "left_semi").select("path", "text"))
    else:
        found = scan.tree(spark, root, ignore)
        files, facts, text = scan.files_table(found), parse.facts(found), text_of(found)
    facts = cut(facts, "facts")  # parsed once, read by every table
    t = parse.tables(facts)
    files = files.drop("parse_status").join(facts.select("path", F.col("status").alias("parse_status")), "path")
    hierarchy = lookup.parents(t["class_hierarchy"], t["symbols"])
    edges = resolve.dedupe(resolve.build_edges(t["calls"], t["symbols"], t["imports"], t["namespaces"]), ["source_path", "source_line"])
    edges = cut(edges.withColumn("edge_id", F.xxhash64("source_symbol_id", "target_name", "source_path", "source_line", F.coalesce("target_symbol_id", F.lit("")))), "edges")
    symbols = cut(evidence.structural_roles(t["symbols"], t["class_hierarchy"], _entry_points(spark, root)), "symbols")
    ranks = graph.global_ranks(symbols, edges, graph.pagerank(symbols, edges), ROLE_BONUS, DEMOTIONS)
    run = uuid.uuid4().hex[:12]
    tables = {"files": files, "facts": facts, "symbols": symbols, "edges": edges, "imports": t["imports"], "class_hierarchy": hierarchy, "symbol_rank": ranks, "module_text": text}
    store.write(run, tables, {"fingerprint": fingerprint(), "root": root, "vcs_head": scan.vcs_head(root), "incremental": bool(old), "scanned_ns": started})
    store.publish(run)
    return run


def _entry_points(spark: SparkSession, root: str) -> DataFrame:
    return scan.entry_points(spark, root)


def differences(store: Store, one: str, other: str) -> dict[str, int]:
    """Rows by which two snapshots differ, per table: a full build and an incremental one of the same tree differ in none."""
    out = {}
    for name in TABLES:
        a, b = (_comparable(store.table(name, r)) for r in (one, other))
        out[name] = lookup.multiset_diff(a, b).count()
    return out


def _comparable(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, ranks rounded."""
    plain = lambda f: F.to_json(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.round(f.name, 6) if f.dataType.typeName() == "double" else F.col(f.name)
    return df.select(*[plain(f).alias(f.name) for f in df.schema])
