"""The shape of a snapshot over the driver's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    return doc.select(
        F.concat(F.when(F.col("doc_id") % 10 == 0, "tests/").otherwise("src/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("long").alias("size"),
        (F.col("doc_id") * 1_000_000_000).alias("mtime_ns"),
        F.col("lang").alias("language"),
        F.when(F.col("n_chars") >= 50, "parsed").otherwise("unsupported").alias("parse_status"),
        "text",
    )


def lines(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("path", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    brand = F.replace("p_brand", F.lit("#"), F.lit("_"))
    kinds = F.col("p_size") % 4
    return p.select(
        F.col("p_partkey").alias("symbol_id"),
        F.concat(F.lit("src/"), F.lower(brand), F.lit(".py")).alias("path"),
        name.alias("name"),
        F.concat(brand, F.lit("."), name).alias("qualified_name"),
        F.when(kinds == 0, "class").when(kinds == 1, "method").when(kinds == 2, "function").otherwise("interface").alias("kind"),
        (F.col("p_size") * 10).cast("long").alias("start_line"),
        (F.col("p_size") * 10 + F.col("p_partkey") % 37).cast("long").alias("end_line"),
        (F.col("p_partkey") % 11 == 0).alias("is_private"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    parts = table(spark, d, "part").count()
    target = F.when(F.col("l_linenumber") == 1, F.col("l_suppkey") % 7).otherwise((F.col("l_suppkey") * 17 + F.col("l_partkey") * 3 + F.col("l_linenumber")) % parts)
    return line.groupBy(F.col("l_partkey").alias("source_symbol_id"), target.alias("target_symbol_id")).agg(
        (1.0 - 5.0 * F.max("l_discount")).alias("confidence"),
        F.when(F.min("l_returnflag") == "A", "ambiguous").otherwise("resolved").alias("status"),
        F.min("l_linestatus").alias("edge_kind"),
        F.lit("lexical").alias("backend"),
        F.count("*").alias("n_calls"),
    )


def imports(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("src/c"), (F.col("o_custkey") % 40).cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("m"), (F.col("o_orderkey") % 60).cast("string")).alias("module")
    ).distinct()


def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    return (
        table(spark, d, "supplier")
        .select(named("S", "s_suppkey").alias("class_name"), named("N", "s_nationkey").alias("parent_name"))
        .unionByName(table(spark, d, "nation").select(named("N", "n_nationkey").alias("class_name"), named("R", "n_regionkey").alias("parent_name")))
    )


def calls(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    path = F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit(".py"))
    return joined.groupBy(F.col("l_orderkey").alias("call_id"), path.alias("path"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("call_name")).agg(F.min("l_linenumber").alias("arg_count"))


def audit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"),
        "ts",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("agent_id"),
        F.col("event_type").alias("tool_name"),
        F.when(F.col("event_type") == "error", "ERROR").when(F.col("value") > 100, "DENIED").otherwise("SUCCESS").alias("status"),
        F.col("value").alias("duration_ms"),
        F.col("props").alias("details_json"),
    )


def memory(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    at = (F.col("conv_id") * 100 + F.col("turn")).cast("double")
    return c.select(
        F.col("role").alias("scope"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("namespace"),
        F.concat(F.lit("k"), (F.col("turn") % 3).cast("string")).alias("key"),
        F.col("turn").alias("seq"),
        F.col("text").alias("value"),
        at.alias("created_at"),
        F.when(F.col("turn") % 4 != 0, at + 50).alias("expires_at"),
    )


def ledger(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("q"), (F.col("o_custkey") % 50).cast("string")).alias("sig_hash"),
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("run"), (F.col("o_orderkey") % 3).cast("string")).alias("run_id"),
        F.concat(F.lit("a"), (F.col("o_orderkey") % 2).cast("string")).alias("answer"),
        F.concat(F.lit("a"), (F.col("o_orderkey") % 7 + 2 - F.when(F.col("o_orderkey") % 41 == 0, 2).otherwise(0)).cast("string")).alias("decoy"),
        (F.col("o_orderkey") % 13 == 0).alias("retire"),
        F.col("o_orderpriority").alias("agent"),
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    return line.groupBy(F.concat(F.lit("B"), (F.col("l_suppkey") % 3).cast("string")).alias("arm"), (F.col("l_orderkey") % 200).alias("task_id"), F.col("l_linenumber").alias("seed")).agg(
        F.max("l_extendedprice").alias("total_tokens"), F.max("l_quantity").alias("latency_seconds"), (F.min("l_returnflag") != "A").alias("task_success")
    )


def gold(spark: SparkSession, d: str) -> DataFrame:
    doc, lab = table(spark, d, "documents"), table(spark, d, "labels")
    grade = F.greatest(F.coalesce("quality", F.lit(0)) * 3 - F.coalesce("toxic", F.lit(0)), F.lit(0))
    return doc.join(lab, "doc_id", "left").select(F.col("lang").alias("task_id"), "doc_id", "n_chars", grade.alias("grade"))


#: The same views for DuckDB, in an order in which each may read those before it.
DUCKDB = {
    "fx_files": "SELECT concat(CASE WHEN doc_id % 10 = 0 THEN 'tests/' ELSE 'src/' END, source, '/doc_', CAST(doc_id AS STRING), '.txt') AS path, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size, doc_id * 1000000000 AS mtime_ns, lang AS language, CASE WHEN n_chars >= 50 THEN 'parsed' ELSE 'unsupported' END AS parse_status, text FROM documents",
    "fx_lines": "SELECT path, CAST(i AS BIGINT) AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT path, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM fx_files)",
    "fx_terms": r"SELECT path, term, count(*) AS tf FROM (SELECT path, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM fx_files) GROUP BY path, term",
    "fx_symbols": "SELECT p_partkey AS symbol_id, concat('src/', lower(replace(p_brand, '#', '_')), '.py') AS path, replace(p_name, ' ', '_') AS name, concat(replace(p_brand, '#', '_'), '.', replace(p_name, ' ', '_')) AS qualified_name, CASE p_size % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'function' ELSE 'interface' END AS kind, CAST(p_size * 10 AS BIGINT) AS start_line, CAST(p_size * 10 + p_partkey % 37 AS BIGINT) AS end_line, p_partkey % 11 = 0 AS is_private FROM part",
    "fx_edges": "SELECT l_partkey AS source_symbol_id, CASE WHEN l_linenumber = 1 THEN l_suppkey % 7 ELSE (l_suppkey * 17 + l_partkey * 3 + l_linenumber) % (SELECT count(*) FROM part) END AS target_symbol_id, 1.0e0 - 5.0e0 * max(l_discount) AS confidence, CASE WHEN min(l_returnflag) = 'A' THEN 'ambiguous' ELSE 'resolved' END AS status, min(l_linestatus) AS edge_kind, 'lexical' AS backend, count(*) AS n_calls FROM lineitem GROUP BY 1, 2",
    "fx_imports": "SELECT DISTINCT concat('src/c', CAST(o_custkey % 40 AS STRING), '.py') AS path, concat('m', CAST(o_orderkey % 60 AS STRING)) AS module FROM orders",
    "fx_hierarchy": "SELECT concat('S', CAST(s_suppkey AS STRING)) AS class_name, concat('N', CAST(s_nationkey AS STRING)) AS parent_name FROM supplier UNION ALL SELECT concat('N', CAST(n_nationkey AS STRING)), concat('R', CAST(n_regionkey AS STRING)) FROM nation",
    "fx_calls": "SELECT l.l_orderkey AS call_id, concat('src/', lower(replace(p.p_brand, '#', '_')), '.py') AS path, replace(p.p_name, ' ', '_') AS call_name, min(l.l_linenumber) AS arg_count FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1, 2, 3",
    "fx_audit": "SELECT event_id AS id, ts, concat('u', CAST(user_id AS STRING)) AS agent_id, event_type AS tool_name, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN value > 100 THEN 'DENIED' ELSE 'SUCCESS' END AS status, value AS duration_ms, props AS details_json FROM events",
    "fx_memory": "SELECT role AS scope, concat('c', CAST(conv_id AS STRING)) AS namespace, concat('k', CAST(turn % 3 AS STRING)) AS key, turn AS seq, text AS value, CAST(conv_id * 100 + turn AS DOUBLE) AS created_at, CASE WHEN turn % 4 = 0 THEN NULL ELSE CAST(conv_id * 100 + turn + 50 AS DOUBLE) END AS expires_at FROM conversations",
    "fx_ledger": "SELECT concat('q', CAST(o_custkey % 50 AS STRING)) AS sig_hash, o_orderkey AS seq, concat('run', CAST(o_orderkey % 3 AS STRING)) AS run_id, concat('a', CAST(o_orderkey % 2 AS STRING)) AS answer, concat('a', CAST(o_orderkey % 7 + 2 - CASE WHEN o_orderkey % 41 = 0 THEN 2 ELSE 0 END AS STRING)) AS decoy, o_orderkey % 13 = 0 AS retire, o_orderpriority AS agent FROM orders",
    "fx_runs": "SELECT concat('B', CAST(l_suppkey % 3 AS STRING)) AS arm, l_orderkey % 200 AS task_id, l_linenumber AS seed, max(l_extendedprice) AS total_tokens, max(l_quantity) AS latency_seconds, min(l_returnflag) <> 'A' AS task_success FROM lineitem GROUP BY 1, 2, 3",
    "fx_gold": "SELECT d.lang AS task_id, d.doc_id, d.n_chars, greatest(coalesce(l.quality, 0) * 3 - coalesce(l.toxic, 0), 0) AS grade FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
}


def duckdb(body: str, recursive: bool = False) -> str:
    """`body`, with the views it names (and those they read) in front; `body` may begin with further views."""
    needed = {k for k in DUCKDB if k in body}
    for k in reversed(DUCKDB):
        if k in needed:
            needed |= {x for x in DUCKDB if x != k and x in DUCKDB[k]}
    views = ", ".join(f"{k} AS ({DUCKDB[k]})" for k in DUCKDB if k in needed)
    body = body.strip()
    more = body[5:].strip() if body.upper().startswith("WITH ") else None
    head = "WITH RECURSIVE " if recursive else "WITH "
    if not views:
        return body if more is None else head + more
    return f"{head}{views}, {more}" if more is not None else f"{head}{views} {body}"
