"""Answers made of others: a symbol inspected, a context packet, batches with references, the tool catalogue, and how rows are written out."""

from __future__ import annotations

import inspect
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import budget, graph
from .api import Snapshot

#: How far edges are trusted in a packet, operations of a batch, and what a minimal view keeps.
CALLEES, CALLERS, MOST_OPERATIONS = 0.6, 0.5, 10
MINIMAL = ("symbol_id", "name", "kind", "path", "start_line")
OFFSETS = ("start_byte", "end_byte", "body_start", "body_end")


def wire_symbols(symbols: DataFrame) -> DataFrame:
    """Without byte offsets, which mean nothing outside."""
    return symbols.drop(*OFFSETS)


def project(rows: DataFrame, view: str) -> DataFrame:
    """A view's columns: minimal keeps the few that name a symbol (and a body that was asked for)."""
    if view not in ("minimal", "normal", "full"):
        raise ValueError("view must be minimal, normal or full")
    return rows if view != "minimal" else rows.select(*[c for c in rows.columns if c in (*MINIMAL, "signature", "body")])


def path_group(path: Column) -> Column:
    """Code, then evals, then tests."""
    return F.when(path.startswith("tests/") | path.contains("/tests/"), 2).when(path.startswith("evals/"), 1).otherwise(0)


def neighbours(symbols: DataFrame, edges: DataFrame, ranks: DataFrame, symbol_id: str) -> DataFrame:
    """The callees of a symbol in the order of their first call, then its callers: code first, then by rank. `pos` counts within each."""
    from pyspark.sql import Window

    s = symbols.select("symbol_id", "path", "qualified_name", "kind", "start_line", "signature")
    own = lambda side, other, least: edges.filter((F.col(side) == symbol_id) & (F.col(other) != symbol_id) & graph.traversable(least)).groupBy(F.col(other).alias("symbol_id")).agg(F.max("confidence").alias("confidence"), F.min("source_line").alias("line"))
    callees = own("source_symbol_id", "target_symbol_id", CALLEES).join(s, "symbol_id").withColumns({"relation": F.lit("callee"), "score": F.lit(0.0)})
    callers = own("target_symbol_id", "source_symbol_id", CALLERS).join(s, "symbol_id").join(ranks.select("symbol_id", "score"), "symbol_id", "left").na.fill(0.0, ["score"]).withColumn("relation", F.lit("caller"))
    both = callees.unionByName(callers)
    order = [F.when(F.col("relation") == "callee", F.col("line")).otherwise(path_group(F.col("path"))), F.when(F.col("relation") == "callee", -F.col("confidence")).otherwise(-F.col("score")), F.col("path"), F.col("start_line"), F.col("symbol_id")]
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("relation").orderBy(*order)))


def fit_lines(lines: list[str], most_tokens: int) -> tuple[list[str], int]:
    """The longest beginning of a body within the tokens, and how many lines are left out; a body that fits is whole."""
    total = 0
    for k, line in enumerate(lines):
        total += -(-(len(line.encode()) + 1) // 4)
        if total > most_tokens:
            return lines[:k], len(lines) - k
    return lines, 0


def inspect_symbol(snapshot: Snapshot, query: str, view: str = "normal", budget_tokens: int = 2048) -> dict:
    """The symbol that a query names, with its neighbours; the full view is a packet of its body, callees and callers within the budget.

    What reaches the driver is one symbol, its body and its direct neighbours, which the packet's budget cuts."""
    found = snapshot.find_symbols(query, limit=5).collect()
    exact = [r for r in found if query in (r.name, r.qualified_name)] or found
    if not exact:
        return {"status": "not_found", "query": query}
    target = exact[0]
    symbols, edges = snapshot.table("symbols"), snapshot.table("edges")
    near = neighbours(symbols, edges, snapshot.table("symbol_rank"), target.symbol_id).filter(F.col("pos") <= budget_tokens // 4).orderBy("relation", "pos").collect()
    answer = {"status": "resolved", "query": query, "target_symbol_id": target.symbol_id, "symbol": project(wire_symbols(symbols).filter(F.col("symbol_id") == target.symbol_id), view).first().asDict(), "relationship_count": len(near), "candidates": len(found)}
    line = lambda r: " ".join(str(x) for x in (r.path, r.qualified_name, r.start_line, round(r.confidence, 2)))
    if view != "full":
        return answer | {"relationships": [{"relation": r.relation, "symbol_id": r.symbol_id, "path": r.path, "line": r.start_line} for r in near]}
    text = snapshot.table("module_text").filter(F.col("path") == target.path).first()
    body = (text.text.split("\n") if text else [])[target.start_line - 1 : target.end_line]
    kept, omitted = fit_lines(body, int(budget_tokens * budget.SHARES["target"]))
    cost = lambda x: -(-(len(x.encode()) + 1) // 4)
    sections = {"target": [("\n".join(kept), cost("\n".join(kept)))]} | {k: [(line(r), cost(line(r))) for r in near if r.relation + "s" == k] for k in ("callees", "callers")}
    return answer | {"packet": budget.packet(sections, budget_tokens), "omitted_lines": omitted}


#: Operations that a batch may hold: they only read.
BATCHABLE = ("find_symbols", "search_source", "module_dependents", "symbol_context", "repo_map")
_REFERENCE = re.compile(r"^\$(prev|\d+)\[(\d+)\]\.(\w+)$")


def batch(snapshot: Snapshot, operations: list[dict]) -> list[dict]:
    """At most ten operations ({"op", "args"}) in order. An argument `$prev[0].symbol_id`, or `$2[0].path`, is a field of a row of an earlier answer. An
    operation that fails leaves an error and does not end the others; one that isn't allowed ends the batch before it starts."""
    if not operations or len(operations) > MOST_OPERATIONS:
        raise ValueError(f"a batch has 1 to {MOST_OPERATIONS} operations")
    for k, o in enumerate(operations):
        if o.get("op") not in BATCHABLE:
            raise ValueError(f"operation {k} is none of {', '.join(BATCHABLE)}")
    results: list[dict] = []
    for o in operations:
        try:
            args = {}
            for name, value in o.get("args", {}).items():
                if isinstance(value, str) and (m := _REFERENCE.match(value)):
                    value = results[-1 if m[1] == "prev" else int(m[1])]["rows"][int(m[2])][m[3]]
                args[name] = value
            rows = [r.asDict(recursive=True) for r in getattr(snapshot, o["op"])(**args).limit(100).collect()]
            results.append({"op": o["op"], "rows": rows})
        except Exception as e:  # noqa: BLE001 - reported, and the others go on
            results.append({"op": o["op"], "rows": [], "error": f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"})
    return results


def tools(spark: SparkSession) -> DataFrame:
    """The catalogue: position, name, description and parameters (JSON) of each question that a snapshot answers."""
    rows = []
    for k, (name, fn) in enumerate((n, f) for n, f in inspect.getmembers(Snapshot, inspect.isfunction) if not n.startswith("_") and f.__doc__ or n in BATCHABLE):
        parameters = {p.name: {"type": str(p.annotation), "required": p.default is p.empty} | ({} if p.default is p.empty else {"default": p.default}) for p in list(inspect.signature(fn).parameters.values())[1:]}
        rows.append((k, name, "retrieval", (fn.__doc__ or "").strip().split("\n")[0], json.dumps(parameters, sort_keys=True)))
    return spark.createDataFrame(rows, "position int, name string, category string, description string, parameters string")


def tool_schema(spark: SparkSession, name: str) -> dict:
    """One tool's parameters."""
    row = tools(spark).filter(F.col("name") == name).first()
    if row is None:
        raise LookupError(name)
    return json.loads(row.parameters)


def compact_text(rows: DataFrame, columns: list[str], order: list) -> DataFrame:
    """(pos, line): rows as lines of their values, tabs between, in order; line ends inside values become spaces."""
    from ..operators.lookup import numbered

    line = F.concat_ws("\t", *[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), r"\s*\r?\n\s*", " ") for c in columns])
    return numbered(rows.select(*[F.col(c) for c in rows.columns], line.alias("line")), order).select("pos", "line")


def finalize(rows: DataFrame, mode: str, columns: list[str], order: list) -> DataFrame:
    """The wire's forms: `structured` keeps the rows, `text` is a JSON object a row, `compact_text` a line a row."""
    if mode == "structured":
        return rows.select(*columns)
    if mode == "text":
        return rows.select(F.replace(F.to_json(F.struct(*columns)), F.lit("\\r\\n"), F.lit("\\n")).alias("line"))
    if mode == "compact_text":
        return compact_text(rows, columns, order).select("line")
    raise ValueError("mode must be structured, text or compact_text")


def agent_identity(asked: Column, bound: str | None, trusted: bool = False) -> tuple[Column, Column]:
    """The agent a request acts as, and why it may not. A bound process takes no other name; without one the name is the request's own word, but
    `admin` is nobody's to claim."""
    form = r"^[a-zA-Z0-9_-]{1,64}$"
    asked = F.when(asked != "", asked)
    chosen = F.coalesce(asked, F.lit("anonymous")) if not bound else F.coalesce(asked, F.lit(bound)) if trusted else F.lit(bound)
    error = F.when(~F.coalesce(asked, F.lit(bound or "anonymous")).rlike(form), "invalid_agent_id")
    if bound and not trusted:
        error = F.coalesce(error, F.when(asked.isNotNull() & (asked != bound), "not_the_bound_agent"))
    if not trusted:
        error = F.coalesce(error, F.when(chosen == "admin", "reserved_agent_id"))
    return F.when(error.isNull(), chosen), error


def word_forms(files: DataFrame, languages: tuple[str, ...] = ("java", "c_sharp")) -> DataFrame:
    """One row: whether at least half of the parsed files are in languages whose names are searched by word forms, too."""
    parsed = files.filter(F.col("parse_status") == "parsed")
    return parsed.agg((F.coalesce(F.count_if(F.col("language").isin(*languages)) * 2 >= F.count("*"), F.lit(False)) & (F.count("*") > 0)).alias("enabled"))


def body_matches(index: DataFrame, terms: list[str], every: bool = True) -> DataFrame:
    """(id) of the documents of an inverted index that hold every term, or any."""
    hits = index.filter(F.col("term").isin(*terms)).select("term", "id").distinct()
    return hits.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") >= (len(set(terms)) if every else 1)).select("id")


def stage_match(path: Column, terms: list[str], pattern: str | None) -> Column:
    """The least query term in the name of a file that the pattern marks as a stage; null without one."""
    if not pattern:
        return F.lit(None).cast("string")
    stem = F.regexp_replace(F.lower(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)), r"^(.+)\.[^.]*$", "$1")
    first = F.array_min(F.filter(F.array(*map(F.lit, terms)).cast("array<string>"), lambda t: F.contains(stem, t)))
    return F.when(stem.rlike(pattern), first)


def word_parts(query: Column, least: int = 3) -> Column:
    """Identifier parts of a query's words that are long enough, by first appearance."""
    words = F.regexp_extract_all(query, F.lit(r"([A-Za-z0-9_]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.flatten(F.transform(words, T.split_identifier)), lambda x: F.length(x) >= least))


def iso_utc(at: Column) -> Column:
    """A time in UTC, to the microsecond, with its offset."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
