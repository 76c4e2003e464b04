"""Answers over a published snapshot: one method per question, each a DataFrame, so that answers compose and stay lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import budget, fulltext, graph, lookup, state
from ..sources.parse import skeleton
from ..sources.snapshot import Store, repo_state

MAX_LIMIT, MAX_DEPTH, MAX_HOPS, MAX_K, LEAST_BUDGET = 100, 3, 2, 8, 32


def checked(name: str, value: int, low: int, high: int) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
        raise ValueError(f"{name} must be an integer from {low} to {high}")
    return value


class Snapshot:
    def __init__(self, store: Store, run_id: str | None = None):
        self.store, self.run_id = store, run_id or store.current()
        if not self.run_id:
            raise LookupError("nothing is published")

    def table(self, name: str) -> DataFrame:
        return self.store.table(name, self.run_id)

    def index_status(self, listing: DataFrame | None = None) -> DataFrame:
        """One row: counts, edge precision and, given a listing of the tree, freshness."""
        files, edges = self.table("files"), self.table("edges")
        counts = files.agg(F.count("*").alias("n_files"), F.count_if(F.col("parse_status") == "parsed").alias("n_parsed"))
        more = edges.agg(F.count("*").alias("n_edges"), F.round(F.avg((F.col("status") == "resolved").cast("double")), 3).alias("resolved_share"))
        row = counts.join(F.broadcast(more)).join(F.broadcast(self.table("symbols").agg(F.count("*").alias("n_symbols"))))
        fresh = repo_state(files, listing) if listing is not None else None
        return row.join(F.broadcast(fresh)) if fresh is not None else row.withColumn("state", F.lit("unknown"))

    def find_symbols(self, pattern: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        return lookup.find_symbols(self.table("symbols"), pattern, kind, checked("limit", limit, 1, MAX_LIMIT))

    def search_source(self, query: str, limit: int = 10, expand: bool = False, k: int = 5, hops: int = 1) -> DataFrame:
        """Symbols by BM25 over name, qualified name, tokens and body: all terms before some, three of a file at most, tests last."""
        checked("limit", limit, 1, MAX_LIMIT)
        terms = [t for t in T.query_terms(query) if t not in T.STOP_WORDS] or T.query_terms(query)
        s = self.table("symbols").join(self.table("module_text"), "path", "left")
        body = F.array_join(F.slice(F.split("text", "\n"), F.col("start_line"), F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1)), "\n")
        docs = s.select("symbol_id", "name", "qualified_name", F.array_join(T.split_identifier(F.col("name")), " ").alias("code_tokens"), body.alias("own_body"))
        scored = fulltext.scan_bm25(docs, "symbol_id", fulltext.WEIGHTS, terms).withColumnRenamed("id", "symbol_id")
        ranked = fulltext.and_then_or(scored.join(self.table("symbols"), "symbol_id"), len(terms), limit)
        test, vendored = T.test_path_search(F.col("path")), T.vendored_path(F.col("path"))
        order = [test, vendored, F.col("phase"), F.col("score"), F.col("path"), F.col("start_line"), F.col("symbol_id")]
        top = fulltext.per_file_top(ranked, order).orderBy(*order).limit(limit).select("symbol_id", "path", "name", "start_line", F.round("score", 6).alias("score"), "phase")
        if not expand:
            return top
        anchors = [r.symbol_id for r in top.limit(graph.MAX_ANCHORS).collect()]
        near = graph.expand(self.table("symbols"), self.table("edges"), anchors, terms, checked("k", k, 1, MAX_K), checked("hops", hops, 1, MAX_HOPS))
        return top.withColumn("relation", F.lit("match")).unionByName(near.select("symbol_id", "path", "name", F.col("start_line"), "score", F.lit(2).alias("phase"), "relation"))

    def repo_map(self, query: str | None = None, budget_tokens: int = 1024, include_tests: bool = True) -> DataFrame:
        """Symbols by rank (and closeness to a query), packed to a budget."""
        checked("budget_tokens", budget_tokens, LEAST_BUDGET, 8192)
        s = self.table("symbols").join(self.table("symbol_rank"), "symbol_id", "left")
        if not include_tests:
            s = s.filter(~T.test_path_graph(F.col("path")))
        terms = T.query_terms(query) if query else []
        hits = F.size(F.array_intersect(T.split_identifier(F.col("name")), F.array(*map(F.lit, terms)).cast("array<string>")))
        ranked = s.withColumn("score", F.coalesce("score", F.lit(0.0)) + 8.0 * hits)
        rows = lookup.numbered(ranked, [F.col("score").desc(), F.col("path"), F.col("start_line"), F.col("symbol_id")])
        rows = rows.withColumn("line", F.concat_ws(" ", "path", T.compact_declaration(F.col("kind"), F.col("qualified_name")), F.col("start_line").cast("string")))
        packed = budget.pack_first_fit(rows.select(F.lit(1).alias("one"), "pos", "line", "symbol_id", T.estimate_tokens(F.col("line")).alias("cost")), "one", "pos", "cost", budget_tokens)
        return packed.filter("taken").select("pos", "line", "symbol_id", "cost")

    def impact_slice(self, symbol_id: str, direction: str = "callers", depth: int = 2, max_nodes: int = 100, min_confidence: float = 0.0, drop_ambiguous: bool = False) -> tuple[DataFrame, DataFrame, bool]:
        """Nodes and edges around a symbol, filtered after the walk, and whether the cap was met."""
        if direction not in ("callers", "callees", "both"):
            raise ValueError("direction must be callers, callees or both")
        nodes, edges, limited = graph.bounded_bfs(self.table("edges"), self.resolve_ref(symbol_id), direction, checked("depth", depth, 0, MAX_DEPTH), checked("max_nodes", max_nodes, 1, 500))
        edges = edges.filter(F.col("confidence") >= min_confidence)
        return nodes, edges.filter("status <> 'ambiguous'") if drop_ambiguous else edges, limited

    def symbol_context(self, symbol_id: str, depth: int = 1) -> DataFrame:
        """The symbol and its neighbours both ways, with bodies."""
        nodes, _, _ = graph.bounded_bfs(self.table("edges"), self.resolve_ref(symbol_id), "both", checked("depth", depth, 0, MAX_DEPTH))
        s = self.table("symbols").join(F.broadcast(nodes), "symbol_id").join(self.table("module_text"), "path", "left")
        # By lines: a redacted line is a line still, but not as long as it was.
        return s.select("symbol_id", "path", "qualified_name", "level", F.array_join(F.slice(F.split("text", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("body"))

    def resolve_ref(self, ref: str) -> str:
        """A symbol id, or the only one that an eight-digit reference stands for."""
        if len(ref) != 8:
            return ref
        found = self.table("symbols").filter(T.compact_ref(F.col("symbol_id")) == ref).select("symbol_id").limit(2).collect()
        if len(found) != 1:
            raise LookupError(f"{ref} stands for {'no symbol' if not found else 'several symbols'}")
        return found[0].symbol_id

    def module_dependents(self, path: str) -> DataFrame:
        names = self.table("files").filter(F.col("path") == path).select(F.explode(T.module_candidates(F.col("path"))).alias("m"))
        mine = self.table("imports").filter(F.col("path") == path).select(F.lit("imports").alias("relation"), F.col("module").alias("name")).distinct()
        theirs = self.table("imports").join(F.broadcast(names), F.col("module").eqNullSafe(F.col("m")) | F.col("module").startswith(F.concat("m", F.lit("."))), "left_semi").select(F.lit("imported_by").alias("relation"), F.col("path").alias("name")).distinct()
        return mine.unionByName(theirs)

    def file_skeleton(self, path: str, include_private: bool = True) -> str:
        """Imports and headers of one file (two point lookups)."""
        text = self.table("module_text").filter(F.col("path") == path).first()
        if text is None:
            raise LookupError(path)
        return skeleton(text.text, [r.asDict() for r in self.table("symbols").filter(F.col("path") == path).collect()], include_private)


class Memory:
    """A keyed store with expiry over versioned tables: each put is a new version, published by the pointer."""

    SCHEMA = "scope string, namespace string, key string, seq long, value string, created_at double, expires_at double"

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def _entries(self) -> DataFrame:
        return self.store.table("key_values") if self.store.current() else self.spark.createDataFrame([], self.SCHEMA)

    def _save(self, df: DataFrame) -> None:
        run = f"{len(self.store.runs()):08d}"
        self.store.write(run, {"key_values": df}, {})
        self.store.publish(run)

    def put(self, puts: DataFrame) -> None:
        """Upserts rows of SCHEMA; secrets in values are redacted; of equal keys the last seq counts."""
        new = state.latest(puts.withColumn("value", T.redact(F.col("value"))))
        self._save(state.merge(self._entries(), new, state.KEY))

    def get(self, requests: DataFrame, now: float) -> DataFrame:
        return state.get(self._entries(), requests, now)

    def delete(self, keys: DataFrame) -> None:
        self._save(self._entries().join(keys, state.KEY, "left_anti"))

    def sweep(self, now: float) -> None:
        self._save(state.live(self._entries(), now))

    def search(self, query: str, now: float, scope: str | None = None, limit: int = 20) -> DataFrame:
        """Phrases in quotes and words, all of them, over key and value, best first."""
        e = state.live(self._entries(), now)
        e = e.filter(F.col("scope") == scope) if scope else e
        e = e.withColumn("id", F.concat_ws("\u0001", *state.KEY)).withColumn("doc", F.concat_ws(" ", "key", "value"))
        found = fulltext.phrase_filter(e, "doc", query)
        scored = fulltext.scan_bm25(e.select("id", "doc"), "id", {"doc": 1.0}, T.query_terms(query))
        return found.join(scored, "id").orderBy("score", "id").limit(limit).select(*state.KEY, "value", F.round("score", 6).alias("score"))
