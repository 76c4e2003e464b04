"""Resolution of calls to symbols by rules in order of priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut
from .lookup import innermost

# How far a resolution within each scope is trusted.
CONFIDENCE = {
    "same_class": 0.95, "same_class_split": 0.85, "implicit_this": 0.90, "implicit_this_partial": 0.85, "overload_arity": 0.85, "overload_group": 0.70,
    "cha_inherited": 0.90, "attr_type": 0.95, "attr_type_inherited": 0.90, "attr_param": 0.90, "exact_receiver_type": 0.95, "field_type": 0.85, "same_file": 0.90,
    "receiver_match": 0.90, "import_match": 0.90, "import_module_match": 0.75, "same_package": 0.75, "same_namespace": 0.80, "namespace_match": 0.80, "global": 0.40,
    "virtual_stub": 0.90, "overload_types": 0.85, "chain_type": 0.85, "extension_method": 0.75, "ambiguous": 0.10,
}


def _owner(qualified: Column) -> Column:
    """What stands before the last dot."""
    return F.regexp_extract(qualified, r"^(.*)\.[^.]*$", 1)


def scopes(extra: dict[str, Column] | None = None) -> dict[str, Column]:
    """Conditions on a (call, candidate) row, in order of priority. Columns that a rule needs are nullable: a null says no."""
    package = lambda c: F.regexp_extract(c, r"^(.*/)[^/]*$", 1)
    rules = {
        "same_class": F.col("receiver").isin("self", "this") & (_owner(F.col("caller_qualified")) == _owner(F.col("qualified_name"))),
        "attr_type": F.col("receiver").rlike(r"^(self|this)\.") & (F.col("receiver_type") == F.substring_index(_owner(F.col("qualified_name")), ".", -1)),
        "exact_receiver_type": F.col("receiver_type").isNotNull() & (F.col("receiver_type") == F.substring_index(_owner(F.col("qualified_name")), ".", -1)),
        "receiver_match": F.col("receiver").isNotNull() & (F.col("receiver") == F.substring_index(_owner(F.col("qualified_name")), ".", -1)),
        "implicit_this": F.col("receiver").isNull() & F.col("caller_qualified").contains(".") & (_owner(F.col("caller_qualified")) == _owner(F.col("qualified_name"))),
        "same_file": F.col("call_path") == F.col("path"),
        "import_match": F.exists(F.coalesce("imported", F.array().cast("array<string>")), lambda m: F.array_contains(F.col("candidate_modules"), m)),
        "same_namespace": F.col("namespace") == F.col("call_namespace"),
        "same_package": package(F.col("call_path")) == package(F.col("path")),
        "global": F.lit(True),
    }
    return rules | (extra or {})


def decide(candidates: DataFrame, call: list[str], rules: dict[str, Column]) -> DataFrame:
    """Rows are distinct by call and symbol, or by call and class of `classes`. Per call: the first rule under which a candidate stands, resolved if exactly one does (or all are overloads of one name), else ambiguous.

    Each (call, candidate) row gets its first rule; one aggregation finds each call's best rule and the candidates under it."""
    names = list(rules)
    rank = F.lit(None).cast("int")
    for k in range(len(names) - 1, -1, -1):
        rank = F.when(F.coalesce(rules[names[k]], F.lit(False)), k).otherwise(rank)
    ranked = candidates.withColumn("rule", rank).filter("rule is not null")
    # Overload pick: by arity, then the smallest start. A name is single if its least and greatest are equal, so one pass with partial aggregation does.
    fits = lambda n_params: F.coalesce(n_params == F.col("arg_count"), F.lit(False))
    pick = lambda c: F.struct((~fits(c["n_params"])).alias("wrong"), c["start_line"].alias("start_line"), c["symbol_id"].alias("symbol_id"))
    if "same" in candidates.columns:
        many = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + x["n"])
        n, n_fit, first_fit = many(F.col("same")), many(F.filter("same", lambda x: fits(x["n_params"]))), F.array_min(F.transform("same", pick))
    else:
        n, n_fit, first_fit = F.lit(1).cast("long"), fits(F.col("n_params")).cast("long"), pick({c: F.col(c) for c in ("n_params", "start_line", "symbol_id")})
    named = F.struct("qualified_name", "path")
    per_rule = ranked.groupBy(*call, "rule").agg(F.sum(n).alias("n"), F.min(named).alias("lo"), F.max(named).alias("hi"), F.min(first_fit).alias("best"), F.sum(n_fit).alias("n_fit"))
    first = F.min(F.struct("rule", "n", (F.col("lo") == F.col("hi")).alias("one_name"), "best", "n_fit"))
    best = per_rule.groupBy(*call).agg(first.alias("b")).select(*call, "b.*")
    scope = F.element_at(F.array(*map(F.lit, names)), F.col("rule") + 1)
    single, overload = F.col("n") == 1, F.col("one_name")
    name = F.when(single, scope).when(overload & (F.col("n_fit") == 1), "overload_arity").when(overload, "overload_group").otherwise("ambiguous")
    table = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return best.select(
        *call, F.when(single | overload, F.col("best.symbol_id")).alias("target_symbol_id"), F.when(single | overload, "resolved").otherwise("ambiguous").alias("status"), name.alias("scope"),
        F.element_at(table, name).alias("confidence"), F.col("n").alias("n_candidates"),
    )


def classes(candidates: DataFrame) -> DataFrame:
    """Candidates that no rule tells apart as one row: in `same` (array) for each number of parameters how many there are (`n`) and the first of them."""
    keys = [c for c in candidates.columns if c not in ("symbol_id", "start_line", "n_params")]
    first = F.min(F.struct("start_line", "symbol_id")).alias("first")
    by_arity = candidates.groupBy(*keys, "n_params").agg(F.count("*").alias("n"), first)
    return by_arity.groupBy(*keys).agg(F.collect_list(F.struct("n_params", "n", "first.start_line", "first.symbol_id")).alias("same"))


def by_context(calls: DataFrame, candidates: DataFrame, name: str, context: list[str], rules: dict[str, Column], near: tuple[str, str] | None = None) -> DataFrame:
    """Calls with their decisions, which are made once for each distinct context and joined back: a context meets the classes of the name's
    candidates, so the rows that meet grow with what differs on both sides and not with calls times candidates. `name` is in the context and
    named alike in the candidates, which have no columns but those that the rules read.

    `near` names a column of the context and one of the candidates whose equality is the first rule: contexts with such candidates are decided by
    them alone, in a join on both, and only the others meet all candidates of their name."""
    whole = F.struct(*context).alias("__context")  # equal in all parts, of which any may be null
    # Few bytes of contexts make many rows with their candidates: adaptive plans may not merge these partitions.
    parts = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    contexts, candidates = calls.select(*context).distinct().repartition(parts, *context), classes(candidates)
    if near is None:
        decided = decide(contexts.join(candidates, name), context, rules)
    else:
        first = next(iter(rules))
        close = contexts.join(candidates, (contexts[name] == candidates[name]) & (contexts[near[0]] == candidates[near[1]])).drop(candidates[name])
        decided = cut(decide(close, context, {first: rules[first]}), "near")
        rest = contexts.select("*", whole).join(decided.select(whole), "__context", "left_anti").drop("__context")
        decided = decided.unionByName(decide(rest.join(candidates, name), context, rules))
    return calls.select("*", whole).join(decided.select(whole, *[c for c in decided.columns if c not in context]), "__context").drop("__context")


def dedupe(edges: DataFrame, order: list[str]) -> DataFrame:
    """The first edge of each (source, target, stub, name, kind)."""
    keys = ["source_symbol_id", "target_symbol_id", "target_stub_id", "target_name", "edge_kind"]
    w = Window.partitionBy(*keys).orderBy(*order)
    return edges.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def build_edges(calls: DataFrame, symbols: DataFrame, imports: DataFrame, namespaces: DataFrame | None = None) -> DataFrame:
    """Edges of parsed calls: the innermost symbol around each, candidates by name, then the rules. `namespaces` (path, namespace) are of those languages that have them."""
    s = symbols.select("symbol_id", "path", "name", "qualified_name", "kind", "start_line", "end_line", F.col("n_params"))
    caller = innermost(calls, s).withColumnRenamed("symbol_id", "caller_id").filter("caller_id is not null")
    known = s.select(F.col("symbol_id").alias("caller_id"), F.col("qualified_name").alias("caller_qualified"))
    kind = F.col("receiver_type") if "receiver_type" in calls.columns else F.lit(None).cast("string")
    found = calls.select("path", "line", "name", "start_byte", "receiver", kind.alias("receiver_type"), "arg_count").distinct().join(caller, ["path", "line"]).join(known, "caller_id")
    mods = imports.groupBy("path").agg(F.collect_set("module").alias("imported"))
    from ..functions.text import module_candidates

    cands = s.filter(~F.col("name").startswith("<")).withColumn("candidate_modules", module_candidates(F.col("path")))
    full = F.transform("candidate_modules", lambda m: F.concat(m, F.lit("."), F.col("name")))
    cands = cands.withColumn("candidate_modules", F.concat("candidate_modules", full))
    if namespaces is None:
        spaces = cands.select("path", F.lit(None).cast("string").alias("namespace")).distinct()
    else:
        spaces = namespaces.groupBy("path").agg(F.min("namespace").alias("namespace"))
    cands = cands.join(spaces, "path", "left")
    joined = found.withColumnRenamed("path", "call_path").join(cands.drop("end_line", "kind"), "name").filter("caller_id <> symbol_id").join(mods.withColumnRenamed("path", "call_path"), "call_path", "left")
    joined = joined.join(spaces.withColumnsRenamed({"path": "call_path", "namespace": "call_namespace"}), "call_path", "left")
    decided = decide(joined, ["caller_id", "call_path", "line", "start_byte", "name"], scopes())
    return decided.select(F.col("caller_id").alias("source_symbol_id"), "target_symbol_id", F.lit(None).cast("string").alias("target_stub_id"), F.col("name").alias("target_name"), F.lit("calls").alias("edge_kind"), "status", F.lit("lexical").alias("backend"), "confidence", F.col("call_path").alias("source_path"), F.col("line").alias("source_line"), F.array("scope").alias("evidence"))
