"""Evidence and structure: call sites against gold, guardrails, roles, packets' distances, documentation runs, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def essential_distance(rows: DataFrame, group: str, order: str, essential: str) -> DataFrame:
    """Distance of each line to the nearest essential one before or after it."""
    back = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(group).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(essential), F.col(order))
    return rows.withColumn("distance", F.least(F.col(order) - F.last(at, True).over(back), F.first(at, True).over(ahead) - F.col(order)))


def first_broken(steps: DataFrame, group: str, order: str, valid: str) -> DataFrame:
    """Steps before the first invalid one, and where to look again."""
    broken = F.min(F.when(~F.col(valid), F.col(order))).over(Window.partitionBy(group))
    return steps.withColumn("recheck_from", broken).filter(F.col("recheck_from").isNull() | (F.col(order) < F.col("recheck_from")))


def doc_blocks(lines: DataFrame, comment: str = r"^\s*(#|//|\*|/\*)") -> DataFrame:
    """Runs of comment lines: path, first and last line."""
    marked = lines.filter(F.col("line").rlike(comment))
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("path").orderBy("line_no"))
    return marked.withColumn("island", island).groupBy("path", "island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line")).drop("island")


def doc_of_symbols(symbols: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each symbol with the comment block that ends on the line before it."""
    b = blocks.select("path", F.col("start_line").alias("doc_start"), F.col("end_line").alias("doc_end"))
    return symbols.join(b, ["path"]).filter(F.col("doc_end") == F.col("start_line") - 1)


def call_sites(gold: DataFrame, edges: DataFrame, least: float = 0.6) -> DataFrame:
    """Gold call sites (path, line, name, expected) with what the edges say there: the edge of that name, else the only edge on the line."""
    e = edges.select(F.col("source_path").alias("path"), F.col("source_line").alias("line"), F.col("target_name").alias("e_name"), "target_symbol_id", "confidence")
    by_line = e.groupBy("path", "line").agg(F.count("*").alias("n_edges"), F.collect_list(F.struct("e_name", "target_symbol_id", "confidence")).alias("es"))
    named = F.filter("es", lambda x: x["e_name"] == F.col("name"))
    chosen = F.when(F.size(named) > 0, F.element_at(named, 1)).when(F.col("n_edges") == 1, F.element_at("es", 1))
    joined = gold.join(by_line, ["path", "line"], "left").withColumn("edge", chosen)
    trusted = F.col("edge.confidence") >= least
    return joined.select(*gold.columns, F.when(trusted, F.col("edge.target_symbol_id")).alias("found"))


def precision_recall(sites: DataFrame) -> DataFrame:
    hit = F.col("found").isNotNull() & (F.col("found") == F.col("expected"))
    return sites.agg(F.count("*").alias("n"), F.round(F.count_if(hit) / F.nullif(F.count("found"), F.lit(0)), 4).alias("precision"), F.round(F.count_if(hit) / F.nullif(F.count("expected"), F.lit(0)), 4).alias("recall"))


def grounded(mentioned: Column, anchors: Column) -> tuple[Column, Column]:
    """Share of what a summary mentions that is verified, and share of the verified anchors that it mentions."""
    both = F.size(F.array_intersect(mentioned, anchors))
    share = lambda n: F.when(n > 0, both / n).otherwise(1.0)
    return share(F.size(mentioned)), share(F.size(anchors))


def name_index(symbols: DataFrame) -> DataFrame:
    """name -> ordered structs of its symbols."""
    row = F.struct("path", "qualified_name", "kind", F.col("symbol_id").cast("string").alias("symbol_id"))
    return symbols.groupBy("name").agg(F.array_sort(F.collect_list(row)).alias("entries"))


def changed_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names whose symbols differ between two snapshots: only calls to these need resolving again."""
    a, b = name_index(old).withColumnRenamed("entries", "a"), name_index(new).withColumnRenamed("entries", "b")
    return a.join(b, "name", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("name")


def to_resolve(calls: DataFrame, changed: DataFrame, reparsed: DataFrame) -> DataFrame:
    """Files whose calls must be resolved again: those parsed anew, and those that mention a changed name."""
    return calls.join(changed, "name", "left_semi").select("path").unionByName(reparsed.select("path")).distinct()


def module_links(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target): the file a module name stands for, by its full dotted name, else without its last part."""
    names = files.select(F.col("path").alias("target"), F.explode(T.module_candidates(F.col("path"))).alias("m")).groupBy("m").agg(F.min("target").alias("target"))
    full, short = names.withColumnsRenamed({"m": "m1", "target": "t1"}), names.withColumnsRenamed({"m": "m2", "target": "t2"})
    joined = imports.join(full, F.col("module") == F.col("m1"), "left").join(short, F.regexp_extract("module", r"^(.*)\.[^.]+$", 1) == F.col("m2"), "left")
    return joined.select("path", F.coalesce("t1", "t2").alias("target")).filter("target is not null and target <> path").distinct()


def suffix_matches(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, module, target): files whose path ends with the module's segments. Suffixes are exploded, so the join is by equality."""
    bare = F.regexp_replace(F.regexp_replace("path", r"\.[^./]+$", ""), r"/__init__$", "")
    parts = F.split(bare, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    ends = files.select(F.col("path").alias("target"), F.explode(suffixes).alias("module"))
    return imports.join(ends, "module").filter("target <> path").select("path", "module", "target")


def js_candidates(source: Column, target: Column) -> Column:
    """Paths that a relative specifier may mean: joined to the importer's folder, with each ending and index file."""
    folder = F.regexp_extract(source, r"^(.*/)?[^/]*$", 1)
    joined = F.regexp_replace(F.concat(folder, target), r"(^|/)\./", "$1")
    for _ in range(8):
        joined = F.regexp_replace(joined, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    endings = ["", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", "/index.js", "/index.jsx", "/index.ts", "/index.tsx", "/index.mjs"]
    return F.transform(F.array(*map(F.lit, endings)), lambda e: F.concat(joined, e))


def script_links(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, module, target): the file that a relative specifier means, the first of its candidates that exists."""
    relative = imports.filter(F.col("module").startswith("."))
    tried = relative.select("path", "module", F.posexplode(js_candidates(F.col("path"), F.col("module"))).alias("pos", "target"))
    return tried.join(files.select(F.col("path").alias("target")), "target").groupBy("path", "module").agg(F.min_by("target", "pos").alias("target"))


def structural_roles(symbols: DataFrame, hierarchy: DataFrame, entry_targets: DataFrame) -> DataFrame:
    """Roles by structure: protocols, what implements them, and declared entry points (module:attribute with one match)."""
    protocol = symbols.filter((F.col("kind") == "interface") | F.col("name").rlike("(Protocol|Base|Interface)$")).select("symbol_id", F.col("name").alias("parent"))
    parents_of = hierarchy.select("class_name", F.substring_index("parent_name", ".", -1).alias("parent"))
    implements = parents_of.join(protocol.select("parent"), "parent", "left_semi").select(F.col("class_name").alias("qualified_name")).distinct()
    mods = symbols.withColumn("m", F.explode(T.module_candidates(F.col("path"))))
    entry = entry_targets.select(F.split("target", ":")[0].alias("m"), F.split("target", ":")[1].alias("qualified_name"))
    hits = mods.join(entry, ["m", "qualified_name"]).groupBy("m", "qualified_name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("symbol_id")).filter("n = 1").select("symbol_id")
    tagged = (
        protocol.select("symbol_id", F.lit("protocol_definition").alias("role"))
        .unionByName(symbols.join(implements, "qualified_name", "left_semi").select("symbol_id", F.lit("protocol_implementation").alias("role")))
        .unionByName(hits.select("symbol_id", F.lit("declared_entry_point").alias("role")))
    )
    roles = tagged.groupBy("symbol_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return symbols.join(roles, "symbol_id", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))


def role_counts(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.explode("roles").alias("role")).groupBy("role").agg(F.count("*").alias("n"))


def query_signature(stems: Column) -> Column:
    """The first 16 hex digits of the digest of a query's sorted distinct stems."""
    return F.substring(F.sha2(F.to_json(F.array_sort(F.array_distinct(stems))), 256), 1, 16)


def canonical(columns: list[str]) -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def strip_empty(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull() & (v != ""))


def edge_context_digest(hierarchy: DataFrame, most_edges: int) -> DataFrame:
    """A digest of what resolution depends on besides names: row digests are summed, so no task gathers them."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", "class_name", "parent_name"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return hierarchy.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.sum(part).cast("string"), F.lit(str(most_edges))), 256).alias("digest"))


def count_params(signature: Column) -> Column:
    """Parameters of a signature, by commas outside inner brackets; null without a parameter list."""
    inner = F.regexp_extract(signature, r"^[^(]*\((.*)\)[^)]*$", 1)
    flat = inner
    for _ in range(4):
        flat = F.regexp_replace(flat, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>", "")
    return F.when(~signature.rlike(r"\(.*\)"), F.lit(None).cast("int")).when(F.trim(inner) == "", 0).otherwise(F.size(F.split(flat, ",")))
