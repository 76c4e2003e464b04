"""Lookups over symbols, files and imports: wildcards, counts, joins, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .checkpoints import cut


def kind_filter(kind: str) -> Column:
    """A method may also be a function with a dotted name."""
    if kind == "method":
        return (F.col("kind") == "method") | ((F.col("kind") == "function") & F.col("qualified_name").contains("."))
    return F.col("kind") == kind


def matching(symbols: DataFrame, pattern: str, kind: str | None = None) -> DataFrame:
    like, _ = T.wildcard(pattern)
    found = symbols.filter(T.ascii_like(F.col("name"), like) | T.ascii_like(F.col("qualified_name"), like))
    return found.filter(kind_filter(kind)) if kind else found


def relevance(pattern: str) -> list[Column]:
    """Sort keys: how exactly the name is meant, tests last, then shorter names."""
    target = pattern.replace("*", "").replace("?", "").strip()
    test = F.when(F.col("path").startswith("tests/") | F.col("path").startswith("evals/"), 2).otherwise(1)
    if not target:
        return [test, F.col("name"), F.length("qualified_name"), F.col("path"), F.col("start_line")]
    rank, low = None, target.lower()
    steps = []
    for c in ("name", "qualified_name"):
        steps.append((c, F.col(c) == target, T.ascii_lower(F.col(c)) == low, F.col(c).startswith(target), T.ascii_lower(F.col(c)).startswith(low)))
    ordered = [steps[0][1], steps[0][2], steps[1][1], steps[1][2], steps[0][3], steps[0][4], steps[1][3], steps[1][4]]
    for k, cond in enumerate(ordered, 1):
        rank = F.when(cond, k) if rank is None else rank.when(cond, k)
    return [rank.otherwise(9), test, F.length("qualified_name"), F.col("path"), F.col("start_line")]


def find_symbols(symbols: DataFrame, pattern: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    return matching(symbols, pattern, kind).orderBy(*relevance(pattern), "symbol_id").limit(limit)


def count_symbols(symbols: DataFrame, pattern: str, kind: str | None = None) -> DataFrame:
    return matching(symbols, pattern, kind).agg(F.count("*").alias("n"))


def language_file_counts(files: DataFrame) -> DataFrame:
    return files.filter(F.col("parse_status") == "parsed").groupBy("language").agg(F.count("*").alias("n"))


def importer_count(imports: DataFrame) -> DataFrame:
    return imports.agg(F.count_distinct("path").alias("n"))


def importers_of(imports: DataFrame, modules: list[str]) -> DataFrame:
    return imports.filter(F.col("module").isin(*modules)).select("path").distinct()


def module_dependents(imports: DataFrame, path: str, modules: list[str]) -> DataFrame:
    """What a file imports, and who imports it."""
    mine = imports.filter(F.col("path") == path).select(F.lit("imports").alias("relation"), F.col("module").alias("name"))
    theirs = importers_of(imports, modules).select(F.lit("imported_by").alias("relation"), F.col("path").alias("name"))
    return mine.distinct().unionByName(theirs)


#: Lines of a bucket in which points and spans meet.
BUCKET = 128


def innermost(points: DataFrame, symbols: DataFrame, line: str = "line") -> DataFrame:
    """Each distinct (path, line) with the symbol of least span that contains it, then the latest start.

    Points and spans meet by path and bucket of lines, so a file of many symbols is no one group, and a point meets only what is near it."""
    s = symbols.select(F.col("path").alias("s_path"), "symbol_id", "start_line", "end_line")
    s = s.withColumn("s_bucket", F.explode(F.expr(f"sequence(cast(start_line div {BUCKET} as bigint), cast(greatest(start_line, end_line) div {BUCKET} as bigint))")))
    p = points.select("path", line).distinct().withColumn("bucket", F.expr(f"cast({line} div {BUCKET} as bigint)"))
    inside = p.join(s, (F.col("path") == F.col("s_path")) & (F.col("bucket") == F.col("s_bucket")) & F.col(line).between(F.col("start_line"), F.col("end_line")), "left")
    key = F.struct((F.col("end_line") - F.col("start_line")).alias("span"), (-F.col("start_line")).alias("late"), F.col("symbol_id").alias("symbol_id"))
    return inside.groupBy("path", line).agg(F.min(F.when(F.col("symbol_id").isNotNull(), key)).alias("best")).select("path", line, F.col("best.symbol_id").alias("symbol_id"))


def numbered(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """Rows numbered from 1 in a total order, without sorting them in one task: they are dealt out by ranges, sorted there and written; each range
    then starts at the count of those before it (a row per range)."""
    kept = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "numbered")
    counts = kept.groupBy("__part").agg(F.count("*").alias("n"))
    first = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    at = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(first, "__part").withColumn(name, F.col("__first") + at + 1).drop("__part", "__at", "__first")


def parents(hierarchy: DataFrame, symbols: DataFrame) -> DataFrame:
    """class_hierarchy rows with the parent's symbol: by full name, else by the last part; of equal names the last one counts."""
    last = lambda key: symbols.groupBy(key.alias("key")).agg(F.max_by("symbol_id", F.struct("path", "start_line", "symbol_id")).alias("found"))
    full, short = last(F.col("qualified_name")), last(F.col("name"))
    joined = hierarchy.join(full.withColumnsRenamed({"key": "k1", "found": "f1"}), F.col("parent_name") == F.col("k1"), "left")
    joined = joined.join(short.withColumnsRenamed({"key": "k2", "found": "f2"}), F.substring_index("parent_name", ".", -1) == F.col("k2"), "left")
    return joined.select(*hierarchy.columns, F.coalesce("f1", "f2").alias("parent_symbol_id"))


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, each as often as it has them more."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def unique_remap(old: DataFrame, new: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Old to new ids by keys that are unique on both sides."""
    one = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(id_col).alias(name)).filter("n = 1").drop("n")
    return one(old, "old_id").join(one(new, "new_id"), keys)


def last_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def family_defer(ranked: DataFrame, cap: int, pos: str = "pos") -> DataFrame:
    """Rows past the cap of one name, or repeats of one qualified name, move behind the others, in order."""
    by_name = F.row_number().over(Window.partitionBy("name").orderBy(pos))
    by_qualified = F.row_number().over(Window.partitionBy("qualified_name").orderBy(pos))
    flagged = ranked.withColumn("deferred", (by_name > cap) | (by_qualified > 1))
    return numbered(flagged, ["deferred", pos], "new_pos")


def compact_map_order(ranked: DataFrame, anchors: int = 20, pos: str = "pos") -> DataFrame:
    """The first rows, then those of the same files, then the rest."""
    tier = F.when(F.col(pos) <= anchors, 0).when(F.max((F.col(pos) <= anchors).cast("int")).over(Window.partitionBy("path")) == 1, 1).otherwise(2)
    return ranked.withColumn("tier", tier)
