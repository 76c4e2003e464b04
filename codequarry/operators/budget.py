"""Token budgets: first fit with skips, prefixes, popping from the tail, and sections with shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .folds import ordered_fold


def first_fit(costs: Column, budget: int) -> Column:
    """Array of booleans: which of an ordered array of costs are taken. An item that doesn't fit is skipped and later ones may fit; the first is always taken."""
    step = lambda acc, c: F.when(
        (acc["used"] + c <= budget) | (F.size(acc["taken"]) == 0), F.struct((acc["used"] + c).alias("used"), F.concat(acc["taken"], F.array(F.lit(True))).alias("taken"))
    ).otherwise(F.struct(acc["used"].alias("used"), F.concat(acc["taken"], F.array(F.lit(False))).alias("taken")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("taken"))
    return F.aggregate(costs, start, step, lambda acc: acc["taken"])


def pack_first_fit(items: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """Items with `taken`, per group, in order. Rows stream by; of a group only the used sum is kept."""
    at = items.columns.index(cost)

    def step(used, row):
        ok = used is None or used + row[at] <= budget
        return ((used or 0) + row[at] if ok else used), (*row, ok)

    return ordered_fold(items, [group], [order], lambda: None, step, StructType([*items.schema, StructField("taken", BooleanType())]))


def prefix_fit(items: DataFrame, group: str, order: list, cost: str, budget: int) -> DataFrame:
    """Rows while the running cost stays within the budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(cost).over(w)).filter(F.col("used") <= budget)


def pop_tail(items: DataFrame, group: str, order: list, cost: str, budget: int, share: float = 1.0) -> DataFrame:
    """Rows that stay when the last ones go until the rest fit in a share of the budget: for costs above 0, a prefix."""
    return prefix_fit(items, group, order, cost, int(budget * share))


#: Shares of a context packet's sections.
SHARES = {"target": 0.30, "callees": 0.25, "callers": 0.25, "more": 0.08, "context": 0.12}


def packet(sections: dict[str, list[tuple[str, int]]], budget: int, shares: dict[str, float] | None = None) -> dict[str, list[str]]:
    """Items (text, cost) of each section within its share; what a section leaves goes on to the next, and what all leave to a second pass."""
    shares = shares or SHARES
    taken: dict[str, list[str]] = {s: [] for s in shares}
    left: dict[str, list[tuple[str, int]]] = {s: list(sections.get(s, ())) for s in shares}
    spare = budget - sum(int(budget * x) for x in shares.values())
    for s, share in shares.items():
        room = int(budget * share) + spare
        while left[s] and left[s][0][1] <= room:
            text, cost = left[s].pop(0)
            taken[s].append(text)
            room -= cost
        spare = room
    for s in shares:
        while left[s] and left[s][0][1] <= spare:
            text, cost = left[s].pop(0)
            taken[s].append(text)
            spare -= cost
    return taken


def envelope(rows: DataFrame, order: list, cost: str, budget: int, **fields) -> DataFrame:
    """One response row: the packed items as JSON, tokens asked for and used, whether some were left out, and given fields."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    packed = rows.withColumn("__used", F.sum(cost).over(w)).withColumn("__fits", F.col("__used") <= budget)
    item = F.when(F.col("__fits"), F.struct(F.col("__used").alias("u"), F.to_json(F.struct(*rows.columns)).alias("j")))
    return packed.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"]), "\n").alias("data"),
        F.coalesce(F.max(F.when(F.col("__fits"), F.col("__used"))), F.lit(0)).cast("long").alias("used_tokens"),
        F.coalesce(F.max((~F.col("__fits")).cast("int")), F.lit(0)).cast("boolean").alias("truncated"),
    ).select(F.lit(budget).cast("long").alias("requested_tokens"), "used_tokens", "truncated", "data", *[F.lit(v).alias(k) for k, v in fields.items()])
