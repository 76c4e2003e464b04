"""Statistics of benchmark runs and ranked results."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 2000


def arm_summary(runs: DataFrame) -> DataFrame:
    """Medians and success rate of each arm; a metric that any of its rows lacks is null."""
    whole = lambda c, agg: F.when(F.count(c) == F.count("*"), agg)
    return runs.groupBy("arm").agg(
        F.count("*").alias("n_runs"),
        whole("total_tokens", F.median("total_tokens")).alias("median_tokens"),
        whole("latency_seconds", F.median("latency_seconds")).alias("median_latency"),
        whole("task_success", F.avg(F.col("task_success").cast("double"))).alias("success_rate"),
    )


def paired(runs: DataFrame, baseline: str, keys: tuple[str, ...] = ("task_id", "seed")) -> DataFrame:
    """Rows of other arms beside the baseline's of the same keys; unmatched rows go."""
    base = runs.filter(F.col("arm") == baseline).groupBy(*keys).agg(F.max("total_tokens").alias("base_tokens"), F.max("latency_seconds").alias("base_latency"), F.max(F.col("task_success").cast("int")).alias("base_success"))
    return runs.filter(F.col("arm") != baseline).join(base, list(keys))


def paired_reduction(runs: DataFrame, baseline: str) -> DataFrame:
    """Median relative reduction of tokens, and mean change of success, of each arm."""
    p = paired(runs, baseline).filter("base_tokens > 0")
    return p.groupBy("arm").agg(
        F.count("*").alias("n_pairs"), F.median(1 - F.col("total_tokens") / F.col("base_tokens")).alias("median_reduction"), F.avg(F.col("task_success").cast("int") - F.col("base_success")).alias("success_delta")
    )


#: Draws that are evaluated at once.
DRAWS = 4_000_000


def draws(n: int, seed: int) -> Iterator[np.ndarray]:
    """The numbers below n that Python's generator gives for this seed, as many as are asked for: the same 32-bit words, their highest bits,
    those from n on left out."""
    _, words, _ = random.Random(seed).getstate()
    source = np.random.MT19937()
    source.state = {"bit_generator": "MT19937", "state": {"key": np.array(words[:-1], np.uint32), "pos": words[-1]}}
    while True:
        some = source.random_raw(1 << 20).astype(np.uint32) >> np.uint32(32 - n.bit_length())
        yield some[some < n].astype(np.int64)


def bootstrap(values: list[float], statistic: str = "median", samples: int = SAMPLES, level: float = 0.95, seed: int = 0) -> tuple[float, float] | None:
    """Percentile interval of the median or mean over resamples, by Python's generator from a fixed seed."""
    if not values:
        return None
    of, n = np.asarray(values, float), len(values)
    fn = np.median if statistic == "median" else np.mean
    source, left, found = draws(n, seed), np.zeros(0, np.int64), []
    while len(found) < samples:
        rows = min(samples - len(found), max(1, DRAWS // n))
        parts, total = [left], len(left)
        while total < rows * n:
            parts.append(next(source))
            total += len(parts[-1])
        every = np.concatenate(parts)
        found += fn(of[every[: rows * n]].reshape(rows, n), axis=1).tolist()
        left = every[rows * n :]
    found.sort()
    low = (1 - level) / 2
    return found[int(low * (samples - 1))], found[int((1 - low) * (samples - 1))]


def bootstrap_intervals(df: DataFrame, group: str, value: str, statistic: str = "median", samples: int = SAMPLES) -> DataFrame:
    """(group, n, low, high). A group is one arm's pairs, which is the size of a benchmark."""
    key = df.schema[group].dataType.simpleString()

    def run(pdf):
        import pandas as pd

        values = sorted(pdf[value].dropna().tolist())
        ci = bootstrap(values, statistic, samples)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "n": [len(values)], "low": [ci and ci[0]], "high": [ci and ci[1]]})

    return df.select(group, F.col(value).cast("double").alias(value)).groupBy(group).applyInPandas(run, f"{group} {key}, n long, low double, high double")


def percentiles(df: DataFrame, group: str, value: str, at: dict[str, float]) -> DataFrame:
    """Exact percentiles by linear interpolation."""
    return df.groupBy(group).agg(*[F.percentile(value, F.lit(q)).alias(name) for name, q in at.items()])


def retrieval(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Per task: accuracy at 1, 3 and 5, reciprocal rank, and recall at 5 and 10. ranked: task_id, item, rank; gold: task_id, item."""
    hits = ranked.join(gold.select("task_id", "item", F.lit(1).alias("hit")), ["task_id", "item"], "left")
    total = gold.groupBy("task_id").agg(F.count_distinct("item").alias("n_gold"))
    first = F.min(F.when(F.col("hit") == 1, F.col("rank")))
    at = lambda k: F.count_distinct(F.when((F.col("hit") == 1) & (F.col("rank") <= k), F.col("item")))
    per = hits.groupBy("task_id").agg(first.alias("first"), at(5).alias("h5"), at(10).alias("h10"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return total.join(per, "task_id", "left").select(
        "task_id",
        *[F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)).alias(f"acc{k}") for k in (1, 3, 5)],
        zero(1 / F.col("first")).alias("mrr"),
        zero(F.col("h5") / F.col("n_gold")).alias("recall5"),
        zero(F.col("h10") / F.col("n_gold")).alias("recall10"),
    )


def ndcg(ranked: DataFrame, k: int = 10) -> DataFrame:
    """Per task, of rows (task_id, rank from 1, grade): nDCG@k, share of grade 3 found, and share of grade 0 among the first k."""
    gain = lambda grade, rank: (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)
    ideal = F.row_number().over(Window.partitionBy("task_id").orderBy(F.col("grade").desc(), "rank"))
    with_ideal = ranked.withColumn("ideal", ideal)
    top = F.col("rank") <= k
    return with_ideal.groupBy("task_id").agg(
        F.sum(F.when(top, gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("ideal") <= k, gain(F.col("grade"), F.col("ideal"))).otherwise(0.0)).alias("idcg"),
        F.avg(F.when(F.col("grade") == 3, top.cast("double"))).alias("essential_recall"),
        F.avg(F.when(top, (F.col("grade") == 0).cast("double"))).alias("noise"),
    ).select("task_id", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"), "essential_recall", "noise")


def rollup(metrics: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Means by group and over all (group null)."""
    return metrics.rollup(group).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def edge_precision(edges: DataFrame) -> DataFrame:
    """Shares of resolved and ambiguous edges, null without edges."""
    share = lambda s: F.round(F.avg((F.col("status") == s).cast("double")), 3)
    return edges.agg(F.count("*").alias("n"), share("resolved").alias("resolved_share"), share("ambiguous").alias("ambiguous_share"))


def scope_distribution(edges: DataFrame, scope: str = "edge_kind") -> DataFrame:
    return edges.groupBy("status", F.col(scope).alias("scope")).agg(F.count("*").alias("n"))


def suspicious(threshold: float = 0.40) -> Column:
    """Reasons to doubt an edge, in order."""
    return F.array_compact(F.array(F.when(F.col("status") == "ambiguous", "ambiguous"), F.when(F.col("confidence") <= threshold, "low_confidence")))


def edge_audit(edges: DataFrame, top: int = 20) -> DataFrame:
    """Targets with the most incoming edges, and how many of those are doubtful."""
    judged = edges.filter(F.col("target_symbol_id").isNotNull()).withColumn("doubt", (F.size(suspicious()) > 0).cast("long"))
    per = judged.groupBy("target_symbol_id").agg(F.count("*").alias("in_degree"), F.sum("doubt").alias("n_doubtful"), F.round(F.avg("doubt"), 4).alias("doubtful_share"))
    return per.orderBy(F.col("in_degree").desc(), F.col("n_doubtful").desc(), "target_symbol_id").limit(top)


def kpis(summary: DataFrame, thresholds: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per arm and threshold: the value, the bound, and whether it is met. `thresholds`: name -> (column, least value)."""
    rows = F.array(*[F.struct(F.lit(n).alias("kpi"), F.col(c).cast("double").alias("value"), F.lit(float(b)).alias("bound")) for n, (c, b) in thresholds.items()])
    return summary.select("arm", F.explode(rows).alias("k")).select("arm", "k.*", (F.col("k.value") >= F.col("k.bound")).alias("met"))
