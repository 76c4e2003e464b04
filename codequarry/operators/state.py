"""Keyed state in batch: upserts, expiry, locks, rate limits, the evidence ledger, audit and access rules."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .folds import ordered_fold

KEY = ["scope", "namespace", "key"]


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: bool = False) -> DataFrame:
    """Upsert of `new` (one row a key) into `old`. With keep_if_null, null values of new rows leave the old ones."""
    values = [c for c in old.columns if c not in keys]
    n = new.select(*keys, F.struct(*values).alias("__new"))
    joined = old.join(n, keys, "full_outer")
    pick = lambda c: F.coalesce(F.col("__new")[c], F.col(c)) if keep_if_null else F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c))
    return joined.select(*keys, *[pick(c).alias(c) for c in values])


def latest(puts: DataFrame, keys: list[str] = KEY, seq: str = "seq") -> DataFrame:
    """The last put of each key: an aggregation with partial maxima, no sort."""
    rest = [c for c in puts.columns if c not in keys]
    return puts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(*keys, "r.*")


def live(entries: DataFrame, now: Column | float, inclusive: bool = True) -> DataFrame:
    """Unexpired entries. Searches keep an entry that expires just now (inclusive); point reads treat only what lies before now as expired, too."""
    now = now if isinstance(now, Column) else F.lit(float(now))
    return entries.filter(F.col("expires_at").isNull() | ((F.col("expires_at") >= now) if inclusive else (F.col("expires_at") > now)))


def list_entries(entries: DataFrame, now: float, limit: int, scope: str | None = None) -> DataFrame:
    """The first entries by time, of which expired ones go afterwards: they use up the limit."""
    found = entries.filter(F.col("scope") == scope) if scope else entries
    return live(found.orderBy("created_at", *KEY).limit(limit), now)


def get(entries: DataFrame, requests: DataFrame, now: float, keys: list[str] = KEY) -> DataFrame:
    """Per request: not_found, expired or found."""
    found = requests.join(entries.select(*keys, "value", "expires_at", F.lit(True).alias("there")), keys, "left")
    status = F.when(F.col("there").isNull(), "not_found").when(F.col("expires_at") < now, "expired").otherwise("found")
    return found.select(*keys, status.alias("status"), F.when(status == "found", F.col("value")).alias("value"))


def rate_limit(events: DataFrame, key: str, time: str, limit: int, window: float, id_col: str = "id") -> DataFrame:
    """(key, id, accepted): an event is accepted if fewer than `limit` accepted ones lie within the window before it, its border included."""
    e = events.select(key, F.col(time).cast("double").alias("t"), F.col(id_col).cast("long").alias("id"))
    schema = StructType([e.schema[key], StructField("id", LongType()), StructField("accepted", BooleanType())])

    def step(kept, row):
        name, t, i = row
        while kept and kept[0] < t - window:
            kept.popleft()
        ok = len(kept) < limit
        if ok:
            kept.append(t)
        return kept, (name, i, ok)

    return ordered_fold(e, [key], ["t", "id"], deque, step, schema)


def locks(requests: DataFrame, timeout: float) -> DataFrame:
    """(resource_key, seq, agent_id, acquired): a lock is free when it has expired by now or the same agent holds it."""
    r = requests.select("resource_key", F.col("at").cast("double").alias("at"), F.col("seq").cast("long").alias("seq"), "agent_id")
    schema = StructType([r.schema["resource_key"], StructField("seq", LongType()), StructField("agent_id", StringType()), StructField("acquired", BooleanType())])

    def step(state, row):
        (held, until), (key, at, seq, agent) = state, row
        ok = until <= at or held == agent
        return ((agent, at + timeout) if ok else state), (key, seq, agent, ok)

    return ordered_fold(r, ["resource_key"], ["at", "seq"], lambda: (None, -math.inf), step, schema)


def ledger(submissions: DataFrame) -> DataFrame:
    """(sig_hash, status, confirmations, n_submissions) after each signature's submissions in order.

    A submission has `answers` and `decoys` (arrays), or retires the card (`retire`). The first one asserts. An answer that was a decoy, or
    the reverse, is a conflict, whatever the card's state. A retired card is asserted anew by the next submission. Otherwise a conflict
    stays; the same answers from another run confirm; other answers from another run are a conflict, and from the same run they assert anew.
    What a conflict brings does not replace the card's items."""
    columns = submissions.columns
    pick = lambda c, kind: F.col(c).cast(kind).alias(c) if c in columns else F.lit(None).cast(kind).alias(c)
    answers = F.col("answers") if "answers" in columns else F.array("answer")
    s = submissions.select("sig_hash", F.col("seq").cast("long").alias("seq"), "run_id", answers.cast("array<string>").alias("answers"), pick("decoys", "array<string>"), pick("retire", "boolean"))
    schema = StructType([s.schema["sig_hash"], StructField("status", StringType()), StructField("confirmations", LongType()), StructField("n_submissions", LongType())])

    def step(card, row):
        _, _, run, answers, decoys, retire = row
        status, n, last, known, wrong, total = card
        new, bad = frozenset(answers or ()), frozenset(decoys or ())
        total += 1
        if status is None:
            return ("asserted", 1, run, new, bad, total), None
        if retire:
            return ("retired", n, last, known, wrong, total), None
        if known & bad or wrong & new:
            return ("conflicted", n, run, known, wrong, total), None
        if status == "retired":
            return ("asserted", 1, run, new, bad, total), None
        if status == "conflicted":
            return (status, n, run, known, wrong, total), None
        if known and known == new:
            return ("confirmed", n + 1, run, new, bad, total) if last != run else (status, n, run, new, bad, total), None
        return ("conflicted", n, run, known, wrong, total) if last != run else ("asserted", 1, run, new, bad, total), None

    return ordered_fold(s, ["sig_hash"], ["seq"], lambda: (None, 0, None, frozenset(), frozenset(), 0), step, schema, lambda key, card: (key[0], card[0], card[1], card[5]))


def evict(cards: DataFrame, most: int) -> DataFrame:
    """The most recently used cards of each repository."""
    w = Window.partitionBy("repo_id").orderBy(F.coalesce("last_used_at", "created_at").desc(), F.col("card_id").desc())
    return cards.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def query_logs(logs: DataFrame, limit: int = 100, agent: str | None = None, status: str | None = None) -> DataFrame:
    """Newest first; a missing agent is anonymous."""
    found = logs.withColumn("agent_id", F.coalesce("agent_id", F.lit("anonymous")))
    if agent:
        found = found.filter(F.col("agent_id") == agent)
    if status:
        found = found.filter(F.col("status") == status)
    return found.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def retention(logs: DataFrame, cutoff) -> DataFrame:
    """How many rows a cut-off keeps and how many it deletes."""
    return logs.agg(F.count(F.when(F.col("ts") >= cutoff, 1)).alias("n_kept"), F.count(F.when(F.col("ts") < cutoff, 1)).alias("n_deleted"))


def merge_seen(registered: DataFrame, seen: DataFrame) -> DataFrame:
    """All agents, registered or seen: what is registered wins, but the traces tell last activity and calls."""
    return registered.join(seen, "agent_id", "full_outer").select("agent_id", F.coalesce("status", F.lit("active")).alias("status"), F.coalesce("policy", F.lit("standard")).alias("policy"), "last_active", F.coalesce("call_count", F.lit(0)).cast("long").alias("call_count"))


def active(heartbeats: DataFrame, now: Column, stale_seconds: int = 30) -> DataFrame:
    """Servers seen lately; times that can't be read count as never."""
    seen = F.try_to_timestamp(F.col("last_seen"))
    return heartbeats.filter(seen >= now - F.make_interval(secs=F.lit(stale_seconds)))


def access(requests: DataFrame, agents: DataFrame, halted: bool, read_only: list[str]) -> DataFrame:
    """Why a request is refused, null if it isn't: halt, then the agent's state, then its policy, then the rate."""
    joined = requests.join(agents.select("agent_id", F.col("status").alias("state"), "policy", "custom_tools"), "agent_id", "left")
    tool = F.col("tool_name")
    reason = F.coalesce(
        F.when(F.lit(halted), "emergency_halt"),
        F.when(F.col("state").isin("paused", "blocked"), F.concat(F.lit("agent_"), F.col("state"))),
        F.when((F.col("policy") == "read_only") & ~tool.isin(*read_only), "policy_read_only"),
        F.when((F.col("policy") == "custom") & ~F.array_contains(F.coalesce("custom_tools", F.array().cast("array<string>")), tool), "policy_custom"),
        F.when(~F.coalesce(F.col("accepted"), F.lit(True)), "rate_limited"),
    )
    return joined.select(*requests.columns, reason.alias("reason"))


def consolidate(entries: DataFrame, scope: str, most: int = 500) -> DataFrame:
    """One summary row of a scope's oldest entries, in order."""
    oldest = entries.filter(F.col("scope") == scope).orderBy("created_at", *KEY).limit(most)
    return oldest.groupBy("scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "namespace", "key", "value"))), lambda r: F.concat_ws(": ", r["key"], r["value"])), "\n").alias("value"), F.count("*").alias("n_entries"))
