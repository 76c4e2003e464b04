"""The evidence ledger's cards: candidates, the best card, what of its evidence still holds, the gate for new evidence, ranks, upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reasons for which something may be called a decoy.
DECOY_REASONS = ("no_reference", "test_only", "wrapper_only", "unrelated")


def candidates(cards: DataFrame, tokens: list[str], now: float, limit: int = 50) -> DataFrame:
    """Live asserted or confirmed cards that share a token with the query, by card id."""
    live = F.col("status").isin("asserted", "confirmed") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return cards.filter(live & F.arrays_overlap("sig_tokens", F.array(*map(F.lit, tokens)))).orderBy("card_id").limit(limit)


def scored(cards: DataFrame, tokens: list[str], least_share: float, least_overlap: int) -> DataFrame:
    """Cards alike enough, with `score` (Jaccard). Where the queries differ, a card goes whose decoys, but not answers, hold an added token, or
    that has lost tokens for added ones none of which its answers hold (`answer_stems`, `decoy_stems`)."""
    asked = F.array(*map(F.lit, tokens))
    both, all_ = F.size(F.array_intersect("sig_tokens", asked)), F.size(F.array_union("sig_tokens", asked))
    added, dropped = F.array_except(asked, F.col("sig_tokens")), F.array_except(F.col("sig_tokens"), asked)
    to_decoy = F.arrays_overlap(added, F.array_except("decoy_stems", "answer_stems"))
    swapped = (F.size(added) > 0) & (F.size(dropped) > 0) & (F.size(F.array_intersect(added, F.col("answer_stems"))) == 0)
    rows = cards.withColumns({"score": both / all_, "overlap": both})
    return rows.filter((F.col("score") >= least_share) & (F.col("overlap") >= least_overlap) & ~F.coalesce(to_decoy, F.lit(False)) & ~swapped)


def best_card(cards: DataFrame, score: str = "score") -> DataFrame:
    """The card that is confirmed, then the most alike, then the most confirmed, then the first."""
    order = F.struct((F.col("status") == "confirmed").alias("c"), F.round(score, 6).alias("s"), F.col("confirmations"), (-F.col("card_id")).alias("i"))
    return cards.orderBy(order.desc()).limit(1)


def verified(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """Items with `state`: valid if the symbol's body is as it was, changed, or missing."""
    now = symbols.select("path", "qualified_name", "symbol_id", F.col("body_sha256").alias("now_sha"))
    state = F.when(F.col("now_sha").isNull(), "missing").when(F.col("now_sha") != F.col("body_sha256"), "changed").otherwise("valid")
    return items.join(now, ["path", "qualified_name"], "left").withColumn("state", state).drop("now_sha")


def prior_evidence(items: DataFrame, cards: DataFrame, decoy_share: float) -> DataFrame:
    """Per card, from verified items: the answers that hold, the steps before the first that doesn't and where that is, the decoys that hold (of
    a confirmed card that is alike enough), and whether the card is to be retired since no answer holds."""
    valid = F.col("state") == "valid"
    broken = F.min(F.when((F.col("role") == "step") & ~valid, F.col("ord")))
    edges = items.groupBy("card_id").agg(broken.alias("recheck_from"))
    rows = items.join(edges, "card_id").join(cards.select("card_id", "status", "score"), "card_id")
    until = F.coalesce("recheck_from", F.lit(1 << 30))
    count = lambda role, more=F.lit(True): F.count_if((F.col("role") == role) & valid & more)
    shown = (F.col("status") == "confirmed") & (F.col("score") >= decoy_share)
    found = rows.groupBy("card_id", "status", "recheck_from").agg(
        count("answer").alias("n_answers"), count("step", F.col("ord") < until).alias("n_steps"), count("decoy", shown).alias("n_decoys")
    )
    return found.withColumn("retire", F.col("n_answers") == 0)


def gate_answers(answers: DataFrame, symbols: DataFrame, fresh: DataFrame) -> DataFrame:
    """Answers (`input`: symbol id, @, line) with the reason for which each is refused, null if none is."""
    parts = answers.withColumns({"sid": F.regexp_extract("input", r"^(.*)@[^@]*$", 1), "line": F.regexp_extract("input", r"@\s*([+-]?\d+)\s*$", 1).try_cast("int")})
    s = symbols.select(F.col("symbol_id").cast("string").alias("sid"), F.col("path"), "start_line", "end_line", F.lit(True).alias("known"))
    rows = parts.join(s, "sid", "left").join(fresh.select("path", F.lit(True).alias("fresh")), "path", "left")
    reason = (
        F.when(~F.col("input").contains("@") | F.col("line").isNull(), "invalid_format").when(F.col("known").isNull(), "unknown_symbol")
        .when(F.col("fresh").isNull(), "stale_file").when(~F.col("line").between(F.col("start_line"), F.col("end_line")), "line_outside_symbol")
    )
    return rows.select(*answers.columns, reason.alias("reason"))


def gate_steps(steps: DataFrame, symbols: DataFrame, fresh: DataFrame, lines: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps (`input`: from, >, to, @, line) with the reason for refusal; the target's name must stand on the line. `edge_missing` tells that no edge says so."""
    parts = steps.withColumns({"a": F.regexp_extract("input", r"^([^>]*)>.*@[^@]*$", 1), "b": F.regexp_extract("input", r"^[^>]*>(.*)@[^@]*$", 1), "line": F.regexp_extract("input", r"@\s*([+-]?\d+)\s*$", 1).try_cast("int")})
    s = symbols.select(F.col("symbol_id").cast("string").alias("a"), "path", "start_line", "end_line", F.lit(True).alias("a_known"))
    t = symbols.select(F.col("symbol_id").cast("string").alias("b"), F.col("name").alias("b_name"))
    rows = parts.join(s, "a", "left").join(t, "b", "left").join(fresh.select("path", F.lit(True).alias("fresh")), "path", "left")
    rows = rows.join(lines.select("path", F.col("line_no").alias("line"), F.col("line").alias("text")), ["path", "line"], "left")
    known = edges.select(F.col("source_symbol_id").cast("string").alias("a"), F.col("target_symbol_id").cast("string").alias("b")).distinct().withColumn("edge", F.lit(True))
    named = F.array_contains(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), F.col("b_name"))
    reason = (
        F.when(~F.col("input").rlike(">.*@") | F.col("line").isNull(), "invalid_format").when(F.col("a") == F.col("b"), "self_loop_step")
        .when(F.col("a_known").isNull() | F.col("b_name").isNull(), "unknown_symbol").when(F.col("fresh").isNull(), "stale_file")
        .when(~F.col("line").between(F.col("start_line"), F.col("end_line")), "line_outside_symbol").when(F.col("text").isNull(), "stale_file").when(~named, "evidence_mismatch")
    )
    return rows.join(known, ["a", "b"], "left").select(*steps.columns, reason.alias("reason"), (reason.isNull() & F.col("edge").isNull()).alias("edge_missing"))


def gate_decoys(decoys: DataFrame, symbols: DataFrame, fresh: DataFrame) -> DataFrame:
    """Decoys (`input`: symbol id, !, reason code) with the reason for refusal."""
    parts = decoys.withColumns({"sid": F.regexp_extract("input", r"^(.*)![^!]*$", 1), "code": F.regexp_extract("input", r"!([^!]*)$", 1)})
    s = symbols.select(F.col("symbol_id").cast("string").alias("sid"), "path")
    rows = parts.join(s, "sid", "left").join(fresh.select("path", F.lit(True).alias("fresh")), "path", "left")
    reason = (
        F.when(~F.col("input").contains("!"), "invalid_format").when(~F.col("code").isin(*DECOY_REASONS), "invalid_reason_code")
        .when(F.col("path").isNull(), "unknown_symbol").when(F.col("fresh").isNull(), "stale_file")
    )
    return rows.select(*decoys.columns, reason.alias("reason"))


def overlay_order(ranked: DataFrame, roles: DataFrame, named: Column, pos: str = "pos") -> DataFrame:
    """`tier`: confirmed answers first, decoys last unless the query names them; within a tier the order stays."""
    rows = ranked.join(roles.select("path", "qualified_name", "role"), ["path", "qualified_name"], "left")
    return rows.withColumn("tier", F.when(F.col("role") == "answer", 0).when((F.col("role") == "decoy") & ~named, 2).otherwise(1))


def prune(cards: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """The cards that stay, and the repositories that lost some: (repo_id, n_deleted)."""
    gone = (F.col("expires_at") <= now) | (F.col("status") == "retired")
    gone = F.coalesce(gone, F.col("status") == "retired")
    return cards.filter(~gone), cards.filter(gone).groupBy("repo_id").agg(F.count("*").alias("n_deleted"))


def set_status(cards: DataFrame, changes: DataFrame) -> DataFrame:
    """Cards with the statuses that `changes` (card_id, status) give."""
    new = changes.select("card_id", F.col("status").alias("__new"))
    return cards.join(new, "card_id", "left").withColumn("status", F.coalesce("__new", "status")).drop("__new").select(*cards.columns)


def export(cards: DataFrame, items: DataFrame) -> DataFrame:
    """(card_id, json): a card with its items in order. A card's items are those of one answer, which the gate bounds."""
    own = [c for c in items.columns if c != "card_id"]
    nested = items.groupBy("card_id").agg(F.array_sort(F.collect_list(F.struct("role", "ord", *[c for c in own if c not in ("role", "ord")]))).alias("items"))
    return cards.join(nested, "card_id", "left").select("card_id", F.to_json(F.struct(*cards.columns, "items")).alias("json"))
