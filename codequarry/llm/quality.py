"""Document quality from weak labels.

Labellers are overlapping heuristics that each vote good, bad or nothing. Expectation-maximisation over the counts of vote
patterns (there are at most 3 ** labellers of them, however many documents) estimates each labeller's accuracy and each
pattern's posterior. The posteriors of a bounded sample then train a linear scorer on hashed byte 4-grams and hashed
statistics, which scores every document.

Defined results: null and empty texts, and texts of white space alone, get no votes and are not kept; texts too short for
shares get votes only for gross faults; a null id stays null; repeated rows get equal scores; an empty table gives an empty
table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_extract import STOP_WORDS
from .shared import rebatch, texts, tidy

GOOD, NONE, BAD = 1, 0, -1
#: Documents that the scorer is fitted on (about: they are drawn by the hashes of their ids and texts). Counts of votes cover all.
SAMPLE = 6_000
WIDTH = 4_096
ROUNDS = 100
#: Shares that a labeller finds and spares, before the first round.
START = (0.4, 0.98)
_SIGNS = re.compile(r"[#$%&*|~^<>=\\{}_@+]")
_STOP = frozenset().union(*STOP_WORDS.values())
STATS = ("signs", "upper", "again", "stop", "kinds", "length", "lines", "tails", "bare", "pairs", "marks")
_MARK = re.compile(r"[^\w\s]")


def statistics(text: str) -> list[float] | None:
    """Shares of signs, upper-case words, words equal to the one before, stop words and distinct words; mean length of a word; shares of
    repeated lines, of words that end in two signs and of words with signs at both ends, share of distinct pairs of neighbours, and share of
    marks (neither letters, digits nor white space). None without words."""
    words = text.split()
    n = len(words)
    if not n:
        return None
    counts = Counter(words)
    lower = sum(c for w, c in counts.items() if w.lower().strip(".,;:!?\"'()#$%&*|") in _STOP)
    upper = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    again = sum(map(str.__eq__, words, words[1:]))
    lines = text.split("\n")
    return [
        len(_SIGNS.findall(text)) / len(text),
        upper / n,
        again / n,
        lower / n,
        len(counts) / n,
        (len(text) - n) / n,
        1 - len(set(lines)) / len(lines),
        sum(c for w, c in counts.items() if len(w) > 1 and not w[-1].isalnum() and not w[-2].isalnum()) / n,
        sum(c for w, c in counts.items() if not w[0].isalnum() and not w[-1].isalnum()) / n,
        len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0,
        len(_MARK.findall(text)) / len(text),
    ]


#: Labellers, as many as `votes` gives.
LABELLERS = ("signs", "upper", "again", "stop", "kinds", "length", "tails", "bare", "pairs", "marks")


def votes(s: list[float] | None, n_words: int) -> list[int]:
    """One vote of each labeller. They overlap (signs, marks, tails and bare words; repeated words, kinds and pairs) and err: short words,
    few kinds of words and repeated pairs stand in plain prose, too. Short texts give too little evidence for shares, so only gross
    faults count there."""
    if s is None:
        return [NONE] * len(LABELLERS)
    signs, upper, again, stop, kinds, length, lines, tails, bare, pairs, marks = s
    enough = n_words >= 20

    def vote(bad: bool, good: bool) -> int:
        return BAD if bad else GOOD if good and enough else NONE

    return [
        vote(signs > 0.03 and n_words >= 4, signs < 0.005),
        vote(upper > 0.2 and n_words >= 8, upper < 0.05),
        vote(again > 0.15 and n_words >= 8, again < 0.03),
        vote(stop < 0.15 and enough, stop > 0.22),
        vote(kinds < 0.6 and enough, kinds > 0.7),
        vote((length > 5.6 or length < 4.2) and enough, 4.6 < length < 5.4),
        vote(tails > 0.1 and n_words >= 4, tails < 0.01),
        vote(bare > 0.2 and n_words >= 8, bare < 0.01),
        vote(pairs < 0.95 and enough, pairs > 0.975),
        vote(marks > 0.1 and n_words >= 8, marks < 0.05),
    ]


def features(text: str, s: list[float] | None, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and weights: byte 4-grams in proportion, and each statistic's value as one of eight steps."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(raw) >= 4:
        h = (raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)) * np.uint32(2654435761)
        counts = np.bincount(h >> np.uint32(32 - width.bit_length() + 1), minlength=width)
        at = np.flatnonzero(counts)
        weight = counts[at] / len(h)
    else:
        at, weight = np.zeros(0, np.int64), np.zeros(0)
    if s is not None:
        steps = [k * 8 + min(7, int(v * 8) if name != "length" else int(v / 2)) for k, (name, v) in enumerate(zip(STATS, s))]
        more = (np.array(steps, np.uint32) * np.uint32(2246822519)) >> np.uint32(32 - width.bit_length() + 1)
        at, weight = np.concatenate([at, more]), np.concatenate([weight, np.full(len(more), 0.25)])
    return at, weight


def expectation_maximisation(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], list[dict[str, float]]]:
    """Posterior of `good` of each pattern, and each labeller's two accuracies and coverage.

    Each labeller tests for one fault, so it is judged on both classes: `finds` is the share of bad texts among those it votes on
    that it calls bad, `spares` the share of good ones that it calls good. Not voting says nothing. They start at START, which
    settles which class is which. One text of each kind is added to each count, so that unseen votes keep some chance."""
    rows = [(p, n) for p, n in patterns.items() if any(p)]
    m = len(rows[0][0]) if rows else 0
    v = np.array([p for p, _ in rows], float).reshape(len(rows), m)
    n = np.array([c for _, c in rows], float)
    finds, spares, prior, q = np.full(m, START[0]), np.full(m, START[1]), 0.8, np.zeros(len(n))
    for _ in range(rounds if len(n) else 0):
        odds = math.log(prior / (1 - prior)) + (v > 0) @ np.log(spares / (1 - finds)) + (v < 0) @ np.log((1 - spares) / finds)
        q = 1 / (1 + np.exp(-odds))
        good, bad = n * q, n * (1 - q)
        finds = (bad @ (v < 0) + 1) / (bad @ (v != 0) + 2)
        spares = (good @ (v > 0) + 1) / (good @ (v != 0) + 2)
        prior = float((n @ q + 1) / (n.sum() + 2))
    total = sum(patterns.values()) or 1
    known = dict(zip((p for p, _ in rows), q.tolist()))
    return {p: known.get(p, prior) for p in patterns}, [
        {"finds": float(f), "spares": float(g), "coverage": float((n * (v[:, k] != 0)).sum() / total)} for k, (f, g) in enumerate(zip(finds, spares))
    ]


def train(rows: list[tuple[bytes, bytes, float]], width: int = WIDTH, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias of a logistic scorer fitted to posteriors, by Adam."""
    x, y = np.zeros((len(rows), width), np.float32), np.array([p for *_, p in rows], np.float32)
    for k, (at, weight, _) in enumerate(rows):
        np.add.at(x[k], np.frombuffer(at, np.int32), np.frombuffer(weight, np.float32))
    w, m, s = (np.zeros(width + 1, np.float32) for _ in range(3))
    for t in range(1, rounds + 1):
        e = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y
        g = np.concatenate([e @ x / max(1, len(y)) + ridge * w[:-1], [e.mean() if len(y) else 0]]).astype(np.float32)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w - np.float32(0.2) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


def _judged(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].alias("id"), df[text_col].alias("text"))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """The fitted model: posteriors of patterns, labellers' accuracies, and the scorer's weights."""

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            counts.update(pattern(t) for t in texts(b.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array([list(p) for p in counts], pa.list_(pa.int32())), pa.array(list(counts.values()), pa.int64())], names=["votes", "n"])

    rows = _judged(df, id_col, text_col)
    counted = rows.mapInArrow(tidy(cast), "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    patterns = {tuple(r["votes"]): r["n"] for r in counted}
    posterior, accuracies = expectation_maximisation(patterns)

    schema = pa.schema([("at", pa.binary()), ("weight", pa.binary()), ("p", pa.float64())])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for b in batches:
                for t in texts(b.column(1)):
                    s = statistics(t)
                    if s is not None:
                        at, weight = features(t, s)
                        yield at.astype(np.int32).tobytes(), weight.astype(np.float32).tobytes(), posterior[tuple(votes(s, len(t.split())))]

        yield from rebatch(each(), schema, lambda r: 2 * len(r[0]))

    grain = 1 << 24
    share = math.ceil(grain * min(1.0, sample / max(1, sum(patterns.values()))))
    drawn = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(grain)) < share)
    weights = train([tuple(r) for r in drawn.mapInArrow(tidy(featured), "at binary, weight binary, p double").limit(4 * sample).collect()])
    return {"posterior": posterior, "labellers": accuracies, "weights": weights}


def pattern(text: str) -> tuple[int, ...]:
    s = statistics(text)
    return tuple(votes(s, len(text.split()) if s else 0))


def probability(text: str, weights: np.ndarray, s: list[float] | None) -> float:
    at, weight = features(text, s)
    return float(1 / (1 + np.exp(-(weights[at] @ weight + weights[-1]))))


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the scorer's probability of `good`, the posterior of its votes, and whether it is kept."""
    weights, posterior = model["weights"], model["posterior"]
    schema = pa.schema([("id", pa.int64()), ("p_good", pa.float64()), ("posterior", pa.float64()), ("keep", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for key, t in zip(b.column(0).to_pylist(), texts(b.column(1))):
                    s = statistics(t)
                    p = probability(t, weights, s)
                    yield key, p, posterior.get(tuple(votes(s, len(t.split()) if s else 0))), s is not None and p >= 0.5

        yield from rebatch(rows(), schema)

    return _judged(df, id_col, text_col).mapInArrow(tidy(run), "id long, p_good double, posterior double, keep boolean").withColumnRenamed("id", id_col)


def kept(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows that the scorer keeps, all columns as they are."""
    weights, at = model["weights"], df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            judged = [(t, statistics(t)) for t in texts(b.column(at))]
            yield b.filter(pa.array([s is not None and probability(t, weights, s) >= 0.5 for t, s in judged], pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)
