"""Nearest neighbours by additive quantisation.

A vector is approximated by the sum of one word from each of several full-dimensional codebooks, trained in turn on the
residuals of a bounded sample and chosen by beam search. The norm of the approximation is stored beside the codes. A
query scores all codes by tables of its products with all words; the best are ranked again on the original vectors.

Rows are dealt by their ids' hashes to blocks of BLOCK bytes of vectors. First the codes of each block stand in one task while all queries
pass by, a batch at a time: codes and vectors are never copied, queries once for each block. Of a block a query takes its share
of RERANKED candidates and six deviations more (they are dealt by hash), and of all blocks' the best RERANKED. Then only the queries that have
candidates in a block pass by its vectors. Rows of equal codes are one candidate and stand for all their rows; equal vectors are scored once
and stand for their smallest ids.

Defined results: vectors that are null, all zero, hold a null or non-finite component, or differ in length from the
sampled ones take no part; of rows that share an id the one with the smallest vector counts; a row with a null id takes no
part; with fewer candidates than asked for, all are returned; without candidates, nothing is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, rebatch, tidy

#: Vectors that the codebooks are fitted on, at most (about: the sample is drawn by the ids' hashes).
SAMPLE = 16_384
BOOKS, WORDS, BEAM, ROUNDS = 16, 256, 6, 10
#: Candidates of a query that are ranked again.
RERANKED = 2_048
#: Bytes of vectors in a block, and rows below which blocks aren't made smaller to keep all cores busy.
BLOCK, LEAST = 32 << 20, 4_096


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    words = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((words**2).sum(1) - 2 * x @ words.T, axis=1)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        used = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(count[used])[:-1]]), axis=0)
        words[used] = sums / count[used, None]
        empty = np.flatnonzero(count == 0)
        words[empty] = x[rng.choice(len(x), len(empty))]
    return words


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (books x words x dimensions), each fitted to what the ones before it leave."""
    rng = np.random.default_rng(0)
    left, out = x.astype(np.float32), []
    for _ in range(books):
        out.append(kmeans(left, words, rounds, rng))
        near = np.argmin((out[-1] ** 2).sum(1) - 2 * left @ out[-1].T, axis=1)
        left = left - out[-1][near]
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (uint8) and squared norms of the approximations. The beam keeps the best partial sums of each vector."""
    n, (m, k, _) = len(x), books.shape
    codes, norms = np.empty((n, m), np.uint8), np.empty(n, np.float32)
    for a in range(0, n, 1024):
        part = x[a : a + 1024].astype(np.float32)
        rows = np.arange(len(part))[:, None]
        left, chosen = part[:, None, :], np.empty((len(part), 1, 0), np.uint8)
        for book in books:
            cost = (left**2).sum(2)[:, :, None] - 2 * left @ book.T + (book**2).sum(1)
            flat = cost.reshape(len(part), -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            origin, word = best // k, best % k
            left = left[rows, origin] - book[word]
            chosen = np.concatenate([chosen[rows, origin], word[:, :, None].astype(np.uint8)], axis=2)
        top = (left**2).sum(2).argmin(1)
        codes[a : a + 1024] = chosen[rows[:, 0], top]
        norms[a : a + 1024] = ((part - left[rows[:, 0], top]) ** 2).sum(1)
    return codes, norms


def valid(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, books: int = BOOKS, words: int = WORDS, beam: int = BEAM) -> tuple[DataFrame, np.ndarray]:
    """The index (id, vector as doubles, codes, norm), written to the shared folder, and its codebooks."""
    rows = df.select(df[id_col].alias("id"), df[vector_col].cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & valid(F.col("vector"))).groupBy("id").agg(F.min("vector").alias("vector"))
    n = rows.count()
    grain = 1 << 24
    share = math.ceil(grain * min(1.0, sample / max(n, 1)))
    drawn = [r[0] for r in rows.filter(F.pmod(F.xxhash64("id"), F.lit(grain)) < share).select("vector").limit(2 * sample).collect()]
    length = max((len(v) for v in drawn), key=[len(v) for v in drawn].count, default=0)
    fitted = fit(np.array([v for v in drawn if len(v) == length]), books, words) if length else np.zeros((books, words, 0), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1))
            codes, norms = encode(x, fitted, beam)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], names=["id", "vector", "codes", "norm"])

    return materialise(rows.filter(F.size("vector") == length).mapInArrow(tidy(run), "id long, vector array<double>, codes binary, norm float"), "index"), fitted


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def void(rows: np.ndarray) -> np.ndarray:
    """Rows as values that can be compared as a whole."""
    rows = np.ascontiguousarray(rows)
    return rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1])))[:, 0]


class Codes:
    """A block's codes; rows of equal codes are one class, named by its smallest id."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray):
        order = np.argsort(ids, kind="stable")
        _, first = np.unique(void(codes[order]), return_index=True)
        self.names, self.codes, self.norms = ids[order][first], codes[order][first], norms[order][first]

    def nearest(self, queries: np.ndarray, books: np.ndarray, most: int, measure: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Names and scores of the nearest classes of each query."""
        most = min(most, len(self.names))
        for a in range(0, len(queries), 32):
            tables = np.einsum("qd,mkd->mqk", queries[a : a + 32].astype(np.float32), books, optimize=True)
            score = np.zeros((tables.shape[1], len(self.names)), np.float32)
            for m, t in enumerate(tables):
                score += t[:, self.codes[:, m]]
            if measure == "l2":
                score = 2 * score - self.norms
            near = np.argpartition(-score, most - 1, axis=1)[:, :most]
            for row, best in zip(score, near):
                yield self.names[best], row[best]


class Vectors:
    """A block's distinct vectors, with the smallest ids of each, by class of codes."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, codes, vectors = ids[order], codes[order], vectors[order] + 0.0
        _, first, same = np.unique(void(vectors), return_index=True, return_inverse=True)
        at = np.argsort(same, kind="stable")
        starts = np.cumsum(np.bincount(same))[:-1]
        # The query's own row may be among them.
        self.members, self.vectors, self.least = [ids[m[: k + 1]] for m in np.split(at, starts)], vectors[first], ids[first]
        _, begin, kind = np.unique(void(codes), return_index=True, return_inverse=True)
        self.names, names_at = np.unique(ids[begin], return_index=True)
        kinds = kind[first]
        grouped = np.argsort(kinds, kind="stable")
        parts = np.split(grouped, np.cumsum(np.bincount(kinds, minlength=len(begin)))[:-1])
        self.of_class = [parts[k] for k in names_at]

    def nearest(self, own: int, query: np.ndarray, names: np.ndarray, k: int, measure: str) -> list[tuple[int, float]]:
        """(id, score) of the k nearest rows of the named classes."""
        which = np.concatenate([self.of_class[j] for j in np.searchsorted(self.names, names)])
        x = self.vectors[which]
        exact = (x * query).sum(1) if measure == "ip" else -((x - query) ** 2).sum(1)
        found: list[tuple[int, float]] = []
        for c in np.lexsort((self.least[which], -exact)):
            if len(found) >= k and exact[c] < found[k - 1][1]:
                break
            found += [(int(i), float(exact[c])) for i in self.members[which[c]] if i != own]
            if len(found) >= k:
                found.sort(key=lambda f: (-f[1], f[0]))
        return sorted(found, key=lambda f: (-f[1], f[0]))[:k]


def passing_by(rows: DataFrame, load: Callable, answer: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    """`rows` (block, kind, ...): each block's rows of kind 0 are loaded, then those of kind 1 are answered a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            block, parts, loaded = None, [], None
            for b in batches:
                if not b.num_rows:
                    continue
                at, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
                cuts = [0, *(1 + np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1]))).tolist(), b.num_rows]
                for s, e in zip(cuts, cuts[1:]):
                    if at[s] != block:
                        block, parts, loaded = at[s], [], None
                    if not kind[s]:
                        parts.append(b.slice(s, e - s))
                    elif parts or loaded:
                        if loaded is None:
                            loaded, parts = load(pa.Table.from_batches(parts).combine_chunks()), []
                        yield from answer(int(block), loaded, b.slice(s, e - s))

        yield from rebatch(each(), arrow, lambda r: 64 + (20 * len(r[2]) if hasattr(r[2], "__len__") else 0))

    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(tidy(run), schema)


def search(indexed: DataFrame, books: np.ndarray, queries: DataFrame, k: int = 20, reranked: int = RERANKED, measure: str = "ip", block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """query_id, rank, id and score of each query's k nearest. `queries` has id and vector; its own id is no candidate."""
    rows, cores = indexed.count(), indexed.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-rows * 8 * max(1, books.shape[2]) // block), min(cores, -(-rows // least)))
    share = math.ceil(reranked / n + 6 * math.sqrt(reranked / n) + 16) if n > 1 else reranked
    dealt = indexed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    kind = lambda x: F.lit(x).cast("tinyint").alias("kind")

    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), kind(1), "id", null("binary", "codes"), null("float", "norm"), F.col("vector").cast("array<float>").alias("vector"))
    codes = dealt.select("block", kind(0), "id", "codes", "norm", null("array<float>", "vector"))

    def codes_of(t: pa.Table) -> Codes:
        return Codes(t["id"].to_numpy(), np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(t.num_rows, -1), t["norm"].to_numpy())

    def scanned(at: int, loaded: Codes, b: pa.RecordBatch):
        for q, (names, near) in zip(b.column(2).to_pylist(), loaded.nearest(matrix(b.column(5)), books, share, measure)):
            yield q, at, names.tolist(), near.tolist()

    schema = pa.schema([("query_id", pa.int64()), ("block", pa.int32()), ("names", pa.list_(pa.int64())), ("near", pa.list_(pa.float32()))])
    near = materialise(passing_by(codes.unionByName(asked), codes_of, scanned, "query_id long, block int, names array<long>, near array<float>", schema), "near")
    bound = near.groupBy("query_id").agg(F.sort_array(F.flatten(F.collect_list("near")), asc=False).alias("all")).select(F.col("query_id").alias("q"), F.coalesce(F.get("all", F.lit(reranked - 1)), F.array_min("all")).alias("bound"))
    kept = near.join(bound, F.col("query_id") == F.col("q")).select("query_id", "block", F.transform(F.filter(F.arrays_zip("names", "near"), lambda x: x["near"] >= F.col("bound")), lambda x: x["names"]).alias("names")).filter(F.size("names") > 0)

    vectors = dealt.select("block", kind(0), "id", "codes", "vector", null("array<bigint>", "names"))
    wanted = kept.join(queries.select(F.col("id").alias("query_id"), "vector"), "query_id").select("block", kind(1), F.col("query_id").alias("id"), null("binary", "codes"), "vector", "names")

    def vectors_of(t: pa.Table) -> Vectors:
        return Vectors(t["id"].to_numpy(), np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(t.num_rows, -1), matrix(t["vector"].combine_chunks()), k)

    def ranked(at: int, loaded: Vectors, b: pa.RecordBatch):
        for q, vector, names in zip(b.column(2).to_pylist(), matrix(b.column(4)), b.column(5).to_pylist()):
            for i, s in loaded.nearest(q, vector, np.array(names, np.int64), k, measure):
                yield q, i, s

    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    found = passing_by(vectors.unionByName(wanted), vectors_of, ranked, "query_id long, id long, score double", schema)
    # Each block has at most k rows for a query: the merge keeps the k first.
    row = F.struct((-F.col("score")).alias("s"), F.col("id"))
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(row)), 1, k).alias("rows"))
    return best.select("query_id", F.posexplode("rows").alias("pos", "row")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("row.id").alias("id"), (-F.col("row.s")).alias("score"))
