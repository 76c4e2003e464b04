"""Similarity join on word n-grams: a MinHash LSH forest finds candidates, which are verified exactly.

Texts with the same set of n-grams are one node. In each tree a node has a signature, its DEEPEST least hashes, and the sorted
signatures of a tree are its prefix trie: Spark sorts them, and neighbours in the order tell how long a prefix a node shares with
any other. Prefixes shorter than `shortest` are not looked at: searched to that depth, all trees together meet the target recall
for two sets of the threshold's similarity, so a node that shares no such prefix in any tree has no candidates and leaves.

The others start in each tree from the longest prefix they share. All sets that share the searched prefixes of d_i hashes are
candidates, and one of the threshold's similarity s escapes all trees with probability prod(1 - s ** d_i) at most: a set
that shares more than the others is met by starting from it, and one that shares less is independent of where they start. As long as
that is above 1 - RECALL, a node's longest prefixes are shortened by one hash, in all trees at once.

Candidates are linked to the least node of their prefix, never pair by pair; connected nodes form a candidate group. Groups are verified
exactly, in blocks of bounded size against blocks: every pair of nodes of a group is compared by its intersection, and only counts and
spanning links leave a block.

Words are runs of characters that are not white space; a text of fewer words than n has the one gram of all its words. A
document's links are the other documents at the threshold or above, copies included.

Defined results: null, empty and blank texts have no grams, hence no links and a class of their own; a null id stays null and
is never a class's name unless all ids in it are null; rows that share an id are separate documents; an empty table gives an empty
table; columns other than the id and the text aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import materialise, rebatch, slices, texts, tidy

GRAMS, THRESHOLD = 5, 0.8
#: Hashes of a signature are of 16 bits: prefixes that are equal by chance only make candidates.
TREES, DEEPEST, RECALL = 32, 8, 0.99999
#: Grams and nodes of a block of a candidate group, about (nodes are dealt to blocks by their hashes).
BLOCK, NODES = 400_000, 500
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shortest(threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The longest prefix by which two sets of the threshold's similarity meet in some tree with the target recall."""
    d = deepest
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def fewest(threshold: float = THRESHOLD) -> int:
    """Sets of fewer grams have no other set at the threshold."""
    t = Fraction(str(threshold))
    return math.ceil(t / (1 - t)) if t < 1 else 1 << 62


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[1]
    return x ^ (x >> np.uint64(29))


def grams(text: str, n: int = GRAMS) -> np.ndarray:
    """Sorted distinct 64-bit names of the text's word n-grams."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in set(words)}
    h = np.array([known[w] for w in words], np.uint64)
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, np.uint64(size))
    for k in range(size):
        out = mixed(out * _ODD[0] + h[k : k + len(out)])
    return np.unique(out)


def signatures(g: np.ndarray, trees: int, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """Each tree's least hashes, the first four and the next in a 64-bit integer each."""
    low = (g ^ (g >> np.uint64(32))).astype(np.uint32)
    rng = np.random.default_rng(7)
    a = (rng.integers(0, 1 << 31, trees * deepest, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    b = rng.integers(0, 1 << 32, trees * deepest, dtype=np.uint32)
    least = np.full(trees * deepest, np.uint32(0xFFFFFFFF))
    for k in range(0, len(low), 2048):
        h = low[k : k + 2048] * a[:, None] + b[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(least, h.min(1), out=least)
    values = np.zeros((trees, 8), ">u2")
    values[:, :deepest] = (least ^ (least >> np.uint32(16))).reshape(trees, deepest) & np.uint32(0xFFFF)
    head, tail = values.view(">u8").astype(np.uint64).view(np.int64).T
    return head, tail


def shared_prefix(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Of each signature and the one before it, the number of hashes that the two share from the first on; 0 for the first."""
    x = np.concatenate([head[1:, None] ^ head[:-1, None], tail[1:, None] ^ tail[:-1, None]], 1).view(np.uint64)
    equal = (x.astype(">u8").view(">u2").reshape(-1, 8) == 0).cumprod(1).sum(1)
    return np.concatenate([[0], equal]).astype(np.int64)


def _name(g: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None


def _md5(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _signed(df: DataFrame, id_col: str, text_col: str, n: int, trees: int, deepest: int) -> DataFrame:
    schema = pa.schema([("doc", pa.int64()), ("md5", pa.string()), ("node", pa.binary()), ("n_grams", pa.int64()), ("heads", pa.list_(pa.int64())), ("tails", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            seen: dict[str, tuple] = {}
            for b in batches:
                for part in slices(b):
                    seen.clear()
                    for doc, md5, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), texts(part.column(1))):
                        if text not in seen:
                            g = grams(text, n)
                            seen[text] = (_name(g), len(g), *(signatures(g, trees, deepest) if len(g) else (None, None)))
                        yield doc, md5, *seen[text]

        yield from rebatch(rows(), schema, lambda r: 64 + 16 * trees)

    return df.select(df[id_col].alias("doc"), df[text_col].alias("text"), _md5(df[text_col]).alias("md5")).mapInArrow(tidy(run), "doc long, md5 string, node binary, n_grams long, heads array<long>, tails array<long>")


def intersections(sets: list[np.ndarray], split: int | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets, or of the first `split` with the others."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    left, right = (len(sets), 0) if split is None else (split, split)
    out = np.zeros((left, len(sets) - right), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(256, min(8192, (4 << 20) // max(1, len(sets))))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s = slice(*np.searchsorted(column, [a, a + width]))
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[s], column[s] - a] = 1
        out += dense[:left] @ dense[right:].T
    return out


def verify(rows: list[tuple[bytes, int, bool, np.ndarray]], threshold: float, same: bool) -> Iterator[tuple[bytes, int, bytes]]:
    """rows: node, copies, side (False: the first block), grams. Per node: the copies it is linked to, and the least linked node.

    Within one block (`same`) all pairs count, else those between the two."""
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    split = None if same else sum(not r[2] for r in rows)
    if len(rows) < 2 or split in (0, len(rows)):
        return
    sizes, copies = np.array([len(r[3]) for r in rows]), np.array([r[1] for r in rows])
    both = intersections([r[3] for r in rows], split)
    t = Fraction(str(threshold))
    first, second = (sizes, sizes) if same else (sizes[:split], sizes[split:])
    total = first[:, None] + second[None, :]
    linked = both * (t.numerator + t.denominator) >= t.numerator * total
    if same:
        np.fill_diagonal(linked, False)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    shift = 0 if same else split
    for a in range(len(linked)):
        for b in (np.flatnonzero(linked[a]) + shift).tolist():
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    least: dict[int, bytes] = {}
    for k, r in enumerate(rows):
        top = root(k)
        least[top] = min(least.get(top, r[0]), r[0])
    links = linked @ copies[shift:] if same else np.concatenate([linked @ copies[split:], linked.T @ copies[:split]])
    for k in np.flatnonzero(links).tolist():
        yield rows[k][0], int(links[k]), least[root(k)]


def _forest(nodes: DataFrame, threshold: float, trees: int, deepest: int, recall: float) -> DataFrame:
    """Edges (u, v) that connect candidates: nodes that share a searched prefix, to the least of them."""
    if not 0 < deepest <= 8:
        raise ValueError("a signature has 1 to 8 hashes")
    least = shortest(threshold, trees, deepest, recall)
    rows = nodes.filter(F.col("n_grams") >= fewest(threshold)).select("node", F.posexplode(F.arrays_zip("heads", "tails")).alias("tree", "s")).select("tree", F.col("s.heads").alias("head"), F.col("s.tails").alias("tail"), "node")
    schema = pa.schema([("tree", pa.int32()), ("head", pa.int64()), ("tail", pa.int64()), ("node", pa.binary()), ("shared", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The longest prefix that each row shares with a neighbour. The neighbours of a task's first and last row are in other tasks: these rows
        count as sharing all, so that their prefixes are looked at."""
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks().to_batches()[0]
            yield from matched(now, held is None, False)
            held = now.slice(max(0, now.num_rows - 2))
        if held is not None:
            yield from matched(held, held.num_rows < 2, True)

    def matched(b: pa.RecordBatch, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        # Of a batch, all rows but the last are told; the first one was told before unless it is the task's first.
        tree, head, tail = (b.column(k).to_numpy() for k in range(3))
        up = np.where(np.concatenate([[False], tree[1:] == tree[:-1]]), shared_prefix(head, tail), 0)
        down = np.concatenate([up[1:], [0]])
        both = np.maximum(up, down)
        if first:
            both[0] = deepest
        if last:
            both[-1] = deepest
        told = slice(0 if first else 1, len(both) if last else len(both) - 1)
        keep = np.zeros(len(both), bool)
        keep[told] = both[told] >= least
        if keep.any():
            out = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(both[keep], pa.int32())], schema=schema)

    ordered = rows.repartitionByRange("tree", "head", "tail", "node").sortWithinPartitions("tree", "head", "tail", "node")
    found = materialise(ordered.mapInArrow(tidy(run), "tree int, head long, tail long, node binary, shared int"), "matched")
    # How deep each node searches: its longest prefixes are cut down to one depth, the greatest that meets the target.
    escapes = lambda d: math.log(max(1 - threshold**d, 1e-300))
    counts = [F.count(F.when(F.col("shared") == d, 1)).alias(f"n{d}") for d in range(least, deepest + 1)]
    searched = found.groupBy("node").agg(*counts)
    depth = F.lit(least)
    for d in range(least + 1, deepest + 1):
        missed = F.lit(trees * escapes(least)) + sum(F.col(f"n{k}") * F.lit(escapes(min(k, d)) - escapes(least)) for k in range(least, deepest + 1))
        depth = F.when(missed <= math.log(max(1 - recall, 1e-300)), d).otherwise(depth)
    deep = found.join(searched.select("node", depth.alias("depth")), "node")

    def prefix(d):
        cut = lambda c, hashes: F.when(hashes >= 4, F.col(c)).when(hashes > 0, F.expr(f"shiftright({c}, cast(64 - 16 * ({d}{' - 4' if c == 'tail' else ''}) as int))")).otherwise(F.lit(0).cast("long"))
        return F.xxhash64("tree", F.col(d), cut("head", F.col(d)), cut("tail", F.col(d) - 4))

    asked = deep.withColumn("own", F.least("shared", "depth")).select(prefix("own").alias("key")).distinct()
    all_ = found.withColumn("d", F.explode(F.sequence(F.lit(least), F.col("shared")))).select("node", prefix("d").alias("key"))
    members = materialise(all_.join(asked, "key", "left_semi"), "members")
    centre = materialise(members.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("m")).filter("m > 1").drop("m"), "centres")
    return members.join(centre, "key").select(F.col("node").alias("u"), "v")


def _verified(df: DataFrame, nodes: DataFrame, id_col: str, text_col: str, n: int, threshold: float, block: int) -> DataFrame:
    """Links and least linked node of each node, one row per block pair that links it. `nodes` is a written table."""
    sizes = nodes.groupBy("root").agg(F.greatest(F.floor(F.sum("n_grams") / block) + 1, F.floor(F.count("*") / NODES) + 1).cast("int").alias("blocks"))
    # Only groups of several blocks are looked up, from a written table: a large group's nodes are split among tasks.
    several = materialise(sizes.filter("blocks > 1"), "blocks")
    placed = nodes.join(several, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wanted = placed.select("doc", "node", "copies", "root", "block", "blocks")
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    # A node's text is one of those with its least id.
    found = rows.join(wanted, rows["id"].eqNullSafe(wanted["doc"])).select("text", "node", "copies", "root", "block", "blocks")
    made = pa.schema([("node", pa.binary()), ("copies", pa.int64()), ("root", pa.binary()), ("block", pa.int32()), ("blocks", pa.int32()), ("grams", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for b in batches:
                for text, node, *more in zip(*(c.to_pylist() for c in b.columns)):
                    g = grams(text or "", n)
                    if _name(g) == node:
                        yield node, *more, g.tobytes()

        yield from rebatch(each(), made, lambda r: len(r[5]) + 64)

    sets = found.mapInArrow(tidy(cut), "node binary, copies long, root binary, block int, blocks int, grams binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = sets.select("node", "copies", "root", "block", "grams", other).select(
        F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("place"), "root", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node", "copies", "grams"
    )
    schema = pa.schema([("node", pa.binary()), ("links", pa.int64()), ("least", pa.binary()), ("whole", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(key, held):
            if key is not None:
                distinct = {r[0]: r for r in held}
                yield from ((*x, False) for x in verify(list(distinct.values()), threshold, key[1] == key[2]))

        def each():
            now, held = None, []
            for b in batches:
                for _, root, a, e, at, node, copies, g in zip(*(c.to_pylist() for c in b.columns)):
                    if (root, a, e) != now:
                        yield from settle(now, held)
                        now, held = (root, a, e), []
                    held.append((node, copies, at != a, np.frombuffer(g, np.uint64)))
            yield from settle(now, held)

        yield from rebatch(each(), schema)

    return pairs.repartition("place").sortWithinPartitions("place", "root", "a", "b").mapInArrow(tidy(run), "node binary, links long, least binary, whole boolean").drop("whole")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = GRAMS, threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Per row: the id, class_id (the least id of all that links reach), n_links and the text's md5."""
    signed = materialise(_signed(df, id_col, text_col, n, trees, deepest), "signed")
    nodes = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("heads").alias("heads"), F.first("tails").alias("tails"))
    roots = components(_forest(nodes, threshold, trees, deepest, recall))
    members = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"))
    verified = materialise(_verified(df, materialise(members.join(roots, "node"), "grouped"), id_col, text_col, n, threshold, block), "verified")
    classes = components(verified.select(F.col("node").alias("u"), F.col("least").alias("v")))
    linked = verified.groupBy("node").agg(F.sum("links").alias("links"))
    members = materialise(members.join(linked, "node", "left").join(classes, "node", "left").select("node", "doc", "copies", "links", F.coalesce("root", "node").alias("root")), "members")
    names = materialise(members.groupBy("root").agg(F.min("doc").alias("class_id")), "names")
    per_node = members.join(names, "root").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = signed.select("doc", "node", "md5")
    return rows.join(per_node, "node", "left").select(
        F.col("doc").alias(id_col), F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "md5"
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `df`, but of each class only the one with the least id (then the least md5 of its text); a null id is the greatest.

    Rows without grams all stay. Of rows with equal id and text one stays."""
    joined = join(df, id_col, text_col, **options)
    blank = F.col(id_col).eqNullSafe(F.col("class_id")) & (F.col("n_links") == 0)
    alone = joined.filter(blank).select(F.col(id_col).alias("__id"), F.col("md5").alias("__md5"))
    order = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), "md5")
    first = joined.filter(~blank).groupBy("class_id").agg(F.min(order).alias("o")).select(F.col("o.id").alias("__id"), F.col("o.md5").alias("__md5"))
    stays = alone.unionByName(first).distinct()
    keyed = df.withColumn("__key", _md5(df[text_col]))
    found = keyed.join(stays, keyed[id_col].eqNullSafe(stays["__id"]) & (keyed["__key"] == stays["__md5"]), "left_semi")
    # Texts are dealt out by id and text only where some rows are equal in both.
    equal = materialise(joined.groupBy(F.col(id_col).alias("__id"), F.col("md5").alias("__md5")).count().filter("count > 1").drop("count"), "equal")
    if equal.isEmpty():
        return found.drop("__key")
    same = found[id_col].eqNullSafe(equal["__id"]) & (found["__key"] == equal["__md5"])
    return found.join(equal, same, "left_anti").unionByName(found.join(equal, same, "left_semi").dropDuplicates([id_col, "__key"])).drop("__key")
