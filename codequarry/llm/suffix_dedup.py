"""Removal of repeated byte strings by distributed prefix doubling over synchronised positions.

Each byte covered by a string of LENGTH bytes that also starts earlier (smaller id, or same document and smaller start) goes.
Strings are compared on the input and never cross documents.

Round 0 ranks prefixes of GRAM bytes. Their names double within the text (1, 2, 4 ... GRAM bytes), and of all positions it takes
samples: those whose name is the least among the LENGTH - GRAM + 1 of some string. A string that repeats has its samples at equal
offsets, so the samples stand for all strings, and this first round has 3 rows for each 100 bytes. Each further round ranks what is
left by longer strings around the samples, at growing offsets, until they are unique or LENGTH bytes long. In each round Spark sorts pairs:

* A cell is a sample and a range of offsets; its strings start that many bytes before the sample. All have the `core` in common and all
  lie in the `outer` bytes. In round 0 the cell has all offsets, its core is the GRAM bytes; at the end it has one, and core and outer
  are the LENGTH bytes themselves.
* Cells are sorted by (name of the core, digest of the outer bytes). A core that occurs once is unique, and its cell drops out. Of
  cells with equal outer bytes all but the earliest repeat, whole. Where equal cores have different outer bytes, the earliest of each go
  on to the next round, cut into PARTS cells of longer cores.

Names only bring candidates together and 128-bit BLAKE2 digests of the bytes themselves decide, so that a collision of names costs time
and changes nothing. Only the cells of strings that round 0 left open are built: a string with a repeated sample repeats, and each other
one is looked at by the sample whose name is its least (which is unique, or goes on).

Rows that a batch can settle are settled before the shuffle: a text of a million copies costs a row per batch, and of a core that
occurs with many different surroundings one row per batch meets all others, while the rest, known not to be unique, is spread by
its outer bytes. The sorted rows are read as a stream, so no group is held in memory. Very long texts are cut into overlapping parts.

Defined results: a null text is empty; texts below LENGTH bytes stay whole; a null id sorts before all; rows that share an id are
ordered as the table is read, so each keeps its own result, and of equal rows the later is a repeat; an empty table gives an
empty table; columns other than the id (an integer) and the text aren't read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from .shared import collect_garbage, materialise, rebatch, slices, tidy

LENGTH, GRAM = 100, 32
#: Cells that a cell is cut into from one round to the next.
PARTS = 5
#: Bytes of text, and cells, that are worked on at once.
CHUNK, CELLS = 512 << 10, 16_384
#: With it goes a tie below 0, so that it isn't taken for an id of this value.
NULL_ID = -(1 << 63)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    return x ^ (x >> np.uint64(29))


def names(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Name of the `gram` bytes at each position (a power of two), by doubling."""
    x = (raw.astype(np.uint64) + np.uint64(1)) * _ODD[0]
    h = 1
    while h < gram:
        x = x[:-h] * _ODD[1 + h.bit_length() % 6] + x[h:]
        x ^= x >> np.uint64(32)
        h *= 2
    return mixed(x)


def core_name(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw)


def sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """The least (or greatest) of each `width` neighbours, by doubling."""
    h = 1
    while 2 * h <= width:
        x = least(x[:-h], x[h:])
        h *= 2
    return least(x[: len(x) - (width - h)], x[width - h :]) if width > h else x


#: A part of a text: the number of its row, its bytes, where they begin in the text, the text's size, and the positions it answers for.
Part = tuple[int, bytes, int, int, int, int]


def parts_of(raw: bytes, length: int) -> Iterator[tuple]:
    """A text in parts (without the row) of CHUNK positions, with so many bytes around them that nothing about these positions is cut off."""
    for at in range(0, len(raw), CHUNK):
        begin, end = max(0, at - 2 * length), min(len(raw), at + CHUNK + 2 * length)
        yield raw[begin:end], begin, len(raw), at, at + CHUNK


class Chunk:
    """Parts of texts laid out with room between them, and their samples."""

    def __init__(self, parts: list[Part], length: int, gram: int):
        self.length, self.gram, self.side = length, gram, length - gram
        self.row, begin, self.size, self.low, self.high = (np.array([p[k] for p in parts], np.int64) for k in (0, 2, 3, 4, 5))
        lengths = np.array([len(p[1]) for p in parts], np.int64)
        room = b"\0" * (2 * length)
        starts = np.cumsum(np.concatenate([[2 * length], lengths[:-1] + 2 * length]))
        self.raw = room + room.join(p[1] for p in parts) + room
        #: What to take from a place here for the position in the text.
        self.shift = starts - begin
        self.name = names(np.frombuffer(self.raw, np.uint8), gram) | np.uint64(1)
        width = self.side + 1
        least = sliding(self.name, width, np.minimum)
        real = np.zeros(len(least), bool)
        for s, n in zip(starts.tolist(), lengths.tolist()):
            if n >= length:
                real[s : s + n - length + 1] = True
        #: The least name in the string that starts at each place, 0 where none does.
        self.least = np.where(real, least, np.uint64(0))
        greatest = sliding(np.concatenate([np.zeros(width - 1, np.uint64), self.least]), width, np.maximum)
        #: Places of the samples and the parts they stand in.
        self.at = np.flatnonzero(greatest == self.name[: len(greatest)])
        self.part = np.searchsorted(starts, self.at, "right") - 1
        self.pos = self.at - self.shift[self.part]

    def own(self) -> np.ndarray:
        """Whether a sample is of the positions that its part answers for."""
        return (self.pos >= self.low[self.part]) & (self.pos < self.high[self.part])

    def around(self, k: int, first: int, last: int) -> tuple[bytes, int]:
        """The outer bytes of a sample's strings that start `first` to `last` bytes before it, and how many stand before it."""
        at, pos, size = int(self.at[k]), int(self.pos[k]), int(self.size[self.part[k]])
        before = min(pos, last)
        return self.raw[at - before : at + min(size - pos, self.length - first)], before

    def open_offsets(self, wanted: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the samples at `wanted` places, those by which strings are to be looked at, and their least and greatest offsets: a string
        is looked at by the first sample whose name is its least, unless it has a sample at one of the `repeated` places."""
        is_wanted = np.isin(self.at, wanted)
        settled = np.zeros(len(self.raw) + 1, np.int32)
        settled[repeated + 1] = 1
        settled = np.cumsum(settled, dtype=np.int32)
        order = np.lexsort((self.at, self.name[self.at], self.part))
        same = (self.part[order][1:] == self.part[order][:-1]) & (self.name[self.at[order]][1:] == self.name[self.at[order]][:-1])
        before = np.full(len(self.at), -1, np.int64)
        before[order[1:]] = np.where(same, self.at[order[:-1]], -1)
        mine = np.flatnonzero(is_wanted & self.own())
        found, low, high = [], [], []
        for a in range(0, len(mine), 8_192):
            k = mine[a : a + 8_192]
            places = self.at[k][:, None] - np.arange(self.side + 1)
            good = self.least[places] == self.name[self.at[k]][:, None]
            good &= (settled[places + self.side + 1] == settled[places]) & (places > before[k][:, None])
            some = good.any(1)
            found.append(k[some])
            low.append(good[some].argmax(1))
            high.append(self.side - good[some][:, ::-1].argmax(1))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, low, high))


def digest(raw: bytes, before: int, whole: bool) -> bytes:
    """Of a cell's outer bytes; if they reach over a text's end, of how they lie as well."""
    return blake2b(raw, digest_size=16).digest() if whole else blake2b(raw, digest_size=16, person=struct.pack("<II", before + 1, len(raw))).digest()


#: Kinds of rows: to be ranked; the same, but known not to be unique; repeats; goes on to the next round.
RANK, AGAIN, REPEAT, OPEN = 0, 1, 2, 3
_KEYS = [("q", pa.int64()), ("o1", pa.int64()), ("o2", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("pos", pa.int32()), ("kind", pa.int8())]
_SAMPLES = pa.schema(_KEYS)
_CELLS = pa.schema([*_KEYS, ("first", pa.int16()), ("last", pa.int16()), ("low", pa.int16()), ("high", pa.int16()), ("around", pa.binary()), ("before", pa.int16())])
_SAMPLES_SQL = "q long, o1 long, o2 long, doc long, tie long, pos int, kind tinyint"
_CELLS_SQL = _SAMPLES_SQL + ", first smallint, last smallint, low smallint, high smallint, around binary, before smallint"


def dealt(core: np.ndarray, outer: list[bytes], doc: np.ndarray, tie: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of the rows, and their columns q to kind in that order, with what these rows alone can settle."""
    o1, o2 = np.frombuffer(b"".join(outer), "<i8").reshape(-1, 2).T
    order = np.lexsort((pos, tie, doc, o2, o1, core))
    core, o1, o2, doc, tie, pos = (x[order] for x in (core, o1, o2, doc, tie, pos))
    new = np.concatenate([[True], core[1:] != core[:-1]])
    repeats = ~new & np.concatenate([[False], (o1[1:] == o1[:-1]) & (o2[1:] == o2[:-1])])
    group = np.cumsum(new) - 1
    several = (np.bincount(group, ~repeats) > 1)[group]
    place = mixed((doc * 31 + tie * 17 + pos).view(np.uint64))
    apart = mixed(core * _ODD[4] + o1.view(np.uint64))
    q = np.where(repeats, place, np.where(several & ~new, apart, core)).view(np.int64)
    return order, [q, o1, o2, doc, tie, pos.astype(np.int32), np.where(repeats, REPEAT, np.where(several, AGAIN, RANK)).astype(np.int8)]


def _chunks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], length: int) -> Iterator[tuple[list[tuple], list[Part]]]:
    """Rows (raw bytes first) and the parts of their texts, CHUNK bytes at a time."""
    rows, parts, total = [], [], 0
    for b in batches:
        for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns)):
            if len(row[0] or b"") < length:
                continue
            mine = -1
            for part in parts_of(row[0], length):
                if mine < 0:
                    mine = len(rows)
                    rows.append(row[1:])
                parts.append((mine, *part))
                total += len(part[0])
                if total >= CHUNK:
                    yield rows, parts
                    rows, parts, total, mine = [], [], 0, -1
    if parts:
        yield rows, parts


def find_samples(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Round 0: the samples of each chunk."""
    side = length - gram
    for rows, parts in _chunks(batches, ("raw", "doc", "tie"), length):
        chunk = Chunk(parts, length, gram)
        mine = np.flatnonzero(chunk.own())
        if not len(mine):
            continue
        row = chunk.row[chunk.part[mine]]
        doc, tie = np.array([r[0] for r in rows], np.int64)[row], np.array([r[1] for r in rows], np.int64)[row]
        outer = []
        for k in mine.tolist():
            raw, before = chunk.around(k, 0, side)
            outer.append(digest(raw, before, len(raw) == length + side))
        columns = dealt(chunk.name[chunk.at[mine]], outer, doc, tie, chunk.pos[mine])[1]
        for a in range(0, len(mine), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 65_536], f.type) for c, f in zip(columns, _SAMPLES)], schema=_SAMPLES)


def open_cells(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[tuple]:
    """The samples that round 0 left open, as cells to be cut: doc, tie, pos, first, last, low, high, around, before."""
    side = length - gram
    for rows, parts in _chunks(batches, ("raw", "doc", "tie", "wanted", "repeated"), length):
        chunk = Chunk(parts, length, gram)
        begin, end = np.array([p[2] for p in parts], np.int64), np.array([p[2] + len(p[1]) for p in parts], np.int64)

        def places(column: int) -> np.ndarray:
            each = [np.asarray(r[column] or (), np.int64) for r in rows]
            mine = [each[r] for r in chunk.row.tolist()]
            part = np.repeat(np.arange(len(parts)), [len(w) for w in mine])
            pos = np.concatenate(mine)
            inside = (pos >= begin[part]) & (pos < end[part])
            return pos[inside] + chunk.shift[part[inside]]

        for k, low, high in zip(*(x.tolist() for x in chunk.open_offsets(places(2), places(3)))):
            raw, before = chunk.around(k, 0, side)
            yield *rows[chunk.row[chunk.part[k]]][:2], int(chunk.pos[k]), 0, side, low, high, raw, before


def cut(cells: Iterator[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """Cells cut into PARTS, those without open offsets left out."""
    held: list[tuple] = []

    def settle():
        core = np.array([h[0] for h in held], np.uint64)
        doc, tie, pos = (np.array([h[k] for h in held], np.int64) for k in (2, 3, 4))
        order, columns = dealt(core, [h[1] for h in held], doc, tie, pos)
        rest = list(zip(*(held[k][5:] for k in order.tolist())))
        rest[4] = [None if kind == REPEAT else x for kind, x in zip(columns[6].tolist(), rest[4])]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, *rest], _CELLS)], schema=_CELLS)

    for doc, tie, pos, first, last, low, high, around, before in cells:
        step = -(-(last - first + 1) // PARTS)
        for a in range(first, last + 1, step):
            e = min(a + step - 1, last)
            if high < a or low > e:
                continue
            # Within `around`, the sample stands at `before`.
            own = min(before, e)
            outer = around[before - own : before + length - a]
            core = around[before - a : before + length - e]
            name = digest(outer, own, len(outer) == length + e - a)
            # The last cells are as long as their core, and meet by their digests.
            held.append((core_name(core + b"%d" % a) if e > a else int.from_bytes(name[:8], "little"), name, doc, tie, pos, a, e, max(low, a), min(high, e), outer if e > a else None, own))
            if len(held) >= CELLS:
                yield settle()
                held.clear()
    if held:
        yield settle()


def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (q, o1, o2, doc, tie, pos): unique ones drop out, the others repeat or go on. Rows that repeat carry no bytes.

    Of a group that goes on in the next batch only its last key and, as long as it may be unique, its one row are kept."""
    last, more, held = None, False, None
    for b in batches:
        kind = b.column(6).to_numpy()
        if (done := kind == REPEAT).any():
            yield b.filter(pa.array(done))
            b = b.filter(pa.array(~done))
            kind = kind[~done]
        if not b.num_rows:
            continue
        q, o1, o2 = (b.column(k).to_numpy() for k in range(3))
        goes_on = last is not None and q[0] == last[0]
        new = np.concatenate([[not goes_on], q[1:] != q[:-1]])
        other = new | np.concatenate([[not goes_on or (o1[0], o2[0]) != last[1:]], (o1[1:] != o1[:-1]) | (o2[1:] != o2[:-1])])
        group = np.cumsum(new) - (0 if goes_on else 1)  # 0 is the group that goes on, if one does
        several = (np.bincount(group, other) + (np.arange(group[-1] + 1) == 0) * goes_on > 1) | (np.bincount(group, kind == AGAIN) > 0)
        several[0] |= goes_on and more
        if held is not None and goes_on and several[0]:
            yield _as(held, OPEN)
        if not goes_on or several[0] or group[-1]:  # the group that went on has ended, or its row is out
            held = None
        repeats = ~other
        if repeats.any():
            yield _as(b.filter(pa.array(repeats)), REPEAT)
        stays = other & several[group]
        if stays.any():
            yield _as(b.filter(pa.array(stays)), OPEN)
        last, more = (q[-1], o1[-1], o2[-1]), bool(several[-1])
        if not more and (mine := np.flatnonzero(other & (group == group[-1]))).size:
            held = b.slice(int(mine[0]), 1)


def _as(b: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    b = b.set_column(6, "kind", pa.array(np.full(b.num_rows, kind, np.int8)))
    at = b.schema.get_field_index("around")
    return b if kind == OPEN or at < 0 else b.set_column(at, "around", pa.nulls(b.num_rows, pa.binary()))


def _ranked(rows: DataFrame, run: Callable, schema: str, name: str) -> DataFrame:
    """One round: rows are made, sorted and told apart."""
    made = rows.mapInArrow(tidy(run), schema)
    return materialise(made.repartition("q").sortWithinPartitions("q", "o1", "o2", "doc", "tie", "pos").mapInArrow(tidy(classify), schema), name)


def _laid(df: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """doc, tie (tells rows of one id apart, below 0 if the id is null), raw bytes and, if carried, the other columns."""
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer")
    rest = [df[c].alias(f"rest{k}") for k, c in enumerate(df.columns) if c not in (id_col, text_col)] if carry else []
    columns = [F.coalesce(df[id_col].cast("long"), F.lit(NULL_ID)).alias("doc"), df[text_col].cast("binary").alias("raw"), *rest]
    rows = df.select(*columns, F.when(df[id_col].isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long").alias("tie"))
    shared = df.groupBy(df[id_col].alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select(F.coalesce(F.col("id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.col("id").isNull().alias("unnamed"))
    if shared.isEmpty():
        return rows
    shared = materialise(shared, "shared")
    same = (rows["doc"] == shared["doc"]) & ((rows["tie"] < 0) == shared["unnamed"])
    # Written once, so that the numbers are fixed.
    again = materialise(rows.join(shared, same, "left_semi").withColumn("tie", F.when(F.col("tie") < 0, -2 - F.monotonically_increasing_id()).otherwise(1 + F.monotonically_increasing_id())), "shared")
    return rows.join(shared, same, "left_anti").unionByName(again)


def removed_runs(b: pa.RecordBatch) -> Iterator[tuple[int, int, bytes | None, list[tuple[int, int]]]]:
    """Per row of the layout and its marks: doc, tie, raw bytes, and the maximal runs of bytes to remove."""
    lists = b.column(b.schema.get_field_index("marks"))
    flat = lists.flatten()
    first, last = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
    at = 0
    for doc, tie, raw, n in zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in ("doc", "tie", "raw")), counts):
        runs = []
        if n:
            size = len(raw)
            edges = np.zeros(size + 1, np.int32)
            np.add.at(edges, np.maximum(first[at : at + n], 0), 1)
            np.add.at(edges, np.minimum(last[at : at + n], size), -1)
            gone = np.concatenate([[0], (np.cumsum(edges)[:size] > 0).view(np.int8), [0]])
            change = np.flatnonzero(np.diff(gone))
            runs = list(zip(change[::2].tolist(), change[1::2].tolist()))
        at += n
        yield doc, tie, raw, runs


def _marked(df: DataFrame, id_col: str, text_col: str, length: int, gram: int, carry: bool = False) -> DataFrame:
    """The layout with each row's marks, places of bytes that go; they may overlap and reach over the text's ends."""
    if gram & (gram - 1) or not 0 < gram < length:
        raise ValueError("gram must be a power of two below the length")
    side = length - gram
    laid = _laid(df, id_col, text_col, carry)
    found = _ranked(laid.select("doc", "tie", "raw"), lambda it: find_samples(it, length, gram), _SAMPLES_SQL, "round0")
    collect_garbage(df.sparkSession)
    mark = F.struct((F.col("pos") - F.col("last")).alias("first"), (F.col("pos") - F.col("first") + length).alias("last")).alias("mark")
    marks = found.filter(F.col("kind") == REPEAT).select("doc", "tie", F.struct((F.col("pos") - side).alias("first"), (F.col("pos") + length).alias("last")).alias("mark"))
    places = [F.collect_list(F.when(F.col("kind") == kind, F.col("pos"))).alias(name) for kind, name in ((OPEN, "wanted"), (REPEAT, "repeated"))]
    wanted = found.groupBy("doc", "tie").agg(*places).filter(F.size("wanted") > 0)
    cells = laid.select("doc", "tie", "raw").join(wanted, ["doc", "tie"])
    take = ["doc", "tie", "pos", "first", "last", "low", "high", "around", "before"]

    def first_cut(batches):
        return cut(open_cells(batches, length, gram), length)

    def next_cut(batches):
        return cut((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))), length)

    run, width, k = first_cut, side + 1, 0
    while width > 1:
        width, k = -(-width // PARTS), k + 1
        ranked = _ranked(cells, run, _CELLS_SQL, f"round{k}")
        collect_garbage(df.sparkSession)
        marks = marks.unionByName(ranked.filter(F.col("kind") == REPEAT).select("doc", "tie", mark))
        # Cells of one offset are settled by their digests, and carry no bytes to cut.
        cells, run = ranked.filter((F.col("kind") == OPEN) & (F.col("first") < F.col("last"))).select(*take), next_cut
    return laid.join(marks.groupBy("doc", "tie").agg(F.collect_list("mark").alias("marks")), ["doc", "tie"], "left")


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, e in runs:
        kept.append(raw[at:a])
        at = e
    return b"".join([*kept, raw[at:]])


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: the id, n_bytes, n_removed, `spans` (removed runs) and `kept` (the remaining bytes)."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", spans), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for whole in batches:
                for b in slices(whole):
                    for doc, tie, raw, runs in removed_runs(b):
                        raw = raw or b""
                        yield None if tie < 0 else doc, len(raw), sum(e - a for a, e in runs), [{"start": a, "end": e} for a, e in runs], without(raw, runs)

        yield from rebatch(rows(), schema, lambda r: len(r[4]) + 64)

    found = _marked(df, id_col, text_col, length, gram).mapInArrow(tidy(run), "doc long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
    return found.withColumnRenamed("doc", id_col)


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The same rows and columns without the removed bytes; characters that are cut go whole. A null text stays null."""
    marked = _marked(df, id_col, text_col, length, gram, carry=True)
    names_ = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                found = [(None if tie < 0 else doc, None if raw is None else without(raw, runs).decode("utf-8", "ignore")) for doc, tie, raw, runs in removed_runs(b)]
                ids, new = pa.array([d for d, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())
                yield pa.RecordBatch.from_arrays([ids if c == id_col else new if c == text_col else b.column(b.schema.get_field_index(f"rest{k}")) for k, c in enumerate(names_)], names=[f"c{k}" for k in range(len(names_))])

    out = marked.mapInArrow(tidy(run), StructType([StructField(f"c{k}", LongType() if f.name == id_col else f.dataType) for k, f in enumerate(df.schema)]))
    return out.select(*[F.col(f"c{k}").cast(f.dataType).alias(f.name) for k, f in enumerate(df.schema)])
