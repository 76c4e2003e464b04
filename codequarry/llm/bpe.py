"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has exactly one last token in its BPE encoding. Storing that token per prefix makes
the encoding a chain of back steps, an append an extension of the table, and an edit a recomputation from the edit on.
A token t that ends at i is the last token of prefix i if and only if the last token of prefix i - len(t) and t stay
apart when their bytes are merged together, which two tokens' merge trees decide alone.

Defined results: a null text is the empty text and has no ids; any code points are encoded, as every byte is a token;
repeated rows give repeated results; an empty table gives an empty table; columns other than the id and the text are
not read, so clashing names do no harm; a null id stays null.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import rebatch, slices, texts, tidy
from .vocabulary import Generations, ranks

#: Entries of a worker's cache of chunks.
CACHE = 250_000


class Encoder:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        self.rank = ranks(ranks_path)
        self.bytes_of = [b""] * (max(self.rank.values()) + 1)
        for piece, k in self.rank.items():
            self.bytes_of[k] = piece
        self.longest = max(map(len, self.rank))
        self.split = regex.compile(pattern)
        self.parts = self._merge_trees()
        self.apart: dict[int, bool] = {}
        self.cache = Generations(CACHE)

    def _merge_trees(self) -> list[tuple[int, int] | None]:
        """The two tokens that each token is merged from: the split whose halves are tokens of lower rank that stay apart."""
        self.parts = [None] * len(self.bytes_of)
        self.apart = {}
        for k, piece in enumerate(self.bytes_of):  # in rank order, so that halves are known
            best = None
            for cut in range(1, len(piece)):
                a, b = self.rank.get(piece[:cut]), self.rank.get(piece[cut:])
                if a is not None and b is not None and a < k and b < k and self._apart(a, b, k):
                    best = (a, b)
                    break
            self.parts[k] = best
        return self.parts

    def _apart(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether merging left's and right's bytes, with merges ranked under `below` only, keeps the border.

        Merges happen in rank order, so the merge trees are undone from the highest rank down. At each step the two
        tokens at the border are those present just before merges of rank `limit`; the border falls if they form one."""
        rank, name, parts = self.rank, self.bytes_of, self.parts
        limit = len(name) if below is None else below
        while True:
            joint = rank.get(name[left] + name[right])
            if joint is not None and joint < limit:
                return False
            x, y = parts[left], parts[right]
            if x is None and y is None:
                return True
            # Undo the later of the two merges. On equal ranks the left one was done first.
            if y is None or (x is not None and left > right):
                limit, left = left, x[1]
            else:
                limit, right = right + 1, y[0]

    def prefixes(self, piece: bytes, last: list[int] | None = None, start: int = 0) -> list[int]:
        """last[i]: the last token of piece[:i]. With a table for piece[:start], only the rest is computed."""
        rank, apart, lengths = self.rank, self.apart, self.bytes_of
        last = [-1] if last is None else last[: start + 1]
        for i in range(len(last), len(piece) + 1):
            for j in range(max(0, i - self.longest), i):
                t = rank.get(piece[j:i])
                if t is None:
                    continue
                if j == 0:
                    if i == 1 or self._whole(t):
                        break
                    continue
                before = last[j]
                key = before << 24 | t
                ok = apart.get(key)
                if ok is None:
                    if len(apart) > 400_000:
                        apart.clear()
                    ok = apart[key] = self._whole(t) and self._apart(before, t)
                if ok:
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")
            last.append(t)
        return last

    def _whole(self, token: int) -> bool:
        """Whether merging reaches this token from its bytes."""
        return self.parts[token] is not None or len(self.bytes_of[token]) == 1

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern. A match that is itself in the vocabulary is that token."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        return self.walk(self.prefixes(piece), len(piece))

    def walk(self, last: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def pieces(self, found: list[bytes]) -> dict[bytes, bytes]:
        """Ids of many matches. In sorted order each shares its first rows of the table with the one before it."""
        out: dict[bytes, bytes] = {}
        last, previous = [-1], b""
        for piece in sorted(found):
            whole = self.rank.get(piece)
            if whole is not None:
                ids = [whole]
            else:
                shared, most = 0, min(len(piece), len(previous))
                while shared < most and piece[shared] == previous[shared]:
                    shared += 1
                last, previous = self.prefixes(piece, last, shared), piece
                ids = self.walk(last, len(piece))
            out[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        matches = [[m.encode("utf-8", "replace") for m in self.split.findall(c)] for c in chunks]
        known = self.pieces(set(itertools.chain.from_iterable(matches)))
        return [b"".join(map(known.__getitem__, m)) for m in matches]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        chunks = [chunks_of(x, self.split) for x in texts]
        known = self.cache.fill(itertools.chain.from_iterable(chunks), self._chunks)
        return [b"".join(map(known.__getitem__, x)) for x in chunks]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: White space other than the space and the line end.
_OTHER = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Runs of three.
_RUNS = ["".join(x) for x in itertools.product(" \n", repeat=3)]


def chunks_of(text: str, split: regex.Pattern) -> list[str]:
    """Parts of the text at whose borders every match of the pattern ends too, so that parts can be encoded apart.

    White space begins a match, and of a run before a word all but the last character are one match. So where runs are
    of at most two characters (one at the end of the text), each space begins a part and each line end is one. Other
    texts are split by the pattern itself."""
    if _OTHER.search(text) or any(x in text for x in _RUNS) or (text[-2:].isspace() and len(text) > 1 and text[-2].isspace()):
        return split.findall(text)
    out: list[str] = []
    for k, line in enumerate(text.split("\n")):
        if k:
            out.append("\n")
        first, *rest = line.split(" ")
        if first:
            out.append(first)
        out += [" " + x for x in rest]
    return out


@functools.lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    return Encoder(ranks_path, pattern)


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, `ids` (binary, little-endian unsigned 32-bit) and `decoded` (binary), decoded from these ids."""
    schema = pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks_path, pattern)

        def rows():
            for b in batches:
                for part in slices(b):
                    for key, ids in zip(part.column(0).to_pylist(), coder.encode(texts(part.column(1)))):
                        yield key, ids, coder.decode(ids)

        yield from rebatch(rows(), schema, lambda r: len(r[1]) + len(r[2]))

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(tidy(run), "id long, ids binary, decoded binary").withColumnRenamed("id", id_col)
