"""Packing by power-of-two decomposition.

A document's ids (its tokens, then the end id) are cut from the front into pieces of the longest length, then one piece
for each binary digit of the rest, longest first. Every piece is a sequence of its own, of a length that is a power of
two, so no sequence crosses documents and none is padded; sequences of equal length are numbered together, so that a
bucket of one length is a range of sequence ids.

Defined results: a null or empty text has the end id alone; a null id stays null; repeated rows are packed each;
an empty table has no pieces; columns other than the id and the text are not read.
"""

from __future__ import annotations

import array
import functools
import itertools
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, rebatch, slices, texts, tidy
from .vocabulary import Generations

END = 1
LONGEST = 2048
CACHE = 250_000
#: Words that go to the library as one text.
TOGETHER = 256


class WordTokenizer:
    """Ids of a tokenizer file that drops white space: words between spaces and line ends are encoded once each.

    Special tokens' strings in a text get their ids, as the library gives them. Words of lower-case letters alone go to the library's model many at
    a time, past the normalizer and the pattern that would leave them as they are, and their ids are told apart by the mark that ends
    a word's last token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.cache, self.letters = Generations(CACHE), Generations(CACHE)
        self.marks = {m: self._each([m])[0] for m in ".,"}

    def _each(self, words: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case letters."""
        out: list[bytes] = []
        parts = [words[a : a + TOGETHER] for a in range(0, len(words), TOGETHER)]
        for part, e in zip(parts, self.model.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(ends) != len(part):
                out += self._each(part)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        cores = [_letters(w) or (_letters(w[:-1]) if w[-1:] in self.marks else None) for w in words]
        known = self.letters.fill((c for c in cores if c), self._together)
        others = iter(self._each([w for w, c in zip(words, cores) if not c]))
        return [next(others) if not c else known[c] + self.marks[w[-1]] if w[-1] in self.marks else known[c] for w, c in zip(words, cores)]

    def _lowered(self, text: str) -> str:
        """The text with A to Z as a to z, where that changes no id: the library composes characters before it lowers them."""
        if any(s[:2] in text for s in self.special):
            return text
        lower = text.encode().lower().decode()
        return lower if unicodedata.is_normalized("NFC", lower) else text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        words = [self._lowered(x).replace("\n", " ").split(" ") for x in texts]
        known = self.cache.fill(itertools.chain.from_iterable(words), self._words)
        return [b"".join(map(known.__getitem__, x)) for x in words]


def _letters(word: str) -> str | None:
    """A word of letters of the Latin blocks in lower case; null if it is another. These are letters to every version of the library, composed,
    and lowered one by one (but for the dotted capital I)."""
    return word.lower() if word.isalpha() and (word.isascii() or (max(word) < "\u0250" and "\u0130" not in word)) else None


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def binary_cuts(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n ids: powers of two, none above `longest`, in falling order."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def pieces(df: DataFrame, tokenizer_path: str, longest: int = LONGEST, end: int = END, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row per piece: the id, start, length, `ids` (binary, little-endian unsigned 32-bit; null if not asked for), ids_crc32,
    doc_tokens, and its place (`part`, `place`): the task that made it, and its number among the task's pieces of that length."""
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("place", pa.int64())])
    binary_cuts(1, longest)
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, places = word_tokenizer(tokenizer_path), TaskContext.get().partitionId(), {}

        def rows():
            for b in batches:
                for s in slices(b):
                    for key, raw in zip(s.column(0).to_pylist(), coder.encode(texts(s.column(1)))):
                        raw += last
                        n = len(raw) // 4
                        at = 0
                        for length in binary_cuts(n, longest):
                            place = places[length] = places.get(length, -1) + 1
                            piece = raw[at * 4 : (at + length) * 4]
                            yield key, at, length, piece if ids else None, zlib.crc32(piece), n, part, place
                            at += length

        yield from rebatch(rows(), schema, lambda r: 4 * r[2] * ids + 48)

    made = df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(tidy(run), "id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, part int, place long")
    return (made if ids else made.drop("ids")).withColumnRenamed("id", id_col)


def number(df: DataFrame) -> DataFrame:
    """Sequence ids, gapless from 0 in order of (length, part, place), for any table that keeps those columns of `pieces`.

    The table is written first, so that places are fixed. A count per task and length is summed up in Spark, and one total per
    length (of which there are as many as powers of two up to the longest) reaches the driver."""
    fixed = materialise(df, "pieces")
    counts = fixed.groupBy("length", "part").agg(F.count("*").alias("n"))
    first, base = F.lit(None).cast("long"), 0
    for length, n in sorted(tuple(r) for r in fixed.groupBy("length").count().collect()):
        first = F.when(F.col("length") == length, F.lit(base)).otherwise(first)
        base += n
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", (first + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("first"))
    return fixed.join(offsets, ["length", "part"]).withColumn("sequence_id", F.col("first") + F.col("place")).withColumn("offset", F.lit(0).cast("long")).drop("first", "part", "place")


def pack(df: DataFrame, tokenizer_path: str, longest: int = LONGEST, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All sequences with their ids."""
    return number(pieces(df, tokenizer_path, longest, end, id_col, text_col))
