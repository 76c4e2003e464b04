"""Token counts under a unigram vocabulary, by dynamic programming over a trie of distinct pre-tokens.

Pieces come from a public model file, whose scores are merge ranks, not probabilities; the log-probability of rank r is
-log(r + 1) by Zipf's law, held as an integer multiple of 2**-20, so that sums are exact. A text, with a space in front and each space written as U+2581, is cut
into pieces of the greatest total score; on equal scores, into the fewest. No piece has that sign after another
character and none a line end, so texts fall into pre-tokens (signs, then other characters) that are scored apart.
Distinct pre-tokens are put in sorted order, which is the depth-first order of their trie: forward scores of a shared
prefix are computed once, and each terminal node's count is stored. A character that no piece has counts as its UTF-8
bytes, at the lowest score less 10.

Defined results: null and empty texts have 0 tokens; a null id stays null; repeated rows are counted each; an empty
table gives an empty table; columns other than the id and the text are not read.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import rebatch, slices, texts, tidy
from .vocabulary import Generations

SIGN = "▁"
CACHE = 400_000
#: A cost is score x UNIT less the number of pieces, so that equal scores are settled by the count, exactly.
UNIT = 1 << 40
UNKNOWN_PENALTY = 10


class Unigram:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = [p for p in model.pieces if p.type == 1]
        self.score = {p.piece: round(-math.log1p(max(0.0, -p.score)) * 2**20) for p in normal}
        self.cost = {p: x * UNIT - 1 for p, x in self.score.items()}
        self.longest = max(map(len, self.cost))
        self.unknown = (min(self.score.values()) - UNKNOWN_PENALTY * 2**20) * UNIT
        if any(SIGN in p.lstrip(SIGN) or "\n" in p for p in self.cost):
            raise ValueError("this vocabulary has pieces across pre-tokens")
        self.cache = Generations(CACHE)

    def forward(self, word: str, best: list[int], start: int) -> list[int]:
        """best[i] of the first i characters, of which those up to `start` are given."""
        cost, longest = self.cost, self.longest
        best = best[: start + 1]
        for i in range(start + 1, len(word) + 1):
            top = None
            for j in range(max(0, i - longest), i):
                c = cost.get(word[j:i])
                if c is not None and (top is None or best[j] + c > top):
                    top = best[j] + c
            if word[i - 1] not in cost:
                other = best[i - 1] + self.unknown - len(word[i - 1].encode("utf-8", "replace"))
                top = other if top is None else max(top, other)
            best.append(top)
        return best

    def counts(self, words: list[str]) -> list[int]:
        """Pieces of each pre-token."""
        out, best, previous = {}, [0], ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(previous))
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            best, previous = self.forward(word, best, shared), word
            out[word] = -best[-1] % UNIT
        return [out[w] for w in words]

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """Pre-tokens and tokens of each text."""
        split = [Counter(pre_tokens(x)) for x in texts]
        known = self.cache.fill(itertools.chain.from_iterable(split), self.counts)
        return [(sum(c.values()) + x.count("\n"), sum(n * known[w] for w, n in c.items()) + x.count("\n")) for c, x in zip(split, texts)]


_PARTS = re.compile(f"{SIGN}+[^{SIGN}]*|[^{SIGN}]+")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text, without its line ends, which are one token each."""
    if not text:
        return []
    text = (SIGN + text).replace(" ", SIGN)
    return [w for line in text.split("\n") for w in _PARTS.findall(line)]


@functools.lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    return Unigram(path)


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_pretokens and n_tokens."""
    schema = pa.schema([("id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(model_path)
        yield from rebatch(((key, *n) for b in batches for s in slices(b) for key, n in zip(s.column(0).to_pylist(), model.count(texts(s.column(1))))), schema)

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(tidy(run), "id long, n_pretokens long, n_tokens long").withColumnRenamed("id", id_col)
