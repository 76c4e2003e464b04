"""Functions over whole values that no builtin covers: redaction inside JSON, token counts by a vocabulary file, stems of compound words."""

from __future__ import annotations

import functools
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from . import text as T
from .stemming import stem

_SECRET, _KEY = re.compile(T.SECRET), re.compile(T.PRIVATE_KEY)


def redacted(value):
    """Text leaves of nested lists and dictionaries with lines that hold secrets replaced."""
    if isinstance(value, str):
        return "\n".join(T.REDACTED if _SECRET.search(x) or _KEY.search(x) else x for x in value.split("\n"))
    if isinstance(value, dict):
        return {k: redacted(v) for k, v in value.items()}
    return [redacted(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def redact_json(column: pd.Series) -> pd.Series:
    """JSON with its text leaves redacted, compact; what isn't JSON is redacted as a text."""

    def one(x):
        if x is None:
            return None
        try:
            return json.dumps(redacted(json.loads(x)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return redacted(x)

    return column.map(one)


@functools.lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counted_tokens(column, path: str | None = None, pattern: str | None = None):
    """(n, method): tokens by a vocabulary file of ranks, or the estimate of one for each four bytes where none is given."""
    if path is None:
        return F.struct(T.estimate_tokens(column).alias("n"), F.lit("estimate").alias("method"))

    @F.pandas_udf(LongType())
    def exact(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else len(_encoding(path, pattern).encode_ordinary(x)))

    return F.struct(exact(column).alias("n"), F.lit("vocabulary").alias("method"))


@F.pandas_udf(ArrayType(StringType()))
def stems_of_parts(parts: pd.Series) -> pd.Series:
    """Distinct stems, in order, of words that are no stop words, before or after stemming, and have two letters or more."""
    stop = frozenset(T.STOP_WORDS)

    def one(words):
        if words is None:
            return None
        return list(dict.fromkeys(s for w in words if len(w) > 1 and w not in stop and len(s := stem(w)) > 1 and s not in stop))

    return parts.map(one)


def atomic_stems(text):
    """Stems of a text's words taken apart: compound words count by their parts alone."""

    def parts(word):
        found = T.split_identifier(word)
        compound = (F.size(found) > 1) & (F.get(found, F.size(found) - 1) == F.lower(word))
        return F.when(compound, F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found)

    words = F.regexp_extract_all(text, F.lit(f"({T.TERM})"), F.lit(1))
    return stems_of_parts(F.flatten(F.transform(words, parts)))
