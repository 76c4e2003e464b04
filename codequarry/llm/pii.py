"""Personal data: base patterns, and terms that reveal them (information-theoretic sanitisation).

Base spans come from four patterns. Each base value is a protected entity e; its windows are the REACH tokens on each
side of its occurrences. Over all texts, n(t) counts a term's occurrences, n(e) the token positions in e's windows,
n(t, e) t's occurrences there, each once, and N all tokens. t discloses e if PMI(t; e) >= SHARE * IC(e), that is, if
n(t, e) / n(t) >= (n(e) / N) ** (1 - SHARE) = b. Small counts are corrected: it must be surer than SURE that the share is
above b, that is, of n(t) draws with chance b, n(t, e) hits must be rarer than 1 - SURE by Chernoff's bound (which is
exact, b ** n(t), where t never stands elsewhere). No count is a condition of its own: the rarer e is, the fewer do.
All occurrences of t in the texts that hold e, in e's windows or not, become spans of kind `term`, but for those inside
base spans. Numbers are generalised, words removed.

Defined results: null and empty texts have no spans; a null id stays null; repeated rows have equal spans; an empty table
gives an empty table; columns other than the id and the text are not read. All scans take time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, rebatch, texts, tidy

#: Kinds in their order, and the patterns' parts.
KINDS = ("email", "ip", "card", "phone", "term")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_OTHER = re.compile(r"[^0-9]+")
_TERM = re.compile(r"\w+")

REACH = 8
SHARE = 0.9
SURE = 0.8
#: Terms a task counts before it passes its counts on.
HELD = 250_000


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ has one candidate: the run of local characters before it, and the domain after it."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = free = m.end()
            yield start, end
        else:
            free = end
        at = text.find("@", end)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """In a chain of numbers joined by dots, each four in turn are a match; no number may exceed 255."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _OTHER.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(a, 1, b) for a, b in ips(text)] + [(a, 2, b) for a, b in cards(text)] + ([(a, 3, b) for a, b in phones(text)] if "+" in text else [])
    return sorted(found)


def free(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the tokens that aren't inside spans, in order."""
    covered, words = 0, []
    edges = iter([*spans, (len(text) + 1, 0, len(text) + 1)])
    a, _, b = next(edges)
    for m in _TERM.finditer(text):
        while m.start() >= b:
            covered = max(covered, b)
            a, _, b = next(edges)
        if m.end() <= a and m.start() >= covered:
            words.append((m.start(), m.end(), m[0].lower()))
    return words


def contexts(text: str, spans: list[tuple[int, int, int]], words: list[tuple[int, int, str]], reach: int = REACH) -> Iterator[tuple[str, int, int, bytes]]:
    """(term, start, end, entity) of the free tokens around each span; each once for an entity."""
    k, seen = 0, set()
    for start, kind, end in spans:
        while k < len(words) and words[k][0] < start:
            k += 1
        near = [w for w in words[max(0, k - reach) : k + 2 * reach] if w[0] >= end or w[1] <= start]
        near = [w for w in near if w[1] <= start][-reach:] + [w for w in near if w[0] >= end][:reach]
        value = text[start:end].lower() if kind < 2 else _OTHER.sub("", text[start:end])
        entity = hashlib.blake2b(f"{KINDS[kind]}:{value}".encode("utf-8", "replace"), digest_size=12).digest()
        for w in near:
            if (entity, w[0]) not in seen:
                seen.add((entity, w[0]))
                yield w[2], w[0], w[1], entity


_SPANS = "array<struct<start: int, kind: int, end: int>>"
_NEAR = "array<struct<term: string, start: int, end: int, entity: binary>>"
_WORDS = "array<struct<start: int, end: int, term: string>>"


def _scan(df: DataFrame, id_col: str, text_col: str, reach: int) -> DataFrame:
    """One pass over the texts: a row per document (n null; words where there are spans), and rows of a term and its count in a part of the table."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    near = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("entity", pa.binary())]))
    word = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string())]))
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("spans", span), ("near", near), ("words", word), ("term", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            counts: Counter = Counter()
            for b in batches:
                for key, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                    found = base_spans(text)
                    counts.update(_TERM.findall(text))
                    if len(counts) > HELD:
                        yield from flush(counts)
                    words = free(text, found) if found else []
                    close = [dict(zip(("term", "start", "end", "entity"), w)) for w in contexts(text, found, words, reach)]
                    words = [dict(zip(("start", "end", "term"), w)) for w in words]
                    yield key, hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=12).digest(), [{"start": a, "kind": k, "end": e} for a, k, e in found], close, words, None, None
            yield from flush(counts)

        def flush(counts):
            lower: Counter = Counter()
            for w, n in counts.items():
                lower[w.lower()] += n
            counts.clear()
            for w, n in lower.items():
                yield None, None, None, None, None, w, n

        yield from rebatch(rows(), schema, lambda r: 32 + 100 * len(r[3] or ()) + 40 * len(r[4] or ()))

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(tidy(run), f"id long, key binary, spans {_SPANS}, near {_NEAR}, words {_WORDS}, term string, n long")


def _surprise(hits: Column, draws: Column, chance: Column) -> Column:
    """Of the chance of so many hits or more, minus the logarithm of Chernoff's bound."""
    missed = draws - hits
    return hits * F.log(hits / (draws * chance)) + F.when(missed > 0, missed * F.log(F.try_divide(missed, draws * (1 - chance)))).otherwise(0.0)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, share: float = SHARE, sure: float = SURE) -> DataFrame:
    """Per row: the id, `key` (a digest of the text) and `spans`: (start, kind as a number of KINDS, end), in order."""
    scanned = materialise(_scan(df, id_col, text_col, reach), "pii")
    documents = scanned.filter(F.col("n").isNull()).select("id", "key", "spans", "near", "words")
    counts = scanned.filter(F.col("n").isNotNull()).groupBy("term").agg(F.sum("n").alias("n_t"))
    total = scanned.agg(F.sum("n")).first()[0] or 1
    near = documents.filter(F.size("near") > 0).select("id", "key", F.explode("near").alias("w")).select("id", "key", "w.*")
    together = near.groupBy("term", "entity").agg(F.count("*").alias("n_te"))
    entities = near.groupBy("entity").agg(F.count("*").alias("n_e"))
    telling = (
        together.join(entities, "entity")
        .join(counts, "term")
        .withColumn("b", F.pow(F.col("n_e") / F.lit(float(total)), F.lit(1 - share)))
        .filter(F.col("n_te") >= F.col("n_t") * F.col("b"))
        .filter(_surprise(F.col("n_te"), F.col("n_t"), F.col("b")) > -math.log(1 - sure))
        .select("term", "entity")
    )
    # By the term alone, then by whether the document holds the entity: telling terms are rare, so few rows pass the first join.
    words = documents.filter(F.size("words") > 0).select("id", "key", F.explode("words").alias("w")).select("id", "key", "w.*").join(telling, "term")
    holds = near.select(F.col("id").alias("h_id"), F.col("key").alias("h_key"), F.col("entity").alias("h_entity")).distinct()
    held = words.join(holds, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key")) & (F.col("entity") == F.col("h_entity")), "left_semi")
    term = F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end")
    added = held.groupBy("id", "key").agg(F.collect_set(term).alias("terms"))
    base = documents.select("id", "key", "spans")
    joined = base.join(added, base["id"].eqNullSafe(added["id"]) & (base["key"] == added["key"]), "left").select(
        base["id"].alias(id_col), base["key"], F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", F.col("terms").cast(_SPANS)))).alias("spans")
    )
    return joined


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The same rows and columns with base values replaced by their kind, terms removed, and telling numbers generalised."""
    spans = find(df, id_col, text_col, **options).filter(F.size("spans") > 0).dropDuplicates([id_col, "key"])
    keyed = df.withColumn("__row", F.struct(*[df[c] for c in df.columns])).select("__row", df[id_col].alias("__id"), F.col(text_col).alias("__text"))
    found = spans.select(F.col(id_col).alias("__sid"), F.hex("key").alias("__key"), F.col("spans").alias("__spans"))

    @F.pandas_udf("string")
    def digest(t):
        return t.map(lambda x: hashlib.blake2b((x or "").encode("utf-8", "replace"), digest_size=12).hexdigest().upper())

    @F.pandas_udf("string")
    def clean(t, s):
        import pandas as pd

        return pd.Series([x if y is None or not len(y) else replaced(x, y) for x, y in zip(t, s)], dtype=object)

    keyed = keyed.withColumn("__digest", digest("__text"))
    joined = keyed.join(found, keyed["__id"].eqNullSafe(found["__sid"]) & (keyed["__digest"] == found["__key"]), "left")
    new = F.when(F.col("__spans").isNull(), F.col("__text")).otherwise(clean("__text", "__spans"))
    return joined.select(*[(new if c == text_col else F.col("__row")[c]).alias(c) for c in df.columns])


def replaced(text: str, spans) -> str:
    """The text with its spans replaced; of overlapping spans the first stands for all."""
    out, at = [], 0
    for s in spans:
        start, kind, end = s["start"], s["kind"], s["end"]
        if start < at:
            if end > at:
                at = end
            continue
        out.append(text[at:start])
        if KINDS[kind] != "term":
            out.append(f"[{KINDS[kind].upper()}]")
        elif text[start:end].isdigit():
            out.append("[NUMBER]")
        at = end
    out.append(text[at:])
    return "".join(out)
