"""The queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audio, bpe, html_extract, ngram_join, packing, pii, quality, suffix_dedup, token_counts
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.fit(documents))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < pii.KINDS.index("term"))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts[:-1], F.sha2(pii.joined_spans(base), 256).alias("base_sha256"), pii.joined_spans(F.col("spans")).alias("spans"), counts[-1])


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).drop("md5")


def op6_audio_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio.audio_columns(table(spark, sf_dir, "documents").withColumn("payload", F.col("text").cast("binary")))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.col("n_frames").cast("string"), F.sha2("log_mel", 256), F.to_json("segments")).alias("feature"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)
    return packing.number(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed, books = ann.index(table(spark, sf_dir, "embeddings"))
    asked = indexed.filter(F.col("id") % 20 == 0).select("id", "vector")
    return ann.search(indexed, books, asked, k=20).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES: dict[str, Query] = {
    "op1_html_extract": op1_html_extract,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_ngram_join": op5_ngram_join,
    "op6_audio_columns": op6_audio_columns,
    "op7_token_counts": op7_token_counts,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_packing": op9_packing,
    "op10_nearest": op10_nearest,
}

#: DuckDB's form of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op5_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM documents),
 g AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS MATERIALIZED (SELECT p.x, p.y FROM p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 5 * p.m >= 4 * (a.n + b.n - p.m)),
 r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
 SELECT d.doc_id, least(d.doc_id, coalesce(c.least_y, d.doc_id)) AS class_id, coalesce(k.n, 0) AS n_links FROM documents d
 LEFT JOIN (SELECT x, min(y) AS least_y FROM r GROUP BY x) c ON c.x = d.doc_id LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) k ON k.x = d.doc_id""",
    "op8_suffix_dedup": r"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
 w AS (SELECT doc_id, i, md5(b[i : i + 99]) AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM d)),
 f AS (SELECT s, min(doc_id * 1000000000 + i) AS first FROM w GROUP BY s HAVING count(*) > 1),
 r AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id * 1000000000 + i <> first),
 g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM r),
 h AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM g),
 u AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS z FROM h GROUP BY doc_id, k),
 p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM u),
 q AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(hex(b[before + 1 : a - 1]), '' ORDER BY a) AS head FROM p JOIN d USING (doc_id) GROUP BY doc_id)
 SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
 CASE WHEN head IS NULL THEN sha256(b) ELSE sha256(unhex(head || hex(b[last + 1 :]))) END AS kept_sha256 FROM d LEFT JOIN q USING (doc_id)""",
}
