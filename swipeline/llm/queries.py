"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swipeline.llm.best_fit import best_fit_pack
from swipeline.llm.codes import product_codes
from swipeline.llm.common import cut, lower_ascii, scratch
from swipeline.llm.exact_dedup import exact_dedup
from swipeline.llm.hnsw import embedding_dedup
from swipeline.llm.licenses import license_scan
from swipeline.llm.mixing import mix
from swipeline.llm.packing import pack
from swipeline.llm.quality import quality
from swipeline.llm.simhash import simhash_dedup
from swipeline.llm.substring import substring_dedup
from swipeline.llm.token_counts import document_counts, TokenRollup
from swipeline.llm.toxicity import toxicity
from swipeline.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lower_ascii(F.coalesce("text", F.lit("")))
    return exact_dedup(table(spark, sf_dir, "documents"), "doc_id", F.sha2(text, 256).alias("text_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over all documents: all inserted, those labelled toxic deleted, those of low quality revised.

    A revision counts a text again without its runs of symbols, in the same pass over the texts; counts are joined with the labels, so no text is
    shuffled. The last two batches are committed twice and the history is compacted, which changes nothing.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rollup = TokenRollup(spark, scratch(spark, "token-rollup"))
    symbols = "[!*$%&#|]+"
    counted = cut(document_counts(docs, revised=F.when(F.col("text").rlike(symbols), F.regexp_replace("text", symbols, ""))))
    inserts = counted.withColumn("op", F.lit("insert"))
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    deletes = toxic.withColumn("op", F.lit("delete"))
    poor = labels.filter("quality = 0").select("doc_id").distinct().join(toxic, "doc_id", "left_anti")
    revised = counted.join(poor, "doc_id", "left_semi").withColumns({"tokens": F.col("revised"), "op": F.lit("revise")})
    for number, changes in enumerate((inserts, deletes, revised)):
        rollup.commit(number, changes)
    for number, changes in ((2, revised), (1, deletes)):
        rollup.commit(number, changes)
    rollup.compact()
    return rollup.totals()


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes(table(spark, sf_dir, "embeddings"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = best_fit_pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Product codes by plain distances to all entries, a few common table expressions a round."""
    assigned = """near_{r} AS MATERIALIZED (
          SELECT vec_id, p, min(d * {entries} + e) AS best FROM (
            SELECT vec_id, p, e, sum((x - c) * (x - c)) AS d FROM items JOIN book_{r} USING (p, pos) GROUP BY ALL)
          GROUP BY ALL)"""
    moved = """book_{n} AS MATERIALIZED (
          SELECT p, e, pos, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM book_{r} LEFT JOIN (
            SELECT p, best % {entries} AS e, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM near_{r} JOIN items USING (vec_id, p) GROUP BY ALL) USING (p, e, pos))"""
    steps = ",\n        ".join(x.format(r=r, n=r + 1, entries=entries) for r in range(rounds) for x in (assigned, moved))
    return f"""
        WITH items AS MATERIALIZED (
          SELECT vec_id, k // w AS p, k % w AS pos, CAST(floor({scale} * CAST(embedding[k + 1] AS DOUBLE)) AS BIGINT) AS x FROM (
            SELECT vec_id, embedding, len(embedding) // {parts} AS w, unnest(range(len(embedding))) AS k FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
        book_0 AS MATERIALIZED (
          SELECT p, e, pos, x AS c FROM items JOIN (
            SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT DISTINCT vec_id FROM items ORDER BY vec_id LIMIT {entries})) USING (vec_id)),
        {steps},
        {assigned.format(r=rounds, entries=entries)},
        coded AS (
          SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM near_{rounds} GROUP BY 1)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, pos)) FROM book_{rounds}) AS codebooks_sha256
        FROM coded JOIN embeddings USING (vec_id)"""


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_packing, op3_embedding_dedup, op4_mixing, op5_toxicity, op6_substring, op7_quality, op8_exact_dedup, op9_token_counts, op10_simhash, op11_whitening, op12_vector_codes, op13_best_fit)}

ORACLE_SQL = {
    "op12_vector_codes": codes_sql(),
    "op4_mixing": r"""
        WITH sized AS (
          SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                 md5('mix|' || doc_id) AS k
          FROM documents),
        per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        weighed AS (
          SELECT *, ([3, 1, 2])[1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight, 2 * source_size AS cap
          FROM per),
        summed AS (
          SELECT *, coalesce(sum(cap) OVER w, 0) AS caps, coalesce(sum(weight) OVER w, 0) AS weights
          FROM weighed
          WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        level AS (
          SELECT max(((SELECT CAST(1.5 AS DOUBLE) * sum(source_size) FROM summed) - CAST(caps AS DOUBLE))
                     / CAST((SELECT sum(weight) FROM summed) - weights AS DOUBLE)) AS x
          FROM summed),
        goal AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * x) AS target FROM summed, level),
        placed AS (
          SELECT doc_id, s.source, s.size, source_size, target, CAST(round(target) AS BIGINT) AS budget,
                 coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, doc_id, s.size
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
                    + least(size, greatest(0, CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END - before)) AS BIGINT) AS taken
        FROM placed""",
    "op8_exact_dedup": """
        WITH t AS (
          SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
          FROM documents)
        SELECT doc_id, sha256(text) AS text_sha256, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept
        FROM t WINDOW same AS (PARTITION BY text)""",
}
