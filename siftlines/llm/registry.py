"""The queries of this subpackage over the given tables, and those that SQL can express."""

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from siftlines.llm import (common, dedup, hardneg, langid, lexical, lm, mixing, neighbours, packing, quality, sharding, simhash,
                           tokenfile, vectordups)

#: A vocabulary file that lies on every executor.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predictions(documents(spark, folder))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.exact_groups(documents(spark, folder))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scores(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, folder))


def op5_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scores(documents(spark, folder))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(documents(spark, folder)).select("doc_id", "fingerprint", "component_id")


def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0)


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder)).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "first_position", "last_position")


def op10_token_file(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{common.folder(spark)}/{uuid.uuid4().hex}"
    tokenfile.write(documents(spark, folder), path, TOKENIZER)
    return tokenfile.read(spark, path)


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hardneg.mine(vectors, F.col("vec_id") % 100 == 0, label)


def op12_vector_dups(spark: SparkSession, folder: str) -> DataFrame:
    return vectordups.near_groups(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (op1_language_id, op2_exact_dedup, op3_quality, op4_sharding, op5_lm_scores, op6_packing, op7_simhash, op8_neighbours,
                op9_mixing, op10_token_file, op11_hard_negatives, op12_vector_dups, op13_lexical_search)
    return {f.__name__: f for f in numbered} | {"pipeline": corpus_pipeline.run}


ORACLE = {
    "op2_exact_dedup": r"""
        WITH texts AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
        FROM texts WINDOW same AS (PARTITION BY text_sha256)""",
    "op9_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
            FROM documents),
        sources AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS position
            FROM sized GROUP BY source),
        weighed AS (
            SELECT *, position % 3 + 1 AS weight, [0.5::DOUBLE, 0.0, -0.5][(position % 3 + 1)::INT] AS slope
            FROM sources),
        filled AS (
            SELECT *, coalesce(sum(3 * source_size) OVER before, 0)::BIGINT AS spent,
                   coalesce(sum(weight) OVER before, 0)::BIGINT AS gone,
                   sum(source_size) OVER ()::BIGINT AS words, sum(weight) OVER ()::BIGINT AS weights
            FROM weighed
            WINDOW before AS (ORDER BY source_size::DOUBLE / weight, position
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        levels AS (
            SELECT (words - spent)::DOUBLE / (weights - gone) AS level, source_size::DOUBLE / weight AS ratio, position
            FROM filled),
        chosen AS (
            SELECT level FROM levels WHERE level <= 3 * ratio ORDER BY ratio, position LIMIT 1),
        aims AS (
            SELECT source, source_size, slope, least(level * weight, 3.0::DOUBLE * source_size) AS target
            FROM weighed, chosen),
        stream AS (
            SELECT doc_id, size, source_size, target, slope, round(target)::BIGINT AS whole,
                   coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY md5(doc_id::VARCHAR)
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin
            FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source),
        parts AS (
            SELECT *, greatest(0, least(size, whole - begin)) AS a,
                   greatest(0, least(size, whole - begin - source_size)) AS b,
                   greatest(0, least(size, whole - begin - 2 * source_size)) AS c
            FROM stream),
        counted AS (
            SELECT *, (a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS copies FROM parts),
        shares AS (
            SELECT *, least(1.0, begin / greatest(target, 1.0)) AS early,
                   least(1.0, (begin + (copies - 1) * source_size) / greatest(target, 1.0)) AS late
            FROM counted)
        SELECT doc_id, size::BIGINT AS size, source_size, target, (a + b + c)::BIGINT AS taken, copies,
               CASE WHEN copies > 0 THEN 2 * early / (1 + slope + sqrt(greatest(0.0,
                   (1 + slope) * (1 + slope) - 4 * slope * early))) END AS first_position,
               CASE WHEN copies > 0 THEN 2 * late / (1 + slope + sqrt(greatest(0.0,
                   (1 + slope) * (1 + slope) - 4 * slope * late))) END AS last_position
        FROM shares""",
    "op11_hard_negatives": r"""
        WITH usable AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.x, b.x)::BIGINT AS score
            FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER best)::INT AS rank, vec_id AS negative_id, positive_score,
               score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER best <= 5""",
    "op12_vector_dups": r"""
        WITH RECURSIVE usable AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.93),
        reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
        least AS (SELECT a, min(b) AS b FROM reached GROUP BY a),
        counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
               vec_id = least(vec_id, coalesce(least.b, vec_id)) AS kept
        FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN counted ON vec_id = counted.a""",
    "op13_lexical_search": r"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents),
        postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
        lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id),
        totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        weights AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM postings, totals GROUP BY term, n_docs),
        scores AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), totals
            GROUP BY item_id, doc_id)
        SELECT item_id, (row_number() OVER best)::INT AS rank, doc_id, score FROM scores WHERE score > 0
        WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
        QUALIFY row_number() OVER best <= 50""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLE
