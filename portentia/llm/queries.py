"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portentia.llm.common import keyed_text, read
from portentia.runtime import run_dir, stage


def op3_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portentia.llm.decontaminate import leaks

    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portentia.llm.quality_rules import quality

    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"
    )


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from portentia.llm.byte_bpe import round_trip

    docs = keyed_text(read(spark, sf_dir, "documents"))
    coded = round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portentia.llm.repeats import remove_repeats

    cut = remove_repeats(keyed_text(read(spark, sf_dir, "documents")))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return cut.select(
        "doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from portentia.llm import token_files as T

    path = run_dir(spark, "tokens")
    T.write_tokens(keyed_text(read(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"), path)
    segments = T.read_segments(spark, path)
    docs = T.documents(segments).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return T.with_starts(docs, segments).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portentia.llm import sanitise as S

    spans = S.find_spans(keyed_text(read(spark, sf_dir, "documents")))
    base = F.array_join(F.concat(*[S.joined(k) for k in S.KINDS]), ",")
    every = F.array_join(F.concat(*[S.joined(k) for k in (*S.KINDS, "term")]), ",")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in S.KINDS]
    return spans.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portentia.llm.pitman_yor import language_model

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    scores, model = language_model(keyed_text(read(spark, sf_dir, "documents")), held_out)
    return scores.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portentia.llm.near_duplicates import near_duplicates

    return near_duplicates(keyed_text(read(spark, sf_dir, "documents")), size=4)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portentia.llm.line_dedup import removed_lines

    return removed_lines(keyed_text(read(spark, sf_dir, "documents")))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portentia.llm.html_text import extract

    pages = extract(read(spark, sf_dir, "pages"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portentia.llm.spelling import variants, word_counts

    docs = keyed_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return variants(stage(word_counts(docs), "words"))


def op12_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portentia.llm.vector_file import top_k

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portentia.llm.hard_negatives import hard_negatives

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


QUERIES = {
    "op1_remove_repeats": op1_remove_repeats,
    "op2_token_files": op2_token_files,
    "op5_sanitise": op5_sanitise,
    "op6_pitman_yor": op6_pitman_yor,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_line_dedup": op8_line_dedup,
    "op9_main_text": op9_main_text,
    "op3_leaks": op3_leaks,
    "op4_quality_rules": op4_quality_rules,
    "op10_byte_level_bpe": op10_byte_level_bpe,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_top_k_search": op12_top_k_search,
    "op13_hard_negatives": op13_hard_negatives,
}

#: Usable vectors as integer codes (doubles, exact for products of this size).
_CODES = """codes AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""
ORACLE: dict[str, str] = {
    "op12_top_k_search": f"""
WITH {_CODES}, pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM codes q JOIN codes c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
""",
    "op13_hard_negatives": f"""
WITH {_CODES}, named AS (
    SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM codes WHERE label IS NOT NULL
), pairs AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_inner_product(a.v, c.v)::BIGINT AS score
    FROM named a JOIN named c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
    n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN pairs n USING (anchor_id)
WHERE NOT n.alike AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
QUALIFY rank <= 5
""",
}
