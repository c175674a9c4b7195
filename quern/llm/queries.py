"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.defects import find_defects
from quern.llm.leakage import find_leaks
from quern.llm.mixture import count_tokens, draw_mixture, plan_shares, reached_shares
from quern.llm.nearduplicates import similar_groups, similar_pairs, similar_texts
from quern.llm.neighbours import nearest_neighbours, neighbour_pairs, usable_vectors
from quern.llm.personal import find_personal, span_rows
from quern.llm.pieces import piece_boundaries, split_oversized
from quern.llm.sentences import sentences_of_records
from quern.llm.variants import link_variants, variant_pairs
from quern.runtime import durable, read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences_of_records(read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "facts"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_defects(read_table(spark, sf_dir, "question_results")).select("q_id", "run_index", "defect")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_boundaries(split_oversized(read_table(spark, sf_dir, "chunks")))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(read_table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similar_pairs(*similar_texts(read_table(spark, sf_dir, "chunks")))
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(*similar_texts(read_table(spark, sf_dir, "chunks")))


_VECTORS = (("chunk", "vec_chunks", "chunk_id"), ("entity", "vec_entities", "entity_id"))


def _neighbours(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    return [(kind, nearest_neighbours(usable_vectors(read_table(spark, sf_dir, table), key))) for kind, table, key in _VECTORS]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [neighbour_pairs(found).select(F.lit(kind).alias("kind"), "id_a", "id_b") for kind, found in _neighbours(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        found.select(F.lit(kind).alias("kind"), "id", "rank", "neighbour", F.round(F.col("similarity").cast("double"), 5).alias("similarity"))
        for kind, found in _neighbours(spark, sf_dir)
    ]
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(link_variants(read_table(spark, sf_dir, "entities"), read_table(spark, sf_dir, "aliases")))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_variants(read_table(spark, sf_dir, "entities"), read_table(spark, sf_dir, "aliases"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))
    return leaks.filter("exact").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = read_table(spark, sf_dir, "mix_targets")
    sizes = durable(_sizes(spark, sf_dir))
    shares = reached_shares(draw_mixture(sizes, targets), plan_shares(sizes, targets))
    return shares.filter("not reachable").select("source")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = read_table(spark, sf_dir, "mix_targets")
    sizes = durable(_sizes(spark, sf_dir))
    return reached_shares(draw_mixture(sizes, targets), plan_shares(sizes, targets))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw_mixture(_sizes(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_rows(find_personal(read_table(spark, sf_dir, "documents"), with_text=False))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(read_table(spark, sf_dir, "documents")).select("doc_id", F.size("spans").alias("n_spans"), "redacted")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_pieces, p4_found, p4_groups, p5_found, p5_neighbours, p6_found, p6_groups, p7_found, p7_leaks, p8_found, p8_shares, p8_mixture, p9_found, p9_redacted)}


def oracle_sql() -> dict[str, str]:
    return {}
