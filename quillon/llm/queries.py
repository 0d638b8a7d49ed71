"""Queries of the training-data operators, by the numbers of their problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import addresses, boilerplate, bpe, components, entity_match, fusion, mixing, name_links, subjects
from quillon.runtime import read

Query = Callable[[SparkSession, str], DataFrame]


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    left = entity_match.company_records(read(spark, d, "company"))
    return entity_match.match_records(left, entity_match.listed_records(read(spark, d, "ftm_entity")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_matches(spark, d).select("left_id", "right_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return name_links.link_names(name_links.queue_names(read(spark, d, "er_queue_item")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.link_places(read(spark, d, "company"), "id", "registered_address_in_full")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, ids = components.merge_links(read(spark, d, "merge_audit"), read(spark, d, "er_gold_pair"))
    return components.group_ids(pairs, ids, "left", "right")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.boilerplate_lines(read(spark, d, "article_text"))


def _p6_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return fusion.claims(read(spark, d, "er_queue_item"), read(spark, d, "seed_spec")), fusion.members(read(spark, d, "merge_audit"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.survivors(*_p6_rows(spark, d))


def p6_fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(*_p6_rows(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(read(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_target"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_target"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(read(spark, d, "documents"), read(spark, d, "subject_label"), read(spark, d, "subject_area"))


def queries() -> dict[str, Query]:
    fs = (p1_found, p1_matches, p2_found, p3_found, p4_found, p5_found, p6_found, p6_fused, p7_ids, p8_mix, p8_shares, p9_found)
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    from quillon.llm import sql

    return dict(sql.ORACLES)
