"""Queries of the text-corpus operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested
from . import address, encode, names, pack, pii, spans, split

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_oversized(_t(spark, sf, "chunks")).drop("blocks")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return split.account_blocks(_t(spark, sf, "chunks"))


def _employers(spark: SparkSession, sf: str) -> DataFrame:
    """Name and address of the employers inside W2 records."""
    w2 = _t(spark, sf, "extractions").filter("document_type = 'W2'").select("data")
    return nested.party_blocks(w2, "employer").select("name", "address").distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return address.same_location(_t(spark, sf, "parties"), _employers(spark, sf))


def p2_places(spark: SparkSession, sf: str) -> DataFrame:
    """The place of every party and of every W2 employer's address."""
    parties = _t(spark, sf, "parties").select(F.lit("party").alias("source"), F.col("party_id").alias("id"), "address")
    both = parties.unionByName(_employers(spark, sf).select(F.lit("employer").alias("source"), F.lit(None).cast("long").alias("id"), "address").distinct())
    return both.join(address.locations(both).hint("merge"), "address").select("source", "id", "address", "location_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.same_party(_t(spark, sf, "parties"), _employers(spark, sf))


def p4_parties(spark: SparkSession, sf: str) -> DataFrame:
    return names.entities(_t(spark, sf, "parties"), _employers(spark, sf)).withColumnsRenamed({"id": "party_id", "location_id": "entity_id"})


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(_t(spark, sf, "files"))


def p5_masked(spark: SparkSession, sf: str) -> DataFrame:
    return pii.mask_pages(_t(spark, sf, "files"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode_corpus(_t(spark, sf, "documents"))


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    return pack.pack(_t(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_spans(_t(spark, sf, "documents"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_shares(_t(spark, sf, "documents"))


def p8_deduped(spark: SparkSession, sf: str) -> DataFrame:
    return spans.without_repeats(_t(spark, sf, "documents"))


def queries() -> dict[str, Query]:
    return {"p1_pieces": p1_pieces, "p1_found": p1_found, "p2_found": p2_found, "p2_places": p2_places, "p4_found": p4_found, "p4_parties": p4_parties, "p5_found": p5_found, "p5_masked": p5_masked, "p6_ids": p6_ids, "p7_packed": p7_packed, "p8_found": p8_found, "p8_shares": p8_shares, "p8_deduped": p8_deduped}


def oracle_sql() -> dict[str, str]:
    return {"p8_found": spans.FOUND_SQL, "p8_shares": spans.SHARES_SQL, "p8_deduped": spans.DEDUPED_SQL}
