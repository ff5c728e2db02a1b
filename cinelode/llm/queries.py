"""The pN queries of the llm operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelode.llm import bpe, canonical, mixing, stuffing, survivors, topn, turns
from cinelode.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.match(table(spark, d, "files", "id", "name"), table(spark, d, "season", "show_id", "show", "aliases")).select("id", "show_id")


def p2_within_reach(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct typed title with all shows within its distance."""
    return canonical.within_reach(table(spark, d, "files", "id", "name"), table(spark, d, "season", "show_id", "show", "aliases"))


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Typed titles that no listed show is near to, with the number of files that hold them."""
    return p2_within_reach(spark, d).filter("show_id is null").select("title", "files")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    timing = table(spark, d, "timing", "id", "rendered_at", "speaker", "overflow", "compression")
    rows = topn.latest(timing, "id", "rendered_at", ["overflow", "compression", "speaker"])
    rows = rows.select("id", "speaker", topn.number("overflow").alias("overflow"), topn.number("compression").alias("compression"))
    rows = rows.filter(F.col("overflow").isNotNull() & F.col("speaker").isNotNull() & (F.trim("speaker") != ""))
    ranking = [F.col("overflow").desc(), F.col("compression").desc_nulls_last(), F.col("id").asc()]
    return topn.top_n(rows, "speaker", ranking, 5, ["id", "overflow", "compression"]).select("speaker", "place", "id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.same_files(table(spark, d, "files"), fields=False).select("first_id", "keep_id")


def p4_merged(spark: SparkSession, d: str) -> DataFrame:
    """The record built field by field for each group, values of more trusted containers first."""
    return survivors.same_files(table(spark, d, "files"), by_source=True).select("first_id", "keep_id", "item_id", "best_name", "best_short_name", "best_size")


SCRIPT = ("id", "episode_id", "show_id", "start", "end", "window", "speaker", "text", "kind", "is_group")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.turns(table(spark, d, "utterances", *SCRIPT), table(spark, d, "bank", "show_id", "speaker", "actor"))


def p5_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns with their cleaned text."""
    return turns.turns(table(spark, d, "utterances", *SCRIPT), table(spark, d, "bank", "show_id", "speaker", "actor"), with_text=True)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents", "doc_id", "text"), "doc_id")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix itself: every output slot with its block and the pieces of documents in it."""
    return mixing.mix(table(spark, d, "documents", "doc_id", "text", "source"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached by source, also where the target can't be met."""
    return mixing.report(table(spark, d, "documents", "doc_id", "text", "source"), table(spark, d, "mix_targets"))


def p7_shares_long(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached if the mix is to have a million blocks, more than the small sources can fill: some targets can't be met."""
    return mixing.report(table(spark, d, "documents", "doc_id", "text", "source"), table(spark, d, "mix_targets"), total_blocks=1_000_000)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.flagged(table(spark, d, "documents", "doc_id", "text"))


def p8_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Over all pages: the shapes, with the number of pages and pieces that have them."""
    pages = stuffing.shapes(table(spark, d, "documents", "doc_id", "text")).select(F.explode("shapes").alias("s"))
    return pages.groupBy("s.kind", "s.shape").agg(F.count(F.lit(1)).alias("pages"), F.sum("s.pieces").alias("pieces"), F.sum("s.chars").alias("chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_within_reach, p2_unmatched, p3_found, p4_found, p4_merged, p5_found, p5_turns, p6_ids, p7_mix, p7_shares, p7_shares_long, p8_found, p8_shapes)}


P3 = """
WITH l AS (
  SELECT id, speaker, overflow, compression,
         row_number() OVER (PARTITION BY id ORDER BY rendered_at DESC NULLS LAST, overflow DESC NULLS LAST, compression DESC NULLS LAST, speaker DESC NULLS LAST) AS r
  FROM timing),
k AS (
  SELECT id, speaker, overflow, CASE WHEN isnan(compression) THEN NULL ELSE compression END AS compression
  FROM l WHERE r = 1 AND overflow IS NOT NULL AND NOT isnan(overflow) AND speaker IS NOT NULL AND trim(speaker) <> ''),
p AS (SELECT speaker, id, row_number() OVER (PARTITION BY speaker ORDER BY overflow DESC, compression DESC NULLS LAST, id) AS place FROM k)
SELECT speaker, CAST(place AS INTEGER) AS place, id FROM p WHERE place <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3}
