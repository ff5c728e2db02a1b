"""Alignment of scripts: two versions are made of the lines by shifting and stretching them by a rule of the episode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelode.functions import score as S
from cinelode.functions import text as T
from cinelode.operators import align as A
from cinelode.plans.base import query
from cinelode.plans.script import ANCHOR, SPEECH, speech
from cinelode.sources.tables import table

# The fixed version: episodes shifted by 1.5 s times (episode mod 5), every third stretched by 25/23.976.
FIXED = "fixed AS (SELECT episode_id, id, text, CAST(round((CASE WHEN episode_id % 3 = 0 THEN st * 25 / 23.976 ELSE st END) + 1500 * (episode_id % 5)) AS BIGINT) AS st FROM speech WHERE id % 4 <> 0)"
PAIRS = f"{SPEECH}, {FIXED}, ka AS (SELECT episode_id, {ANCHOR} AS key, min(st) AS a FROM speech WHERE text IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1), kb AS (SELECT episode_id, {ANCHOR} AS key, min(st) AS b FROM fixed WHERE text IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1), pairs AS (SELECT episode_id, a / 1000 AS t0, (b - a) / 1000 AS o FROM ka JOIN kb USING (episode_id, key) WHERE length(key) >= 14)"


def versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = speech(spark, d)
    moved = lambda c: F.round(F.when(F.col("episode_id") % 3 == 0, c * 25 / 23.976).otherwise(c.cast("double")) + 1500 * (F.col("episode_id") % 5)).cast("long")
    return s, s.filter("id % 4 <> 0").withColumns({"st": moved(F.col("st")), "en": moved(F.col("en"))})


@query(f"{PAIRS} SELECT episode_id, count(*) AS n, round(sum(t0), 3) AS at_sum, round(sum(o), 3) AS o_sum FROM pairs GROUP BY 1")
def j13_r09_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Lines said once on either side, as anchors of both versions."""
    p = A.anchors(*versions(spark, d))
    return p.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("at"), 3).alias("at_sum"), F.round(F.sum("offset"), 3).alias("o_sum"))


FITS = f"{PAIRS}, f AS (SELECT episode_id, count(*) AS n, median(o) AS middle, CASE WHEN count(*) >= 6 THEN coalesce(regr_slope(o, t0), 0) ELSE 0 END AS slope, coalesce(CASE WHEN count(*) >= 6 THEN regr_intercept(o, t0) END, median(o)) AS cr, max(t0) - min(t0) AS span FROM pairs GROUP BY 1), g AS (SELECT episode_id, median(abs(o - middle)) AS scatter, median(abs(o - (slope * t0 + cr))) AS residual FROM pairs JOIN f USING (episode_id) GROUP BY 1)"


@query(f"{FITS} SELECT episode_id, n, round(middle, 4) AS middle, round(slope, 5) AS slope, round(span, 3) AS span, round(scatter, 4) AS scatter, round(residual, 3) AS residual FROM f JOIN g USING (episode_id)")
def a08_a09_fits(spark: SparkSession, d: str) -> DataFrame:
    """Offset as a median and as a line, with what is left over."""
    f = A.fits(A.anchors(*versions(spark, d)))
    return f.select("episode_id", "n", F.round("middle", 4).alias("middle"), F.round("slope", 5).alias("slope"), F.round("span", 3).alias("span"), F.round("scatter", 4).alias("scatter"), F.round("residual", 3).alias("residual"))


@query(f"{FITS}, r AS (SELECT episode_id, 1 / (1 + slope) AS ratio FROM f WHERE n >= 8) SELECT episode_id, round(ratio, 4) AS ratio, CASE WHEN least(abs(ratio - 25 / 23.976), abs(ratio - 23.976 / 25)) <= 0.005 THEN '25/23.976' WHEN least(abs(ratio - 25 / 24), abs(ratio - 24 / 25)) <= 0.005 THEN '25/24' WHEN least(abs(ratio - 24 / 23.976), abs(ratio - 23.976 / 24)) <= 0.005 THEN '24/23.976' END AS pair FROM r")
def m13_rates(spark: SparkSession, d: str) -> DataFrame:
    """Named rate pairs of the fitted slopes."""
    f = A.fits(A.anchors(*versions(spark, d))).filter("n >= 8").withColumn("ratio", 1 / (1 + F.col("slope")))
    return f.select("episode_id", F.round("ratio", 4).alias("ratio"), S.rate_name(F.col("ratio")).alias("pair"))


@query(f"{SPEECH} SELECT episode_id, count(DISTINCT frame) AS frames FROM (SELECT episode_id, unnest(generate_series(st // 50, en // 50 - 1)) AS frame FROM speech WHERE en // 50 > st // 50) GROUP BY 1")
def x02_activity(spark: SparkSession, d: str) -> DataFrame:
    """Frames that a line covers, by episode."""
    return A.covered(speech(spark, d))


@query()
def x04_correlated(spark: SparkSession, d: str) -> DataFrame:
    """Shift of the best correlation of both versions' activity."""
    return A.correlated(*versions(spark, d)).select("episode_id", "shift_ms", F.round("peak", 6).alias("peak"), F.round("margin", 6).alias("margin"))


@query()
def x05_decided(spark: SparkSession, d: str) -> DataFrame:
    """The decision for each episode: by text, as a rate, by activity, or none."""
    a, b = versions(spark, d)
    return A.decided(A.fits(A.anchors(a, b)), A.correlated(a, b)).withColumn("offset", F.round("offset", 4))


# The shift of subtitles: written as SRT and ASS stamps and read back.
@query(f"{SPEECH} SELECT id, lpad(CAST((st + 3720) // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST((st + 3720) // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((st + 3720) // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST((st + 3720) % 1000 AS VARCHAR), 3, '0') AS srt, CAST((st + 3720) // 3600000 AS VARCHAR) || ':' || lpad(CAST((st + 3720) // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((st + 3720) // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST((st + 3720) // 10 % 100 AS VARCHAR), 2, '0') AS ass, st + 3720 AS back FROM speech")
def f19_s23_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Stamps of lines moved by 3.72 s, in both formats, and read back."""
    t = F.col("st") + 3720
    s = speech(spark, d).select("id", T.clock(t, ",").alias("srt"), T.clock(t, ".", 2).alias("ass"))
    return s.withColumn("back", T.clock_ms(F.col("srt")))


SHARED = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query(f"WITH l AS (SELECT doc_id, show_id, list_distinct({SHARED}) AS w FROM documents WHERE text IS NOT NULL AND show_id IS NOT NULL), s AS (SELECT DISTINCT show_id, list_distinct(regexp_extract_all(lower(\"show\"), '[a-z0-9]+')) AS w FROM season) SELECT l.doc_id, CAST(len(list_intersect(l.w, s.w)) AS INTEGER) AS shared, round(len(list_intersect(l.w, s.w)) / len(s.w), 6) AS coverage FROM l JOIN s USING (show_id) WHERE len(s.w) > 0")
def r07_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Words of a document shared with its show's title, and how much of the title they cover."""
    s = table(spark, d, "season", "show_id", "show").dropDuplicates().select("show_id", S.word_set(F.col("show")).alias("want")).filter("size(want) > 0")
    l = table(spark, d, "documents", "doc_id", "show_id", "text").filter("text is not null and show_id is not null").select("doc_id", "show_id", S.word_set(F.col("text")).alias("have"))  # noqa: E741
    shared = F.size(F.array_intersect("have", "want"))
    return l.join(s, "show_id").select("doc_id", shared.alias("shared"), F.round(shared / F.size("want"), 6).alias("coverage"))
