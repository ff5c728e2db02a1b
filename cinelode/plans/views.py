"""Cleaned tables that the queries of the three flows start from, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelode.functions import patterns as P
from cinelode.functions import text as T
from cinelode.operators.intervals import usable_time
from cinelode.operators.rank import latest_by
from cinelode.plans.base import quoted
from cinelode.sources.tables import table


def real(c: Column) -> Column:
    """NaN as NULL."""
    return F.when(F.isnan(c), None).otherwise(c)


def lines(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Lines of scripts with usable times (ms), repeats removed; labels that say nothing are NULL."""
    u = table(spark, d, "utterances", "id", "episode_id", "show_id", "start", "end", "window", "speaker", "text", "style", "kind", "is_group", "role", *more).dropDuplicates()
    said = F.upper(T.strip(F.col("speaker")))
    return usable_time(u).select("id", "episode_id", "show_id", F.col("s_ms").alias("st"), F.col("e_ms").alias("en"), F.when(~said.isin("", "-"), said).alias("speaker"), "text", "style", "kind", "is_group", "role", *more)


LINES = """
lines AS (
  SELECT id, episode_id, show_id, least(a, b) AS st, greatest(a, b) AS en,
         CASE WHEN said NOT IN ('', '-') THEN said END AS speaker, text, style, kind, is_group, role
  FROM (
    SELECT *, upper(regexp_replace(speaker, '^\\s+|\\s+$', '', 'g')) AS said,
           CAST(round(coalesce(s, e - w) * 1000) AS BIGINT) AS a, CAST(round(coalesce(e, s + w) * 1000) AS BIGINT) AS b
    FROM (SELECT DISTINCT id, episode_id, show_id, speaker, text, style, kind, is_group, role,
                 CASE WHEN isnan("start") THEN NULL ELSE "start" END AS s, CASE WHEN isnan("end") THEN NULL ELSE "end" END AS e,
                 CASE WHEN isnan("window") THEN NULL ELSE "window" END AS w FROM utterances))
  WHERE a IS NOT NULL AND b IS NOT NULL)"""

MEASURES = ("start_seconds", "held", "generated", "available", "compression", "gain", "late", "pan", "overflow")


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Render reports: the latest row of each line, NaN as NULL."""
    t = table(spark, d, "timing").withColumns({c: real(F.col(c)) for c in MEASURES})
    return latest_by(t, ["id"], "rendered_at", ["speaker", "role", *MEASURES, "mix"])


REPORTS = f"""
reports AS (
  SELECT * EXCLUDE (r) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY rendered_at DESC NULLS LAST, speaker DESC NULLS LAST) AS r
    FROM (SELECT DISTINCT id, speaker, role, mix, rendered_at, {", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in MEASURES)} FROM timing)) WHERE r = 1)"""


def listed(spark: SparkSession, d: str) -> DataFrame:
    """Files of ready downloads: kind, item (name), item_id, id, name, short_name, size; names missing are left out."""
    f = table(spark, d, "files", "id", "item_id", "name", "short_name", "size", "listed_at").dropDuplicates()
    i = table(spark, d, "downloads", "id", "kind", "name", "download_state", "download_present").dropDuplicates()
    ready = F.lower("download_state").isin(*P.READY_STATES) | F.col("download_present")
    i = i.filter(F.coalesce(ready, F.lit(False))).select(F.col("id").alias("item_id"), "kind", F.coalesce("name", F.concat_ws("-", "kind", F.col("id").cast("string"))).alias("item"))
    return f.filter(F.trim("name") != "").join(i, "item_id")


LISTED = """
listed AS (
  SELECT f.item_id, f.id, f.name, f.short_name, f.size, f.listed_at, i.kind, coalesce(i.name, concat_ws('-', i.kind, CAST(i.id AS VARCHAR))) AS item
  FROM (SELECT DISTINCT * FROM files) f JOIN (SELECT DISTINCT * FROM downloads) i ON i.id = f.item_id
  WHERE (lower(i.download_state) IN ('cached', 'completed', 'downloaded', 'seeding', 'uploading') OR i.download_present) AND trim(f.name) <> '')"""


def releases(spark: SparkSession, d: str) -> DataFrame:
    """Files as search results: title, size, seeders and category flags made from the id."""
    f = table(spark, d, "files", "id", "name", "size").dropDuplicates().filter(F.trim("name") != "")
    return f.select("id", T.stem(F.col("name")).alias("title"), F.col("size").alias("size"), F.pmod(F.col("id") * 37, F.lit(900)).alias("seeders"), (F.pmod("id", F.lit(11)) == 0).alias("lossless_cat"), (F.pmod("id", F.lit(13)) == 0).alias("lossy_cat"))


RELEASES = """
releases AS (
  SELECT id, regexp_replace(regexp_replace(name, '^.*/', ''), '(.)\\.[^.]*$', '\\1') AS title, size, id * 37 % 900 AS seeders, id % 11 = 0 AS lossless_cat, id % 13 = 0 AS lossy_cat
  FROM (SELECT DISTINCT id, name, size FROM files) WHERE trim(name) <> '')"""


def sub(expr: str, pattern: str, to: str = "") -> str:
    """DuckDB: all matches replaced."""
    return f"regexp_replace({expr}, {quoted(pattern)}, '{to}', 'g')"


def has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {quoted(pattern)})"


def got(expr: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({expr}, {quoted(pattern)}, {group}), '')"


#: RE2 knows only ASCII word boundaries; a boundary of letters of any script is spelt out.
NO_WORD = r"[^\p{L}\p{N}_]"


def cut(expr: str, pattern: str) -> str:
    """DuckDB: what stands before the first match."""
    flags, body = ("(?is)", pattern[4:]) if pattern.startswith("(?i)") else ("(?s)", pattern)
    if body.startswith(r"\b") and body.endswith(r"\b"):
        return f"regexp_replace({expr}, {quoted(f'{flags}(^|{NO_WORD})(?:{body[2:-2]})(?:{NO_WORD}.*)?$')}, {quoted(chr(92) + '1')})"
    return f"regexp_replace({expr}, {quoted(f'{flags}(?:{body}).*$')}, '')"


def trimmed(expr: str, chars: str = r"\s") -> str:
    return sub(expr, rf"^[{chars}]+|[{chars}]+$")


def stages(base: str, *steps: dict[str, str]) -> str:
    """Nested selects: each step adds its columns to those before."""
    for step in steps:
        base = "SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in step.items()) + f" FROM ({base})"
    return base


EDGE = r" \-–—,;(\["


def clean_show_steps(src: str, out: str) -> list[dict[str, str]]:
    """DuckDB steps of the show title of column ``src``. (URL escapes are undone by url_decode.)"""
    t = f"__{out}"
    site = lambda e: trimmed(sub(e, P.SITE_PREFIX))
    year_end, span_end = r"\b((?:19|20)\d{2})\s*$", r"\(((?:19|20)\d{2})\s*[-–—]\s*(?:19|20)?\d{2,4}\)\s*$"
    return [
        {t + "1": site(site(site(f"url_decode({src})")))},
        {t + "2": cut(cut(sub(t + "1", r"\[[^\]]*\]\s*$"), P.SHOW_CUT), P.QUALITY)},
        {t + "3": trimmed(sub(t + "2", r"[._]+", " "), EDGE)},
        {out: f"nullif({sub(sub(t + '3', year_end, '(' + chr(92) + '1)'), span_end, '(' + chr(92) + '1)')}, '')"},
    ]
