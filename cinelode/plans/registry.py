"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import importlib

from pyspark.sql import DataFrame, SparkSession

from cinelode.operators import intervals
from cinelode.plans import base
from cinelode.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    lines = intervals.usable_time(table(spark, d, "utterances", "episode_id", "start", "end", "window"))
    return intervals.gaps(lines, "episode_id")


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    lines = intervals.usable_time(table(spark, d, "utterances", "episode_id", "start", "end", "window"))
    return intervals.periods(lines, "episode_id")


USABLE = """
WITH t AS (
  SELECT episode_id,
    CASE WHEN isnan("start") OR isinf("start") THEN NULL ELSE "start" END AS s,
    CASE WHEN isnan("end") OR isinf("end") THEN NULL ELSE "end" END AS e,
    CASE WHEN isnan("window") OR isinf("window") THEN NULL ELSE "window" END AS w
  FROM utterances),
f AS (SELECT episode_id, CAST(round(coalesce(s, e - w) * 1000) AS BIGINT) AS a, CAST(round(coalesce(e, s + w) * 1000) AS BIGINT) AS b FROM t),
i AS (SELECT DISTINCT episode_id, least(a, b) AS s, greatest(a, b) AS e FROM f WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
"""

P1 = USABLE + """
r AS (SELECT episode_id, max(e) OVER w AS reach, lead(s) OVER (PARTITION BY episode_id ORDER BY s, e) AS nxt FROM i
      WINDOW w AS (PARTITION BY episode_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT episode_id, reach AS gap_start_ms, nxt AS gap_end_ms FROM r WHERE nxt > reach
"""

P1_PERIODS = USABLE + """
r AS (SELECT episode_id, s, e, max(e) OVER (PARTITION BY episode_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS part FROM r)
SELECT episode_id, min(s) AS period_start_ms, max(e) AS period_end_ms FROM n GROUP BY episode_id, part
"""


#: Modules whose queries are registered.
MODULES = ("library", "search", "script", "render", "align", "frames", "formats", "records")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"cinelode.plans.{m}")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    _load()
    return base.QUERIES["t01_m01_best_episodes"](spark, d)


def queries() -> dict[str, Query]:
    _load()
    return {"p1_found": p1_found, "p1_periods": p1_periods} | base.QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return {"p1_found": P1, "p1_periods": P1_PERIODS} | base.SQL
