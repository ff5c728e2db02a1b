"""A log monitor: findings of render logs, as a stream with state and as a batch.

Lines read are those of the logs at hand: 'hh:mm Show #n: laid a lines, squeezed b, c too long' and
'hh:mm pitch of NAME: wanted a Hz, heard b Hz in n lines', besides loud lines. An episode is remembered from line to line.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Share squeezed or overruns that make an episode tight; lines and percent of a drift.
TIGHT, OVERRUNS, DRIFT_LINES, DRIFT_PERCENT = 0.33, 12, 4, 20.0
LAID = r"^(?:\d\d:\d\d )?(.+ #\d+): laid (\d+) lines, squeezed (\d+), (\d+) too long"
PITCH = r"pitch of (.+): wanted (\d+) Hz, heard (\d+) Hz in (\d+) lines"
LOUD = r"failed with exit|^Traceback|is fully rendered|not resolved yet"

SQL = f"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(text, chr(13) || chr(10), chr(10), 'g'), chr(13), chr(10), 'g') AS t FROM documents WHERE source = 'render_logs' AND text IS NOT NULL)),
x AS (SELECT doc_id, n, line, nullif(regexp_extract(line, '{LAID}', 1), '') AS ep, TRY_CAST(regexp_extract(line, '{LAID}', 2) AS INTEGER) AS laid, TRY_CAST(regexp_extract(line, '{LAID}', 3) AS INTEGER) AS sq, TRY_CAST(regexp_extract(line, '{LAID}', 4) AS INTEGER) AS ov,
  nullif(regexp_extract(line, '{PITCH}', 1), '') AS who, TRY_CAST(regexp_extract(line, '{PITCH}', 2) AS DOUBLE) AS want, TRY_CAST(regexp_extract(line, '{PITCH}', 3) AS DOUBLE) AS heard, TRY_CAST(regexp_extract(line, '{PITCH}', 4) AS INTEGER) AS cnt FROM l),
y AS (SELECT *, last_value(ep IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS episode FROM x),
z AS (SELECT doc_id, n, coalesce(episode, '?') AS episode, CASE WHEN regexp_matches(line, '{LOUD}') THEN 'loud' WHEN cnt >= {DRIFT_LINES} AND want > 0 AND abs(heard - want) / want * 100 > {DRIFT_PERCENT} THEN 'drift' WHEN laid > 0 AND (sq / laid >= {TIGHT} OR ov >= {OVERRUNS}) THEN 'tight' END AS finding FROM y)
SELECT doc_id, CAST(n AS INTEGER) AS n, episode, finding FROM z WHERE finding IS NOT NULL"""


def findings(lines: DataFrame, key: str) -> DataFrame:
    """(key, n, episode, finding) of log lines (key, n, line): loud, drift or tight. NUL bytes are dropped."""
    line = F.replace("line", F.lit("\0"), F.lit(""))
    num = lambda p, i: F.regexp_extract("line", p, i).try_cast("double")
    x = lines.withColumn("line", line).withColumn("ep", F.nullif(F.regexp_extract("line", LAID, 1), F.lit("")))
    episode = F.last("ep", ignorenulls=True).over(W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    off = F.abs(num(PITCH, 3) - num(PITCH, 2)) / F.nullif(num(PITCH, 2), F.lit(0.0)) * 100
    tight = (num(LAID, 2) > 0) & ((num(LAID, 3) / F.nullif(num(LAID, 2), F.lit(0.0)) >= TIGHT) | (num(LAID, 4) >= OVERRUNS))
    finding = F.when(F.col("line").rlike(LOUD), "loud").when((num(PITCH, 4) >= DRIFT_LINES) & (off > DRIFT_PERCENT), "drift").when(tight, "tight")
    return x.select(key, "n", F.coalesce(episode, F.lit("?")).alias("episode"), finding.alias("finding")).filter("finding is not null")


def monitored(stream: DataFrame, forgiven: tuple[str, ...] = ()) -> DataFrame:
    """The same on a stream of (log, n, line): the episode at hand is the state of each log. Speakers ``forgiven`` never drift.

    Lines of a micro-batch are taken in the order of ``n``; the state is one string a log.
    """
    import re

    laid, pitch, loud = re.compile(LAID), re.compile(PITCH), re.compile(LOUD)
    skip = {f.upper() for f in forgiven}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        episode = state.get[0] if state.exists else "?"
        out = []
        for pdf in batches:
            for n, line in sorted(zip(pdf["n"], pdf["line"], strict=True)):
                line = (line or "").replace("\0", "")
                m, p = laid.search(line), pitch.search(line)
                if m:
                    episode = m[1]
                if loud.search(line):
                    out.append((key[0], int(n), episode, "loud"))
                elif p and int(p[4]) >= DRIFT_LINES and p[1].upper() not in skip and int(p[2]) and abs(int(p[3]) - int(p[2])) / int(p[2]) * 100 > DRIFT_PERCENT:
                    out.append((key[0], int(n), episode, "drift"))
                elif m and int(m[2]) and (int(m[3]) / int(m[2]) >= TIGHT or int(m[4]) >= OVERRUNS):
                    out.append((key[0], int(n), episode, "tight"))
        state.update((episode,))
        yield pd.DataFrame(out, columns=["log", "n", "episode", "finding"])

    return stream.groupBy("log").applyInPandasWithState(step, "log string, n bigint, episode string, finding string", "episode string", "append", "NoTimeout")
