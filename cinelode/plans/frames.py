"""Frame features on the embeddings table: each array is taken as a chunk of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelode.operators import frames as O
from cinelode.operators import intervals
from cinelode.operators import render as R
from cinelode.plans.base import query
from cinelode.plans.script import SPEECH, speech
from cinelode.sources.tables import table

WIDTH = 4
EMB = f"WITH e AS (SELECT {{id}} AS chunk, {{vec}} AS v FROM embeddings), f AS (SELECT chunk, frame, sqrt(list_sum(list_transform(v[frame * {WIDTH} + 1:frame * {WIDTH} + {WIDTH}], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / {WIDTH}) AS rms FROM (SELECT chunk, v, unnest(range(len(v) // {WIDTH})) AS frame FROM e))"
EMB = EMB.format(id="vec_id", vec="embedding")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("v"))


def levels(spark: SparkSession, d: str) -> DataFrame:
    return O.rms_frames(chunks(spark, d), "chunk", "v", WIDTH)


@query(f"{EMB} SELECT chunk, CAST(frame AS INTEGER) AS frame, round(rms, 6) AS rms FROM f")
def x01_rms(spark: SparkSession, d: str) -> DataFrame:
    """Level of each frame of four samples."""
    return levels(spark, d).withColumn("rms", F.round("rms", 6))


ACTIVE = f"{EMB}, p AS (SELECT chunk, quantile_cont(rms, 0.9) AS p90 FROM f GROUP BY 1), a AS (SELECT chunk, frame, rms, rms > 0.6 * p90 AS is_on FROM f JOIN p USING (chunk))"


@query(f"{ACTIVE} SELECT chunk, count(*) AS frames, count(*) FILTER (WHERE is_on) AS active FROM a GROUP BY 1")
def x03_a10_active(spark: SparkSession, d: str) -> DataFrame:
    """Frames above a share of the 90th percentile."""
    a = O.active(levels(spark, d), "chunk", 0.6)
    return a.groupBy("chunk").agg(F.count(F.lit(1)).alias("frames"), F.count_if("on").alias("active"))


@query(f"{EMB} SELECT chunk, CAST(frame AS INTEGER) AS frame, round(sum(rms) OVER (PARTITION BY chunk ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM f")
def w06_smoothed(spark: SparkSession, d: str) -> DataFrame:
    return O.smoothed(levels(spark, d), "chunk").select("chunk", "frame", F.round("smooth", 6).alias("smooth"))


BRIDGED = f"{ACTIVE}, b AS (SELECT *, last_value(CASE WHEN is_on THEN frame END IGNORE NULLS) OVER (PARTITION BY chunk ORDER BY frame ROWS UNBOUNDED PRECEDING) AS lo, first_value(CASE WHEN is_on THEN frame END IGNORE NULLS) OVER (PARTITION BY chunk ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM a), c AS (SELECT chunk, frame, is_on OR coalesce(hi - lo <= 2, FALSE) AS t FROM b)"


@query(f"{BRIDGED} SELECT chunk, CAST(frame AS INTEGER) AS frame, t AS bridged FROM c")
def w07_bridged(spark: SparkSession, d: str) -> DataFrame:
    """Single silent frames between loud ones filled."""
    return O.bridged(O.active(levels(spark, d), "chunk", 0.6), "chunk", "on", 1).select("chunk", "frame", "bridged")


@query(f"{BRIDGED}, g AS (SELECT chunk, frame, frame - row_number() OVER (PARTITION BY chunk ORDER BY frame) AS grp FROM c WHERE t) SELECT chunk, CAST(min(frame) AS INTEGER) AS head, CAST(max(frame) AS INTEGER) AS tail FROM g GROUP BY chunk, grp HAVING count(*) >= 3")
def w08_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of at least three loud frames."""
    b = O.bridged(O.active(levels(spark, d), "chunk", 0.6), "chunk", "on", 1)
    return O.runs(b, "chunk", "bridged", 3).select("chunk", F.col("first").alias("head"), F.col("last").alias("tail"))


@query(f"{EMB}, m AS (SELECT chunk, max(rms) AS top FROM f GROUP BY 1) SELECT chunk, round(avg(rms) FILTER (WHERE rms > 0.15 * top), 6) AS level FROM f JOIN m USING (chunk) GROUP BY 1")
def x07_speech_level(spark: SparkSession, d: str) -> DataFrame:
    """Mean level of the frames above 15 % of the loudest."""
    f = levels(spark, d)
    top = f.groupBy(F.col("chunk").alias("c")).agg(F.max("rms").alias("top"))
    return f.join(top, F.col("chunk") == F.col("c")).groupBy("chunk").agg(F.round(F.avg(F.when(F.col("rms") > 0.15 * F.col("top"), F.col("rms"))), 6).alias("level"))


HALF = "(list_sum(list_transform(v[{a}:{b}], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(v[{a}:{b}]))"


@query(f"{EMB.split(', f AS')[0]} SELECT chunk, round((r - l) / (l + r), 6) AS pan, round(10 * log10((l + r) / 2 + 1e-12), 6) AS loudness FROM (SELECT chunk, {HALF.format(a=1, b='len(v) // 2')} AS l, {HALF.format(a='len(v) // 2 + 1', b='len(v)')} AS r FROM e) WHERE l + r > 0")
def x08_pan_loudness(spark: SparkSession, d: str) -> DataFrame:
    """Pan and loudness; an array's halves are taken as left and right."""
    half = F.floor(F.size("v") / 2).cast("int")
    c = chunks(spark, d).withColumn("p", O.pan_and_level(F.slice("v", 1, half), F.slice("v", half + 1, F.greatest(F.size("v") - half, F.lit(0)))))
    return c.select("chunk", F.round("p.pan", 6).alias("pan"), F.round("p.loudness", 6).alias("loudness"))


@query(f"{EMB.split(', f AS')[0]}, m AS (SELECT max(abs(x)) AS peak FROM (SELECT unnest(v) AS x FROM e)) SELECT chunk, round(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE))) * CASE WHEN peak > 0.02 THEN 0.02 / peak ELSE 1 END, 4) AS total FROM e, m")
def x15_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Samples scaled so that the loudest of all stays under a ceiling; one global maximum."""
    c = chunks(spark, d)
    peak = c.select(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double")))).alias("m")).agg(F.max("m").alias("peak"))
    gain = F.when(F.col("peak") > 0.02, 0.02 / F.col("peak")).otherwise(1.0)
    return c.join(F.broadcast(peak)).select("chunk", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")) * gain, 4).alias("total"))


SPANS = f"{SPEECH}, sp AS (SELECT episode_id, st // 50 AS head, en // 50 AS tail FROM speech WHERE en // 50 - st // 50 >= 2)"


@query(f"{SPANS}, fr AS (SELECT episode_id, head, tail, unnest(generate_series(head, tail - 1)) AS frame FROM sp), w AS (SELECT episode_id, frame, max(CASE WHEN least(frame - head, tail - 1 - frame) < least(2, (tail - head) // 2) THEN least(frame - head, tail - 1 - frame) * CASE WHEN least(2, (tail - head) // 2) > 1 THEN 1.0 ELSE 1.0 END ELSE 1.0 END) AS weight FROM fr GROUP BY 1, 2) SELECT episode_id, count(*) AS frames, CAST(round(sum(weight), 6) AS DOUBLE) AS weight FROM w GROUP BY 1")
def g04_mask(spark: SparkSession, d: str) -> DataFrame:
    """Union of spans as a mask with ramps of two frames."""
    s = speech(spark, d).select("episode_id", F.floor(F.col("st") / 50).alias("head"), F.floor(F.col("en") / 50).alias("tail"))
    m = O.mask(s, "episode_id", "head", "tail", 2)
    return m.groupBy("episode_id").agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum("weight"), 6).alias("weight"))


@query(f"{SPANS}, s AS (SELECT episode_id, head, tail FROM sp), on_ AS (SELECT DISTINCT episode_id, unnest(generate_series(head // 20, tail // 20)) AS second FROM s), r AS (SELECT episode_id, max(second) AS top FROM on_ GROUP BY 1) SELECT r.episode_id, r.top + 1 AS seconds, count(*) AS during, r.top + 1 - count(*) AS between_ FROM r JOIN on_ USING (episode_id) GROUP BY 1, 2")
def a19_during_between(spark: SparkSession, d: str) -> DataFrame:
    """Seconds of an episode during and between speech."""
    s = speech(spark, d).select("episode_id", F.floor(F.col("st") / 50).alias("head"), F.floor(F.col("en") / 50).alias("tail")).filter("tail - head >= 2")
    on = intervals.periods(s.select("episode_id", F.floor(F.col("head") / 20).alias("s_ms"), (F.floor(F.col("tail") / 20) + 1).alias("e_ms")), "episode_id", 600)
    during = F.sum(F.col("period_end_ms") - F.col("period_start_ms"))
    return on.groupBy("episode_id").agg(F.max("period_end_ms").alias("seconds"), during.alias("during")).withColumn("between_", F.col("seconds") - F.col("during"))


@query(f"{EMB}, b AS (SELECT chunk, CASE WHEN frame < 2 THEN 'low' WHEN frame < 6 THEN 'mid' ELSE 'high' END AS band, 20 * log10(rms + 1e-9) AS db FROM f) SELECT band, count(*) AS frames, round(avg(db), 4) AS db FROM b GROUP BY 1")
def a18_bands(spark: SparkSession, d: str) -> DataFrame:
    """Mean of decibels by band; a frame's place in its chunk stands for the band."""
    band = F.when(F.col("frame") < 2, "low").when(F.col("frame") < 6, "mid").otherwise("high")
    return levels(spark, d).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg(20 * F.log10(F.col("rms") + 1e-9)), 4).alias("db"))


W13 = f"""{ACTIVE.replace('WITH ', 'WITH RECURSIVE ', 1)}, d AS (
  SELECT chunk, frame, CAST(CASE WHEN is_on THEN 0.3 ELSE 1.0 END + (1.0 - CASE WHEN is_on THEN 0.3 ELSE 1.0 END) * CASE WHEN is_on THEN 0.7 ELSE 0.95 END AS DOUBLE) AS gain FROM a WHERE frame = 0
  UNION ALL SELECT a.chunk, a.frame, CASE WHEN is_on THEN 0.3 ELSE 1.0 END + (d.gain - CASE WHEN is_on THEN 0.3 ELSE 1.0 END) * CASE WHEN CASE WHEN is_on THEN 0.3 ELSE 1.0 END < d.gain THEN 0.7 ELSE 0.95 END FROM d JOIN a ON a.chunk = d.chunk AND a.frame = d.frame + 1)
SELECT chunk, frame, round(gain + 1e-9, 5) AS gain FROM d"""


@query(W13)
def w13_duck(spark: SparkSession, d: str) -> DataFrame:
    """Duck envelope: quick down, slow up."""
    a = O.active(levels(spark, d), "chunk", 0.6).select(F.col("chunk").alias("episode_id"), F.col("frame").cast("long").alias("frame"), F.col("on").alias("speaking"))
    return R.ducked(a, 0.3, 0.7, 0.95).select(F.col("episode_id").alias("chunk"), "frame", F.round(F.col("gain") + 1e-9, 5).alias("gain"))
