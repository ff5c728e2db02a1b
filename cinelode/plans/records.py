"""Readers, writers and small operators as queries: their inputs are made of the tables' rows by rules that both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelode.functions import text as T
from cinelode.operators import casting
from cinelode.operators import frames as O
from cinelode.operators import render
from cinelode.operators import script as C
from cinelode.plans import views as V
from cinelode.plans.base import query
from cinelode.plans.frames import EMB, WIDTH, chunks, levels
from cinelode.plans.script import G01, SPEECH, speech
from cinelode.sources import readers as R
from cinelode.sources import writers as W
from cinelode.sources.tables import table

FILES = "f AS (SELECT DISTINCT id, item_id, name, size FROM files)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files", "id", "item_id", "name", "size").dropDuplicates()


@query("SELECT id, name, download_state FROM (SELECT DISTINCT id, name, download_state FROM downloads)")
def s01_listing(spark: SparkSession, d: str) -> DataFrame:
    """Downloads written as a listing's JSON and read back by its schema."""
    i = table(spark, d, "downloads", "id", "name", "download_state").dropDuplicates()
    page = i.select(F.to_json(F.struct(F.lit(True).alias("success"), F.lit(None).cast("string").alias("detail"), F.array(F.struct("id", "name", "download_state")).alias("data"))).alias("j"))
    schema = "success boolean, detail string, data array<struct<id:bigint,name:string,download_state:string>>"
    return R.successful(page.select(F.from_json("j", schema).alias("x")).select("x.*"))


@query(f"WITH {FILES} SELECT id, CASE WHEN id % 4 = 0 THEN 'magnet:?xt=' || id WHEN id % 4 = 1 THEN 'https://host/' || id END AS link FROM f WHERE id % 4 < 2")
def s04_links(spark: SparkSession, d: str) -> DataFrame:
    """Results with a magnet or a download link; an empty one counts as none."""
    i, s = F.col("id"), F.col("id").cast("string")
    r = _files(spark, d).select("id", F.when(i % 4 == 0, F.concat(F.lit("magnet:?xt="), s)).when(i % 4 == 2, "").alias("magnetUrl"), F.when(i % 4 == 1, F.concat(F.lit("https://host/"), s)).when(i % 4 == 3, "").alias("downloadUrl"))
    return R.with_link(r).select("id", "link")


# Lines of settings: a comment, a blank line, a line without '=', and two settings of each plan, one with '=' in its value.
@query("SELECT season_id, 'SHOW_' || season_id AS key, trim(regexp_replace(\"show\", '^\\s+|\\s+$', '', 'g')) AS value FROM season UNION ALL SELECT season_id, 'OPT', 'a=b ' || season_id FROM season")
def s05_env_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("season_id").cast("string")
    text = F.concat(F.lit("# plan "), s, F.lit("\n\n  no setting\n SHOW_"), s, F.lit(" = "), F.col("show"), F.lit("\nOPT=a=b "), s)
    rows = R.lines_of(table(spark, d, "season", "season_id", "show").withColumn("text", text), "season_id", "text")
    keyed = rows.select(F.struct("season_id", "n").alias("n"), "line")
    return R.env_pairs(keyed).select("n.season_id", "key", "value")


@query("SELECT season_id, trim(\"show\") AS folder, CASE WHEN season_id % 3 = 0 THEN '' ELSE 'S{season:02d} | x' END AS template FROM season")
def s06_watchlist(spark: SparkSession, d: str) -> DataFrame:
    """Watch rows; the first bar splits, a missing template is ''."""
    body = F.concat(F.lit("# watched\n"), "show", F.when(F.col("season_id") % 3 == 0, "").otherwise(" | S{season:02d} | x"))
    rows = R.lines_of(table(spark, d, "season", "season_id", "show").withColumn("text", body), "season_id", "text")
    return R.watchlist(rows.select(F.struct("season_id", "n").alias("n"), "line")).select("n.season_id", "folder", "template")


@query(f"WITH {FILES} SELECT id, CAST(id AS VARCHAR) AS album, 'y' AS year, CAST(size AS VARCHAR) AS size, 'u' || id AS url FROM f WHERE size IS NOT NULL AND id % 5 <> 0")
def s07_s08_queue(spark: SparkSession, d: str) -> DataFrame:
    """Queue lines written with tabs and read back; lines of another arity are dropped."""
    s = F.col("id").cast("string")
    line = F.concat_ws("\t", s, F.lit("y"), F.col("size").cast("string"), F.lit("t"), F.concat(F.lit("u"), s))
    rows = _files(spark, d).filter("size is not null").select(F.col("id").alias("n"), F.when(F.col("id") % 5 == 0, F.concat(line, F.lit("\tmore"))).otherwise(line).alias("line"))
    return R.queue_rows(rows).select(F.col("n").alias("id"), "album", "year", "size", "url")


@query("SELECT doc_id, CASE WHEN starts_with(text, chr(65279)) THEN substr(text, 2) ELSE text END AS text FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(65533))")
def s12_charsets(spark: SparkSession, d: str) -> DataFrame:
    """Texts as bytes and back, a byte order mark dropped."""
    docs = table(spark, d, "documents", "doc_id", "text").filter(F.col("text").isNotNull() & ~F.col("text").contains("�"))
    return docs.select("doc_id", R.any_charset(F.encode("text", "UTF-8")).alias("text"))


@query("SELECT DISTINCT id, speaker, text, \"start\" AS st FROM utterances WHERE NOT isnan(\"start\") OR \"start\" IS NULL")
def s13_utterance_json(spark: SparkSession, d: str) -> DataFrame:
    """Utterances as JSON and back."""
    u = table(spark, d, "utterances", "id", "speaker", "text", "start").filter(~F.isnan("start") | F.col("start").isNull()).dropDuplicates().withColumnRenamed("start", "st")
    return u.select(F.from_json(F.to_json(F.struct("id", "speaker", "text", "st")), "id bigint, speaker string, text string, st double").alias("x")).select("x.*")


@query("SELECT show_id, speaker, seconds, clips FROM (SELECT DISTINCT show_id, speaker, seconds, clips FROM bank)")
def s14_maps(spark: SparkSession, d: str) -> DataFrame:
    """The bank of each show as a JSON object of objects, and its entries read back."""
    b = table(spark, d, "bank", "show_id", "speaker", "seconds", "clips").dropDuplicates()
    maps = b.groupBy("show_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", F.struct("seconds", "clips")))))).alias("j"))
    return maps.select("show_id", F.explode(F.from_json("j", "map<string,struct<seconds:double,clips:int>>")).alias("speaker", "v")).select("show_id", "speaker", "v.seconds", "v.clips")


@query("SELECT value.id::BIGINT AS id, value.show::VARCHAR AS shown FROM (SELECT {'id': season_id, 'show': \"show\"} AS value FROM season)")
def s17_worksheet(spark: SparkSession, d: str) -> DataFrame:
    """Worksheet lines, one JSON entry each, read back."""
    lines = W.worksheet_lines(table(spark, d, "season", "season_id", "show"), "season_id", ["show"])
    return lines.select(F.from_json("value", "season_id bigint, show string").alias("x")).select(F.col("x.season_id").alias("id"), F.col("x.show").alias("shown"))


@query("SELECT CAST(season_id AS VARCHAR) AS id, CASE WHEN season_id % 4 = 0 THEN '' ELSE 'R' || season_id % 7 END AS role, CASE WHEN season_id % 2 = 0 THEN 'sign' END AS kind FROM (SELECT DISTINCT season_id FROM season)")
def s18_answers(spark: SparkSession, d: str) -> DataFrame:
    """Compact answers with comments; the last answer of an id wins."""
    i, s = F.col("season_id"), F.col("season_id").cast("string")
    role = F.when(i % 4 == 0, "-").otherwise(F.concat(F.lit("R"), (i % 7).cast("string")))
    text = F.concat(F.lit("# answers\n"), s, F.lit(" OLD song\n"), s, F.lit(" "), role, F.when(i % 2 == 0, " sign").otherwise(""), F.lit("  # done"))
    rows = R.lines_of(table(spark, d, "season", "season_id").withColumn("text", text), "season_id", "text")
    return R.answers(rows.select("n", "line"))


@query()
def s19_listing(spark: SparkSession, d: str) -> DataFrame:
    """The tables' own files as a listing; contents are not read. A file system is no table, so there is no SQL."""
    return W.listing(spark, d, "*.parquet").select("name", "length")


@query(f"WITH {FILES} SELECT id, CASE id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' END AS kind FROM f")
def s22_image_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What an image is by its first bytes."""
    head = F.when(F.col("id") % 4 == 0, "FFD8FFE0").when(F.col("id") % 4 == 1, "89504E47").when(F.col("id") % 4 == 2, "52494646").otherwise("00112233")
    return _files(spark, d).select("id", R.image_kind(F.unhex(head)).alias("kind"))


@query(f"WITH {FILES}, k AS (SELECT DISTINCT id, size FROM f) SELECT id, CASE WHEN id % 3 = 0 THEN size ELSE size * 2 END AS value FROM k")
def s25_cache(spark: SparkSession, d: str) -> DataFrame:
    """Read-through cache: every third file's value is known, the others are worked out."""
    f = _files(spark, d).select("id", "size").distinct()
    known = f.filter("id % 3 = 0").select("id", F.col("size").alias("value"))
    return W.through_cache(f, known, "id", lambda miss: miss.select("id", (F.col("size") * 2).alias("value")))[0]


# Sheets of an item: one under the name of its first audio file, one that names its last, and a third that fits none unless it is alone.
SHEETS = """a AS (SELECT DISTINCT item_id, id, name FROM files WHERE regexp_matches(name, '(?i)\\.(flac|mp3|ape|m4a)$')),
st AS (SELECT item_id, id, lower(regexp_replace(regexp_replace(name, '^.*/', ''), '(.)\\.[^.]*$', '\\1')) AS stem FROM a),
g AS (SELECT item_id, arg_min(stem, id) AS first, arg_max(stem, id) AS last, count(*) AS n FROM st GROUP BY 1),
s AS (SELECT item_id, 1 AS sheet, last AS in_it, 'own' AS own FROM g UNION ALL SELECT item_id, 2, 'none', first FROM g WHERE item_id % 2 = 0),
c AS (SELECT item_id, count(*) AS sheets FROM s GROUP BY 1)"""


@query(f"WITH {SHEETS} SELECT st.id, CAST(min(s.sheet) AS INTEGER) AS sheet FROM st JOIN g USING (item_id) JOIN c USING (item_id) JOIN s USING (item_id) WHERE st.stem = s.in_it OR st.stem = s.own OR (g.n = 1 AND c.sheets = 1) GROUP BY 1")
def j14_sheets(spark: SparkSession, d: str) -> DataFrame:
    """The sheet of each audio file."""
    a = table(spark, d, "files", "item_id", "id", "name").filter(F.col("name").rlike(r"(?i)\.(flac|mp3|ape|m4a)$")).dropDuplicates()
    g = a.groupBy("item_id").agg(F.min(F.struct("id", T.stem(F.col("name")).alias("s")))["s"].alias("first"), F.max(F.struct("id", T.stem(F.col("name")).alias("s")))["s"].alias("last"))
    one = g.select("item_id", F.lit(1).alias("sheet"), F.lit("own.cue").alias("sheet_name"), F.concat("last", F.lit(".wav")).alias("named"))
    two = g.filter("item_id % 2 = 0").select("item_id", F.lit(2).alias("sheet"), F.concat("first", F.lit(".cue")).alias("sheet_name"), F.lit("none.wav").alias("named"))
    return casting.sheets_of_audio(a, one.unionByName(two))


@query("WITH p AS (SELECT DISTINCT \"show\" AS phrase FROM season), w AS (SELECT phrase, list_distinct(regexp_extract_all(lower(phrase), '[a-z0-9'']+')) AS want FROM p) SELECT phrase, take, array_to_string(list_sort(CASE WHEN take = 1 THEN CAST([] AS VARCHAR[]) ELSE want END), '|') AS missed FROM w, (SELECT unnest([1, 2]) AS take)")
def a23_takes(spark: SparkSession, d: str) -> DataFrame:
    """Takes of each phrase with what they missed: the first heard all, the second nothing."""
    p = table(spark, d, "season", "show").distinct().select(F.col("show").alias("phrase"))
    t = p.select("phrase", F.lit(1).alias("take"), F.col("phrase").alias("heard")).unionByName(p.select("phrase", F.lit(2).alias("take"), F.lit(None).cast("string").alias("heard")))
    return casting.takes(t).select("phrase", F.explode("takes").alias("t")).select("phrase", "t.take", F.array_join(F.array_sort("t.missed"), "|").alias("missed"))


@query(f"WITH {FILES} SELECT id, CAST(id % 900 AS INTEGER) AS index, CASE WHEN id % 6 > 0 THEN 'bear_' || id % 9 END AS voice, CASE WHEN id % 6 > 0 THEN 'some-words-' || id % 4 END AS slug, CASE WHEN id % 6 > 2 THEN CAST(id % 5 AS INTEGER) END AS take FROM f WHERE id % 6 > 0 UNION ALL SELECT id, NULL, NULL, NULL, NULL FROM f WHERE id % 6 = 0")
def f23_clip_names(spark: SparkSession, d: str) -> DataFrame:
    """Parts of clip names, some without a take, some none."""
    s = lambda n: (F.col("id") % n).cast("string")
    name = F.concat(s(900), F.lit("-bear_"), s(9), F.lit("-some-words-"), s(4), F.when(F.col("id") % 6 > 2, F.concat(F.lit("-t"), s(5))).otherwise(""), F.lit(".wav"))
    return _files(spark, d).select("id", W.clip_name(F.when(F.col("id") % 6 == 0, "nothing.wav").otherwise(name)).alias("x")).select("id", "x.*")


@query("SELECT season_id, CASE WHEN season_id % 3 > 0 THEN 'BEAR ' || season_id END AS voice, trim(\"show\") AS text FROM season WHERE NOT contains(\"show\", '::')")
def f24_spoken_lines(spark: SparkSession, d: str) -> DataFrame:
    """Voice and text of lines with a voice before '::', and of lines without."""
    s = table(spark, d, "season", "season_id", "show").filter(~F.col("show").contains("::"))
    line = F.when(F.col("season_id") % 3 > 0, F.concat(F.lit(" BEAR "), F.col("season_id").cast("string"), F.lit(" ::  "), "show")).otherwise(F.col("show"))
    return s.select("season_id", W.spoken_line(line).alias("x")).select("season_id", "x.voice", "x.text")


LOUD = f"{EMB.split(', f AS')[0]}, l AS (SELECT chunk, v, list_transform(range(0, (len(v) - 1) // 4 + 1), lambda i: list_sum(list_transform(v[i * 4 + 1:i * 4 + 4], lambda x: abs(CAST(x AS DOUBLE)))) / 4) AS lev FROM e WHERE len(v) > 0), k AS (SELECT chunk, v, list_filter(range(0, len(lev)), lambda i: lev[i + 1] > 0.9 * list_max(lev)) AS loud FROM l)"


@query(f"{LOUD} SELECT chunk, len(v[loud[1] * 4 + 1:(loud[-1] + 1) * 4]) AS kept FROM k")
def x06_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """Samples that are left when quiet ends are cut; a frame is four samples here, and quiet is under nine tenths of the peak."""
    t = casting.trimmed(chunks(spark, d).filter(F.size("v") > 0), "v", 200, 0.9)
    return t.select("chunk", F.size("v").cast("long").alias("kept"))


@query(f"{EMB}, r AS (SELECT chunk, frame, rms * 40 AS ratio FROM f), m AS (SELECT chunk, greatest(3.0, median(ratio)) AS mid, max(ratio) AS top FROM r GROUP BY 1) SELECT chunk, CAST(frame AS INTEGER) AS frame FROM r JOIN m USING (chunk) WHERE ratio >= mid OR top < mid")
def x09_passable(spark: SparkSession, d: str) -> DataFrame:
    """Frames good enough to be measured; a frame's level times forty stands for the ratio."""
    r = levels(spark, d).withColumn("ratio", F.col("rms") * 40)
    return O.passable(r, "chunk").select("chunk", "frame")


@query(f"{EMB.split(', f AS')[0]}, x AS (SELECT chunk // 3 AS line, chunk % 3 AS voice, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS p FROM e), s AS (SELECT line, p + voice * 5 AS i, sum(CAST(x AS DOUBLE)) AS s FROM x GROUP BY 1, 2), n AS (SELECT chunk // 3 AS line, count(*) AS n FROM e GROUP BY 1) SELECT line, i, round(s / sqrt(n), 6) AS sample FROM s JOIN n USING (line)")
def x10_unison(spark: SparkSession, d: str) -> DataFrame:
    """Three chunks laid over each other, each five samples later."""
    v = chunks(spark, d).select(F.expr("chunk div 3").alias("line"), (F.col("chunk") % 3).alias("voice"), F.col("v").alias("samples"))
    u = casting.unison(v, "line", 5)
    return u.select("line", F.col("i").cast("long").alias("i"), F.round("sample", 6).alias("sample"))


@query(f"{EMB}, p AS (SELECT a.chunk, a.frame, a.rms AS voice, b.rms * 0.1 AS behind FROM f a JOIN f b ON b.chunk = a.chunk AND b.frame = a.frame + 1) SELECT chunk, count(*) AS frames, count(*) FILTER (WHERE voice > 0.005 AND voice / (behind + 1e-6) >= 10) AS clean FROM p GROUP BY 1")
def p15_clean_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a clean clip; a tenth of the next frame's level stands for what is behind the voice."""
    f = levels(spark, d)
    b = f.select(F.col("chunk").alias("__c"), (F.col("frame") - 1).alias("__f"), (F.col("rms") * 0.1).alias("behind"))
    p = f.join(b, (F.col("chunk") == F.col("__c")) & (F.col("frame") == F.col("__f")))
    return p.groupBy("chunk").agg(F.count(F.lit(1)).alias("frames"), F.count_if(O.clean(F.col("rms"), F.col("behind"))).alias("clean"))


DB = f"{EMB}, q AS (SELECT chunk, frame, 20 * log10(rms + 1e-9) AS db FROM f)"


@query(f"{DB}, p AS (SELECT a.chunk, a.frame, a.db AS before, b.db AS after FROM q a JOIN q b ON b.chunk = a.chunk + 1 AND b.frame = a.frame), h AS (SELECT *, CASE WHEN frame * 600 >= 8000 THEN 'air' WHEN frame * 600 >= 3400 THEN 'presence' WHEN frame * 600 >= 1000 THEN 'upper voice' WHEN frame * 600 >= 400 THEN 'voice' WHEN frame * 600 >= 120 THEN 'low' ELSE 'sub' END AS band FROM p) SELECT band, count(*) AS frames, round(avg(after - before), 6) + 0.0 AS delta, abs(avg(after - before)) > 3 AS large FROM h GROUP BY 1")
def a18_band_report(spark: SparkSession, d: str) -> DataFrame:
    """Mean difference of decibels by band between a chunk and the next; a frame's place times 600 Hz stands for its frequency."""
    q = levels(spark, d).select("chunk", "frame", (20 * F.log10(F.col("rms") + 1e-9)).alias("db"))
    b = q.select((F.col("chunk") - 1).alias("__c"), F.col("frame").alias("__f"), F.col("db").alias("after"))
    p = q.join(b, (F.col("chunk") == F.col("__c")) & (F.col("frame") == F.col("__f"))).select((F.col("frame") * 600).alias("hertz"), F.col("db").alias("before"), "after")
    return O.band_report(p).select("band", "frames", (F.round("delta", 6) + 0.0).alias("delta"), "large")


@query(f"{DB}, p AS (SELECT a.chunk, a.db AS before, b.db AS after, a.frame % 3 = 0 AS on_ FROM q a JOIN q b ON b.chunk = a.chunk + 1 AND b.frame = a.frame) SELECT chunk, round(avg(after - before) FILTER (WHERE on_), 6) + 0.0 AS during, round(avg(after - before) FILTER (WHERE NOT on_), 6) + 0.0 AS between_ FROM p GROUP BY 1 HAVING count(*) FILTER (WHERE on_) > 0 AND count(*) FILTER (WHERE NOT on_) > 0")
def a19_stability(spark: SparkSession, d: str) -> DataFrame:
    """Mean difference while a line plays (every third frame here) and between lines."""
    q = levels(spark, d).select("chunk", "frame", (20 * F.log10(F.col("rms") + 1e-9)).alias("db"))
    b = q.select((F.col("chunk") - 1).alias("__c"), F.col("frame").alias("__f"), F.col("db").alias("after"))
    p = q.join(b, (F.col("chunk") == F.col("__c")) & (F.col("frame") == F.col("__f"))).select("chunk", F.col("db").alias("before"), "after", (F.col("frame") % 3 == 0).alias("on_"))
    return O.stability(p, "chunk", "on_").select("chunk", (F.round("during", 6) + 0.0).alias("during"), (F.round("between", 6) + 0.0).alias("between_"))


CASES = G01.replace("SELECT n.episode_id, g.id, n.overdub FROM g JOIN n USING (low)", "")


@query(f"{CASES}, pans AS (SELECT upper(speaker) AS speaker, max(abs(CASE WHEN isnan(ratio) THEN NULL ELSE ratio END) / 100) AS far FROM bank GROUP BY 1), o AS (SELECT DISTINCT n.episode_id, n.overdub, x.speaker FROM g JOIN n USING (low) JOIN x ON x.id = g.id) SELECT episode_id, overdub, bool_and(coalesce(far <= 0.15, TRUE)) AS eligible FROM o LEFT JOIN pans USING (speaker) GROUP BY 1, 2")
def g03_eligible_cases(spark: SparkSession, d: str) -> DataFrame:
    """Whether a case may be resolved by itself; a hundredth of the bank's ratio stands for a speaker's measured pan."""
    s = speech(spark, d)
    inside = s.join(C.overlap_cases(s).select("id", "overdub"), "id")
    pans = table(spark, d, "bank", "speaker", "ratio").select(F.upper("speaker").alias("speaker"), (V.real(F.col("ratio")) / 100).alias("pan"))
    return render.auto_resolved(inside, pans)


NUDGES = "SELECT l.id, l.kind, l.role, CASE WHEN l.id % 3 = 0 THEN l.id % 5 / 10.0 END AS lift, CASE WHEN l.id % 2 = 0 THEN 0.25 END AS tp, CASE WHEN l.id % 4 = 0 THEN 1.1 END AS tc, CASE WHEN l.id % 7 = 0 THEN 0.8 END AS tg, CASE WHEN l.id % 5 > 0 THEN -0.5 END AS sp, 0.9 AS sc, CASE WHEN l.id % 2 = 1 THEN 1.2 END AS sg FROM lines l WHERE l.kind IN ('speech', 'sign')"


@query(f"WITH {V.LINES}, b AS ({NUDGES}), c AS (SELECT *, kind = 'sign' AS sign, coalesce(role <> '' AND upper(role) NOT IN ('NARRATION', 'NARRATOR'), FALSE) AS played FROM b), e AS (SELECT *, NOT sign AND NOT played AND lift IS NULL AS none FROM c) SELECT id, round(CAST(coalesce(tp, 0) + CASE WHEN none THEN 0 ELSE coalesce(lift, CASE WHEN sign THEN -0.3 WHEN played THEN coalesce(sp, 0) ELSE 0 END) END AS DOUBLE), 6) AS pitch, round(CAST(coalesce(tc, 1) * CASE WHEN sign THEN 1.05 WHEN played THEN sc ELSE 1 END AS DOUBLE), 6) AS pace, round(CAST(coalesce(tg, 1) * CASE WHEN sign THEN 0.9 WHEN played THEN coalesce(sg, 1) ELSE 1 END AS DOUBLE), 6) AS gain FROM e")
def m07_composed(spark: SparkSession, d: str) -> DataFrame:
    """Pitch, pace and gain that a line ends up with; tunings, shades and lifts are made of its id."""
    i = F.col("id")
    a = V.lines(spark, d).filter("kind in ('speech', 'sign')").select(
        "id", "kind", "role", F.when(i % 3 == 0, i % 5 / 10.0).alias("lift"), F.when(i % 2 == 0, 0.25).alias("tuning_pitch"), F.when(i % 4 == 0, 1.1).alias("tuning_pace"), F.when(i % 7 == 0, 0.8).alias("tuning_gain"), F.when(i % 5 > 0, -0.5).alias("shade_pitch"), F.lit(0.9).alias("shade_pace"), F.when(i % 2 == 1, 1.2).alias("shade_gain")
    )
    return render.nudged(a).select("id", *[F.round(c, 6).alias(c) for c in ("pitch", "pace", "gain")])


CURVE = f"{EMB}, g AS (SELECT chunk, frame, 1 / (1 + rms) AS gain, count(*) OVER (PARTITION BY chunk) AS n FROM f), s AS (SELECT chunk, n, unnest(range(n * {WIDTH})) AS sample FROM (SELECT DISTINCT chunk, n FROM g)), q AS (SELECT *, floor((sample - {WIDTH / 2}) / {WIDTH}) AS k FROM s)"


@query(f"{CURVE} SELECT q.chunk, q.sample, round(CASE WHEN sample < {WIDTH / 2} OR sample > (n - 1) * {WIDTH} + {WIDTH / 2} THEN 1.0 ELSE a.gain + coalesce((sample - k * {WIDTH} - {WIDTH / 2}) / {WIDTH} * (b.gain - a.gain), 0) END, 6) AS gain FROM q LEFT JOIN (SELECT chunk, frame, gain FROM g) a ON a.chunk = q.chunk AND a.frame = q.k LEFT JOIN (SELECT chunk, frame, gain FROM g) b ON b.chunk = q.chunk AND b.frame = q.k + 1")
def w13_curve(spark: SparkSession, d: str) -> DataFrame:
    """Gains of frames as a curve over samples."""
    g = levels(spark, d).select("chunk", "frame", (1 / (1 + F.col("rms"))).alias("gain"))
    return O.interpolated(g, "chunk", WIDTH).select("chunk", "sample", F.round("gain", 6).alias("gain"))


@query(f"{EMB.split(', f AS')[0]}, x AS (SELECT chunk, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS p FROM e), m AS (SELECT a.chunk, a.p, CAST(a.x AS DOUBLE) * 4 * (1 - a.p % 11 / 10.0) + CAST(b.x AS DOUBLE) * 4 * (a.p % 11 / 10.0) AS s FROM x a JOIN x b ON b.chunk = a.chunk + 1 AND b.p = a.p), k AS (SELECT max(abs(s)) AS peak FROM m) SELECT chunk, p, round(s * CASE WHEN peak > 0.99 THEN 0.99 / peak ELSE 1 END, 6) + 0.0 AS sample FROM m, k")
def x15_crossfaded(spark: SparkSession, d: str) -> DataFrame:
    """Samples of a chunk faded into the next one's, normalised to a peak of 0.99; both are four times as loud here, so that the peak is met."""
    x = chunks(spark, d).select("chunk", F.posexplode("v").alias("p", "x")).withColumn("x", F.col("x").cast("double") * 4)
    b = x.select((F.col("chunk") - 1).alias("__c"), F.col("p").alias("__p"), F.col("x").alias("y"))
    m = x.join(b, (F.col("chunk") == F.col("__c")) & (F.col("p") == F.col("__p"))).select("chunk", F.col("p").cast("long").alias("p"), O.crossfaded(F.col("x"), F.col("y"), F.col("p") % 11 / 10.0).alias("sample"))
    return O.normalised(m, "sample").select("chunk", "p", (F.round("sample", 6) + 0.0).alias("sample"))


# Two words respelt, as whole words, a capital first letter kept.
RESPELT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc, '(^|[^\\p{L}\\p{N}''’])harbour($|[^\\p{L}\\p{N}''’])', '\\1har-ber\\2', 'g'), '(^|[^\\p{L}\\p{N}''’])Harbour($|[^\\p{L}\\p{N}''’])', '\\1Har-ber\\2', 'g'), '(^|[^\\p{L}\\p{N}''’])clerk($|[^\\p{L}\\p{N}''’])', '\\1clark\\2', 'g'), '(^|[^\\p{L}\\p{N}''’])Clerk($|[^\\p{L}\\p{N}''’])', '\\1Clark\\2', 'g')"


@query(f"{SPEECH} SELECT id, {RESPELT} AS said FROM (SELECT id, text AS nfc FROM speech WHERE regexp_matches(text, '^[ -~]*$'))")
def f17_respelt(spark: SparkSession, d: str) -> DataFrame:
    """Lines of plain letters with respelt words (SQL has no compatibility form for others; those are held by literal cases)."""
    s = speech(spark, d).filter(F.col("text").rlike("^[ -~]*$")).select("id", F.col("text").alias("said"))
    return casting.speakable(s, "said", {"harbour": "har-ber", "clerk": "clark"})
