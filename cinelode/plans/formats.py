"""Formats: subtitle files and logs among the documents, cue sheets, links, templates, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelode.functions import text as T
from cinelode.plans.base import query
from cinelode.sources import readers as R
from cinelode.sources.tables import table
from cinelode.streaming import logs

MS = "CAST(round((CAST(split_part({0}, ':', 1) AS DOUBLE) * 3600 + CAST(split_part({0}, ':', 2) AS DOUBLE) * 60 + CAST(replace(split_part({0}, ':', 3), ',', '.') AS DOUBLE)) * 1000) AS BIGINT)"
NL = "regexp_replace(regexp_replace(text, chr(13) || chr(10), chr(10), 'g'), chr(13), chr(10), 'g')"
S09 = f"""WITH l AS (SELECT doc_id, unnest(string_split({NL}, chr(10))) AS line, generate_subscripts(string_split({NL}, chr(10)), 1) - 1 AS n FROM documents WHERE contains(text, 'Dialogue:')),
p AS (SELECT doc_id, n, string_split(b, ',') AS f, b FROM (SELECT doc_id, n, regexp_replace(line, '^\\s*Dialogue:\\s*', '') AS b FROM l WHERE regexp_matches(line, '^\\s*Dialogue:')))
SELECT doc_id, CAST(n AS INTEGER) AS n, {MS.format('trim(f[2])')} AS st, {MS.format('trim(f[3])')} AS en, upper(trim(f[5])) AS actor, array_to_string(f[10:], ',') AS text FROM p
WHERE len(f) >= 10 AND regexp_matches(trim(f[2]), '^\\d+:\\d+:\\d+(\\.\\d+)?$') AND regexp_matches(trim(f[3]), '^\\d+:\\d+:\\d+(\\.\\d+)?$')"""


@query(S09)
def s09_ass_events(spark: SparkSession, d: str) -> DataFrame:
    """Dialogue lines of the ASS files among the documents."""
    docs = table(spark, d, "documents", "doc_id", "text").filter(F.col("text").contains("Dialogue:"))
    return R.ass_events(R.lines_of(docs, "doc_id", "text"), "doc_id").select("doc_id", "n", "st", "en", "actor", "text")


STAMPS = r"(\d{1,2}:\d{2}:\d{2}[,.]\d{1,3})\s*-->\s*(\d{1,2}:\d{2}:\d{2}[,.]\d{1,3})[^\n]*\n?([\s\S]*)"
S10 = f"""WITH b AS (SELECT doc_id, unnest(string_split(regexp_replace({NL}, '\\n[ \\t]*\\n+', chr(1), 'g'), chr(1))) AS block FROM documents WHERE contains(text, '-->') AND NOT contains(text, 'Dialogue:'))
SELECT doc_id, {MS.format("regexp_extract(block, '" + STAMPS + "', 1)")} AS st, {MS.format("regexp_extract(block, '" + STAMPS + "', 2)")} AS en, regexp_replace(regexp_replace(regexp_extract(block, '{STAMPS}', 3), '\\s*\\n\\s*', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text
FROM b WHERE regexp_matches(block, '\\d:\\d{{2}}[,.]\\d{{1,3}}\\s*-->') AND regexp_matches(block, '{STAMPS}')"""


@query(S10)
def s10_srt_events(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the SRT files among the documents."""
    docs = table(spark, d, "documents", "doc_id", "text").filter(F.col("text").contains("-->") & ~F.col("text").contains("Dialogue:"))
    return R.srt_events(docs, "doc_id", "text").select("doc_id", "st", "en", "text")


# A sheet is written for each show of the bank and read back: one track a speaker, starts by the seconds before it.
CUE = """WITH b AS (SELECT show_id, speaker, seconds, row_number() OVER (PARTITION BY show_id ORDER BY speaker) AS num, coalesce(sum(CAST(round(seconds * 75) AS BIGINT)) OVER (PARTITION BY show_id ORDER BY speaker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM bank)
SELECT show_id, CAST(num AS INTEGER) AS num, speaker AS title, round(f / 75.0, 6) AS start, round((lead(f) OVER (PARTITION BY show_id ORDER BY num) - f) / 75.0, 6) AS duration, CAST(1990 + show_id % 30 AS INTEGER) AS yr FROM b"""


@query(CUE.replace("round(f / 75.0, 6)", "CAST(round(f / 75.0, 6) AS DOUBLE)").replace("round((lead", "CAST(round((lead").replace("/ 75.0, 6) AS duration", "/ 75.0, 6) AS DOUBLE) AS duration"))
def s11_w12_w17_f18_cue_sheets(spark: SparkSession, d: str) -> DataFrame:
    """CUE sheets written and parsed again, with track spans."""
    w = W.partitionBy("show_id").orderBy("speaker")
    b = table(spark, d, "bank", "show_id", "speaker", "seconds").withColumns({"num": F.row_number().over(w), "f": F.coalesce(F.sum(F.round(F.col("seconds") * 75).cast("long")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    stamp = F.format_string("%02d:%02d:%02d", F.floor(F.col("f") / 4500), F.floor(F.col("f") / 75) % 60, F.col("f") % 75)
    track = F.concat(F.format_string("  TRACK %02d AUDIO\n    TITLE \"%s\"\n    INDEX 01 ", "num", "speaker"), stamp)
    sheets = b.groupBy("show_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("num", track.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    text = F.concat(F.lit("REM DATE "), (1990 + F.col("show_id") % 30).cast("string"), F.lit('\nPERFORMER "Cast"\nFILE "cast.wav" WAVE\n'), F.col("body"))
    t = R.track_spans(R.cue_tracks(R.lines_of(sheets.withColumn("text", text), "show_id", "text"), "show_id"), "show_id")
    return t.select("show_id", "num", "title", F.round("start", 6).alias("start"), F.round("duration", 6).alias("duration"), F.col("date").alias("yr"))


@query("SELECT id, 'https://host/get/' || id || '?file=' || id AS url, '/get/' || id || '?file=' || id AS packed, translate(to_base64(encode('https://host/get/' || id || '?file=' || id || '~~~')), '+/', '-_') AS b64 FROM (SELECT DISTINCT id FROM files)")
def s28_f22_links(spark: SparkSession, d: str) -> DataFrame:
    """Links packed without host and key, and URL-safe base64."""
    i = table(spark, d, "files", "id").distinct().withColumn("s", F.col("id").cast("string"))
    url = F.concat(F.lit("https://host/get/"), "s", F.lit("?file="), "s")
    return i.select("id", url.alias("url"), R.packed_url(F.concat(url, F.lit("&apikey=secret"))).alias("packed"), T.url_safe_base64(F.concat(url, F.lit("~~~"))).alias("b64"))


@query("SELECT season_id, replace(replace('{show} S{s}E{e}', '{show}', \"show\"), 'S{s}E{e}', 'S' || lpad(CAST(coalesce(season, 1) AS VARCHAR), 2, '0') || 'E' || lpad(CAST(coalesce(episodes, 12) AS VARCHAR), 2, '0')) AS q FROM season")
def f21_templates(spark: SparkSession, d: str) -> DataFrame:
    """Query templates filled for each plan."""
    c = F.concat("show", F.lit(" S{season:02d}E{ep:02d}"))
    return table(spark, d, "season", "season_id", "show", "season", "episodes").select("season_id", T.fill_template(c, F.coalesce("season", F.lit(1)), F.coalesce("episodes", F.lit(12))).alias("q"))


@query("SELECT season_id, coalesce(season, 1) AS season, coalesce(episodes, 12) AS episodes, coalesce(python, 'python3') AS python, coalesce(queue, 'card') AS queue, array_to_string(coalesce(options, []), ' ') AS options FROM season")
def s16_plans(spark: SparkSession, d: str) -> DataFrame:
    """Plans with defaults laid over what they leave out."""
    s = table(spark, d, "season")
    return s.select("season_id", F.coalesce("season", F.lit(1)).alias("season"), F.coalesce("episodes", F.lit(12)).alias("episodes"), F.coalesce("python", F.lit("python3")).alias("python"), F.coalesce("queue", F.lit("card")).alias("queue"), F.array_join(F.coalesce("options", F.array().cast("array<string>")), " ").alias("options"))


@query("WITH p AS (SELECT season_id, unnest(generate_series(1, episodes)) AS ep FROM season WHERE episodes IS NOT NULL), h AS (SELECT season_id, (season_id * 7 + e * 3) % 15 + 1 AS ep FROM season, unnest(generate_series(1, 6)) AS t(e)) SELECT season_id, CAST(ep AS INTEGER) AS ep, p.ep IS NOT NULL AS declared, h.ep IS NOT NULL AS found FROM p FULL OUTER JOIN (SELECT DISTINCT * FROM h) h USING (season_id, ep)")
def j18_st5_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Declared and discovered episodes of each plan; what is found on disk is a rule of the numbers here."""
    s = table(spark, d, "season", "season_id", "episodes")
    p = s.filter("episodes is not null").select("season_id", F.explode(F.sequence(F.lit(1), "episodes")).alias("ep"), F.lit(True).alias("declared"))
    h = s.select("season_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("e")).select("season_id", ((F.col("season_id") * 7 + F.col("e") * 3) % 15 + 1).alias("ep"), F.lit(True).alias("found")).distinct()
    j = p.join(h, ["season_id", "ep"], "full_outer")
    return j.select("season_id", "ep", F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("found", F.lit(False)).alias("found"))


@query("SELECT id, size % 10000 + 44 AS length, least(coalesce(CASE WHEN id % 3 = 0 THEN id * 5 END, size % 10000 + 43), size % 10000 + 43) AS last, id % 12000 < size % 10000 + 44 AS ok FROM (SELECT DISTINCT id, size FROM files WHERE size > 0)")
def m14_s24_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Byte ranges of slices clamped to the file, satisfiable or not."""
    from cinelode.functions import score as S

    f = table(spark, d, "files", "id", "size").filter("size > 0").dropDuplicates()
    # One byte a frame, one frame a second: the size stands for the seconds.
    r = S.byte_range((F.col("size") % 10000).cast("double"), F.lit(1), F.lit(1), F.lit(8), F.col("id") % 12000, F.when(F.col("id") % 3 == 0, F.col("id") * 5))
    return f.withColumn("r", r).select("id", "r.length", "r.last", "r.ok")


@query("WITH a AS (SELECT DISTINCT id, md5(name) AS have FROM downloads WHERE name IS NOT NULL), m AS (SELECT DISTINCT id, CASE WHEN id % 8 = 0 THEN md5(name || 'x') ELSE md5(name) END AS want FROM downloads WHERE name IS NOT NULL AND id % 5 <> 0) SELECT a.id, CASE WHEN want IS NULL THEN 'unlisted' WHEN want = have THEN 'ok' ELSE 'differs' END AS state FROM a LEFT JOIN m USING (id)")
def j20_checksums(spark: SparkSession, d: str) -> DataFrame:
    """Checksums against a manifest, made here from the names with every eighth changed."""
    a = table(spark, d, "downloads", "id", "name").dropDuplicates().filter("name is not null")
    m = a.filter("id % 5 <> 0").select("id", F.when(F.col("id") % 8 == 0, F.md5(F.concat("name", F.lit("x")))).otherwise(F.md5("name")).alias("want"))
    return a.join(m, "id", "left").select("id", F.when(F.col("want").isNull(), "unlisted").when(F.col("want") == F.md5("name"), "ok").otherwise("differs").alias("state"))


# Media items: subtitle streams are made from the language column of the documents.
@query("SELECT doc_id, coalesce(lower(nullif(lang, '')), '') IN ('en', 'eng', 'english') AS english, lang IS NULL AS unprobed FROM documents")
def p20_s26_languages(spark: SparkSession, d: str) -> DataFrame:
    """Whether an item has English subtitles, and items that were never probed."""
    stream = F.struct(F.lit("Subtitle").alias("Type"), F.col("lang").alias("Language"), F.lit(None).cast("string").alias("DisplayLanguage"))
    streams = F.when(F.col("lang").isNotNull(), F.array(stream)).otherwise(F.array_remove(F.array(stream), stream))
    return table(spark, d, "documents", "doc_id", "lang").withColumn("s", streams).select("doc_id", R.has_language(F.col("s"), ("en", "eng", "english")).alias("english"), (F.size("s") == 0).alias("unprobed"))


# Tracks of a show: one for each of its documents; the language rule picks one.
P21 = """WITH t AS (SELECT doc_id, show_id, coalesce(lower(lang), 'und') AS lang, coalesce(lower(source), '') AS title FROM documents WHERE show_id IS NOT NULL),
r AS (SELECT *, CASE WHEN lang IN ('en', 'eng') THEN 1 WHEN lang = 'und' AND count(*) FILTER (WHERE lang = 'und') OVER (PARTITION BY show_id) = 1 THEN 2 WHEN lang = 'und' AND contains(title, 'forum') THEN 3 WHEN lang = 'und' THEN 4 END AS rule FROM t)
SELECT show_id, doc_id, CAST(rule AS INTEGER) AS rule FROM (SELECT *, row_number() OVER (PARTITION BY show_id ORDER BY rule, CASE WHEN rule = 4 THEN -doc_id ELSE doc_id END) AS n FROM r WHERE rule IS NOT NULL) WHERE n = 1"""


@query(P21)
def p21_p22_track_choice(spark: SparkSession, d: str) -> DataFrame:
    """Track choice: English first, a sole untagged one, one by title, else the last untagged."""
    t = table(spark, d, "documents", "doc_id", "show_id", "lang", "source").filter("show_id is not null").select("doc_id", "show_id", F.coalesce(F.lower("lang"), F.lit("und")).alias("lang"), F.coalesce(F.lower("source"), F.lit("")).alias("title"))
    und = t.groupBy(F.col("show_id").alias("__s")).agg(F.count_if(F.col("lang") == "und").alias("n_und"))
    t = t.join(und, F.col("show_id") == F.col("__s"))
    rule = F.when(F.col("lang").isin("en", "eng"), 1).when((F.col("lang") == "und") & (F.col("n_und") == 1), 2).when((F.col("lang") == "und") & F.col("title").contains("forum"), 3).when(F.col("lang") == "und", 4)
    t = t.withColumn("rule", rule).filter("rule is not null").withColumn("o", F.when(F.col("rule") == 4, -F.col("doc_id")).otherwise(F.col("doc_id")))
    best = t.groupBy("show_id").agg(F.min(F.struct("rule", "o", "doc_id")).alias("m"))
    return best.select("show_id", "m.doc_id", "m.rule")


@query("SELECT id, size > 0 AND coalesce(name LIKE '%.mp4', FALSE) AS copy, array_to_string(list_filter([CASE WHEN size IS NULL THEN 'size' END, CASE WHEN name IS NULL OR trim(name) = '' THEN 'name' END, CASE WHEN listed_at IS NULL THEN 'time' END], lambda x: x IS NOT NULL), ',') AS blockers, CASE WHEN id % 3 = 0 THEN 24 ELSE 16 END AS bits FROM (SELECT DISTINCT id, size, name, listed_at FROM files)")
def p23_p25_m15_checks(spark: SparkSession, d: str) -> DataFrame:
    """Copy or transcode, a list of blockers, and an inferred bit depth, on the files' own columns."""
    f = table(spark, d, "files", "id", "size", "name", "listed_at").dropDuplicates()
    blockers = F.array_compact(F.array(F.when(F.col("size").isNull(), "size"), F.when(F.col("name").isNull() | (F.trim("name") == ""), "name"), F.when(F.col("listed_at").isNull(), "time")))
    return f.select("id", ((F.col("size") > 0) & F.coalesce(F.col("name").endswith(".mp4"), F.lit(False))).alias("copy"), F.array_join(blockers, ",").alias("blockers"), F.when(F.col("id") % 3 == 0, 24).otherwise(16).alias("bits"))


@query("SELECT kind, id, added_at FROM (SELECT DISTINCT kind, id, added_at, row_number() OVER (PARTITION BY kind ORDER BY added_at DESC NULLS LAST, id) AS r FROM (SELECT DISTINCT kind, id, added_at FROM downloads)) WHERE r = 1")
def t11_t13_latest_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """The newest of each kind, unknown times last, first on ties."""
    i = table(spark, d, "downloads", "kind", "id", "added_at").dropDuplicates()
    m = i.groupBy("kind").agg(F.max(F.struct("added_at", (-F.col("id")).alias("k"))).alias("m"))
    return m.select("kind", (-F.col("m.k")).alias("id"), "m.added_at")


@query("SELECT s.show_id, b.speaker, b.actor IS NOT NULL AS by_actor, coalesce(b.actor, b.speaker) AS name FROM (SELECT DISTINCT show_id FROM season) s JOIN bank b USING (show_id)")
def j02_alias_default(spark: SparkSession, d: str) -> DataFrame:
    """Lookup in a small dimension with the key itself as default."""
    s = table(spark, d, "season", "show_id").distinct()
    b = table(spark, d, "bank", "show_id", "speaker", "actor")
    return b.join(s, "show_id").select("show_id", "speaker", F.col("actor").isNotNull().alias("by_actor"), F.coalesce("actor", "speaker").alias("name"))


LOG = logs.SQL


@query(LOG)
def st1_log_monitor(spark: SparkSession, d: str) -> DataFrame:
    """The log monitor's batch twin over the render logs among the documents."""
    docs = table(spark, d, "documents", "doc_id", "text", "source").filter("source = 'render_logs' and text is not null")
    return logs.findings(R.lines_of(docs, "doc_id", "text"), "doc_id")
