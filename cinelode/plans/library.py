"""Flow A: from listings to the wanted library, with its pieces as queries of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelode.functions import patterns as P
from cinelode.functions import score as S
from cinelode.functions import text as T
from cinelode.operators import library as L
from cinelode.operators import reconcile as R
from cinelode.plans import views as V
from cinelode.plans.base import query, quoted
from cinelode.plans.views import EDGE, clean_show_steps, cut, got, has, stages, sub, trimmed
from cinelode.sources.tables import table


def words(xs: tuple[str, ...]) -> str:
    return "(" + ", ".join(quoted(x) for x in xs) + ")"


def sanitize(e: str) -> str:
    return f"coalesce(nullif({trimmed(trimmed(sub(e, P.BAD_CHARS)), chr(92) + '.')}, ''), 'untitled')"


def stem(e: str) -> str:
    return "regexp_replace(regexp_replace(" + e + r", '^.*/', ''), '(.)\.[^.]*$', '\1')"


EXT = r"lower(nullif(regexp_extract(coalesce(nullif(short_name, ''), name), '\.([^./]+)$', 1), ''))"
CLASS = f"CASE WHEN ext IN {words(P.VIDEO_EXT)} THEN 'video' WHEN ext IN {words(P.AUDIO_EXT)} THEN 'audio' WHEN ext IN {words(P.SUBTITLE_EXT)} THEN 'subtitle' WHEN ext IN {words(P.IMAGE_EXT)} THEN 'image' ELSE 'other' END"

PARTS = stages(
    "SELECT * FROM listed",
    {"head": "CASE WHEN contains(name, '/') THEN split_part(name, '/', 1) END", "ext": EXT},
    {"low": "min(head) OVER (PARTITION BY item_id)", "high": "max(head) OVER (PARTITION BY item_id)", "flat": "max(CAST(head IS NULL AS INTEGER)) OVER (PARTITION BY item_id)", "cls": CLASS},
    {"rel": "CASE WHEN flat = 0 AND low = high THEN substr(name, length(head) + 2) ELSE name END"},
    {"parts": f"list_transform(list_filter(string_split(rel, '/'), lambda x: x <> ''), lambda x: {sanitize('x')})"},
)
MEDIA = f"""media AS (SELECT *, parts[-1] AS last_part, CASE WHEN len(parts) > 1 THEN parts[-2] ELSE '' END AS folder_part FROM ({PARTS})
  WHERE cls IN ('video', 'audio') AND len(parts) > 0 AND len(list_filter(parts, lambda p: lower(p) IN ('sample', 'samples', 'proof'))) = 0
    AND NOT {has(stem('parts[-1]'), P.SAMPLE)} AND coalesce(size, 0) >= CASE WHEN cls = 'video' THEN {P.MIN_VIDEO} ELSE {P.MIN_AUDIO} END)"""
ROUTED = """routed AS (SELECT *, CASE WHEN any_video = 1 THEN 'video' ELSE 'music' END AS route
  FROM (SELECT *, max(CAST(cls = 'video' AS INTEGER)) OVER (PARTITION BY item_id) AS any_video FROM media) WHERE cls = 'video' OR any_video = 0)"""
BASE = f"WITH {V.LISTED}, {MEDIA}, {ROUTED}"


def pick(g: int) -> str:
    return f"CASE which WHEN 1 THEN {got('probe', P.EPISODE_TOKEN, g)} WHEN 2 THEN {got('probe', P.X_TOKEN, g)} WHEN 3 THEN {got('probe', P.DOT_EPISODE, g)} END"


#: Written from the survey: a two- or three-digit number between dots, perhaps with a version, before a quality word.
BETWEEN_DOTS = r"(?i)^(.+?)[.]([0-9]{2,3})(?:[.]v[0-9]+)?[.](?:(?:2160|1080|720|480)p|bluray|(?:br|bd)rip|web-?dl|hdtv|(?:x|h[.]?)26[45]|hevc)\b"
VOL = r"(?i)\b(?:vol|part|chapter)\.?$"
EPISODES = stages(
    "SELECT * FROM routed WHERE route = 'video'",
    {"probe": "replace(last_part, '_', ' ')", "looks_tv": has("name", P.TV), "stem": stem("last_part")},
    {"dash0": f"CASE WHEN NOT {has('regexp_extract(probe, ' + quoted(P.DASH_EPISODE) + ', 1)', VOL)} THEN coalesce({got('probe', P.DASH_EPISODE, 2)}, {got('probe', P.DASH_EPISODE, 3)}) END"},
    {"dash": f"coalesce(dash0, {got('probe', BETWEEN_DOTS, 2)})"},
    {"which": f"CASE WHEN {has('probe', P.EPISODE_TOKEN)} THEN 1 WHEN {has('probe', P.X_TOKEN)} THEN 2 WHEN {has('probe', P.DOT_EPISODE)} THEN 3 WHEN dash IS NOT NULL THEN 4 END"},
    {"dash_show": f"CASE WHEN which = 4 THEN CASE WHEN dash0 IS NOT NULL THEN {got('probe', P.DASH_EPISODE, 1)} ELSE {got('probe', BETWEEN_DOTS, 1)} END END"},
    {"own": got("dash_show", P.SEASON_END), "of_folder0": got("folder_part", P.SEASON_FOLDER), "prefix": f"CASE which WHEN 1 THEN {cut('probe', P.EPISODE_TOKEN)} WHEN 2 THEN {cut('probe', P.X_TOKEN)} WHEN 4 THEN dash_show END"},
    *clean_show_steps("prefix", "prefix_show"),
    *clean_show_steps("item", "item_show"),
    {
        "show0": "CASE WHEN which IS NOT NULL THEN coalesce(prefix_show, item_show) END",
        "season0": f"CASE WHEN which = 4 THEN coalesce(CAST(own AS INTEGER), CAST(of_folder0 AS INTEGER), 1) ELSE CAST({pick(1)} AS INTEGER) END",
        "episode0": f"CASE WHEN which = 4 THEN CAST(dash AS INTEGER) ELSE CAST({pick(2)} AS INTEGER) END",
    },
    {"bare": trimmed(sub("show0", P.SPECIALS_END), EDGE)},
    {"special": f"coalesce({has('show0', P.SPECIALS_END)} AND bare <> '', FALSE)"},
    {
        "shown": "CASE WHEN special THEN bare ELSE show0 END",
        "season": "CASE WHEN show0 IS NOT NULL THEN CASE WHEN special THEN 0 ELSE season0 END END",
        "named": "coalesce(show0 IS NOT NULL AND which IN (1, 2), FALSE)",
        "of_folder": "coalesce(show0 IS NOT NULL AND which = 4 AND own IS NULL AND of_folder0 IS NOT NULL AND NOT special, FALSE)",
    },
    {"episode": "CASE WHEN of_folder THEN CAST(row_number() OVER (PARTITION BY item_id, shown, season, of_folder ORDER BY episode0, id) AS INTEGER) WHEN show0 IS NOT NULL THEN episode0 END"},
)
FACTS = stages(
    f"SELECT * FROM ({EPISODES})",
    {"no_tv": "shown IS NULL AND NOT looks_tv"},
    *clean_show_steps("stem", "stem_title"),
    {"any_tv": "max(CAST(NOT no_tv AS INTEGER)) OVER (PARTITION BY item_id) = 1", "videos": "count(*) OVER (PARTITION BY item_id)", "others": "count(*) FILTER (WHERE no_tv) OVER (PARTITION BY item_id)", "yeared": "coalesce(" + has("stem_title", r"\((?:19|20)\d{2}\)$") + ", FALSE)"},
    {"is_release": f"no_tv AND (coalesce(size, 0) >= {P.MAIN_FILE} OR others = 1 OR yeared)"},
    {"main": "CASE WHEN is_release THEN lower(coalesce(stem_title, stem)) END"},
)
FACTS = f"episodes AS ({FACTS}), facts AS (SELECT e.*, m.mains FROM episodes e JOIN (SELECT item_id, count(DISTINCT main) AS mains FROM episodes GROUP BY item_id) m USING (item_id))"


@query(f"WITH {V.LISTED} SELECT kind, CAST(CASE kind WHEN 'torrents' THEN 0 WHEN 'usenet' THEN 1 ELSE 2 END AS INTEGER) AS kind_ord, count(DISTINCT item_id) AS items, count(*) AS files FROM listed GROUP BY ALL")
def s02_sources(spark: SparkSession, d: str) -> DataFrame:
    """Union of the three kinds of downloads with their order."""
    f = V.listed(spark, d)
    kinds = [f.filter(F.col("kind") == k).withColumn("kind_ord", F.lit(i)) for i, k in enumerate(("torrents", "usenet"))]
    rest = f.filter(~F.col("kind").isin("torrents", "usenet")).withColumn("kind_ord", F.lit(2))
    return kinds[0].unionByName(kinds[1]).unionByName(rest).groupBy("kind", "kind_ord").agg(F.count_distinct("item_id").alias("items"), F.count(F.lit(1)).alias("files"))


@query("SELECT i.id AS item_id, CASE WHEN f.id IS NULL THEN NULL ELSE CAST(row_number() OVER (PARTITION BY i.id ORDER BY f.id) - 1 AS INTEGER) END AS file_ord, f.id, f.name FROM (SELECT DISTINCT id FROM downloads) i LEFT JOIN (SELECT DISTINCT id, item_id, name FROM files) f ON f.item_id = i.id")
def s03_unnested(spark: SparkSession, d: str) -> DataFrame:
    """Items with nested files to rows with ordinals; items without files stay."""
    f = table(spark, d, "files", "id", "item_id", "name").dropDuplicates()
    nested = f.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("files"))
    items = table(spark, d, "downloads", "id").distinct().withColumnRenamed("id", "item_id").join(nested, "item_id", "left")
    return L.unnested(items).select("item_id", "file_ord", "file.id", "file.name")


@query(f"SELECT id, coalesce(lower(download_state) IN {words(P.READY_STATES)} OR download_present, download_present, FALSE) AS ready FROM (SELECT DISTINCT id, download_state, download_present FROM downloads)")
def p01_ready(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "downloads", "id", "download_state", "download_present").dropDuplicates()
    return i.select("id", F.coalesce(F.lower("download_state").isin(*P.READY_STATES) | F.col("download_present"), "download_present", F.lit(False)).alias("ready"))


@query(f"SELECT id, ext, {CLASS} AS cls, coalesce(ext IN {words(P.LOSSLESS_EXT)}, FALSE) AS lossless FROM (SELECT DISTINCT id, {EXT} AS ext FROM files)")
def p02_class(spark: SparkSession, d: str) -> DataFrame:
    shown = F.coalesce(F.nullif("short_name", F.lit("")), F.col("name"))
    f = table(spark, d, "files", "id", "name", "short_name").select("id", T.extension(shown).alias("ext"), T.file_class(shown).alias("cls")).dropDuplicates()
    return f.select("id", "ext", "cls", F.coalesce(F.col("ext").isin(*P.LOSSLESS_EXT), F.lit(False)).alias("lossless"))


@query(f"{BASE} SELECT id, array_to_string(parts, '|') AS parts, cls FROM media")
def p03_p04_media_files(spark: SparkSession, d: str) -> DataFrame:
    """Junk filter and common wrapper strip."""
    return L.media_files(V.listed(spark, d)).select("id", F.array_join("parts", "|").alias("parts"), "cls")


@query(f"{BASE} SELECT route, cls, count(*) AS files, count(DISTINCT item_id) AS items FROM routed GROUP BY ALL")
def p05_routes(spark: SparkSession, d: str) -> DataFrame:
    r = L.facts(L.media_files(V.listed(spark, d)))
    return r.groupBy("route", "cls").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("item_id").alias("items"))


@query(f"{BASE}, {FACTS} SELECT id, any_tv, CAST(videos AS BIGINT) AS videos, CAST(others AS BIGINT) AS others, is_release, CAST(mains AS BIGINT) AS mains FROM facts")
def p06_features(spark: SparkSession, d: str) -> DataFrame:
    """Whole-item facts by which a file counts as a feature."""
    df = L.facts(L.media_files(V.listed(spark, d))).filter("route = 'video'")
    return df.select("id", "any_tv", "videos", "others", "is_release", "mains")


@query(f"{BASE}, {FACTS} SELECT id, shown AS title, season, episode, named, of_folder FROM facts")
def f02_f03_w10_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Episode cascade, season of the folder, and renumbering within a season folder."""
    df = L.facts(L.media_files(V.listed(spark, d))).filter("route = 'video'")
    return df.select("id", F.col("ep.show").alias("title"), "ep.season", "ep.episode", "ep.named", "ep.of_folder")


SHOWS = stages("SELECT DISTINCT id, name, " + stem("name") + " AS st FROM files WHERE name IS NOT NULL", *clean_show_steps("st", "title"))


@query(f"SELECT id, title FROM ({SHOWS})")
def f01_clean_show(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files", "id", "name").dropDuplicates().filter("name is not null")
    return f.select("id", T.clean_show(T.stem(F.col("name"))).alias("title"))


F04 = f"SELECT DISTINCT id, {sanitize('last')} AS clean, CASE WHEN {has('last', P.DOT_EPISODE)} THEN 'S' || lpad(CAST(CAST(regexp_extract(last, {quoted(P.DOT_EPISODE)}, 1) AS INTEGER) AS VARCHAR), 2, '0') || 'E' || lpad(CAST(CAST(regexp_extract(last, {quoted(P.DOT_EPISODE)}, 2) AS INTEGER) AS VARCHAR), 2, '0') || ' - ' || {sub('last', P.DOT_EPISODE)} ELSE last END AS friendly FROM (SELECT id, regexp_replace(name, '^.*/', '') AS last FROM files WHERE name IS NOT NULL)"


@query(F04)
def f04_f05_names(spark: SparkSession, d: str) -> DataFrame:
    last = F.regexp_replace("name", "^.*/", "")
    return table(spark, d, "files", "id", "name").filter("name is not null").select("id", T.sanitize(last).alias("clean"), T.friendly_name(last).alias("friendly")).dropDuplicates()


def tags_steps(src: str, out: str) -> list[dict[str, str]]:
    """DuckDB steps of clean_audio_tags."""
    t = f"__{out}"
    steps = [{t + "0": sub(sub(sub(src, r"^\s*\([^)]*\)\s*"), r"\s*\{[^}]*\}\s*", " "), r"\s*\[[^\]]*\]\s*$")}]
    for i in range(4):
        steps.append({f"{t}{i + 1}": trimmed(sub(sub(f"{t}{i}", P.AUDIO_TAG_BRACKET, " "), P.AUDIO_TAG_TAIL), EDGE + r")\]}")})
    steps += [
        {t + "h": cut(t + "4", P.AUDIO_CUT)},
        {t + "5": f"CASE WHEN {trimmed(t + 'h', EDGE)} <> '' THEN {t}h ELSE {t}4 END"},
        {t + "6": trimmed(sub(sub(sub(t + "5", P.DISC_COUNT, " "), r"[\(\[\{]\s*[\)\]\}]", " "), r"\s{2,}", " "), EDGE)},
        {out: f"{t}6 || repeat(')', greatest(length({t}6) - length(replace({t}6, '(', '')) - length({t}6) + length(replace({t}6, ')', '')), 0))"},
    ]
    return steps


def album_steps(src: str, p: str) -> list[dict[str, str]]:
    """DuckDB steps of artist_album: columns {p}artist, {p}album, {p}year."""
    site = lambda e: trimmed(sub(e, P.SITE_PREFIX))
    dates, span = r"\b((?:19|20)\d{2})[.\-/](\d{1,2})[.\-/](\d{1,2})\b", r"\(?\b((?:19|20)\d{2})\s*[-–—]\s*(?:19|20)?\d{2,4}\)?"
    lead, bare, any_year = r"^\(?((?:19|20)\d{2})\)?[\s.\-–—]+(\S)", r"^\(?((?:19|20)\d{2})\)?$", r"\b((?:19|20)\d{2})\b"
    q = f"__{p}"
    return [
        {q + "a": sub(sub(sub(site(site(site(f"url_decode({src})"))), "_+", " "), dates, r"\1"), span, r"\1")},
        *tags_steps(q + "a", q + "b"),
        {q + "y": got(q + "b", lead), q + "c": sub(q + "b", lead, r"\2")},
        {q + "p": f"list_filter(list_transform(string_split({sub(q + 'c', r'[ ]*[ \t]+[-–—]\s*|\s*[-–—]\s+', chr(1))}, chr(1)), lambda x: {trimmed('x', EDGE)}), lambda x: x <> '')"},
        {q + "s": f"len({q}p) > 1 AND NOT {has(q + 'p[1]', bare)}"},
        {q + "n": f"CASE WHEN {q}s THEN {q}p[1] END", q + "r": f"CASE WHEN {q}s THEN {q}p[2:] ELSE {q}p END"},
        {q + "o": f"CASE WHEN {q}y IS NULL THEN {got(q + 'r[1]', bare)} END"},
        {q + "r2": f"CASE WHEN {q}o IS NOT NULL THEN {q}r[2:] ELSE {q}r END", q + "y2": f"coalesce({q}y, {q}o)"},
        {q + "l": trimmed(f"array_to_string({q}r2, ' - ')", EDGE)},
        {q + "i": f"CASE WHEN {q}y2 IS NULL AND {trimmed('regexp_extract(' + q + 'l, ' + quoted('(?s)^(.*?)' + any_year) + ', 1)', EDGE)} <> '' THEN {got(q + 'l', any_year)} END"},
        {q + "y3": f"coalesce({q}y2, {q}i)", q + "l2": f"CASE WHEN {q}i IS NOT NULL THEN {trimmed('regexp_replace(' + q + 'l, ' + quoted('(?s)^(.*?)' + any_year) + ', ' + quoted(chr(92) + '1 ') + ')', EDGE)} ELSE {q}l END"},
        {q + "l3": sub(q + "l2", r"[\(\[]\s*(?:19|20)\d{2}\s*[\)\]]?", " ")},
        {q + "l4": f"CASE WHEN {q}y3 IS NOT NULL THEN {sub(q + 'l3', chr(91) + chr(92) + 's,;.' + chr(92) + '-–—]*' + chr(92) + 'b(?:19|20)' + chr(92) + 'd{2}' + chr(92) + 's*$')} ELSE {q}l3 END"},
        *tags_steps(q + "l4", q + "l5"),
        {q + "n2": f"coalesce(nullif({trimmed(sub(q + 'n', r'\s*\([^)]*\)\s*$'))}, ''), {q}n)"},
        {q + "h": trimmed(f"split_part({q}n2, ',', 1)")},
        {p + "artist": f"nullif(CASE WHEN contains({q}n2, ',') AND {has(q + 'h', r'\S\s+\S')} THEN {q}h ELSE {q}n2 END, '')", p + "album": f"nullif({q}l5, '')", p + "year": f"CAST({q}y3 AS INTEGER)"},
    ]


ALBUMS = stages("SELECT DISTINCT id, name AS item FROM downloads WHERE name IS NOT NULL", *album_steps("item", "x_"))


@query(f"SELECT id, x_artist AS artist, x_album AS album, x_year AS yr FROM ({ALBUMS})")
def f06_f07_albums(spark: SparkSession, d: str) -> DataFrame:
    """Artist, album and year of every download's name."""
    i = table(spark, d, "downloads", "id", "name").dropDuplicates().filter("name is not null").withColumn("a", T.artist_album(F.col("name")))
    return i.select("id", "a.artist", "a.album", F.col("a.year").alias("yr"))


MUSIC_DIRS = stages(
    "SELECT * FROM routed WHERE route = 'music'",
    {"dirs": f"list_filter(parts[:-2], lambda p: lower(p) NOT IN {words(P.MUSIC_JUNK_DIRS)})"},
    {"named_dir": f"list_filter(dirs, lambda p: NOT {has('p', P.DISC_DIR)})[-1]", "discs": f"list_transform(list_filter(dirs, lambda p: {has('p', P.DISC_DIR)}), lambda p: 'CD ' || lpad(CAST(CAST(regexp_extract(p, {quoted(P.DISC_DIR)}, 1) AS INTEGER) AS VARCHAR), 2, '0'))"},
    *album_steps("item", "i_"),
    *album_steps("named_dir", "s_"),
    {"artist0": "CASE WHEN s_album IS NOT NULL THEN coalesce(s_artist, i_artist) ELSE i_artist END", "album0": "coalesce(s_album, i_album)", "year0": "CASE WHEN s_album IS NOT NULL THEN s_year ELSE i_year END"},
    {"artist": sanitize("coalesce(artist0, album0, item)"), "whole": "coalesce(album0, item) || CASE WHEN year0 IS NOT NULL THEN ' (' || year0 || ')' ELSE '' END"},
    {"album": sanitize("whole")},
)


@query(f"{BASE} SELECT id, artist, album, array_to_string(discs, '/') AS discs FROM ({MUSIC_DIRS}) WHERE coalesce(artist0, album0) IS NOT NULL")
def f08_music_dirs(spark: SparkSession, d: str) -> DataFrame:
    df = L.music_dirs(L.facts(L.media_files(V.listed(spark, d)))).filter("is_music")
    return df.select("id", "artist", "album", F.array_join("discs", "/").alias("discs"))


# Sheets, made by a rule of the item: every third download has one, some without a date or a performer.
SHEETS = "CASE WHEN item_id % 3 = 0 AND item_id % 2 = 0 THEN 'Sheet Artist ' || item_id % 5 END AS t_artist, CASE WHEN item_id % 3 = 0 THEN 'Sheet Album ' || item_id % 7 END AS t_album, CASE WHEN item_id % 3 = 0 AND item_id % 4 <> 0 THEN 1990 + item_id % 20 END AS t_year"
SHEET_DIRS = MUSIC_DIRS.replace("SELECT * FROM routed", f"SELECT *, {SHEETS} FROM routed").replace("coalesce(s_artist, i_artist) ELSE i_artist END", "coalesce(s_artist, t_artist, i_artist) ELSE coalesce(t_artist, i_artist) END").replace("coalesce(s_album, i_album)", "coalesce(s_album, t_album, i_album)").replace("THEN s_year ELSE i_year END", "THEN s_year ELSE CAST(coalesce(t_year, i_year) AS INTEGER) END")


@query(f"{BASE} SELECT id, artist, album FROM ({SHEET_DIRS}) WHERE coalesce(artist0, album0) IS NOT NULL")
def f08_sheet_dirs(spark: SparkSession, d: str) -> DataFrame:
    """Artist and album folders where cue sheets state what names only imply; the sheets are made by a rule of the item."""
    i = F.col("item_id")
    files = L.facts(L.media_files(V.listed(spark, d)))
    sheets = files.select("item_id").distinct().filter(i % 3 == 0).select("item_id", F.when(i % 2 == 0, F.concat(F.lit("Sheet Artist "), (i % 5).cast("string"))).alias("performer"), F.concat(F.lit("Sheet Album "), (i % 7).cast("string")).alias("title"), F.when(i % 4 != 0, 1990 + i % 20).alias("date"))
    return L.music_dirs(files, sheets).filter("is_music").select("id", "artist", "album")


YEARED = r"\((?:19|20)\d{2}\)$"
FILMS = stages(
    "SELECT * FROM facts WHERE no_tv",
    {"bonus": f"videos > 1 AND (len(parts) > 1 OR {has('stem', P.EXTRAS)} OR {has('stem', '(?i)' + chr(92) + 'bnc(?:op|ed)')})"},
    {"chosen": "CASE WHEN mains > 1 OR any_tv OR NOT bonus THEN coalesce(stem_title, item_show, item) ELSE coalesce(item_show, item) END"},
    {"better": f"CASE WHEN NOT coalesce({has('chosen', YEARED)}, FALSE) AND coalesce({has('item_show', YEARED)}, FALSE) THEN item_show ELSE chosen END"},
    {"folder": f"CASE WHEN any_tv AND NOT is_release THEN NULL ELSE {sanitize('better')} END"},
)


@query(f"{BASE}, {FACTS} SELECT id, folder, is_release FROM ({FILMS}) WHERE folder IS NOT NULL")
def f09_film_folders(spark: SparkSession, d: str) -> DataFrame:
    facts = L.facts(L.media_files(V.listed(spark, d))).filter("route = 'video'")
    return L.film_dir(facts.filter("no_tv")).filter("folder is not null").select("id", "folder", "is_release")


FRIENDLY_LAST = f"CASE WHEN {has('last_part', P.DOT_EPISODE)} THEN 'S' || lpad(CAST(CAST(regexp_extract(last_part, {quoted(P.DOT_EPISODE)}, 1) AS INTEGER) AS VARCHAR), 2, '0') || 'E' || lpad(CAST(CAST(regexp_extract(last_part, {quoted(P.DOT_EPISODE)}, 2) AS INTEGER) AS VARCHAR), 2, '0') || ' - ' || {sub('last_part', P.DOT_EPISODE)} ELSE last_part END"
SEASON_DIR = f"regexp_extract(array_to_string(parts[:-2], '/'), {quoted(P.SEASON_FOLDER)}, 1)"


def pad(e: str) -> str:
    return f"CASE WHEN {e} < 10 THEN '0' || {e} ELSE CAST({e} AS VARCHAR) END"


WANTED = f"""wanted AS (
  SELECT *, CASE kind WHEN 'torrents' THEN 0 WHEN 'usenet' THEN 1 ELSE 2 END AS kind_ord, folder || '/' || rest AS path FROM (
    SELECT 'tv' AS dest, {sanitize('shown')} AS folder, 'Season ' || {pad('season')} || '/' || CASE WHEN named THEN last_part ELSE 'S' || {pad('season')} || 'E' || {pad('episode')} || ' - ' || {FRIENDLY_LAST} END AS rest, kind, item_id, id, 0 AS lossy FROM facts WHERE shown IS NOT NULL
    UNION ALL SELECT 'tv', {sanitize('coalesce(item_show, item)')}, CASE WHEN {SEASON_DIR} <> '' THEN 'Season ' || {pad('CAST(' + SEASON_DIR + ' AS INTEGER)')} || '/' || last_part ELSE array_to_string(parts, '/') END, kind, item_id, id, 0 FROM facts WHERE shown IS NULL AND looks_tv
    UNION ALL SELECT 'movies', folder, CASE WHEN is_release THEN last_part ELSE 'Featurettes/' || last_part END, kind, item_id, id, 0 FROM ({FILMS}) WHERE folder IS NOT NULL
    UNION ALL SELECT 'music', artist || '/' || album, CASE WHEN len(discs) > 0 THEN array_to_string(discs, '/') || '/' ELSE '' END || {stem('last_part')}, kind, item_id, id, CAST(ext NOT IN {words(P.LOSSLESS_EXT)} AS INTEGER) FROM ({MUSIC_DIRS}) WHERE coalesce(artist0, album0) IS NOT NULL))"""
FULL = f"{BASE}, {FACTS}, {WANTED}"


@query(f"{FULL} SELECT dest, path, kind, item_id, id FROM wanted")
def library_wanted(spark: SparkSession, d: str) -> DataFrame:
    """Flow A up to the wanted entries."""
    return L.wanted(V.listed(spark, d)).select("dest", "path", "kind", "item_id", "id")


@query(f"{FULL} SELECT dest, path, id, skipped FROM (SELECT *, row_number() OVER (PARTITION BY dest, path ORDER BY kind_ord, lossy, item_id, id) AS r, count(*) OVER (PARTITION BY dest, path) - 1 AS skipped FROM wanted) WHERE r = 1")
def r02_t12_first_source(spark: SparkSession, d: str) -> DataFrame:
    """First source of each path, lossless first."""
    return L.first_source(L.wanted(V.listed(spark, d))).select("dest", "path", "id", "skipped")


# Aliases of shows, as a setting: variant (lower case) to title (lower case).
ALIASED = """al AS (SELECT variant, min(title) AS title FROM (SELECT lower(unnest(aliases)) AS variant, lower("show") AS title FROM season) WHERE variant IS NOT NULL AND title IS NOT NULL AND variant <> title GROUP BY 1)"""
YEAR_SUFFIX = r"\s*\((?:19|20)[0-9]{2}(?:-(?:19|20)[0-9]{2})?\)$"
FOLDERS = f"""{FULL}, {ALIASED}, v AS (SELECT dest, folder, count(*) AS n FROM wanted WHERE dest IN ('tv', 'movies') GROUP BY ALL),
b0 AS (SELECT *, lower(regexp_replace(folder, '{YEAR_SUFFIX}', '')) AS bare, regexp_matches(folder, '{YEAR_SUFFIX}') AS yeared FROM v),
b1 AS (SELECT b0.*, coalesce(w.title, x.title) AS aliased FROM b0 LEFT JOIN al w ON w.variant = lower(folder) LEFT JOIN al x ON x.variant = bare),
b2 AS (SELECT *, coalesce(aliased, bare) AS base, max(CAST(aliased IS NOT NULL AS INTEGER)) OVER (PARTITION BY dest, coalesce(aliased, bare)) = 1 AND lower(folder) = coalesce(aliased, bare) AS spelt FROM b1),
folders AS (SELECT dest, folder, first_value(folder) OVER (PARTITION BY dest, base ORDER BY CAST(spelt AS INTEGER) DESC, CASE WHEN spelt AND folder = upper(folder) THEN 1 ELSE 0 END, CAST(yeared AS INTEGER) DESC, CASE WHEN yeared THEN 0 ELSE -n END, folder) AS canon, n, count(*) OVER (PARTITION BY dest, base) AS variants FROM b2),
moved AS (SELECT w.* REPLACE (coalesce(f.canon, w.folder) AS folder, coalesce(f.canon, w.folder) || '/' || w.rest AS path) FROM wanted w LEFT JOIN folders f ON f.dest = w.dest AND f.folder = w.folder)"""


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "season", "show", "aliases").select(F.explode(F.transform("aliases", F.lower)).alias("variant"), F.lower("show").alias("title"))
    return s.filter("variant is not null and title is not null and variant <> title")


@query(f"{FOLDERS} SELECT * FROM folders")
def a04_a05_r03_folders(spark: SparkSession, d: str) -> DataFrame:
    """Variants of folder names with their counts and the one to keep, aliases of shows included."""
    return L.canonical_folders(L.wanted(V.listed(spark, d)), _aliases(spark, d))


@query(f"{FOLDERS} SELECT dest, path, id, skipped FROM (SELECT *, row_number() OVER (PARTITION BY dest, path ORDER BY kind_ord, lossy, item_id, id) AS r, count(*) OVER (PARTITION BY dest, path) - 1 AS skipped FROM moved) WHERE r = 1")
def r03_merged_library(spark: SparkSession, d: str) -> DataFrame:
    """The library after folders are merged: paths that fall together have one source again."""
    return L.first_source(L.merged_folders(L.wanted(V.listed(spark, d)), _aliases(spark, d))).select("dest", "path", "id", "skipped")


QSCORE = f"CASE WHEN contains(f, 'remux') THEN -1000 WHEN {has('f', P.UPSCALE)} THEN -2000 ELSE (CASE WHEN contains(f, '2160p') THEN 4 WHEN contains(f, '1080p') THEN 3 WHEN contains(f, '720p') THEN 2 WHEN contains(f, '480p') THEN 1 ELSE 0 END) * 100 + CASE WHEN {has('f', 'blu-?ray')} THEN 10 ELSE 0 END + CASE WHEN {has('f', P.HDR)} THEN 5 ELSE 0 END - CASE WHEN {has('f', P.FOREIGN)} AND NOT {has('f', P.WITH_ORIGINAL)} THEN 30 ELSE 0 END END"
T01 = f"""{FOLDERS}, q AS (SELECT *, lower(folder) AS title, CAST(regexp_extract(rest, '^Season (\\d+)/', 1) AS INTEGER) AS season, CAST(regexp_extract(regexp_extract(rest, '/(.*)$', 1), {quoted(P.EPISODE_TOKEN)}, 2) AS INTEGER) AS episode, lower(regexp_extract(rest, '/(.*)$', 1)) AS f
  FROM moved WHERE dest = 'tv' AND regexp_matches(rest, '^Season \\d+/[^/]+$') AND {has('rest', P.EPISODE_TOKEN)}),
s AS (SELECT *, CAST({QSCORE} AS INTEGER) AS score FROM q)
SELECT title, season, episode, id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY title, season, episode ORDER BY score DESC, kind_ord, item_id, id) AS r FROM s) WHERE r = 1"""


@query(T01)
def t01_m01_best_episodes(spark: SparkSession, d: str) -> DataFrame:
    """The best copy of each episode, variants of a show's folder taken together: the flagship."""
    return L.best_copies(L.merged_folders(L.wanted(V.listed(spark, d)), _aliases(spark, d))).select(F.col("show").alias("title"), "season", "episode", "id", "item_id", "score")


@query(f"{FOLDERS}, s AS (SELECT *, CAST({QSCORE} AS INTEGER) AS score FROM (SELECT *, lower(rest) AS f FROM moved WHERE dest = 'movies' AND NOT contains(rest, '/'))) SELECT folder, id, score FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY score DESC, kind_ord, item_id, id) AS r FROM s) WHERE r = 1")
def t02_best_films(spark: SparkSession, d: str) -> DataFrame:
    return L.best_films(L.merged_folders(L.wanted(V.listed(spark, d)), _aliases(spark, d))).select("folder", "id", "score")


# The tables list no images, so every file stands for one, with a name made for it and its size brought into the range of covers.
COVER_NAMES_CASE = "CASE " + " ".join(f"WHEN contains(s, '{n}') THEN {i}" for i, n in enumerate(P.COVER_NAMES)) + f" ELSE {len(P.COVER_NAMES)} END"
T05 = f"""WITH f AS (SELECT DISTINCT id, item_id, CASE id % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'scan back' ELSE 'page' END || id % 4 || '.jpg' AS nm, size % 30000000 AS size FROM files),
s AS (SELECT *, {stem('nm')} AS s FROM f WHERE size > {P.COVER_MIN} AND size < {P.COVER_MAX}),
r AS (SELECT *, {COVER_NAMES_CASE} + CASE WHEN {has('s', P.BACK_COVER)} THEN {len(P.COVER_NAMES)} ELSE 0 END AS rnk FROM s)
SELECT item_id, id, CAST(rnk AS INTEGER) AS rnk, size FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rnk, size DESC, id) AS n FROM r) WHERE n = 1"""


@query(T05)
def t05_p26_covers(spark: SparkSession, d: str) -> DataFrame:
    """Cover pick; every file is taken as an image here, under a made name, as the tables list none."""
    f = table(spark, d, "files", "id", "item_id", "size").dropDuplicates()
    kind = F.when(F.col("id") % 3 == 0, "front").when(F.col("id") % 3 == 1, "scan back").otherwise("page")
    f = f.select("id", "item_id", F.concat(kind, (F.col("id") % 4).cast("string"), F.lit(".jpg")).alias("name"), F.lit(None).cast("string").alias("short_name"), (F.col("size") % 30_000_000).alias("size"))
    return L.covers(f).select("item_id", "id", F.col("rank").alias("rnk"), "size")


# Existing entries: paths of the files with an even id (others are new), with an older source where the id divides by 6,
# and stale ones made of item names.
EXISTING = """w AS (SELECT dest || '/' || path AS path, min(id) AS id FROM wanted GROUP BY 1),
e AS (SELECT path, CASE WHEN id % 6 = 0 THEN id - 1 ELSE id END AS id FROM w WHERE id % 2 = 0 UNION ALL SELECT DISTINCT 'old/' || item, 0 FROM listed WHERE item_id % 4 = 0)"""
R01 = f"{FULL}, {EXISTING}, x AS (SELECT coalesce(w.path, e.path) AS path, CASE WHEN w.path IS NULL THEN 'stale' WHEN e.path IS NULL THEN 'created' WHEN w.id = e.id THEN 'unchanged' ELSE 'updated' END AS action FROM w FULL OUTER JOIN e ON w.path = e.path)"


def _planned(spark: SparkSession, d: str) -> DataFrame:
    files = V.listed(spark, d)
    w = L.wanted(files).groupBy(F.concat_ws("/", "dest", "path").alias("path")).agg(F.min("id").alias("id"))
    e = w.filter("id % 2 = 0").withColumn("id", F.when(F.col("id") % 6 == 0, F.col("id") - 1).otherwise(F.col("id")))
    old = files.filter("item_id % 4 = 0").select(F.concat(F.lit("old/"), "item").alias("path"), F.lit(0).cast("long").alias("id")).distinct()
    return R.actions(w, e.unionByName(old), "path", "id")


@query(f"{R01} SELECT path, action FROM x")
def r01_s21_j07_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Wanted against existing: created, updated, unchanged, stale."""
    return _planned(spark, d)


@query(f"{R01} SELECT count(*) FILTER (WHERE action = 'stale') AS stale, count(*) FILTER (WHERE action <> 'created') AS existing, CASE WHEN count(*) FILTER (WHERE action = 'stale') > 0.25 * count(*) FILTER (WHERE action <> 'created') AND count(*) FILTER (WHERE action <> 'created') >= 20 THEN 'would delete ' || count(*) FILTER (WHERE action = 'stale') || '/' || count(*) FILTER (WHERE action <> 'created') || ' files' END AS block FROM x")
def r06_a20_prune_gate(spark: SparkSession, d: str) -> DataFrame:
    return R.prune_gate(_planned(spark, d))


@query("SELECT DISTINCT id, lower(regexp_replace(name, '[^\\p{L}\\p{N}_]+', '', 'g')) AS word_key, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS ascii_key, substr(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS slug FROM downloads WHERE name IS NOT NULL")
def f11_f12_f20_keys(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("name")
    return table(spark, d, "downloads", "id", "name").filter("name is not null").select("id", T.word_key(c).alias("word_key"), T.ascii_key(c).alias("ascii_key"), T.slug(c).alias("slug")).dropDuplicates()


@query("SELECT count(*) FILTER (WHERE starts_with(s, 'uploading') OR starts_with(s, 'stalled')) AS busy, CAST(greatest(0, 500 - count(*) FILTER (WHERE starts_with(s, 'uploading') OR starts_with(s, 'stalled'))) AS BIGINT) AS free FROM (SELECT DISTINCT id, lower(download_state) AS s FROM downloads)")
def a21_slots(spark: SparkSession, d: str) -> DataFrame:
    """Busy and free slots by state prefix (the states of these tables)."""
    i = table(spark, d, "downloads", "id", "download_state").dropDuplicates()
    busy = F.count_if(F.lower("download_state").startswith("uploading") | F.lower("download_state").startswith("stalled"))
    return i.agg(busy.alias("busy")).withColumn("free", F.greatest(F.lit(0), F.lit(500) - F.col("busy")).cast("long"))
