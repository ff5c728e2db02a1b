"""Flow C, first half: from script lines to annotated utterances, overlaps and scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelode.functions import patterns as P
from cinelode.functions import text as T
from cinelode.operators import casting, ordered, render
from cinelode.operators import script as O
from cinelode.plans import views as V
from cinelode.plans.base import query, quoted
from cinelode.plans.library import words
from cinelode.plans.views import has, sub, trimmed
from cinelode.sources.tables import table

SPEECH = f"WITH {V.LINES}, speech AS (SELECT * FROM lines WHERE kind = 'speech')"
CLEAN = trimmed(sub(sub(sub(sub("text", r"\{[^}]*\}"), r"\\[Nnh]", " "), P.GLOSS, r"\2"), r"\s+", " "))


def speech(spark: SparkSession, d: str) -> DataFrame:
    return V.lines(spark, d).filter("kind = 'speech'")


STYLED = " OR ".join(f"contains(lower(coalesce(style, '')), '{h}')" for h in P.DIALOGUE_STYLES)


@query(f"WITH u AS (SELECT DISTINCT id, text, style, array_to_string(regexp_extract_all(coalesce(text, ''), '\\{{([^}}]*)\\}}', 1), ' ') AS tags FROM utterances) SELECT id, CASE WHEN {has('tags', P.DRAWING)} THEN 'drawing' WHEN {has(chr(108) + 'ower(coalesce(style, ' + quoted('') + '))', P.SONG_STYLE)} THEN 'song' WHEN {has('tags', P.TYPESET)} OR NOT ({STYLED}) THEN 'sign' ELSE 'speech' END AS event_kind FROM u")
def p13_event_kinds(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "utterances", "id", "text", "style").dropDuplicates()
    return u.select("id", T.event_kind(F.col("text"), F.col("style")).alias("event_kind"))


@query(f"SELECT DISTINCT id, coalesce(lower({trimmed('speaker')}) IN {words(P.GROUP_LABELS)} OR contains(speaker, '/') OR contains(speaker, '&'), FALSE) AS is_crowd, array_to_string(CASE WHEN len(m) > 1 THEN m ELSE [] END, '|') AS named FROM (SELECT id, speaker, list_filter(list_transform(string_split({sub('speaker', P.GROUP_SEPARATOR, chr(1))}, chr(1)), lambda x: {trimmed('x')}), lambda x: x <> '') AS m FROM utterances WHERE speaker IS NOT NULL)")
def p14_f16_groups(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "utterances", "id", "speaker").filter("speaker is not null")
    return u.select("id", T.is_group(F.col("speaker")).alias("is_crowd"), F.array_join(T.group_members(F.col("speaker")), "|").alias("named")).dropDuplicates()


ANCHOR = trimmed(sub(sub(f"lower({sub(sub('text', chr(92) + '{[^}]*' + chr(92) + '}|<[^>]*>'), r'\\[Nnh]', ' ')})", "[^a-z0-9 ]", " "), r"\s+", " "))


@query(f"SELECT DISTINCT id, {CLEAN} AS said, {ANCHOR} AS anchor FROM utterances WHERE text IS NOT NULL")
def f13_f14_clean_text(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "utterances", "id", "text").filter("text is not null")
    return u.select("id", T.clean_speech(F.col("text")).alias("said"), T.clean_anchor(F.col("text")).alias("anchor")).dropDuplicates()


ATTRIBUTED = f"""{SPEECH}, att AS (SELECT * FROM (SELECT *, last_value(speaker IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY st, id ROWS UNBOUNDED PRECEDING) AS who, max(CAST(speaker IS NOT NULL AS INTEGER)) OVER (PARTITION BY episode_id) = 1 AS labelled FROM speech) WHERE NOT labelled OR who IS NOT NULL)"""


@query(f"{ATTRIBUTED} SELECT episode_id, id, who, labelled AND speaker IS NULL AS continuation FROM att")
def w01_attributed(spark: SparkSession, d: str) -> DataFrame:
    return O.attributed(speech(spark, d)).select("episode_id", "id", "who", "continuation")


# The fold as a recursion over an episode's lines; the state is the list of the last three utterances.
W02 = f"""{ATTRIBUTED.replace('WITH ', 'WITH RECURSIVE ', 1)}, ev AS (
  SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY st, id) AS n, id, st, en, coalesce(who, '∅') AS who, coalesce(text, '') AS text, coalesce(style, '∅') AS style, labelled AND speaker IS NULL AS cont FROM att),
fold AS (
  SELECT episode_id, n, [{{'id': id, 'en': en, 'who': who, 'text': text, 'style': style}}] AS buf, id AS into_id FROM ev WHERE n = 1
  UNION ALL
  SELECT e.episode_id, e.n,
    CASE WHEN x.t IS NOT NULL THEN list_transform(x.buf, lambda b: CASE WHEN b.id = x.t THEN {{'id': b.id, 'en': greatest(b.en, e.en), 'who': b.who, 'text': b.text || ' ' || e.text, 'style': b.style}} ELSE b END)
         ELSE list_append(x.buf, {{'id': e.id, 'en': e.en, 'who': e.who, 'text': e.text, 'style': e.style}})[-3:] END,
    coalesce(x.t, e.id)
  FROM (
    SELECT f.episode_id, f.n, f.buf, e2.id AS eid,
      CASE WHEN c IS NOT NULL AND e2.st - c.en <= {P.MERGE_GAP_MS} AND (e2.cont OR (e2.style = c.style AND NOT {has('c.text', P.SENTENCE_END)} AND {has('e2.text', P.CONTINUES)})) THEN c.id END AS t
    FROM (SELECT f0.*, e1.id AS nid, list_filter(f0.buf, lambda b: b.who = e1.who)[-1] AS c FROM fold f0 JOIN ev e1 ON e1.episode_id = f0.episode_id AND e1.n = f0.n + 1) f
    JOIN ev e2 ON e2.episode_id = f.episode_id AND e2.n = f.n + 1) x
  JOIN ev e ON e.episode_id = x.episode_id AND e.n = x.n + 1)
SELECT f.episode_id, f.into_id AS first_id, count(*) AS events, max(e.en) AS en FROM fold f JOIN ev e ON e.episode_id = f.episode_id AND e.n = f.n GROUP BY 1, 2"""


@query(W02)
def w02_merged(spark: SparkSession, d: str) -> DataFrame:
    """Sentences put together over up to three utterances back."""
    m = O.merged(O.attributed(speech(spark, d)))
    return m.groupBy("episode_id", "first_id").agg(F.sum("events").alias("events"), F.max("en").alias("en"))


@query(f"{SPEECH} SELECT a.id, a.en - a.st AS window_ms, coalesce((SELECT min(b.st) FROM speech b WHERE b.episode_id = a.episode_id AND b.st >= a.en AND (b.st, b.id) > (a.st, a.id)) - a.en, {P.LAST_SLACK_MS}) AS slack_ms FROM speech a")
def w03_room(spark: SparkSession, d: str) -> DataFrame:
    return O.with_room(speech(spark, d)).select("id", "window_ms", "slack_ms")


SCENES = f"{SPEECH}, sc AS (SELECT *, sum(CASE WHEN gap > {P.SCENE_GAP_MS} OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY st, id ROWS UNBOUNDED PRECEDING) AS scene FROM (SELECT *, st - lag(en) OVER (PARTITION BY episode_id ORDER BY st, id) AS gap FROM speech))"
SCENE_ROWS = "SELECT episode_id, CAST(scene AS BIGINT) AS scene, min(st) AS st, arg_max(en, {'st': st, 'id': id}) AS en, count(*) AS n_lines, array_to_string(list_sort(list_distinct(list(speaker) FILTER (WHERE NOT coalesce(is_group, FALSE) AND speaker IS NOT NULL))), '|') AS speakers FROM sc GROUP BY 1, 2"


@query(f"{SCENES} SELECT * REPLACE (coalesce(speakers, '') AS speakers) FROM ({SCENE_ROWS})")
def w04_a14_scenes(spark: SparkSession, d: str) -> DataFrame:
    return O.scene_table(speech(spark, d)).withColumn("speakers", F.array_join("speakers", "|"))


@query(f"{SCENES}, t AS (SELECT *, CASE WHEN coalesce(speakers, '') = '' THEN 0 ELSE len(string_split(speakers, '|')) END AS cast_size FROM ({SCENE_ROWS})) SELECT episode_id, scene, CAST(cast_size AS INTEGER) AS cast_size, n_lines FROM t ORDER BY cast_size DESC, n_lines DESC, episode_id, scene LIMIT 20")
def t06_top_scenes(spark: SparkSession, d: str) -> DataFrame:
    s = O.scene_table(speech(spark, d)).withColumn("cast_size", F.size("speakers"))
    return s.select("episode_id", "scene", "cast_size", "n_lines").orderBy(F.desc("cast_size"), F.desc("n_lines"), "episode_id", "scene").limit(20)


@query(f"{SPEECH}, c AS (SELECT DISTINCT a.id FROM speech a JOIN speech b ON a.episode_id = b.episode_id AND a.st < b.en AND b.st < a.en AND a.speaker <> b.speaker) SELECT id FROM speech WHERE id NOT IN (SELECT id FROM c)")
def j08_clean_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that no other speaker talks over."""
    s = speech(spark, d)
    return s.join(O.colliding(s), "id", "left_anti").select("id")


@query(f"WITH {V.LINES} SELECT id FROM lines g WHERE kind = 'sign' AND NOT EXISTS (SELECT 1 FROM lines s WHERE s.kind = 'speech' AND s.episode_id = g.episode_id AND g.st - {P.SIGN_CLEARANCE_MS} < s.en AND s.st < g.en + {P.SIGN_CLEARANCE_MS})")
def j09_clear_signs(spark: SparkSession, d: str) -> DataFrame:
    """Signs with no speech near them."""
    a = V.lines(spark, d)
    signs = a.filter("kind = 'sign'")
    return signs.join(O.colliding(signs, P.SIGN_CLEARANCE_MS, a.filter("kind = 'speech'")), "id", "left_anti").select("id")


# Greedy by text: the recursion follows the kept signs, each time to the first one far enough away.
W05 = f"""WITH RECURSIVE {V.LINES}, s AS (SELECT episode_id, text, st, id, en, row_number() OVER (PARTITION BY episode_id, text ORDER BY st, id) AS n FROM lines WHERE kind = 'sign' AND text IS NOT NULL),
k AS (
  SELECT episode_id, text, n, [en] AS ends, TRUE AS kept FROM s WHERE n = 1
  UNION ALL
  SELECT s.episode_id, s.text, s.n, CASE WHEN len(list_filter(k.ends, lambda e: s.st - e < {P.REPEAT_MS})) = 0 THEN list_append(k.ends, s.en) ELSE k.ends END, len(list_filter(k.ends, lambda e: s.st - e < {P.REPEAT_MS})) = 0
  FROM k JOIN s ON s.episode_id = k.episode_id AND s.text = k.text AND s.n = k.n + 1)
SELECT s.episode_id, s.id FROM k JOIN s USING (episode_id, text, n) WHERE kept"""


@query(W05)
def w05_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Signs without those that repeat a kept one."""
    signs = V.lines(spark, d).filter("kind = 'sign' and text is not null")
    return O.kept_apart(signs, ["episode_id", "text"], P.REPEAT_MS).select("episode_id", "id")


EDGES = "x AS (SELECT * FROM speech WHERE NOT coalesce(is_group, FALSE)), e AS (SELECT a.episode_id, a.id AS a, b.id AS b FROM x a JOIN x b ON a.episode_id = b.episode_id AND (a.st, a.id) < (b.st, b.id) AND a.en > b.st AND a.speaker IS DISTINCT FROM b.speaker)"


@query(f"{SPEECH}, {EDGES} SELECT episode_id, count(*) AS overlaps FROM e GROUP BY 1")
def j10_overlap_edges(spark: SparkSession, d: str) -> DataFrame:
    """Overlap edges by episode: an earlier line still sounds, speakers differ, groups excluded."""
    s = speech(spark, d).filter(~F.coalesce("is_group", F.lit(False)))
    a = O.binned(s.select("episode_id", "id", "st", "en", "speaker"), 30_000)
    b = s.select(F.col("episode_id").alias("e"), F.col("id").alias("i"), F.col("st").alias("s"), F.col("speaker").alias("w")).withColumn("__bin", F.floor(F.col("s") / 30_000))
    # Each pair is found in the one bin in which the later line starts.
    meets = (F.col("episode_id") == F.col("e")) & (F.col("bin") == F.col("__bin")) & (F.struct("st", "id") < F.struct("s", "i")) & (F.col("en") > F.col("s")) & ~F.col("speaker").eqNullSafe(F.col("w"))
    return a.join(b, meets).groupBy("episode_id").agg(F.count(F.lit(1)).alias("overlaps"))


G01 = f"""{SPEECH.replace('WITH ', 'WITH RECURSIVE ', 1)}, {EDGES}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS id, a AS reach FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.reach),
g AS (SELECT id, min(reach) AS low FROM r GROUP BY id),
f AS (SELECT x.episode_id, g.low, min({{'st': x.st, 'id': x.id}}) AS first FROM g JOIN x ON x.id = g.id GROUP BY 1, 2),
n AS (SELECT episode_id, low, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY first) - 1 AS INTEGER) AS overdub FROM f)
SELECT n.episode_id, g.id, n.overdub FROM g JOIN n USING (low)"""


@query(G01)
def g01_overlap_cases(spark: SparkSession, d: str) -> DataFrame:
    """Connected groups of overlapping lines."""
    return O.overlap_cases(speech(spark, d))


# Colouring as a recursion over the speakers of a case, busiest first; the state is the list of those placed.
PALETTE = "[" + ", ".join(f"CAST({p} AS DOUBLE)" for p in (-0.6, 0.6, -0.35, 0.35, -0.15, 0.15, 0.0)) + "]"
G02 = G01.replace("SELECT n.episode_id, g.id, n.overdub FROM g JOIN n USING (low)", "") + f""",
o AS (SELECT n.episode_id, n.overdub, x.id, x.speaker, x.st, x.en FROM g JOIN n USING (low) JOIN x ON x.id = g.id),
sp AS (SELECT DISTINCT episode_id, overdub, speaker FROM o WHERE speaker IS NOT NULL),
cf AS (SELECT a.episode_id, a.overdub, a.speaker, list(DISTINCT b.speaker) AS others FROM o a JOIN o b ON a.episode_id = b.episode_id AND a.overdub = b.overdub AND a.speaker <> b.speaker AND a.st < b.en AND b.st < a.en GROUP BY 1, 2, 3),
ra AS (SELECT sp.*, coalesce(cf.others, []) AS others, row_number() OVER (PARTITION BY sp.episode_id, sp.overdub ORDER BY len(coalesce(cf.others, [])) DESC, sp.speaker) AS k FROM sp LEFT JOIN cf ON cf.episode_id = sp.episode_id AND cf.overdub = sp.overdub AND cf.speaker = sp.speaker),
pl AS (
  SELECT episode_id, overdub, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(speaker VARCHAR, pan DOUBLE)[]) AS done FROM ra WHERE k = 1
  UNION ALL
  SELECT p.episode_id, p.overdub, r.k, list_append(p.done, {{'speaker': r.speaker, 'pan': coalesce(list_filter({PALETTE}, lambda v: len(list_filter(p.done, lambda q: list_contains(r.others, q.speaker) AND q.pan = v)) = 0)[1], CAST(0.0 AS DOUBLE))}})
  FROM pl p JOIN ra r ON r.episode_id = p.episode_id AND r.overdub = p.overdub AND r.k = p.k + 1),
pan AS (SELECT episode_id, overdub, done[-1].speaker AS speaker, done[-1].pan AS pan FROM pl WHERE k > 0)
"""


@query(G02 + "SELECT * FROM pan")
def g02_conflict_pans(spark: SparkSession, d: str) -> DataFrame:
    s = speech(spark, d)
    return O.conflict_pans(s.join(O.overlap_cases(s).select("id", "overdub"), "id"))


J12 = G01.replace("SELECT n.episode_id, g.id, n.overdub FROM g JOIN n USING (low)", "") + """,
o AS (SELECT n.episode_id, g.id, n.overdub FROM g JOIN n USING (low)),
c AS (SELECT o.episode_id, o.overdub, min(x.st) AS a, max(x.en) AS b, list(DISTINCT x.speaker) AS who FROM o JOIN x USING (id) GROUP BY 1, 2),
w AS (SELECT c.episode_id, c.overdub, c.a, c.b, unnest(who) AS speaker FROM c),
p AS (SELECT w.episode_id, w.overdub, w.speaker, x.id, x.st, CASE WHEN x.en <= w.a THEN w.a - x.en WHEN x.st >= w.b THEN x.st - w.b ELSE 0 END AS gap_ms
  FROM w JOIN x ON x.episode_id = w.episode_id AND x.speaker = w.speaker AND x.en - x.st >= 250 AND x.id NOT IN (SELECT id FROM o))
SELECT episode_id, overdub, speaker, id, gap_ms, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, overdub, speaker ORDER BY gap_ms, st, id) AS place FROM p WHERE gap_ms <= 15000) WHERE place <= 3"""


@query(J12)
def j12_nearest_solo(spark: SparkSession, d: str) -> DataFrame:
    """Nearest lines outside any case of each speaker in a case."""
    s = speech(spark, d)
    o = O.overlap_cases(s).select("id", "overdub")
    inside = s.join(o, "id")
    span = inside.groupBy("episode_id", "overdub").agg(F.min("st").alias("case_st"), F.max("en").alias("case_en"))
    cases = inside.select("episode_id", "overdub", "speaker").filter("speaker is not null").distinct().join(span, ["episode_id", "overdub"])
    return O.nearest_solo(s.join(o, "id", "left_anti"), cases)


@query(f"{SPEECH} SELECT id, array_to_string(list(coalesce(text, '')) OVER (PARTITION BY episode_id ORDER BY st, id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '|') AS before, array_to_string(list(coalesce(text, '')) OVER (PARTITION BY episode_id ORDER BY st, id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '|') AS after FROM speech".replace("array_to_string(list", "coalesce(array_to_string(list").replace("'|') AS", "'|'), '') AS"))
def w09_context(spark: SparkSession, d: str) -> DataFrame:
    """Two lines before and after each line."""
    near = ordered.neighbours(speech(spark, d), ["episode_id"], F.coalesce("text", F.lit("")), 2, 2)
    return near.select("id", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


SURVEY = f"{SPEECH}, c AS (SELECT DISTINCT a.id FROM speech a JOIN speech b ON a.episode_id = b.episode_id AND a.id <> b.id AND a.st < b.en AND b.st < a.en AND (a.speaker IS NULL OR b.speaker IS NULL OR a.speaker <> b.speaker)), s AS (SELECT *, id NOT IN (SELECT id FROM c) AS solo FROM speech)"


def _surveyed(spark: SparkSession, d: str) -> DataFrame:
    s = speech(spark, d)
    hit = O.colliding(s, unknown_always=True).withColumn("hit", F.lit(True))
    return s.join(hit, "id", "left").withColumn("solo", F.col("hit").isNull())


@query(f"{SURVEY} SELECT show_id, speaker, count(*) AS n_lines, sum(en - st)::BIGINT AS speech_ms, count(*) FILTER (WHERE solo AND en - st >= 1200) AS clean, coalesce(sum(en - st) FILTER (WHERE solo AND en - st >= 1200), 0)::BIGINT AS clean_ms, CASE WHEN coalesce(sum(en - st) FILTER (WHERE solo AND en - st >= 1200), 0) >= 30000 THEN 'strong clone' WHEN coalesce(sum(en - st) FILTER (WHERE solo AND en - st >= 1200), 0) >= 10000 THEN 'usable clone' WHEN coalesce(sum(en - st) FILTER (WHERE solo AND en - st >= 1200), 0) >= 3000 THEN 'thin, pool more episodes' ELSE 'fallback voice' END AS verdict FROM s WHERE speaker IS NOT NULL GROUP BY 1, 2")
def a01_a03_survey(spark: SparkSession, d: str) -> DataFrame:
    """Speech and clean speech of every speaker, with the verdict on cloning."""
    ms, clean = F.col("en") - F.col("st"), F.col("solo") & (F.col("en") - F.col("st") >= 1200)
    a = _surveyed(spark, d).filter("speaker is not null").groupBy("show_id", "speaker").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(ms).alias("speech_ms"), F.count_if(clean).alias("clean"), F.coalesce(F.sum(F.when(clean, ms)), F.lit(0)).alias("clean_ms"))
    return a.withColumn("verdict", F.when(F.col("clean_ms") >= 30_000, "strong clone").when(F.col("clean_ms") >= 10_000, "usable clone").when(F.col("clean_ms") >= 3_000, "thin, pool more episodes").otherwise("fallback voice"))


@query(f"{SURVEY} SELECT count(*) AS n_lines, coalesce(sum(en - st), 0)::BIGINT AS speech_ms, count(*) FILTER (WHERE NOT solo) AS collisions, coalesce(sum(en - st) FILTER (WHERE solo AND en - st >= 1200), 0)::BIGINT AS clean_ms FROM s WHERE speaker IS NULL")
def a02_unnamed(spark: SparkSession, d: str) -> DataFrame:
    ms, clean = F.col("en") - F.col("st"), F.col("solo") & (F.col("en") - F.col("st") >= 1200)
    return _surveyed(spark, d).filter("speaker is null").agg(F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum(ms), F.lit(0)).alias("speech_ms"), F.count_if(~F.col("solo")).alias("collisions"), F.coalesce(F.sum(F.when(clean, ms)), F.lit(0)).alias("clean_ms"))


@query(f"{SPEECH} SELECT CAST(show_id AS BIGINT) AS show_id, speaker FROM (SELECT DISTINCT show_id, speaker FROM speech WHERE speaker IS NOT NULL AND NOT coalesce(is_group, FALSE)) EXCEPT SELECT CAST(show_id AS BIGINT), upper(speaker) FROM bank")
def r08_missing_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Speakers of the script that have no voice in the bank."""
    s = speech(spark, d).filter(F.col("speaker").isNotNull() & ~F.coalesce("is_group", F.lit(False))).select(F.col("show_id").cast("long").alias("show_id"), "speaker").distinct()
    bank = table(spark, d, "bank", "show_id", "speaker").select(F.col("show_id").cast("long").alias("show_id"), F.upper("speaker").alias("speaker"))
    return s.exceptAll(bank.distinct())


FOREIGN_WORD = r"[\p{L}\p{N}_]*[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}][\p{L}\p{N}_]*"


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {quoted(FOREIGN_WORD)})) AS word FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def a16_foreign_words(spark: SparkSession, d: str) -> DataFrame:
    """Words with a letter outside ASCII, with counts, over all documents."""
    word = F.explode(F.regexp_extract_all("text", F.lit(FOREIGN_WORD), F.lit(0)))
    return table(spark, d, "documents", "text").filter("text is not null").select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


ROLES = f"{SPEECH}, r AS (SELECT episode_id, upper(role) AS role, count(*) AS n FROM speech WHERE role IS NOT NULL AND role <> '' GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY n DESC, role) AS place FROM r WHERE n >= 3)"


@query(f"{ROLES} SELECT r.episode_id, r.role, r.n, CASE WHEN r.n < 3 THEN 'too few lines' WHEN k.place > 10 THEN 'past the cap' ELSE 'kept' END AS state FROM r LEFT JOIN k USING (episode_id, role)")
def a15_role_counts(spark: SparkSession, d: str) -> DataFrame:
    """Roles of an episode with why they are dropped: few lines, or past ten."""
    r = speech(spark, d).filter("role is not null and role <> ''").groupBy("episode_id", F.upper("role").alias("role")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("episode_id", F.col("n") >= 3).orderBy(F.desc("n"), "role"))
    return r.withColumn("__p", place).select("episode_id", "role", "n", F.when(F.col("n") < 3, "too few lines").when(F.col("__p") > 10, "past the cap").otherwise("kept").alias("state"))


@query(f"{SPEECH}, q AS (SELECT episode_id, count(*) AS n_lines, count(*) FILTER (WHERE role <> '') AS labelled, count(DISTINCT upper(role)) FILTER (WHERE role <> '') AS roles FROM speech GROUP BY 1) SELECT *, CASE WHEN labelled > 0 AND (labelled / n_lines < 0.10 OR labelled / n_lines > 0.95) THEN 'share' WHEN labelled > 0 AND roles / labelled > 0.15 THEN 'density' END AS refusal FROM q")
def p24_label_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Whether an episode's labelling is refused for its share or its density of roles."""
    on = F.col("role") != ""
    q = speech(spark, d).groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(on).alias("labelled"), F.count_distinct(F.when(on, F.upper("role"))).alias("roles"))
    share = F.col("labelled") / F.col("n_lines")
    return q.withColumn("refusal", F.when((F.col("labelled") > 0) & ((share < 0.10) | (share > 0.95)), "share").when((F.col("labelled") > 0) & (F.try_divide("roles", "labelled") > 0.15), "density"))


@query(f"{SPEECH}, v AS (SELECT DISTINCT episode_id, unnest(regexp_extract_all(upper(text), '[A-Z]{{4,}}')) AS word FROM speech WHERE text IS NOT NULL), p AS (SELECT DISTINCT episode_id, speaker, unnest(regexp_extract_all(speaker, '[A-Z]{{4,}}')) AS part FROM speech WHERE speaker IS NOT NULL) SELECT DISTINCT p.episode_id, p.speaker FROM p JOIN v ON v.episode_id = p.episode_id AND (starts_with(v.word, p.part) OR starts_with(p.part, v.word))")
def j16_spoken_names(spark: SparkSession, d: str) -> DataFrame:
    """Labels of which a word is said aloud in the episode, one being a prefix of the other."""
    s = speech(spark, d)
    words_of = lambda c: F.explode(F.regexp_extract_all(c, F.lit("[A-Z]{4,}"), 0))
    said = s.filter("text is not null").select(F.col("episode_id").alias("e"), words_of(F.upper("text")).alias("word")).distinct()
    part = s.filter("speaker is not null").select("episode_id", "speaker", words_of(F.col("speaker")).alias("part")).distinct()
    # Both words share their first four letters if one is a prefix of the other, so these are the join key.
    meets = (F.col("episode_id") == F.col("e")) & (F.substring("word", 1, 4) == F.substring("part", 1, 4)) & (F.col("word").startswith(F.col("part")) | F.col("part").startswith(F.col("word")))
    return part.join(said, meets, "left_semi").select("episode_id", "speaker").distinct()


@query()
def j15_member_voices(spark: SparkSession, d: str) -> DataFrame:
    """Voices of the members that a group's label names."""
    labels = speech(spark, d).filter("is_group and speaker is not null").select("show_id", F.col("speaker").alias("label")).distinct()
    v = casting.member_voices(labels, table(spark, d, "bank", "show_id", "speaker"))
    return v.select("show_id", "label", F.array_join("voices", "|").alias("voices"))


@query()
def f17_speakable(spark: SparkSession, d: str) -> DataFrame:
    """Lines in compatible form with respelt words."""
    return casting.speakable(speech(spark, d).select("id", "text"), "text", {"harbour": "har-ber", "clerk": "clark"})


@query(G02 + "SELECT o.id, o.overdub, o.speaker, pan.pan FROM o LEFT JOIN pan ON pan.episode_id = o.episode_id AND pan.overdub = o.overdub AND pan.speaker = o.speaker")
def j21_placements(spark: SparkSession, d: str) -> DataFrame:
    """Lines of overlap cases with the place resolved for their speaker."""
    s = speech(spark, d)
    inside = s.join(O.overlap_cases(s).select("id", "overdub"), "id")
    return render.placed(inside, O.conflict_pans(inside)).select("id", "overdub", "speaker", "pan")
