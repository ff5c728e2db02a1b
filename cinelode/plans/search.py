"""Flow B: search results to a plan of what to queue."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelode.functions import patterns as P
from cinelode.functions import score as S
from cinelode.functions import text as T
from cinelode.operators import rank
from cinelode.plans import views as V
from cinelode.plans.base import query
from cinelode.plans.library import album_steps, words
from cinelode.plans.views import has, stages
from cinelode.sources.tables import table

REL = f"WITH {V.RELEASES}"
RES = "CASE WHEN contains(t, '2160p') THEN 4 WHEN contains(t, '1080p') THEN 3 WHEN contains(t, '720p') THEN 2 WHEN contains(t, '480p') THEN 1 ELSE 0 END"
EP_NAMED, PACK_NAMED = r"(?i)s\d{1,2}e\d{1,3}", r"(?i)s\d{1,2}\b|season\s*\d"
LIMIT = f"CASE WHEN {has('title', EP_NAMED)} THEN {P.EPISODE_MAX} WHEN {has('title', PACK_NAMED)} THEN {P.PACK_MAX} ELSE {P.MOVIE_MAX} END"
DUB_ONLY = f"{has('title', P.DUB)} AND NOT {has('title', P.ORIGINAL)}"
LOSSLESS = f"CASE WHEN lossless_cat OR {has('title', P.LOSSLESS)} THEN TRUE WHEN lossy_cat OR {has('title', P.LOSSY)} THEN FALSE END"


@query(f"{REL} SELECT id, CASE WHEN coalesce(size, 0) * 12 > {LIMIT} THEN 'size' WHEN {has('title', '(?i)remux')} THEN 'remux' WHEN {DUB_ONLY} THEN 'dub-only' END AS refusal FROM releases")
def p07_p08_p10_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Why a release is refused; sizes are taken twelvefold so that the ceilings are met."""
    return V.releases(spark, d).select("id", S.refusal(F.col("title"), F.col("size") * 12).alias("refusal"))


@query(f"{REL}, r AS (SELECT *, {LOSSLESS} AS ll FROM releases) SELECT id, ll AS lossless, CASE WHEN coalesce(size, 0) > CASE WHEN {has('title', P.BOXSET)} THEN {P.DISCOGRAPHY_MAX} ELSE {P.ALBUM_MAX} END THEN 'size' WHEN {has('title', P.VIDEO_RELEASE)} THEN 'video' WHEN NOT ll THEN 'lossy' END AS refusal FROM r")
def p09_music_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Three-valued lossless test and the refusal of music releases."""
    ll = S.lossless(F.col("title"), F.col("lossless_cat"), F.col("lossy_cat"))
    r = V.releases(spark, d).withColumn("lossless", ll)
    return r.select("id", "lossless", S.music_refusal(F.col("title"), F.col("size"), F.col("lossless")).alias("refusal"))


SCORE = f"CAST({RES} * 1000 + CASE WHEN {has('t', 'blu-?ray')} THEN 200 ELSE 0 END + CASE WHEN {has('t', P.HDR)} THEN 100 ELSE 0 END + least(seeders, 500) - CASE WHEN {has('t', P.DUB)} THEN 300 ELSE 0 END - CASE WHEN coalesce(size, 0) < 200000000 THEN 100000 ELSE 0 END AS BIGINT)"


@query(f"{REL}, s AS (SELECT id, {SCORE} AS score FROM (SELECT *, lower(title) AS t FROM releases)) SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS place, id, score FROM s ORDER BY place LIMIT 100")
def m02_t03_t04_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The hundred best search results: score, then arrival."""
    s = V.releases(spark, d).select("id", S.release_score(F.col("title"), F.col("seeders"), F.col("size")).cast("long").alias("score"))
    top = s.orderBy(F.desc("score"), "id").limit(100)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "id"))).select("place", "id", "score")


@query(f"{REL}, s AS (SELECT id, {SCORE} AS score FROM (SELECT *, lower(title) AS t FROM releases)) SELECT row_number() OVER (ORDER BY score DESC, id) AS place, id, score FROM s")
def t03_ranked_results(spark: SparkSession, d: str) -> DataFrame:
    """All search results with their place: score, then arrival."""
    s = V.releases(spark, d).select("id", S.release_score(F.col("title"), F.col("seeders"), F.col("size")).cast("long").alias("score"))
    return rank.placed(s, "score", "id").select("place", "id", "score")


HIGH = r"(?i)\b24\s?bit|24-?96|24-?192\b"


@query(f"{REL} SELECT id, CAST(least(seeders, 500) + CASE WHEN {LOSSLESS} THEN 2000 ELSE 0 END + CASE WHEN {has('title', P.CUE_TRACKS)} THEN 300 WHEN {has('title', P.CUE_IMAGE)} THEN -300 ELSE 0 END + CASE WHEN {has('title', HIGH)} THEN 100 ELSE 0 END - CASE WHEN coalesce(size, 0) < 20000000 THEN 100000 ELSE 0 END AS BIGINT) AS score FROM releases")
def m03_music_scores(spark: SparkSession, d: str) -> DataFrame:
    ll = S.lossless(F.col("title"), F.col("lossless_cat"), F.col("lossy_cat"))
    return V.releases(spark, d).select("id", S.music_score(F.col("title"), F.col("seeders"), F.col("size"), ll).cast("long").alias("score"))


# Queries: the titles of the shows; a result must hold the normalised query.
RELEVANT = f"{REL}, k AS (SELECT id, lower(regexp_replace(title, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) AS key FROM releases), q AS (SELECT DISTINCT show_id, lower(regexp_replace(\"show\", '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) AS q FROM season)"


@query(f"{RELEVANT} SELECT q.show_id, count(*) AS hits FROM k JOIN q ON contains(k.key, q.q) GROUP BY 1")
def p11_relevant(spark: SparkSession, d: str) -> DataFrame:
    """Results that name a show: the normalised query is part of the normalised title.

    The shows are few and don't grow (checked), so they are broadcast and each title is tried against them all once.
    """
    q = table(spark, d, "season", "show_id", "show").select("show_id", T.word_key(F.col("show")).alias("q")).dropDuplicates()
    k = V.releases(spark, d).select("id", T.word_key(F.col("title")).alias("key"))
    return _contained(k, q).groupBy("show_id").agg(F.count(F.lit(1)).alias("hits"))


#: Most entries of a dimension that is searched by containment in memory.
MOST_QUERIES = 100_000


def _joined(k: DataFrame, q: DataFrame) -> DataFrame:
    """As :func:`_contained` for any number of queries: keys' parts of the queries' lengths, joined by equality."""
    sizes = q.agg(F.array_sort(F.collect_set(F.length("q"))).alias("__sizes"))  # one row of distinct lengths
    part = F.flatten(F.transform("__sizes", lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("key") - n + 1, F.lit(1))), lambda i: F.substring("key", i, n))))
    parts = k.join(F.broadcast(sizes)).select("id", F.explode(part).alias("__p")).distinct()
    return parts.join(q, F.col("__p") == F.col("q")).select("id", "show_id")


def _contained(k: DataFrame, q: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """(id, show_id) of keys that contain a query: up to ``most`` queries by an Aho-Corasick automaton, more by a join on parts."""
    import ahocorasick

    q = q.filter("q <> ''")
    rows = q.limit(most + 1).collect()
    if len(rows) > most:
        return _joined(k, q)
    by_word: dict[str, list[int]] = {}
    for r in rows:
        by_word.setdefault(r.q, []).append(r.show_id)
    shared = k.sparkSession.sparkContext.broadcast(by_word)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = ahocorasick.Automaton()
        for w, shows in shared.value.items():
            auto.add_word(w, (w, shows))
        auto.make_automaton()
        for pdf in batches:
            out = [(i, s) for i, key in zip(pdf["id"], pdf["key"], strict=True) if shared.value for w, shows in {w: n for _, (w, n) in auto.iter(key)}.items() for s in shows]
            yield pd.DataFrame(out, columns=["id", "show_id"])

    return k.mapInPandas(run, "id bigint, show_id int")


ALBUM_ROWS = stages("SELECT id, title, size, seeders FROM releases", *album_steps("title", "x_"))
PLAUSIBLE = f"{REL}, p AS (SELECT id, x_artist, x_album, x_year, size, seeders, lower(regexp_replace(x_album, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) AS key FROM ({ALBUM_ROWS}) WHERE NOT regexp_matches(title, '\\.\\.\\.\\s*$') AND x_album IS NOT NULL AND NOT regexp_matches(coalesce(x_artist, ''), '(?i)^(?:va|various)\\b') AND seeders > 0 AND NOT (x_year IS NULL AND length(x_album) <= 6))"


def _plausible(spark: SparkSession, d: str) -> DataFrame:
    r = V.releases(spark, d).withColumn("a", T.artist_album(F.col("title")))
    artist, album, year = F.col("a.artist"), F.col("a.album"), F.col("a.year")
    fine = ~F.col("title").rlike(r"\.\.\.\s*$") & album.isNotNull() & ~F.coalesce(artist, F.lit("")).rlike(r"(?i)^(?:va|various)\b") & (F.col("seeders") > 0) & ~(year.isNull() & (F.length(album) <= 6))
    return r.filter(fine).select("id", artist.alias("artist"), album.alias("album"), year.alias("yr"), "size", "seeders", T.word_key(album).alias("key"))


@query(f"{PLAUSIBLE} SELECT id, x_album AS album, x_year AS yr FROM p")
def p12_plausible_albums(spark: SparkSession, d: str) -> DataFrame:
    return _plausible(spark, d).select("id", "album", "yr")


def greedy_suffixes(rows: DataFrame, group: str, key: str, order: list[str], least: int = 8) -> DataFrame:
    """Rows kept by a greedy pass in ``order``: not if the key ends in, or is the end of, one already kept (8 letters or more).

    Kept keys of a group are held in a set of all their suffixes, so a row costs its length. Groups stream through sorted partitions; their rows aren't held.
    """
    from cinelode.operators.fold import stream_fold

    cols = list(dict.fromkeys([group, *order, key, "id"]))
    at, ident = cols.index(key), cols.index("id")

    def step(state: tuple[set[str], set[str]], r: tuple) -> tuple | None:
        whole, ends = state
        k = r[at]
        if not k or k in whole:
            return None
        own = {k[i:] for i in range(len(k) - least + 1)}
        if own & whole or (len(k) >= least and k in ends):
            return None
        whole.add(k)
        ends |= own
        return r[0], r[ident], k

    kinds = dict(rows.dtypes)
    # A short kept key is never matched by its end, as the shorter one must have 8 letters.
    return stream_fold(rows.select(*cols), [group], order, lambda: (set(), set()), step, f"{group} {kinds[group]}, id bigint, {key} string")


W16 = f"""{PLAUSIBLE.replace('WITH ', 'WITH RECURSIVE ', 1)}, o AS (SELECT grp, id, key, row_number() OVER (PARTITION BY grp ORDER BY -seeders, id) AS n FROM (SELECT *, CASE WHEN x_artist IS NOT NULL THEN lower(regexp_replace(x_artist, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) END AS grp FROM p WHERE key <> '')),
g AS (
  SELECT grp, n, [key] AS kept, id, TRUE AS took FROM o WHERE n = 1
  UNION ALL
  SELECT grp, n, CASE WHEN took THEN list_append(kept, key) ELSE kept END, id, took FROM (
    SELECT o.grp, o.n, g.kept, o.key, o.id, len(list_filter(g.kept, lambda k: k = o.key OR (least(length(k), length(o.key)) >= 8 AND (ends_with(k, o.key) OR ends_with(o.key, k))))) = 0 AS took
    FROM g JOIN o ON o.grp IS NOT DISTINCT FROM g.grp AND o.n = g.n + 1))
SELECT grp, id FROM g WHERE took"""


@query(W16)
def w16_greedy_albums(spark: SparkSession, d: str) -> DataFrame:
    """Albums of an artist without those whose name ends in a better one's.

    ``grp`` is the artist's normalised name, as a search compares it; albums that name no artist are one group, NULL.
    """
    p = _plausible(spark, d).filter("key <> ''").withColumns({"grp": F.when(F.col("artist").isNotNull(), T.word_key(F.col("artist"))), "rank": -F.col("seeders")})
    return greedy_suffixes(p, "grp", "key", ["rank", "id"]).select("grp", "id")


HELD = "h AS (SELECT DISTINCT lower(regexp_replace(regexp_replace(name, '\\s*\\((?:19|20)\\d{2}\\)$', ''), '[^\\p{L}\\p{N}_]+', '', 'g')) AS held FROM downloads WHERE name IS NOT NULL AND id % 3 = 0)"


def _held(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "downloads", "id", "name").filter("name is not null and id % 3 = 0")
    return i.select(T.word_key(F.regexp_replace("name", r"\s*\((?:19|20)\d{2}\)$", "")).alias("held")).distinct()


SHOWS_KEYED = "n AS (SELECT DISTINCT id, lower(regexp_replace(regexp_replace(name, '\\s*\\((?:19|20)\\d{2}\\)$', ''), '[^\\p{L}\\p{N}_]+', '', 'g')) AS key FROM downloads WHERE name IS NOT NULL)"


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "downloads", "id", "name").filter("name is not null")
    return i.select("id", T.word_key(F.regexp_replace("name", r"\s*\((?:19|20)\d{2}\)$", "")).alias("key")).distinct()


@query(f"WITH {HELD}, {SHOWS_KEYED} SELECT id FROM n WHERE key NOT IN (SELECT held FROM h)")
def j05_not_held(spark: SparkSession, d: str) -> DataFrame:
    """Downloads whose exact key the library doesn't hold."""
    return _keyed(spark, d).join(_held(spark, d), F.col("key") == F.col("held"), "left_anti").select("id")


@query(f"WITH {HELD}, {SHOWS_KEYED} SELECT id FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE least(length(held), length(key)) >= 8 AND (ends_with(key, held) OR ends_with(held, key)))")
def j06_no_suffix_held(spark: SparkSession, d: str) -> DataFrame:
    """Downloads whose key neither ends in a held key nor is the end of one (8 letters or more).

    A suffix match is an equi-join on suffixes: every key is exploded into its suffixes of 8 letters or more, so no pairs are tried.
    """
    suffixes = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c) - 7), lambda i: F.substring(c, i, F.length(c))))
    n, h = _keyed(spark, d), _held(spark, d)
    long_n, long_h = n.filter(F.length("key") >= 8), h.filter(F.length("held") >= 8)
    ends_in = long_n.select("id", suffixes(F.col("key")).alias("s")).join(long_h, F.col("s") == F.col("held")).select("id")
    is_end = long_n.join(long_h.select(suffixes(F.col("held")).alias("s")).distinct(), F.col("key") == F.col("s")).select("id")
    return n.join(ends_in.unionAll(is_end).distinct(), "id", "left_anti").select("id")


@query(f"{REL}, u AS (SELECT 1 AS q, id, title FROM releases WHERE contains(lower(title), 'the') UNION ALL SELECT 2, id, title FROM releases WHERE contains(lower(title), 'of')) SELECT q, id, title FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY q, id) AS r FROM u) WHERE r = 1")
def r04_union_of_queries(spark: SparkSession, d: str) -> DataFrame:
    """Results of two queries as one list, first wins by title."""
    r = V.releases(spark, d).select("id", "title")
    u = r.filter(F.lower("title").contains("the")).withColumn("q", F.lit(1)).unionByName(r.filter(F.lower("title").contains("of")).withColumn("q", F.lit(2)))
    return rank.extreme(u, ["title"], [("q", False), ("id", False)], ["q", "id"]).select("q", "id", "title")


@query(f"{REL}, a AS (SELECT id, title FROM releases WHERE id % 5 = 0), b AS (SELECT id, title FROM releases WHERE id % 5 <> 0) SELECT id, title, 'pending' AS src FROM a UNION ALL SELECT id, title, 'new' FROM b WHERE title NOT IN (SELECT title FROM a)")
def r05_pending_and_new(spark: SparkSession, d: str) -> DataFrame:
    """Pending releases and the new ones by title; every fifth stands for a pending one, all others are search results."""
    r = V.releases(spark, d).select("id", "title")
    a, b = r.filter("id % 5 = 0"), r.filter("id % 5 <> 0")
    return a.withColumn("src", F.lit("pending")).unionByName(b.join(a.select("title").distinct(), "title", "left_anti").withColumn("src", F.lit("new")))


@query("WITH q AS (SELECT DISTINCT id, name FROM downloads WHERE name IS NOT NULL), w AS (SELECT id, name FROM q WHERE name NOT IN (SELECT name FROM q WHERE id % 3 = 0)) SELECT id, row_number() OVER (ORDER BY id) <= 25 AS sent FROM w")
def t10_drained_queue(spark: SparkSession, d: str) -> DataFrame:
    """A queue drained into 25 slots, held names skipped."""
    q = table(spark, d, "downloads", "id", "name").dropDuplicates().filter("name is not null")
    return rank.queue_take(q, q.filter("id % 3 = 0"), "name", "id", 25).select("id", "sent")


@query("WITH s AS (SELECT DISTINCT show_id, \"show\", regexp_replace(lower(\"show\"), '[^a-z0-9]', '', 'g') AS k FROM season), a AS (SELECT show_id, k FROM s UNION SELECT show_id, regexp_replace(lower(al), '[^a-z0-9]', '', 'g') FROM (SELECT show_id, unnest(aliases) AS al FROM season)), q AS (SELECT DISTINCT id, regexp_replace(lower(regexp_replace(name, '\\s*\\((?:19|20)\\d{2}\\)$', '')), '[^a-z0-9]', '', 'g') AS k FROM downloads WHERE name IS NOT NULL), e AS (SELECT q.id, a.show_id FROM q JOIN a USING (k) WHERE k <> ''), p AS (SELECT DISTINCT q.id, a.show_id FROM q JOIN a ON q.k <> '' AND a.k <> '' AND (contains(q.k, a.k) OR contains(a.k, q.k)) WHERE q.id NOT IN (SELECT id FROM e)) SELECT DISTINCT id, show_id, 'exact' AS how FROM e UNION ALL SELECT id, show_id, 'part' FROM p")
def j17_plans_by_title(spark: SparkSession, d: str) -> DataFrame:
    """Plans that a title names: exact keys first, else mutual containment.

    Titles of shows are a bounded dimension; containment either way is tried only for titles without an exact hit.
    """
    s = table(spark, d, "season", "show_id", "show", "aliases")
    names = s.select("show_id", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("show"))).alias("n"))
    a = names.select("show_id", T.ascii_key(F.col("n")).alias("k")).filter("k <> ''").distinct()
    q = table(spark, d, "downloads", "id", "name").filter("name is not null").select("id", T.ascii_key(F.regexp_replace("name", r"\s*\((?:19|20)\d{2}\)$", "")).alias("k")).filter("k <> ''").distinct()
    exact = q.join(a, "k").select("id", "show_id").distinct()
    rest = q.join(exact.select("id").distinct(), "id", "left_anti")
    holds = _contained(rest.select("id", F.col("k").alias("key")), a.select("show_id", F.col("k").alias("q")))
    # The other way round a title is part of a show's key: its substrings of the same length make that an equi-join.
    parts = a.select("show_id", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("k")), lambda i: F.transform(F.sequence(i, F.length("k")), lambda j: F.substring("k", i, j - i + 1))))).alias("part")).distinct()
    inside = rest.join(parts, F.col("k") == F.col("part")).select("id", "show_id")
    part = holds.unionByName(inside).distinct()
    return exact.withColumn("how", F.lit("exact")).unionByName(part.withColumn("how", F.lit("part")))


# Candidate episodes: those of the best copies; the watch looks up to 12 ahead and ends after two misses in a row.
ST3 = """WITH RECURSIVE s AS (SELECT show_id, max(season) AS season, coalesce(arg_max_null(episodes, season), 12) - 6 AS have FROM season WHERE season IS NOT NULL GROUP BY 1),
c AS (SELECT s.show_id, s.season, s.have, unnest(generate_series(s.have + 1, s.have + 12)) AS ep FROM s),
f AS (SELECT *, (show_id * 31 + season * 7 + ep * 13) % 4 <> 0 AS hit FROM c),
m AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER w AS miss, CASE WHEN NOT hit AND NOT lag(hit, 1, TRUE) OVER w THEN 1 ELSE 0 END AS stop FROM f WINDOW w AS (PARTITION BY show_id ORDER BY ep)),
e AS (SELECT *, coalesce(sum(stop) OVER (PARTITION BY show_id ORDER BY ep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM m)
SELECT show_id, CAST(season AS INTEGER) AS season, CAST(ep AS INTEGER) AS ep FROM e WHERE hit AND stopped = 0
UNION ALL SELECT show_id, CAST(season + 1 AS INTEGER), 1 FROM s WHERE (show_id * 31 + (season + 1) * 7 + 13) % 4 <> 0"""


@query(ST3)
def st3_a22_watch(spark: SparkSession, d: str) -> DataFrame:
    """Next episodes of each show until two misses in a row or twelve ahead, and the next season's first.

    What the index offers is a rule of the numbers here, as there is no index.
    """
    s = table(spark, d, "season", "show_id", "season", "episodes").filter("season is not null")
    s = s.groupBy("show_id").agg(F.max("season").alias("season"), F.max(F.struct("season", "episodes"))["episodes"].alias("e")).select("show_id", "season", (F.coalesce("e", F.lit(12)) - 6).alias("have"))
    offered = lambda season, ep: (F.col("show_id") * 31 + season * 7 + ep * 13) % 4 != 0
    c = s.withColumn("ep", F.explode(F.sequence(F.col("have") + 1, F.col("have") + 12))).withColumn("hit", offered(F.col("season"), F.col("ep")))
    w = W.partitionBy("show_id").orderBy("ep")
    c = c.withColumn("stop", (~F.col("hit") & ~F.coalesce(F.lag("hit").over(w), F.lit(True))).cast("int"))
    c = c.withColumn("stopped", F.coalesce(F.sum("stop").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).filter("hit and stopped = 0").select("show_id", "season", "ep")
    nxt = s.filter(offered(F.col("season") + 1, F.lit(1))).select("show_id", (F.col("season") + 1).alias("season"), F.lit(1).alias("ep"))
    return c.unionByName(nxt)


TOK = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
NAMES = f"f AS (SELECT DISTINCT item_id, id, name, id % 9 = 0 AS by_hash, id * 17 % 9000 AS dl, regexp_replace(name, '^.*/', '') AS nm FROM files WHERE name IS NOT NULL AND regexp_matches(name, '(?i)\\.(ass|srt)$')), i AS (SELECT DISTINCT id AS item_id, name AS rel FROM downloads WHERE name IS NOT NULL)"
M04 = f"""WITH {NAMES},
t AS (SELECT f.*, i.rel, list_filter({TOK.format('rel')}, lambda x: x NOT IN {words(S.STOPWORDS)}) AS want, {TOK.format('nm')} AS have FROM f JOIN i USING (item_id)),
s AS (SELECT item_id, id, CASE WHEN ({has('nm', S.SPLIT_DISC)} AND NOT {has('rel', S.SPLIT_DISC)}) OR (NOT by_hash AND cov < 0.6) THEN -1.0 ELSE CASE WHEN by_hash THEN 200 ELSE 0 END + 100 * cov + 10 * len(list_intersect(have, {TOK.format('rel')})) + least(dl, 5000) / 1000 END AS score
  FROM (SELECT *, CASE WHEN len(want) > 0 THEN len(list_intersect(want, have)) / len(want) ELSE 0.0 END AS cov FROM t))
SELECT item_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS r FROM s WHERE score >= 0) WHERE r = 1"""


@query(M04)
def m04_t08_r07_subtitles(spark: SparkSession, d: str) -> DataFrame:
    """The best subtitle file for each download by shared words, with rejections."""
    f = table(spark, d, "files", "id", "item_id", "name").dropDuplicates().filter(F.col("name").rlike(r"(?i)\.(ass|srt)$"))
    i = table(spark, d, "downloads", "id", "name").dropDuplicates().filter("name is not null").select(F.col("id").alias("item_id"), F.col("name").alias("rel"))
    last = F.regexp_replace("name", "^.*/", "")
    s = f.join(i, "item_id").withColumn("score", S.subtitle_score(last, F.col("rel"), F.col("rel"), F.col("id") % 9 == 0, F.col("id") * 17 % 9000)).filter("score >= 0")
    return rank.extreme(s, ["item_id"], [("score", True), ("id", False)], ["id", "score"]).select("item_id", "id", F.round("score", 6).alias("score"))
