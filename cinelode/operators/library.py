"""From a listing of downloads to the wanted entries of a media library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelode.functions import patterns as P
from cinelode.functions import score as S
from cinelode.functions import text as T
from cinelode.operators.rank import extreme
from cinelode.session import cut


def unnested(items: DataFrame) -> DataFrame:
    """Items with an array of files to one row for each file, with its ordinal; an item without files keeps a row."""
    return items.select(*[c for c in items.columns if c != "files"], F.posexplode_outer("files").alias("file_ord", "file"))


def by_item(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Aggregates of an item beside each of its rows, by a join: a hot item is pre-aggregated, not sorted in one task."""
    one = df.groupBy(F.col("item_id").alias("__item")).agg(*[a.alias(n) for n, a in aggregates.items()])
    return df.join(one, F.col("item_id").eqNullSafe(F.col("__item"))).drop("__item")


def media_files(listed: DataFrame) -> DataFrame:
    """Playable files with ``parts`` (path in the item, wrapper folder stripped), ``cls`` and ``ext``.

    The wrapper is stripped only if all files of the item lie under one common first folder. Samples and proofs
    and files under the size floor are dropped (a missing size counts as 0).
    """
    head = F.when(F.col("name").contains("/"), F.substring_index("name", "/", 1))
    df = by_item(listed.withColumn("head", head), low=F.min("head"), high=F.max("head"), flat=F.max(F.col("head").isNull()))
    wrapped = ~F.col("flat") & (F.col("low") == F.col("high"))
    rel = F.when(wrapped, F.substring(F.col("name"), F.length("head") + 2, F.length("name"))).otherwise(F.col("name"))
    parts = F.transform(F.filter(F.split(rel, "/"), lambda x: x != ""), lambda x: T.sanitize(x))
    shown = F.coalesce(F.nullif("short_name", F.lit("")), F.col("name"))
    df = df.withColumns({"parts": parts, "ext": T.extension(shown), "cls": T.file_class(shown)}).drop("head", "low", "high", "flat")
    junk = F.exists("parts", lambda p: F.lower(p).isin("sample", "samples", "proof")) | T.stem(F.element_at("parts", -1)).rlike(P.SAMPLE)
    floor = F.when(F.col("cls") == "video", P.MIN_VIDEO).otherwise(P.MIN_AUDIO)
    return df.filter(F.col("cls").isin("video", "audio") & (F.size("parts") > 0) & ~junk & (F.coalesce("size", F.lit(0)) >= floor))


def facts(files: DataFrame) -> DataFrame:
    """Media files with all that the routing needs, from one aggregation over each item.

    Per file: ``item_title``, ``ep`` (struct of :func:`text.episode_of`), ``looks_tv``, ``stem``, ``stem_title``, ``no_tv``, ``is_release``. Per item:
    any_tv, videos, others (videos that are no episode), mains (distinct films). An item with any video is a video item and loses its
    audio files; otherwise it is music (``route``). Absolute numbers from a season folder are renumbered.
    """
    last, folder = F.element_at("parts", -1), F.when(F.size("parts") > 1, F.element_at("parts", -2)).otherwise(F.lit(""))
    video = F.col("cls") == "video"
    df = files.withColumn("item_title", T.clean_show(F.col("item")))
    df = df.withColumns({"ep": F.when(video, T.episode_of(last, folder, F.col("item_title"), item_is_title=True)), "looks_tv": F.col("name").rlike(P.TV), "stem": T.stem(last)})
    df = df.withColumns({"no_tv": video & F.col("ep.show").isNull() & ~F.col("looks_tv"), "stem_title": T.clean_show(F.col("stem"))})
    yeared = F.coalesce(F.col("stem_title").rlike(r"\((?:19|20)\d{2}\)$"), F.lit(False))
    df = df.withColumn("__film", F.col("no_tv") & (yeared | (F.coalesce("size", F.lit(0)) >= P.MAIN_FILE)))
    df = by_item(
        df,
        any_video=F.max(video),
        any_tv=F.max(video & ~F.col("no_tv")),
        videos=F.count_if(video),
        others=F.count_if("no_tv"),
        mains=F.count_distinct(F.when(F.col("__film"), F.lower(F.coalesce("stem_title", "stem")))),
    )
    df = df.filter(video | ~F.col("any_video")).withColumns(
        {
            "route": F.when(F.col("any_video"), "video").otherwise("music"),
            "is_release": F.col("__film") | (F.col("no_tv") & (F.col("others") == 1)),
            "mains": F.when(F.col("others") == 1, F.lit(1).cast("long")).otherwise(F.col("mains")),
        }
    )
    return renumbered(df).drop("__film", "any_video")


def renumbered(df: DataFrame) -> DataFrame:
    """``ep.episode`` counted 1, 2, 3 .. by (number, id) within (item, show, season) where it came from a folder's season.

    Equal numbers take different places, smallest id first.
    """
    group = W.partitionBy("item_id", "ep.show", "ep.season", "ep.of_folder").orderBy("ep.episode", "id")
    counted = df.withColumn("__n", F.row_number().over(group))
    return counted.withColumn("ep", F.col("ep").withField("episode", F.when(F.col("ep.of_folder"), F.col("__n")).otherwise(F.col("ep.episode")))).drop("__n")


def film_dir(df: DataFrame) -> DataFrame:
    """``folder`` of a film file; NULL for other files and for bonus material of a series, which is dropped."""
    own, of_item = F.col("stem_title"), F.col("item_title")
    bonus = (F.col("videos") > 1) & ((F.size("parts") > 1) | F.col("stem").rlike(P.EXTRAS) | F.col("stem").rlike(r"(?i)\bnc(?:op|ed)"))
    yeared = lambda c: F.coalesce(c.rlike(r"\((?:19|20)\d{2}\)$"), F.lit(False))

    def chosen(of: Column) -> Column:
        first = F.when((F.col("mains") > 1) | F.col("any_tv") | ~bonus, F.coalesce(own, of, "item")).otherwise(F.coalesce(of, "item"))
        return T.let(first, lambda c: F.when(~yeared(c) & yeared(of), of).otherwise(c))

    dropped = ~F.col("no_tv") | (F.col("any_tv") & ~F.col("is_release"))
    return df.withColumn("folder", F.when(~dropped, T.sanitize(T.let(of_item, chosen))))


def music_dirs(df: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """``artist``, ``album``, ``discs`` and ``is_music`` of an audio file; the deepest named folder is the album. NULL for other files.

    ``sheets`` (item_id, performer, title, date; one row an item) state what a download's name only implies, and go before it.
    """
    told = lambda c: F.nullif(F.col(f"__{c}"), F.lit(""))
    if sheets is None:
        df = df.withColumns({f"__{c}": F.lit(None).cast(t) for c, t in (("performer", "string"), ("title", "string"), ("date", "int"))})
    else:
        s = sheets.select(F.col("item_id").alias("__sheet_of"), F.col("performer").alias("__performer"), F.col("title").alias("__title"), F.col("date").cast("int").alias("__date"))
        df = df.join(s, F.col("item_id") == F.col("__sheet_of"), "left").drop("__sheet_of")
    dirs = F.filter(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), lambda p: ~F.lower(p).isin(*P.MUSIC_JUNK_DIRS))
    named = F.get(F.reverse(F.filter(dirs, lambda p: ~p.rlike(P.DISC_DIR))), 0)
    discs = F.transform(F.filter(dirs, lambda p: p.rlike(P.DISC_DIR)), lambda p: F.format_string("CD %02d", F.regexp_extract(p, P.DISC_DIR, 1).cast("int")))

    def chosen(x: Column) -> Column:
        sub = x["sub"]["album"].isNotNull()
        artist = F.when(sub, F.coalesce(x["sub"]["artist"], x["item"]["artist"])).otherwise(x["item"]["artist"])
        album = F.when(sub, x["sub"]["album"]).otherwise(x["item"]["album"])
        year = F.when(sub, x["sub"]["year"]).otherwise(x["item"]["year"])
        whole = T.album_dir(F.coalesce(album, F.col("item")), year)
        return F.struct(T.sanitize(F.coalesce(artist, album, F.col("item"))).alias("artist"), T.sanitize(whole).alias("album"), F.coalesce(artist, album).isNotNull().alias("fine"))

    item = T.let(T.artist_album(F.col("item")), lambda i: F.struct(F.coalesce(told("performer"), i["artist"]).alias("artist"), F.coalesce(told("title"), i["album"]).alias("album"), F.coalesce("__date", i["year"]).alias("year")))
    both = F.struct(item.alias("item"), T.artist_album(named).alias("sub"))
    m = F.when(F.col("route") == "music", T.let(both, chosen))
    df = df.withColumns({"__m": m, "discs": discs})
    return df.withColumns({"artist": F.col("__m.artist"), "album": F.col("__m.album"), "is_music": F.coalesce("__m.fine", F.lit(False))}).drop("__m", "__performer", "__title", "__date")


def wanted(listed: DataFrame) -> DataFrame:
    """Entries of the library: dest (tv, movies, music), folder, rest, path, id, kind, item_id, name, lossy, kind_ord.

    Every file goes its way by conditions on its own row, so the plan is one line from the scan to the result: no
    branch reads or shuffles the listing again. First-wins order among sources of one path is (kind, item_id, id), lossless audio first.
    """
    files = film_dir(facts(media_files(listed)))
    files = music_dirs(files)
    last = F.element_at("parts", -1)
    episode, loose, film = F.col("ep.show").isNotNull(), F.col("looks_tv") & F.col("ep.show").isNull(), F.col("no_tv")
    video = F.col("route") == "video"
    dest = F.when(~video, "music").when(film, "movies").otherwise("tv")
    folder = F.when(~video, F.concat_ws("/", "artist", "album")).when(film, F.col("folder")).when(episode, T.sanitize(F.col("ep.show"))).otherwise(T.sanitize(F.coalesce("item_title", "item")))
    numbered = F.concat(F.format_string("S%02dE%02d - ", F.col("ep.season"), F.col("ep.episode")), T.friendly_name(last))
    episode_rest = F.concat_ws("/", F.format_string("Season %02d", "ep.season"), F.when(F.col("ep.named"), last).otherwise(numbered))
    above = F.array_join(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), "/")
    season_dir = F.nullif(F.regexp_extract(above, P.SEASON_FOLDER, 1), F.lit("")).try_cast("int")
    loose_rest = F.when(season_dir.isNotNull(), F.concat_ws("/", F.format_string("Season %02d", season_dir), last)).otherwise(F.array_join("parts", "/"))
    film_rest = F.when(F.col("is_release"), last).otherwise(F.concat(F.lit("Featurettes/"), last))
    music_rest = F.concat_ws("/", "discs", T.stem(last))
    rest = F.when(~video, music_rest).when(film, film_rest).when(loose, loose_rest).otherwise(episode_rest)
    kept = F.when(~video, F.col("is_music")).when(film, F.col("folder").isNotNull()).otherwise(True)
    kind_ord = F.when(F.col("kind") == "torrents", 0).when(F.col("kind") == "usenet", 1).otherwise(2)
    rows = files.filter(kept).select(dest.alias("dest"), folder.alias("folder"), rest.alias("rest"), "kind", "item_id", "id", "name", F.when(video, 0).otherwise((~F.col("ext").isin(*P.LOSSLESS_EXT)).cast("int")).alias("lossy"), kind_ord.alias("kind_ord"))
    return rows.withColumn("path", F.concat_ws("/", "folder", "rest"))


def first_source(rows: DataFrame) -> DataFrame:
    """One source for each (dest, path), first wins; ``skipped`` counts the other sources."""
    keep = ["kind_ord", "lossy", "item_id", "id", "folder", "rest"]
    order = [("kind_ord", False), ("lossy", False), ("item_id", False), ("id", False)]
    return extreme(rows, ["dest", "path"], order, keep, skipped=F.count(F.lit(1)) - 1)


YEAR_END = r"\s*\((?:19|20)\d{2}(?:-(?:19|20)\d{2})?\)$"


def canonical_folders(rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(dest, folder, canon, n, variants): folders of series and films that mean one title, and the one to keep.

    Folders mean one title if they differ only in case or a year at the end, or if ``aliases`` (variant, title; both
    lower case) name them so, with the year or without. Of an aliased title the variant that is spelt like it wins, not in capitals if there is another; else a
    yeared variant, then the one with most files, then the first by name. Music is left out.
    """
    counts = rows.filter(F.col("dest").isin("tv", "movies")).groupBy("dest", "folder").agg(F.count(F.lit(1)).alias("n"))
    bare = F.lower(F.regexp_replace("folder", YEAR_END, ""))
    if aliases is None:
        counts = counts.withColumn("aliased", F.lit(None).cast("string"))
    else:
        # One title for each variant; the first by name if the setting names several.
        one = aliases.groupBy("variant").agg(F.min("title").alias("title"))
        for c, k in (("__whole", F.lower("folder")), ("__bare", bare)):
            counts = counts.withColumn("__key", k).join(one.select(F.col("variant").alias("__key"), F.col("title").alias(c)), "__key", "left").drop("__key")
        counts = counts.withColumn("aliased", F.coalesce("__whole", "__bare")).drop("__whole", "__bare")
    counts = counts.withColumns({"base": F.coalesce("aliased", bare), "yeared": F.col("folder").rlike(YEAR_END.removeprefix(r"\s*"))})
    # One row a folder; a title has few.
    title = W.partitionBy("dest", "base")
    spelt = F.max(F.col("aliased").isNotNull()).over(title) & (F.lower("folder") == F.col("base"))
    counts = counts.withColumn("__spelt", spelt)
    loud = F.col("folder") == F.upper("folder")
    order = F.struct(~F.col("__spelt"), F.when(F.col("__spelt"), loud).otherwise(False), ~F.col("yeared"), F.when(~F.col("yeared"), -F.col("n")).otherwise(0), "folder")
    return counts.withColumns({"canon": F.min(order).over(title)["folder"], "variants": F.count(F.lit(1)).over(title)}).select("dest", "folder", "canon", "n", "variants")


def merged_folders(rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Entries with their folders renamed to the ones to keep. Paths that fall together have one source again only after :func:`first_source`.

    The entries are written once, as they are counted before they are renamed.
    """
    rows = cut(rows)
    names = canonical_folders(rows, aliases).filter("folder <> canon").select(F.col("dest").alias("__d"), F.col("folder").alias("__f"), "canon")
    joined = rows.join(names, (F.col("dest") == F.col("__d")) & (F.col("folder") == F.col("__f")), "left")
    folder = F.coalesce("canon", "folder")
    return joined.withColumn("folder", folder).drop("__d", "__f", "canon").withColumn("path", F.concat_ws("/", "folder", "rest"))


def best_copies(rows: DataFrame) -> DataFrame:
    """The best copy of each episode (show, season, episode) by quality, ties by kind, item and id."""
    ep = rows.filter((F.col("dest") == "tv") & F.col("rest").rlike(r"^Season \d+/[^/]+$") & F.col("rest").rlike(P.EPISODE_TOKEN))
    ep = ep.withColumns({"show": F.lower("folder"), "season": F.regexp_extract("rest", r"^Season (\d+)/", 1).cast("int"), "episode": F.regexp_extract(F.regexp_extract("rest", r"/(.*)$", 1), P.EPISODE_TOKEN, 2).cast("int"), "score": S.quality(F.element_at(F.split("rest", "/"), -1))})
    return extreme(ep, ["show", "season", "episode"], [("score", True), ("kind_ord", False), ("item_id", False), ("id", False)], ["id", "item_id", "score", "path"])


def best_films(rows: DataFrame) -> DataFrame:
    """The best file of each film folder; files in extras folders are left alone and not listed."""
    main = rows.filter((F.col("dest") == "movies") & ~F.col("rest").contains("/"))
    main = main.withColumn("score", S.quality(F.col("rest")))
    return extreme(main, ["folder"], [("score", True), ("kind_ord", False), ("item_id", False), ("id", False)], ["id", "item_id", "score", "path"])


def covers(files: DataFrame) -> DataFrame:
    """The front cover of each item: best name, then largest, then smallest id. Image files of a plausible size only."""
    shown = F.lower(F.coalesce(F.nullif("short_name", F.lit("")), F.col("name")))
    stem = T.stem(shown)
    rank = F.lit(len(P.COVER_NAMES))
    for i, n in reversed(list(enumerate(P.COVER_NAMES))):
        rank = F.when(stem.contains(n), i).otherwise(rank)
    rank = rank + F.when(stem.rlike(P.BACK_COVER), len(P.COVER_NAMES)).otherwise(0)
    fit = T.extension(shown).isin(*P.IMAGE_EXT) & (F.col("size") > P.COVER_MIN) & (F.col("size") < P.COVER_MAX)
    return extreme(files.filter(fit).withColumn("rank", rank), ["item_id"], [("rank", False), ("size", True), ("id", False)], ["id", "rank", "size"])
