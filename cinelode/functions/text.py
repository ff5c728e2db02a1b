"""Names, titles, labels and stamps as Column expressions (no Python in the plan).

Every function takes and gives Columns; NULL gives NULL unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinelode.functions import patterns as P


def strip(c: Column, chars: str = r"\s") -> Column:
    """Without the characters of class ``chars`` at both ends."""
    return F.regexp_replace(c, rf"^[{chars}]+|[{chars}]+$", "")


def cut_at(c: Column, pattern: str) -> Column:
    """What stands before the first match of ``pattern``; all of it if there is none."""
    flags = "(?is)" if pattern.startswith("(?i)") else "(?s)"
    return F.regexp_replace(c, rf"{flags}(?:{pattern.removeprefix('(?i)')}).*$", "")


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), 0)


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL if it is missing or empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def unquote(c: Column) -> Column:
    """URL escapes undone; a plus stays, malformed text comes back unchanged."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def extension(c: Column) -> Column:
    """Lower-case extension without its dot, NULL if there is none."""
    return F.lower(found(c, r"\.([^./]+)$"))


def file_class(c: Column) -> Column:
    """video, audio, subtitle, image or other."""
    e = extension(c)
    return (
        F.when(e.isin(*P.VIDEO_EXT), "video")
        .when(e.isin(*P.AUDIO_EXT), "audio")
        .when(e.isin(*P.SUBTITLE_EXT), "subtitle")
        .when(e.isin(*P.IMAGE_EXT), "image")
        .otherwise("other")
    )


def stem(c: Column) -> Column:
    """Last part of a path without its extension."""
    return F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"(.)\.[^.]*$", "$1")


def without_site(c: Column) -> Column:
    """Up to three stacked site or group prefixes removed."""
    for _ in range(3):
        c = strip(F.regexp_replace(c, P.SITE_PREFIX, ""))
    return c


def clean_show(c: Column) -> Column:
    """Show or film title of a release name, NULL if nothing is left."""
    t = F.regexp_replace(without_site(unquote(c)), r"\[[^\]]*\]\s*$", "")
    t = cut_at(cut_at(t, P.SHOW_CUT), P.QUALITY)
    t = strip(F.regexp_replace(t, r"[._]+", " "), r" \-–—,;(\[")
    t = F.regexp_replace(t, r"\b((?:19|20)\d{2})\s*$", "($1)")
    t = F.regexp_replace(t, r"\(((?:19|20)\d{2})\s*[-–—]\s*(?:19|20)?\d{2,4}\)\s*$", "($1)")
    return F.nullif(t, F.lit(""))


def friendly_name(c: Column) -> Column:
    """'01.02 - x' as 'S01E02 - x'; other names unchanged."""
    a, b = F.regexp_extract(c, P.DOT_EPISODE, 1), F.regexp_extract(c, P.DOT_EPISODE, 2)
    head = F.format_string("S%02dE%02d - ", F.coalesce(a.try_cast("int"), F.lit(0)), F.coalesce(b.try_cast("int"), F.lit(0)))
    return F.when(c.rlike(P.DOT_EPISODE), F.concat(head, F.regexp_replace(c, P.DOT_EPISODE, ""))).otherwise(c)


def sanitize(c: Column) -> Column:
    """A part of a path without forbidden characters; 'untitled' if nothing is left."""
    t = strip(strip(F.regexp_replace(c, P.BAD_CHARS, "")), r"\.")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("untitled"))


def episode_of(name: Column, folder: Column, item: Column, item_is_title: bool = False) -> Column:
    """Struct show, season, episode, named (the name has an SxxEyy token), of_folder; show NULL if it is no episode.

    Tried in order: SxxEyy, NxM, SS.EE, absolute number behind a dash, absolute number between dots before a quality word. Without a season in the name it is that of
    the folder, else 1; a title that ends in OVA or special is season 0.
    """
    number = lambda c: c.try_cast("int")

    def parts(probe: Column) -> Column:
        dash = F.when(~F.regexp_extract(probe, P.DASH_EPISODE, 1).rlike(r"(?i)\b(?:vol|part|chapter)\.?$"), F.coalesce(found(probe, P.DASH_EPISODE, 2), found(probe, P.DASH_EPISODE, 3)))
        dot = found(probe, P.ABSOLUTE_DOT, 2)
        absolute = F.coalesce(dash, dot)
        which = F.when(probe.rlike(P.EPISODE_TOKEN), 1).when(probe.rlike(P.X_TOKEN), 2).when(probe.rlike(P.DOT_EPISODE), 3).when(absolute.isNotNull(), 4)
        shown = F.when(dash.isNotNull(), found(probe, P.DASH_EPISODE, 1)).otherwise(found(probe, P.ABSOLUTE_DOT, 1))
        return F.struct(probe.alias("probe"), which.alias("which"), absolute.alias("dash"), F.when(which == 4, shown).alias("dash_show"))

    def counted(x: Column) -> Column:
        which, probe = x["which"], x["probe"]
        pick = lambda g: F.when(which == 1, found(probe, P.EPISODE_TOKEN, g)).when(which == 2, found(probe, P.X_TOKEN, g)).when(which == 3, found(probe, P.DOT_EPISODE, g))
        own, of_folder = found(x["dash_show"], P.SEASON_END), found(folder, P.SEASON_FOLDER)
        prefix = F.when(which == 1, cut_at(probe, P.EPISODE_TOKEN)).when(which == 2, cut_at(probe, P.X_TOKEN)).when(which == 4, x["dash_show"])
        return F.struct(
            which.alias("which"),
            F.when(which == 4, F.coalesce(number(own), number(of_folder), F.lit(1))).otherwise(number(pick(1))).alias("season"),
            F.when(which == 4, number(x["dash"])).otherwise(number(pick(2))).alias("episode"),
            F.when(which.isNotNull(), F.coalesce(clean_show(prefix), item if item_is_title else clean_show(item))).alias("show"),
            F.coalesce((which == 4) & own.isNull() & of_folder.isNotNull(), F.lit(False)).alias("of_folder"),
        )

    def last(x: Column) -> Column:
        show = x["show"]
        return let(
            strip(F.regexp_replace(show, P.SPECIALS_END, ""), r" \-–—,;(\["),
            lambda bare: let(
                F.coalesce(show.rlike(P.SPECIALS_END) & (bare != ""), F.lit(False)),
                lambda special: F.struct(
                    F.when(special, bare).otherwise(show).alias("show"),
                    F.when(show.isNotNull(), F.when(special, 0).otherwise(x["season"])).alias("season"),
                    F.when(show.isNotNull(), x["episode"]).alias("episode"),
                    F.coalesce(show.isNotNull() & x["which"].isin(1, 2), F.lit(False)).alias("named"),
                    (show.isNotNull() & x["of_folder"] & ~special).alias("of_folder"),
                ),
            ),
        )

    return let(let(let(F.replace(name, F.lit("_"), F.lit(" ")), parts), counted), last)


def clean_audio_tags(c: Column) -> Column:
    """An album or artist name without formats, rip notes, label braces and disc counts."""
    t = F.regexp_replace(c, r"^\s*\([^)]*\)\s*", "")
    t = F.regexp_replace(t, r"\s*\{[^}]*\}\s*", " ")
    t = F.regexp_replace(t, r"\s*\[[^\]]*\]\s*$", "")
    for _ in range(4):
        t = strip(F.regexp_replace(F.regexp_replace(t, P.AUDIO_TAG_BRACKET, " "), P.AUDIO_TAG_TAIL, ""), r" \-–—,;(\[)\]}")
    edge = r" \-–—,;(\["
    t = let(t, lambda x: let(cut_at(x, P.AUDIO_CUT), lambda head: F.when(strip(head, edge) != "", head).otherwise(x)))
    t = F.regexp_replace(t, P.DISC_COUNT, " ")
    t = strip(F.regexp_replace(F.regexp_replace(t, r"[\(\[\{]\s*[\)\]\}]", " "), r"\s{2,}", " "), edge)
    count = lambda x, mark: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))
    return let(t, lambda x: F.concat(x, F.repeat(F.lit(")"), F.greatest(count(x, "(") - count(x, ")"), F.lit(0)))))


def artist_album(c: Column) -> Column:
    """Struct artist, album, year of a music release name; parts may be NULL."""
    dates, bare_year = r"\b((?:19|20)\d{2})[.\-/](\d{1,2})[.\-/](\d{1,2})\b", r"^\(?((?:19|20)\d{2})\)?$"
    chars = r" \-–—,;(\["
    lead = r"^\(?((?:19|20)\d{2})\)?[\s.\-–—]+(\S)"
    any_year = r"\b((?:19|20)\d{2})\b"

    def first_step(t: Column) -> Column:
        rest = F.regexp_replace(t, lead, "$2")
        parts = F.filter(F.transform(F.split(rest, r"\s+[-–—]\s*|\s*[-–—]\s+"), lambda x: strip(x, chars)), lambda x: x != "")
        return F.struct(found(t, lead).alias("year"), parts.alias("parts"))

    def second_step(x: Column) -> Column:
        parts = x["parts"]
        split = (F.size(parts) > 1) & ~F.get(parts, 0).rlike(bare_year)
        name = F.when(split, F.get(parts, 0))
        rest = F.when(split, F.slice(parts, 2, F.size(parts))).otherwise(parts)
        own = F.when(x["year"].isNull(), found(F.get(rest, 0), bare_year))
        return F.struct(F.coalesce(x["year"], own).alias("year"), name.alias("name"), F.when(own.isNotNull(), F.slice(rest, 2, F.size(rest))).otherwise(rest).alias("rest"))

    def artist(name: Column) -> Column:
        short = F.coalesce(F.nullif(strip(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", "")), F.lit("")), name)
        return let(short, lambda n: let(strip(F.substring_index(n, ",", 1)), lambda head: F.when(n.contains(",") & head.rlike(r"\S\s+\S"), head).otherwise(n)))

    def third_step(x: Column) -> Column:
        album = strip(F.array_join(x["rest"], " - "), chars)
        return let(album, lambda a: let(F.when(x["year"].isNull() & (strip(F.regexp_extract(a, rf"(?s)^(.*?){any_year}", 1), chars) != ""), found(a, any_year)), lambda inside: F.struct(x["name"].alias("name"), F.coalesce(x["year"], inside).alias("year"), F.when(inside.isNotNull(), strip(F.regexp_replace(a, rf"(?s)^(.*?){any_year}", "$1 "), chars)).otherwise(a).alias("album"))))

    def last_step(x: Column) -> Column:
        album = F.regexp_replace(x["album"], r"[\(\[]\s*(?:19|20)\d{2}\s*[\)\]]?", " ")
        album = F.when(x["year"].isNotNull(), F.regexp_replace(album, r"[\s,;.\-–—]*\b(?:19|20)\d{2}\s*$", "")).otherwise(album)
        return F.struct(F.nullif(artist(x["name"]), F.lit("")).alias("artist"), F.nullif(clean_audio_tags(album), F.lit("")).alias("album"), x["year"].try_cast("int").alias("year"))

    t = F.regexp_replace(F.regexp_replace(without_site(unquote(c)), r"_+", " "), dates, "$1")
    t = clean_audio_tags(F.regexp_replace(t, r"\(?\b((?:19|20)\d{2})\s*[-–—]\s*(?:19|20)?\d{2,4}\)?", "$1"))
    return let(let(let(let(t, first_step), second_step), third_step), last_step)


def album_dir(album: Column, year: Column) -> Column:
    return F.when(year.isNotNull(), F.concat(album, F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(album)


def word_key(c: Column) -> Column:
    """Letters and digits of any script, lower case; NULL gives ''."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", "")


def ascii_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")


def clean_speech(c: Column) -> Column:
    """Subtitle text as it is spoken: no override tags, breaks as spaces, no trailing lower-case gloss."""
    t = F.regexp_replace(c, r"\{[^}]*\}", "")
    t = F.regexp_replace(t, r"\\[Nnh]", " ")
    t = F.regexp_replace(t, P.GLOSS, "$2")
    return strip(F.regexp_replace(t, r"\s+", " "))


def clean_anchor(c: Column) -> Column:
    """Lower-case ASCII words for alignment; text of another script becomes ''."""
    t = F.regexp_replace(F.regexp_replace(c, r"\{[^}]*\}|<[^>]*>", ""), r"\\[Nnh]", " ")
    return strip(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^a-z0-9 ]", " "), r"\s+", " "))


def event_kind(text: Column, style: Column) -> Column:
    """drawing, song, sign or speech, first match wins; a NULL style names no dialogue style."""
    tags = F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\{([^}]*)\}"), 1), " ")
    low = F.lower(F.coalesce(style, F.lit("")))
    said = F.lit(False)
    for hint in P.DIALOGUE_STYLES:
        said = said | low.contains(hint)
    return F.when(tags.rlike(P.DRAWING), "drawing").when(low.rlike(P.SONG_STYLE), "song").when(tags.rlike(P.TYPESET) | ~said, "sign").otherwise("speech")


def is_group(c: Column) -> Column:
    """A label that names a crowd or several; NULL and '' name none."""
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    return t.isin(*P.GROUP_LABELS) | t.contains("/") | t.contains("&")


def group_members(c: Column) -> Column:
    """Names in a group label, an empty array if there are fewer than two."""
    parts = F.filter(F.transform(F.split(c, P.GROUP_SEPARATOR), lambda x: strip(x)), lambda x: x != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


def cue_seconds(c: Column) -> Column:
    """'mm:ss:ff' (75 frames a second) in seconds; NULL if it isn't one."""
    g = lambda i: found(c, r"^\s*(\d+):(\d+):(\d+)\s*$", i).try_cast("double")
    return g(1) * 60 + g(2) + g(3) / 75


def clock_ms(c: Column) -> Column:
    """'h:mm:ss.x', 'mm:ss' or 'ss' with dot or comma, in milliseconds; NULL if it isn't one."""
    parts = F.split(F.replace(strip(c), F.lit(","), F.lit(".")), ":")
    seconds = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x.try_cast("double"))
    return F.round(seconds * 1000).cast("long")


def clock(ms: Column, mark: str = ".", digits: int = 3) -> Column:
    """Milliseconds as h:mm:ss with ``digits`` decimals (3 as in SRT, 2 as in ASS)."""
    unit = 10 ** (3 - digits)
    t = F.floor(ms / unit)
    per = 10**digits
    hours = "%02d" if digits == 3 else "%d"
    return F.format_string(f"{hours}:%02d:%02d{mark}%0{digits}d", F.floor(t / (3600 * per)), F.pmod(F.floor(t / (60 * per)), F.lit(60)), F.pmod(F.floor(t / per), F.lit(60)), F.pmod(t, F.lit(per)))


def slug(c: Column, length: int = 40) -> Column:
    return F.substring(strip(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"\-"), 1, length)


def fill_template(c: Column, season: Column, episode: Column) -> Column:
    """A query template with its numbers put in."""
    for token, value in (("{season:02d}", F.lpad(season.cast("string"), 2, "0")), ("{ep:02d}", F.lpad(episode.cast("string"), 2, "0")), ("{season}", season.cast("string")), ("{ep}", episode.cast("string"))):
        c = F.replace(c, F.lit(token), value)
    return c


def url_safe_base64(c: Column) -> Column:
    return F.translate(F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"[\r\n]", ""), "+/", "-_")


def word_count(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))
