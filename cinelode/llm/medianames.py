"""What a typed path of a media file says: its title, and which part of it the file is."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# File extensions by class.
VIDEO = {"mkv", "mp4", "avi", "m4v", "mov", "wmv", "ts", "m2ts", "webm", "mpg", "mpeg", "flv", "ogm"}
AUDIO = {"flac", "ape", "mp3", "m4a", "ogg", "opus", "wav", "wv", "aac", "alac", "wma", "dsf", "dff", "tta"}
SUBTITLE = {"ass", "srt", "ssa", "sub", "vtt", "idx", "sup"}

# Letters of other scripts that look like Latin ones, and digits typed for letters.
CYRILLIC_LIKE_LATIN = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "к": "k", "м": "m", "н": "h", "т": "t", "в": "b", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ɡ": "g", "α": "a", "ο": "o", "ε": "e", "ι": "i", "ν": "v", "ρ": "p", "τ": "t"}
LATIN_LIKE_CYRILLIC = {"a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "y": "у", "x": "х", "i": "і", "k": "к", "m": "м", "t": "т", "b": "в"}
DIGIT_FOR_LETTER = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

# Words for numbers, small words that typed titles lose, folder and tag words.
NUMBER_WORDS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20}
LOST_WORDS = {"the", "a", "an", "and"}
EXTRAS_FOLDERS = {"extras", "extra", "bonus", "featurettes", "featurette", "behind the scenes", "deleted scenes", "interviews", "trailers", "shorts", "other"}
SAMPLE_FOLDERS = {"sample", "samples", "proof"}

_TAIL = re.compile(r"(?:[\s._-]*(?:\(\d{1,2}\)|\bcopy(?:\s*\d+)?|\.?\b(?:repack|proper|rerip|real)\b))+\s*$", re.I)
_BRACKETS = re.compile(r"\[[^\]]*\]|\([^)]*\)|【[^】]*】|\{[^}]*\}")
_SEASON_FOLDER = re.compile(r"^\s*(?:season|series|s)[\s._-]*0*(\d{1,3})\s*$|^\s*(\d{1,2})(?:st|nd|rd|th)\s+season\s*$", re.I)
_SPECIALS_FOLDER = re.compile(r"^\s*(?:specials?|ova|oad|season\s*0+|s0+)\s*$", re.I)
_DISC_FOLDER = re.compile(r"^\s*(?:cd|disc|disk|dvd)[\s._-]*0*(\d{1,2})\s*$", re.I)
_SAMPLE = re.compile(r"(?:^|[\s._-])sample(?:$|[\s._-])", re.I)
_WORDS = "|".join(NUMBER_WORDS)

# Each: pattern, season group, episode group; None as season means that the name has none.
_SPECIAL = re.compile(r"(?:^|[\s._-])(?:ova|oad|ona|specials?|sp)[\s._#-]*0*(\d{1,3})(?:v\d)?(?=$|[\s._\[(-])", re.I)
_EPISODE = [
    (re.compile(r"(?:^|[\s._\-\])(])s0*(\d{1,3})[\s._-]*e(?:p(?:isode)?)?[\s._-]*0*(\d{1,4})(?:v\d)?(?![0-9a-z])", re.I), 1, 2),
    (re.compile(r"(?:^|[\s._\-\])(])0*(\d{1,2})x0*(\d{1,4})(?![0-9a-z])", re.I), 1, 2),
    (re.compile(r"(?:^|[\s._-])(?:season|series)[\s._]*0*(\d{1,3})[\s._]*-[\s._]*0*(\d{1,4})(?:v\d)?(?![0-9a-z])", re.I), 1, 2),
    (re.compile(r"(?:^|[\s._-])0*(\d{1,2})(?:st|nd|rd|th)[\s._]+season[\s._]*-[\s._]*0*(\d{1,4})(?:v\d)?(?![0-9a-z])", re.I), 1, 2),
    (re.compile(r"(?:^|[\s._-])(?:season|series)[\s._]*0*(\d{1,3})[\s._,-]*(?:episode|ep|e)[\s._]*0*(\d{1,4})(?![0-9a-z])", re.I), 1, 2),
    (re.compile(r"^\s*(\d{2})\.(\d{2})(?=$|[\s._-])"), 1, 2),
    (re.compile(r"第\s*0*(\d{1,4})\s*[話集回]"), None, 1),
    (re.compile(r"(?:^|[\s,._-])(?:episode|ep)[\s._]*0*(\d{1,4})(?:v\d)?(?![0-9a-z])", re.I), None, 1),
    (re.compile(rf"(?:^|[\s,._-])(?:episode|ep)[\s._]+({_WORDS})(?![0-9a-z])", re.I), None, 1),
    (re.compile(r"^\s*e0*(\d{1,4})(?=$|[\s._-])", re.I), None, 1),
    (re.compile(r"#\s*0*(\d{1,4})(?![0-9a-z])"), None, 1),
    (re.compile(r"[\s._]-[\s._]*0*(\d{1,4})(?:v\d)?(?=$|[\s._\[(])"), None, 1),
]
_ANY_DIGIT = re.compile(r"\d")
# What a text must hold for the patterns of releases, sound tracks and copies to match.
_SCENE_SIGNS = ("480p", "576p", "720p", "1080p", "1080i", "2160p", "4k", "blu", "web", "hdtv", "rip", "x264", "x265", "h264", "h265", "hevc", "remux")
_SOUND_SIGNS = ("sound", "ost", "o.s.t", "vocal", "score", "song", "theme", "music", "drama")
_TAIL_SIGNS = (")", "copy", "repack", "proper", "rerip", "real")
#: Without a digit or a number's word after "episode" no pattern of an episode can match.
_NUMBERED = re.compile(r"\d|ep(?:isode)?[\s._]+[a-z]", re.I)
_SPACES = re.compile(r"\s+")
_EXTENSION = re.compile(r"[a-z0-9]{2,4}")
_TRACK = re.compile(r"^\s*(?:(\d{1,2})\s*-\s*(?=\d))?0*(\d{1,3})(?=$|[\s._-])")
_SEASON_IN_TITLE = re.compile(r"[\s._-]+(?:(?:season|series)[\s._]*\d{1,3}|\d{1,2}(?:st|nd|rd|th)[\s._]+season|s\d{1,3})\s*$", re.I)
_FILM = re.compile(r"[\s._-]*(?:\bthe[\s._]+movie\b|\bmovie\b|\bfilm\b)[\s._-]*(?:\(?(?:19|20)\d\d\)?)?.*$", re.I)
_SCENE = re.compile(r"[\s._]+(?:(?:19|20)\d\d[\s._]+)?(?:480p|576p|720p|1080p|1080i|2160p|4k|bluray|blu-ray|web-dl|webrip|hdtv|dvdrip|bdrip|x264|x265|h264|h265|hevc|remux)\b.*$", re.I)
_YEAR = re.compile(r"[\s._]+\(?(?:19|20)\d\d\)?\s*$")
_SOUND = re.compile(r"[\s._-]+(?:original[\s._]+(?:motion[\s._]+picture[\s._]+)?sound[\s._]*track|sound[\s._]*track|ost|o\.s\.t\.?|vocal[\s._]+collection|original[\s._]+score|score|character[\s._]+songs?|(?:opening|ending)[\s._]+themes?|music[\s._]+collection|drama[\s._]+cd)\b.*$", re.I)


class Name(NamedTuple):
    """Parts of a path. ``kind``: episode, film, extra, track, sample, or '' for no name."""

    kind: str
    media: str
    season: int | None
    number: int | None
    label: str
    titles: tuple[str, ...]


def letters(text: str) -> str:
    """Lower case, full width to half width, no diacritics on Latin letters."""
    if text.isascii():
        return text.lower()
    out = []
    for c in unicodedata.normalize("NFKC", text).casefold():
        if ord(c) < 128:
            out.append(c)
        elif unicodedata.combining(c):
            continue
        else:
            d = unicodedata.normalize("NFD", c)
            out.append(d[0] if ord(d[0]) < 128 else c)
    return "".join(out).replace("ё", "е").replace("ø", "o").replace("ł", "l").replace("æ", "ae").replace("ß", "ss")


_APOSTROPHE = re.compile(r"['’`´ʼ]")
_TOKEN = re.compile(r"[^\W_]+(?:[@$][^\W_]+)*", re.U)


def tokens(text: str) -> list[str]:
    """Words of a title with look-alike letters and digits for letters undone."""
    out = []
    for t in _TOKEN.findall(_APOSTROPHE.sub("", letters(text))):
        if t.isascii():
            out.append(t if t.isalpha() or t.isdigit() else _undigit(t))
            continue
        latin = sum("a" <= c <= "z" for c in t)
        cyrillic = sum("Ѐ" <= c <= "ԯ" for c in t)
        if latin and latin >= cyrillic:
            t = "".join(CYRILLIC_LIKE_LATIN.get(c, c) for c in t)
        elif cyrillic and latin:
            t = "".join(LATIN_LIKE_CYRILLIC.get(c, c) for c in t)
        elif not latin and t in CYRILLIC_LIKE_LATIN and len(t) == 1:
            t = CYRILLIC_LIKE_LATIN[t]
        if latin and not t.isalpha():
            t = "".join(DIGIT_FOR_LETTER.get(c, c) for c in t)
        out.append(t)
    return out


def _undigit(t: str) -> str:
    return "".join(DIGIT_FOR_LETTER.get(c, c) for c in t) if any("a" <= c <= "z" for c in t) else t


def key(text: str) -> str:
    """The form in which titles are compared: no spaces, marks, articles or 'and'."""
    words = tokens(text)
    return "".join([w for w in words if w not in LOST_WORDS] or words)


def spellings(title: str) -> list[tuple[str, ...]]:
    """Word sequences that mean ``title``: with and without its small words."""
    words = tuple(tokens(title.replace("&", " and ")))
    bare = tuple(w for w in words if w not in LOST_WORDS)
    return [x for x in dict.fromkeys([bare, words]) if x]


def forms(title: str) -> list[tuple[str, ...]]:
    """Word sequences under which a listed title is entered: its spellings, also with the last or first word moved."""
    out = []
    for words in spellings(title):
        out += [words, (words[-1], *words[:-1]), (*words[1:], words[0])]
    return list(dict.fromkeys(out))


@lru_cache(200_000)
def _clean(part: str) -> str:
    """A part of a path as a title: without brackets, tags, years, season and sound track words. Files share folders and titles, so parts are kept."""
    s = _unbracketed(part)
    s = _untailed(s)
    low = s.lower()
    digit = _ANY_DIGIT.search(s)
    # Costly patterns run only where a sign of theirs is.
    if any(x in low for x in _SCENE_SIGNS):
        s = _SCENE.sub("", s)
    if any(x in low for x in _SOUND_SIGNS):
        s = _SOUND.sub("", s)
    if "movie" in low or "film" in low:
        s = _FILM.sub("", s)
    if digit:
        s = _SPECIAL.sub(" ", s)
        s = _YEAR.sub("", s.rstrip())
        s = _SEASON_IN_TITLE.sub("", s.rstrip(" ._-"))
    return s.strip(" ._-,")


def _unbracketed(s: str) -> str:
    return _BRACKETS.sub(" ", s) if "[" in s or "(" in s or "{" in s or "【" in s else s


def _untailed(s: str) -> str:
    """Without marks of a copy or a repeated release at the end."""
    t = s.rstrip().lower()
    return _TAIL.sub("", s) if t.endswith(_TAIL_SIGNS) or t[-1:].isdigit() and "copy" in t else s


@lru_cache(100_000)
def _folder(f: str) -> tuple[str, int | None]:
    """What a folder says: season, disc, extra, sample or title, with its number."""
    low = f.lower().strip()
    if m := _SEASON_FOLDER.match(f):
        return "season", int(m[1] or m[2])
    if _SPECIALS_FOLDER.match(f):
        return "season", 0
    if m := _DISC_FOLDER.match(f):
        return "disc", int(m[1])
    if low in EXTRAS_FOLDERS:
        return "extra", None
    return ("sample" if low in SAMPLE_FOLDERS else "title"), None


def parse(path: str | None) -> Name:
    """Read ``path``. A missing or blank one gives kind ''."""
    text = path or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    parts = [x for p in text.replace("\\", "/").split("/") if (x := p.strip())]
    if not parts:
        return Name("", "", None, None, "", ())
    folders, last = parts[:-1], parts[-1]
    stem, dot, ext = last.rpartition(".")
    ext = ext.strip().lower()
    media = "video" if ext in VIDEO else "audio" if ext in AUDIO else "subtitle" if ext in SUBTITLE else ""
    if not dot or not media and not _EXTENSION.fullmatch(ext):
        stem = last
    stem = _untailed(stem).strip()
    season, disc, extra, sample, above = None, None, False, False, []
    for f in folders:
        kind, n = _folder(f)
        if kind == "season":
            season = n
        elif kind == "disc":
            disc = n
        elif kind == "title":
            above.append(f)
        extra, sample = extra or kind == "extra", sample or kind == "sample"
    higher = [t for t in (_clean(f) for f in reversed(above)) if t]
    if sample or _SAMPLE.search(stem):
        cut = _SAMPLE.split(stem)[0]
        for pattern, _, _ in _EPISODE:
            if m := pattern.search(cut):
                cut = cut[: m.start()]
                break
        return Name("sample", media, None, None, "", tuple(t for t in [_clean(cut), *higher] if t))
    if media == "audio":
        m = _TRACK.match(stem)
        if m:
            return Name("track", media, disc or (int(m[1]) if m[1] else 1), int(m[2]), "", tuple(higher))
        return Name("track", media, disc or 1, None, key(stem), tuple(higher))
    if extra:
        return Name("extra", media, None, None, "".join(tokens(_BRACKETS.sub(" ", stem))), tuple(higher))
    bare = _SPACES.sub(" ", _unbracketed(stem)).rstrip()
    numbered = _NUMBERED.search(bare)
    for pattern, s, e in _EPISODE[:6] if numbered else ():
        if m := pattern.search(bare):
            return Name("episode", media, int(m[s]), int(m[e]), "", _titles(bare[: m.start()], higher))
    if numbered and (m := _SPECIAL.search(bare)):
        return Name("episode", media, 0, int(m[1]), "", _titles(bare[: m.start()], higher))
    for pattern, _, e in _EPISODE[6:] if numbered else ():
        if m := pattern.search(bare):
            n = NUMBER_WORDS[m[e].lower()] if m[e].lower() in NUMBER_WORDS else int(m[e])
            head = bare[: m.start()]
            if season is None and (x := _SEASON_IN_TITLE.search(head.rstrip(" ._-"))):
                season = int(re.search(r"\d+", x[0])[0])
            return Name("episode", media, season, n, "", _titles(head, higher))
    return Name("film", media, None, None, "", _titles(bare, higher))


def _titles(head: str, higher: list[str]) -> tuple[str, ...]:
    t = _clean(head)
    return tuple([t, *higher] if t else higher)
