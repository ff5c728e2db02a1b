"""Scores and measures of releases, voices and lines as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinelode.functions import patterns as P


def resolution(c: Column) -> Column:
    return F.when(c.contains("2160p"), 4).when(c.contains("1080p"), 3).when(c.contains("720p"), 2).when(c.contains("480p"), 1).otherwise(0)


def quality(name: Column) -> Column:
    """Score of a copy of an episode: remux and upscale last, then resolution, disc, HDR, foreign only."""
    f = F.lower(name)
    foreign = F.when(f.rlike(P.FOREIGN) & ~f.rlike(P.WITH_ORIGINAL), 30).otherwise(0)
    plain = resolution(f) * 100 + F.when(f.rlike("blu-?ray"), 10).otherwise(0) + F.when(f.rlike(P.HDR), 5).otherwise(0) - foreign
    return F.when(f.contains("remux"), -1000).when(f.rlike(P.UPSCALE), -2000).otherwise(plain)


def dub_only(title: Column) -> Column:
    return title.rlike(P.DUB) & ~title.rlike(P.ORIGINAL)


def lossless(title: Column, lossless_cat: Column, lossy_cat: Column) -> Column:
    """True, False, or NULL where the release does not say."""
    return F.when(lossless_cat | title.rlike(P.LOSSLESS), True).when(lossy_cat | title.rlike(P.LOSSY), False)


def size_limit(title: Column, music: bool = False) -> Column:
    if music:
        return F.when(title.rlike(P.BOXSET), P.DISCOGRAPHY_MAX).otherwise(F.lit(P.ALBUM_MAX).cast("long"))
    return F.when(title.rlike(r"(?i)s\d{1,2}e\d{1,3}"), P.EPISODE_MAX).when(title.rlike(r"(?i)s\d{1,2}\b|season\s*\d"), P.PACK_MAX).otherwise(F.lit(P.MOVIE_MAX).cast("long"))


def refusal(title: Column, size: Column) -> Column:
    """Why a video release is refused, first reason; NULL if it isn't."""
    t = F.coalesce(title, F.lit(""))
    return F.when(F.coalesce(size, F.lit(0)) > size_limit(t), "size").when(t.rlike("(?i)remux"), "remux").when(dub_only(t), "dub-only")


def music_refusal(title: Column, size: Column, is_lossless: Column) -> Column:
    t = F.coalesce(title, F.lit(""))
    return F.when(F.coalesce(size, F.lit(0)) > size_limit(t, True), "size").when(t.rlike(P.VIDEO_RELEASE), "video").when(~is_lossless, "lossy")


def release_score(title: Column, seeders: Column, size: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    small = F.when(F.coalesce(size, F.lit(0)) < 200_000_000, 100_000).otherwise(0)
    return resolution(t) * 1000 + F.when(t.rlike("blu-?ray"), 200).otherwise(0) + F.when(t.rlike(P.HDR), 100).otherwise(0) + F.least(F.coalesce(seeders, F.lit(0)), F.lit(500)) - F.when(t.rlike(P.DUB), 300).otherwise(0) - small


def music_score(title: Column, seeders: Column, size: Column, is_lossless: Column) -> Column:
    t = F.coalesce(title, F.lit(""))
    cue = F.when(t.rlike(P.CUE_TRACKS), 300).when(t.rlike(P.CUE_IMAGE), -300).otherwise(0)
    high = F.when(t.rlike(r"(?i)\b24\s?bit|24-?96|24-?192\b"), 100).otherwise(0)
    small = F.when(F.coalesce(size, F.lit(0)) < 20_000_000, 100_000).otherwise(0)
    return F.least(F.coalesce(seeders, F.lit(0)), F.lit(500)) + F.when(is_lossless, 2000).otherwise(0) + cue + high - small


# Fixed value: words that carry no title.
STOPWORDS = ("the", "a", "an", "of", "and", "or")
SPLIT_DISC = r"(?i)\b(?:cd|disc|disk|part|pt)\s*[._-]?\s*([0-9])\b"


def word_set(c: Column) -> Column:
    """Distinct lower-case ASCII words; NULL has none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1))


def subtitle_score(name: Column, release: Column, title: Column, by_hash: Column, downloads: Column) -> Column:
    """Rank of a subtitle for a release; -1 rejects a half of a split or too little of the title."""
    want = F.filter(word_set(title), lambda x: ~x.isin(*STOPWORDS))
    covered = F.when(F.size(want) > 0, F.size(F.array_intersect(want, word_set(name))) / F.size(want)).otherwise(0.0)
    shared = F.size(F.array_intersect(word_set(name), word_set(release)))
    half = name.rlike(SPLIT_DISC) & ~release.rlike(SPLIT_DISC)
    score = F.when(by_hash, 200).otherwise(0) + 100 * covered + 10 * shared + F.least(F.coalesce(downloads, F.lit(0)), F.lit(5000)) / 1000
    return F.when(half | (~by_hash & (covered < 0.6)), -1.0).otherwise(score)


# How far a role's shade may lean in pitch, pace and gain.
SHADE_PITCH, SHADE_PACE, SHADE_GAIN = 1.6, 0.06, 0.10


def hash_shade(role: Column) -> Column:
    """Struct pitch, pace, gain: a small repeatable shade from the first bytes of the role's SHA-1."""
    byte = lambda i: F.conv(F.substring(F.sha1(role.cast("binary")), 1 + 2 * i, 2), 16, 10).cast("double") / 127.5 - 1.0
    return F.struct(F.bround(byte(0) * SHADE_PITCH, 2).alias("pitch"), F.bround(1 + byte(1) * SHADE_PACE, 3).alias("pace"), F.bround(1 + byte(2) * SHADE_GAIN, 3).alias("gain"))


def pitch_shade(pitch: Column, neutral: Column, step: float = 0.25, scale: float = 8.0) -> Column:
    """Semitones to lean from neutral: softly limited, snapped to ``step``, clipped."""
    leaned = F.bround(SHADE_PITCH * F.tanh(12 * F.log2(pitch / neutral) / scale) / step) * step
    return F.bround(F.least(F.greatest(leaned, F.lit(-SHADE_PITCH)), F.lit(SHADE_PITCH)), 2)


def pan_gains(pan: Column) -> Column:
    """Equal-power gains (left, right) for pan -1 .. 1."""
    angle = (F.least(F.greatest(pan, F.lit(-1.0)), F.lit(1.0)) + 1) * F.pi() / 4
    return F.struct(F.cos(angle).alias("left"), F.sin(angle).alias("right"))


def wanted_level(target: Column, produced: Column, middle: Column, low: float = 0.4, high: float = 2.6) -> Column:
    """Raw gain towards a target held within (low, high) times the scene's middle; 1 where nothing was measured."""
    held = F.least(F.greatest(target, low * middle), high * middle)
    return F.when((middle > 0) & (target > 0) & (produced > 0), held / produced).otherwise(1.0)


def gain_spread(raw: Column, centre: Column, spread: float = 2.5) -> Column:
    """Gain held within ``spread`` of what the scene needs overall."""
    return F.least(F.greatest(raw, centre / spread), centre * spread)


def room(window: Column, slack: Column) -> Column:
    """Seconds a line may take before it meets the next one."""
    return window + F.greatest(F.lit(0.0), slack - P.BREATH)


def word_budget(room: Column, rate: Column) -> Column:
    return F.greatest(F.lit(2), (room * rate * 1.15).cast("int"))


def rate_name(ratio: Column) -> Column:
    """Name of the frame-rate pair within 0.005 of ``ratio`` or its inverse."""
    pairs = (("25/23.976", 25 / 23.976), ("25/24", 25 / 24), ("24/23.976", 24 / 23.976))
    out = F.lit(None).cast("string")
    for name, r in reversed(pairs):
        out = F.when((F.abs(ratio - r) <= 0.005) | (F.abs(ratio - 1 / r) <= 0.005), name).otherwise(out)
    return out


def byte_range(seconds: Column, rate: Column, channels: Column, bits: Column, first: Column, last: Column) -> Column:
    """Struct of a slice's WAV bytes: block, length, first and last byte after clamping, satisfiable."""
    block = channels * F.floor(bits / 8)
    length = F.floor(seconds * rate) * block + 44
    top = F.least(F.coalesce(last, length - 1), length - 1)
    return F.struct(block.alias("block"), length.cast("long").alias("length"), first.cast("long").alias("first"), top.cast("long").alias("last"), (first < length).alias("ok"))
