"""Patterns, word lists and limits of release, script and audio names.

All patterns are written so that Java and RE2 read them alike (no look-around, numbered groups).
"""

# States in which a download is ready.
READY_STATES = ("cached", "completed", "downloaded", "seeding", "uploading")
BUSY_STATES = ("downloading", "checking", "queued")

# Extensions by class.
VIDEO_EXT = ("mkv", "mp4", "avi", "m4v", "ts", "mov", "wmv", "flv", "webm", "mpg", "mpeg", "m2ts", "ogm")
AUDIO_EXT = ("flac", "ape", "wv", "alac", "m4a", "mp3", "ogg", "opus", "wav", "aiff", "aif", "dsf", "dff", "mpc", "tta", "wma")
LOSSLESS_EXT = ("flac", "ape", "wv", "alac", "wav", "aiff", "aif", "dsf", "dff", "tta")
IMAGE_EXT = ("jpg", "jpeg", "png", "webp")
SUBTITLE_EXT = ("ass", "srt", "ssa", "sub", "vtt")

# Size limits in bytes.
MIN_VIDEO, MIN_AUDIO, MAIN_FILE = 3 * 1024 * 1024, 200 * 1024, 700 * 1024 * 1024
EPISODE_MAX, PACK_MAX, MOVIE_MAX, ALBUM_MAX, DISCOGRAPHY_MAX = 12_000_000_000, 80_000_000_000, 30_000_000_000, 5_000_000_000, 60_000_000_000
COVER_MIN, COVER_MAX = 4 * 1024, 20 * 1024 * 1024

# Episode tokens and title cuts.
TV = r"(?i)(?:s\d{1,2}e\d{1,3}|\b\d{1,2}x\d{1,3}\b|\bep?\d{1,3}\b|season\s*\d+)"
EPISODE_TOKEN = r"(?i)s(\d{1,4})ep?(\d{1,4})"
X_TOKEN = r"\b(\d{1,2})x(\d{1,3})\b"
DOT_EPISODE = r"^(\d{1,2})\.(\d{1,3})(?:\s*-\s*|\s+)"
DASH_EPISODE = r"^(?:\[[^\]]*\]\s*)*(.+?)\s*-\s*(?:[eE](\d{1,3})|(\d{2,3}))(?:\s*-\s*\d{2,3})?(?:\s*v\d+)?\s*(?:[\[\(]|\.[A-Za-z0-9]{2,4}$|$)"
ABSOLUTE_DOT = r"(?i)^(.+?)\.(\d{2,3})(?:\.v\d+)?\.(?:2160p|1080p|720p|480p|bluray|brrip|bdrip|web-?dl|hdtv|x26[45]|h\.?26[45]|hevc)\b"
SEASON_END = r"(?i)\bs(\d{1,2})\s*$"
SEASON_FOLDER = r"(?i)\bseason\s*(\d{1,2})\b"
SITE_PREFIX = r"(?i)^(?:\[[^\]]*\]|www\.?\S+|[\w-]+\.(?:org|com|net|to|io|me|tv|bz|mx)(?:\s*[-–—]+\s*|\s{2,}))"
QUALITY = (
    r"(?i)\b(?:2160p|1080p|720p|480p|576p|4k|8k|uhd|blu-?ray|bdrip|brrip|remux|web-?dl|webmux|webrip|web|hdtv|hdrip|dvdrip|dvd|x26[45]|h\.?26[45]|hevc|avc|av1|xvid|aac2?|ac-?3|eac3|ddp?|dd\+|atmos|truehd|opus|dts(?:-?hd)?|flac|hdr10\+?|hdr|dolby|vision|dv|sdr|repack|proper|internal|limited|complete|series|seasons?|imax|extended|remaster(?:ed)?|hybrid|final|custom|upscale[dr]?|multi[dti]?|multi-?audio|multi-?subs?|subbed|subs?|uncensored|batch|pack|\d+\s?bits?|[257]\.[01]|"
    r"ita|eng|jpn|jap|kor|hun|esp|lat|fre|ger|rus|ukr|dual-?audio|mp4|mkv|avi|www\.\S+)\b"
)
SHOW_CUT = r"(?i)\b(?:s\d{1,2}(?:e\d{1,3})?(?:\s*-\s*s?\d{1,2}(?:e\d{1,3})?)?|season\s*\d+(?:\s*(?:and|&)\s*\d+)*)\b"
SPECIALS_END = r"(?i)\s*[-–:]?\s*\b(?:ovas?|specials?)\b\s*$"
SAMPLE = r"(?i)\bsample\b"
EXTRAS = r"(?i)\b(?:trailer|teaser|featurette|behind|deleted|gag|interview|bts|making|bonus|extras?|promo|shorts?|scenes?)\b"
EXTRAS_DIRS = ("featurettes", "extras", "extra", "behind the scenes", "deleted scenes", "interviews", "scenes", "shorts", "trailers", "other", "specials")
BAD_CHARS = r'[<>:"|?*\x00-\x1f]'

# Words by which releases are refused or scored.
DUB = r"(?i)\b(?:dub(?:bed)?|lat(?:ino)?|cast(?:ellano)?|mvo|dvo|yfx?)\b"
ORIGINAL = r"(?i)\b(?:original|eng(?:lish)?|multi[dti]?|dual|jpn|jap(?:anese)?|vostfr?)\b"
BOXSET = r"(?i)\b(?:discograph|anthology|collection|complete|box\s?set|works|antologi)"
LOSSLESS = r"(?i)\b(?:flac|ape|wv|wavpack|alac|tta|dsd|dsf|sacd|lossless|wav|\d{2}\s?bit|24-?96|24-?192)\b"
LOSSY = r"(?i)\b(?:mp3|aac|m4a|ogg|vorbis|opus|lame|vbr|cbr|\d{3}\s?kbps|v0|v2)\b"
VIDEO_RELEASE = r"(?i)\b(?:satrip|dvdrip|bdrip|hdtv|web-?dl|x26[45]|h\.?26[45]|1080[pi]|720p|2160p|dvd[59]|blu-?ray|mkv|avi|vob|iso|cam-?rip|tv-?rip|vhs-?rip|divx|xvid)\b"
CUE_TRACKS = r"(?i)\btracks?\s*\+\s*\.?cue|\btracks\b"
CUE_IMAGE = r"(?i)\bimage\b|\bone\s*file\b"
FOREIGN = r"(?i)\b(?:ita|hun|esp|lat|ger|fre|rus|ukr|mvo|dvo)\b"
WITH_ORIGINAL = r"(?i)\b(?:eng|multi|dual)\b"
UPSCALE = r"(?i)\bai[\s._-]?upscale[dr]?\b"
HDR = r"(?i)\bhdr\b|\bdv\b|dolby ?vision"

# Album names.
AUDIO_TAG_BRACKET = r"(?i)\s*[\[\(\{][^\]\)\}]*\b(?:flac|ape|wv|wavpack|alac|mp3|aac|ogg|opus|wav|dsd|sacd|lossless|lossy|\d{1,2}\s?bits?|\d{2,3}(?:[.,]\d)?\s?khz|\d{3}\s?kbps|eac|cue|log|scans?|vbr|cbr|vinyl|web|cd|reissue|remaster(?:ed)?|mono|stereo)\b[^\]\)\}]*[\]\)\}]"
AUDIO_TAG_TAIL = r"(?i)[\s_.,-]*\b(?:flac|ape|wv|wavpack|alac|mp3|aac|lossless|scans?|eac|cue|log|vbr|cbr|\d{1,2}\s?bits?|\d{2,3}(?:[.,]\d)?\s?khz|\d{3}\s?kbps|reissue|remaster(?:ed)?|web|vinyl)\b[\s_.,-]*$"
AUDIO_CUT = r"(?i)[\s,;(\[{]+(?:flac|ape|wv|wavpack|alac|mp3|aac|ogg|opus|wav|dsd|dsf|sacd|lossless|lossy|tracks?\s*\+|image\s*\+|image\b|eac|cue|scans?|vbr|cbr|\d{3}\s?kbps|\d{1,2}\s?bits?|\d{2,3}(?:[.,]\d)?\s?khz|web-?dl|satrip|dvdrip|bdrip|hdtv|x26[45])\b"
DISC_COUNT = r"(?i)[,;]?\s*\b\d{1,2}\s*[x×]?\s*cds?\b\s*"
DISC_DIR = r"(?i)^(?:cd|disc|disk)[\s._-]*(\d{1,2})$"
MUSIC_JUNK_DIRS = ("scans", "scan", "artwork", "art", "covers", "cover", "booklet", "logs", "log", "info")
COVER_NAMES = ("front", "cover", "folder", "booklet front", "f1", "album")
BACK_COVER = r"(?i)\b(?:back|tray|inlay|inside|disc|cd\d?|obi|spine)\b"

# Script lines.
DIALOGUE_STYLES = ("main", "dialog", "default", "overlap", "internal", "flashback", "thought", "italics", "alt", "caption")
TYPESET = r"\\(?:pos|move|clip|iclip|org|frz|fry|frx)\b"
DRAWING = r"\\p[1-9]\b"
SONG_STYLE = r"(?i)kara|lyric|song|^insert\b|^(?:opening|ending)\b|^(?:op|ed)(?:\b|[_ -])"
GROUP_LABELS = ("everyone", "all", "kids", "both", "both bears", "crowd", "group", "together", "various", "many")
GROUP_SEPARATOR = r"(?i)\s*[/&+]\s*|\s+and\s+"
SENTENCE_END = r"""[.!?…。！？]["”’)]?\s*$"""
CONTINUES = r"""^["“'(\[]?(?:[a-z]|[,;:—–-])"""
GLOSS = r"\s*\(([a-z][a-z \-']*)\)\s*([.!?…]?)\s*$"
MERGE_GAP_MS, SIGN_CLEARANCE_MS, SCENE_GAP_MS, REPEAT_MS, LAST_SLACK_MS = 600, 400, 4000, 15000, 5000
INTERLEAVE_DEPTH = 3
PLAIN_ROLES = ("NARRATION", "NARRATOR")

# Delivery.
OVERRUN, SQUEEZED = 0.25, 1.01
MAX_FACTOR, MAX_LEAD, BREATH = 1.35, 2.5, 0.15
# Where speakers of an overlap are placed, first choice first.
PANS = (-0.6, 0.6, -0.35, 0.35, -0.15, 0.15, 0.0)
