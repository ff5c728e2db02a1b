"""Readers of the formats around a media library; every row keeps its ordinal."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cinelode.functions import patterns as P
from cinelode.functions import text as T

ITEMS = "kind string, id bigint, name string, download_state string, download_present boolean, files array<struct<id:bigint,name:string,short_name:string,size:bigint>>"
RELEASES = "title string, size bigint, seeders int, indexer string, categories array<struct<id:int>>, magnetUrl string, downloadUrl string"
MEDIA_ITEMS = "Id string, Name string, SeriesName string, Path string, MediaStreams array<struct<Type:string,Language:string,DisplayLanguage:string>>"


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a fixed schema, one file each or lines; nothing is inferred, so nothing is read twice."""
    return spark.read.schema(schema).json(path, multiLine=True)


def successful(listing: DataFrame) -> DataFrame:
    """Rows of a listing's ``data``; a listing that doesn't say ``success`` raises when it is read, instead of standing for an empty one."""
    fail = F.raise_error(F.concat(F.lit("listing failed: "), F.coalesce("detail", F.lit("no detail"))))
    fine = F.when(F.coalesce("success", F.lit(False)), F.col("data")).otherwise(fail)
    return listing.select(F.explode(fine).alias("row")).select("row.*")


def with_link(releases: DataFrame) -> DataFrame:
    """Search results that have a magnet or a download link ('' counts as none)."""
    link = F.coalesce(F.nullif("magnetUrl", F.lit("")), F.nullif("downloadUrl", F.lit("")))
    return releases.withColumn("link", link).filter(F.col("link").isNotNull())


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, line): the lines of each text with ordinals from 0; NULL texts have none."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\r\n|\n|\r")).alias("n", "line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) of text files; a file is one row until it is split, so ordinals are exact."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return lines_of(whole, "file", "value")


def env_pairs(lines: DataFrame) -> DataFrame:
    """key, value of 'key=value' lines; blank lines, comments and lines without '=' are skipped, the first '=' splits."""
    t = T.strip(F.col("line"))
    return lines.filter((t != "") & ~t.startswith("#") & t.contains("=")).select("n", T.strip(F.substring_index(t, "=", 1)).alias("key"), T.strip(F.regexp_extract(t, "^[^=]*=(.*)$", 1)).alias("value"))


def watchlist(lines: DataFrame) -> DataFrame:
    """folder, template of 'folder | template' lines; a missing template is ''."""
    t = T.strip(F.col("line"))
    parts = F.split(t, "[|]", 2)
    return lines.filter((t != "") & ~t.startswith("#")).select("n", T.strip(F.get(parts, 0)).alias("folder"), T.strip(F.coalesce(F.get(parts, 1), F.lit(""))).alias("template"))


def queue_rows(lines: DataFrame) -> DataFrame:
    """album, year, size, title, url of tab-separated lines; other arities are dropped."""
    p = F.split("line", "\t")
    return lines.filter(F.size(p) == 5).select("n", *[F.get(p, i).alias(c) for i, c in enumerate(("album", "year", "size", "title", "url"))])


def answers(lines: DataFrame) -> DataFrame:
    """id, role, kind of 'id role [kind]' lines; '#' starts a comment, '-' is no role, the last answer of an id wins."""
    p = F.filter(F.split(T.strip(F.substring_index("line", "#", 1)), r"\s+"), lambda x: x != "")
    rows = lines.select("n", p.alias("p")).filter(F.size("p") > 0).select("n", F.get("p", 0).alias("id"), F.when(F.coalesce(F.get("p", 1), F.lit("-")) == "-", "").otherwise(F.get("p", 1)).alias("role"), F.get("p", 2).alias("kind"))
    return rows.groupBy("id").agg(F.max(F.struct("n", "role", "kind")).alias("m")).select("id", "m.role", "m.kind")


def ass_events(lines: DataFrame, key: str) -> DataFrame:
    """Dialogue lines of ASS: key, n, st, en (ms), style, actor (upper case), text (9 commas split 10 fields); broken lines are dropped."""
    p = F.split(F.regexp_replace("line", r"^\s*Dialogue:\s*", ""), ",", 10)
    rows = lines.filter(F.col("line").rlike(r"^\s*Dialogue:")).select(key, "n", p.alias("p")).filter(F.size("p") == 10)
    return rows.select(key, "n", T.clock_ms(F.get("p", 1)).alias("st"), T.clock_ms(F.get("p", 2)).alias("en"), T.strip(F.get("p", 3)).alias("style"), F.upper(T.strip(F.get("p", 4))).alias("actor"), F.get("p", 9).alias("text")).filter("st is not null and en is not null")


def srt_events(df: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of SRT: key, n, st, en (ms), text (lines joined by a space)."""
    body = F.regexp_replace(text, "\r\n|\r", "\n")
    blocks = df.select(key, F.posexplode(F.split(body, r"\n[ \t]*\n+")).alias("n", "block"))
    stamp = r"(\d{1,2}:\d{2}:\d{2}[,.]\d{1,3})\s*-->\s*(\d{1,2}:\d{2}:\d{2}[,.]\d{1,3})[^\n]*\n?([\s\S]*)"
    rows = blocks.filter(F.col("block").rlike(r"\d:\d{2}[,.]\d{1,3}\s*-->"))
    g = lambda i: F.regexp_extract("block", stamp, i)
    return rows.select(key, "n", T.clock_ms(F.nullif(g(1), F.lit(""))).alias("st"), T.clock_ms(F.nullif(g(2), F.lit(""))).alias("en"), T.strip(F.regexp_replace(g(3), r"\s*\n\s*", " ")).alias("text")).filter("st is not null and en is not null")


def cue_tracks(lines: DataFrame, key: str) -> DataFrame:
    """Tracks of CUE sheets: key, file_no, file_name, num, title, performer, start, album_title, album_performer, date.

    The context (file and track of a line) is filled forward over the lines; tracks without a start are dropped.
    """
    word = F.upper(F.regexp_extract("line", r"^\s*(\w+)\s+(.*)$", 1))
    rest = F.regexp_extract("line", r"^\s*(\w+)\s+(.*)$", 2)
    bare = F.regexp_replace(T.strip(rest), r'^"(.*)"$', "$1")
    w = W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    x = lines.select(key, "n", word.alias("word"), rest.alias("rest"), bare.alias("bare")).filter("word <> ''")
    x = x.withColumn("file_no", F.sum((F.col("word") == "FILE").cast("int")).over(w))
    x = x.withColumn("track_no", F.sum(((F.col("word") == "TRACK") & (F.col("file_no") > 0)).cast("int")).over(W.partitionBy(key, "file_no").orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    first = lambda cond, v: F.min(F.when(cond, F.struct("n", v.alias("v"))))["v"]
    last = lambda cond, v: F.max(F.when(cond, F.struct("n", v.alias("v"))))["v"]
    head = F.col("track_no") == 0
    album = x.groupBy(key).agg(
        first(head & (F.col("word") == "TITLE"), F.col("bare")).alias("album_title"),
        first(head & (F.col("word") == "PERFORMER"), F.col("bare")).alias("album_performer"),
        last((F.col("word") == "REM") & F.col("rest").rlike(r"(?i)^date\s"), F.nullif(F.regexp_extract("rest", r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")).alias("date"),
    )
    parts = F.split(T.strip(F.col("rest")), r"\s+")
    index = (F.col("word") == "INDEX") & (F.size(parts) == 2)
    files = x.filter("word = 'FILE'").select(F.col(key).alias("__k"), F.col("file_no").alias("__f"), F.regexp_replace(F.regexp_extract("rest", r'^\s*(".*?"|\S+)', 1), '^"|"$', "").alias("file_name"))
    tracks = x.filter("track_no > 0").groupBy(key, "file_no", "track_no").agg(
        first(F.col("word") == "TRACK", F.coalesce(F.regexp_replace(F.get(parts, 0), r"\D", "").try_cast("int"), F.lit(0))).alias("num"),
        last(F.col("word") == "TITLE", F.col("bare")).alias("title"),
        last(F.col("word") == "PERFORMER", F.col("bare")).alias("performer"),
        F.coalesce(last(index & (F.get(parts, 0) == "01"), T.cue_seconds(F.get(parts, 1))), first(index, T.cue_seconds(F.get(parts, 1)))).alias("start"),
    )
    out = tracks.filter("start is not null").join(files, (F.col(key) == F.col("__k")) & (F.col("file_no") == F.col("__f"))).join(album, key)
    return out.select(key, "file_no", "file_name", "num", "title", "performer", "start", "album_title", "album_performer", "date")


def track_spans(tracks: DataFrame, key: str) -> DataFrame:
    """Tracks with ``duration``: up to the next start in the file; NULL for the last."""
    w = W.partitionBy(key, "file_no").orderBy("start", "num")
    return tracks.withColumn("duration", F.lead("start").over(w) - F.col("start"))


@F.pandas_udf(StringType())
def any_charset(b: pd.Series) -> pd.Series:
    """Bytes as UTF-8 (with or without mark), else Windows-1251, else Latin-1; NULL stays."""

    def one(x: bytes | None) -> str | None:
        if x is None:
            return None
        for c in ("utf-8-sig", "utf-8", "cp1251", "latin-1"):
            try:
                return bytes(x).decode(c)
            except UnicodeDecodeError:
                continue
        return None

    return b.map(one)


@F.pandas_udf(StringType())
def compatible(s: pd.Series) -> pd.Series:
    """Unicode normal form NFKC; NULL stays."""
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def wav_chunks(files: DataFrame, chunk: int = 16_000) -> DataFrame:
    """PCM of 8, 16, 24 or 32 bits and 32- or 64-bit floats of ``path``, ``content``: path, rate, channels, chunk, samples (mono, mean of channels). Other data is dropped."""
    import struct

    import numpy as np

    def three(b: bytes) -> np.ndarray:
        x = np.frombuffer(b, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((x[:, 0] << 8 | x[:, 1] << 16 | x[:, 2] << 24) >> 8) / 2.0**23

    # Fixed values: (format, bits) of a header, and how its samples are read.
    known = {
        (1, 8): lambda b: (np.frombuffer(b, np.uint8).astype(np.float64) - 128) / 128,
        (1, 16): lambda b: np.frombuffer(b, "<i2") / 2.0**15,
        (1, 24): three,
        (1, 32): lambda b: np.frombuffer(b, "<i4") / 2.0**31,
        (3, 32): lambda b: np.frombuffer(b, "<f4").astype(np.float64),
        (3, 64): lambda b: np.frombuffer(b, "<f8"),
    }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, b in zip(pdf["path"], pdf["content"], strict=True):
                b = bytes(b or b"")
                if b[:4] != b"RIFF" or b[8:12] != b"WAVE":
                    continue
                at, fmt, data = 12, None, None
                while at + 8 <= len(b):
                    name, size = b[at : at + 4], struct.unpack("<I", b[at + 4 : at + 8])[0]
                    if name == b"fmt ":
                        fmt = struct.unpack("<HHIIHH", b[at + 8 : at + 24])
                    elif name == b"data":
                        data = b[at + 8 : at + 8 + size]
                    at += 8 + size + size % 2
                if not fmt or data is None or (fmt[0], fmt[5]) not in known or not fmt[1]:
                    continue
                step = fmt[5] // 8 * fmt[1]
                x = known[fmt[0], fmt[5]](data[: len(data) // step * step]).reshape(-1, fmt[1]).mean(axis=1)
                parts = [x[i : i + chunk].astype("float32").tolist() for i in range(0, len(x), chunk)]
                yield pd.DataFrame({"path": path, "rate": fmt[2], "channels": fmt[1], "chunk": range(len(parts)), "samples": parts})

    return files.select("path", "content").mapInPandas(run, "path string, rate int, channels int, chunk int, samples array<float>")


def disagreeing(chunks: DataFrame, key: str) -> DataFrame:
    """(key, rates): keys whose files have different sample rates, which can't be mixed or compared frame by frame."""
    return chunks.groupBy(key).agg(F.array_sort(F.collect_set("rate")).alias("rates")).filter(F.size("rates") > 1)


def image_kind(content: Column) -> Column:
    """jpeg, png or webp by the first bytes, else NULL."""
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head == "FFD8FF", "jpeg").when(head == "89504E", "png").when(head == "524946", "webp")


def packed_url(url: Column) -> Column:
    """A grab link without host and key; magnets stay, NULL is ''."""
    path, q = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    kept = F.array_join(F.filter(F.split(q, "&"), lambda x: ~x.startswith("apikey=") & (x != "")), "&")
    return F.when(url.startswith("magnet:"), url).otherwise(F.concat(path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def has_language(streams: Column, names: tuple[str, ...]) -> Column:
    """Whether any subtitle stream has one of the language names."""
    return F.exists(streams, lambda s: (s["Type"] == "Subtitle") & F.lower(F.coalesce(F.nullif(s["Language"], F.lit("")), s["DisplayLanguage"], F.lit(""))).isin(*names))


def subtitle_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Events of both formats of each text: ASS where it has Dialogue lines, else SRT."""
    ass = ass_events(lines_of(df.filter(F.col(text).contains("Dialogue:")), key, text), key).select(key, "n", "st", "en", "actor", "text")
    srt = srt_events(df.filter(~F.col(text).contains("Dialogue:") & F.col(text).contains("-->")), key, text).select(key, "n", "st", "en", F.lit("").alias("actor"), "text")
    return ass.unionByName(srt)


READY = P.READY_STATES
