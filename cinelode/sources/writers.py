"""Writers: tables of lines, JSON maps and worksheets, subtitle files, reports, caches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelode.functions import text as T


def write_tsv(df: DataFrame, columns: list[str], path: str) -> None:
    """Full rewrite of a tab-separated queue; NULL is '', tabs and line ends in a value become spaces."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ") for c in columns]
    df.select(F.concat_ws("\t", *cells).alias("value")).write.mode("overwrite").text(path)


def worksheet_lines(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One JSON entry a line: value."""
    return df.select(F.to_json(F.struct(F.col(key), *columns)).alias("value"))


def read_map(spark: SparkSession, path: str, value_schema: str, key: str = "key") -> DataFrame:
    """A JSON object of objects as rows: key and the value's fields."""
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.explode(F.from_json("value", f"map<string,struct<{value_schema}>>")).alias(key, "v"))
    return entries.select(key, "v.*")


def write_map(df: DataFrame, key: str, columns: list[str], path: str) -> None:
    """Rows as one JSON object of objects. The object is one value, so this is for settings, not for tables that grow."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.struct(*columns)))))
    df.agg(F.to_json(entries).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def subtitle_text(lines: DataFrame, key: str, shift_ms: int = 0, kind: str = "srt") -> DataFrame:
    """(key, text): each key's lines (st, en, text) as a subtitle file, moved, cut at 0 and numbered anew; lines that end before 0 are dropped."""
    st, en = F.greatest(F.col("st") + shift_ms, F.lit(0)), F.col("en") + shift_ms
    rows = lines.select(key, st.alias("st"), en.alias("en"), F.coalesce("text", F.lit("")).alias("text")).filter("en > 0")
    ordered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("st", "en", "text"))).alias("l"))
    if kind == "srt":
        one = lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), T.clock(x["st"], ","), F.lit(" --> "), T.clock(x["en"], ","), F.lit("\n"), x["text"])
        return ordered.select(key, F.concat(F.array_join(F.transform("l", one), "\n\n"), F.lit("\n")).alias("text"))
    one = lambda x, i: F.concat(F.lit("Dialogue: 0,"), T.clock(x["st"], ".", 2), F.lit(","), T.clock(x["en"], ".", 2), F.lit(",Default,,0,0,0,,"), F.replace(x["text"], F.lit("\n"), F.lit("\\N")))
    return ordered.select(key, F.concat(F.array_join(F.transform("l", one), "\n"), F.lit("\n")).alias("text"))


def commit_report(report: DataFrame, artefact: DataFrame, folder: str) -> str:
    """Write the report, then what it describes, each into a new version's folder, and last the manifest that names the version.

    Readers go by :func:`committed`, so until the manifest stands they see the version before, whole. Returns the version.
    """
    spark = report.sparkSession
    version = uuid.uuid4().hex
    report.write.parquet(f"{folder}/{version}/report")
    artefact.write.parquet(f"{folder}/{version}/artefact")
    # The manifest is one small file, written aside and renamed into place.
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    aside, there = path(f"{folder}/aside-{version}"), path(f"{folder}/manifest")
    out = fs.create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    fs.delete(there, False)
    if not fs.rename(aside, there):
        raise OSError(f"the manifest of {folder} could not be put in place")
    return version


def committed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(report, artefact) of the version that the manifest names."""
    version = spark.read.text(f"{folder}/manifest", wholetext=True).first().value
    return spark.read.parquet(f"{folder}/{version}/report"), spark.read.parquet(f"{folder}/{version}/artefact")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, modified) of files; contents are not read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def through_cache(rows: DataFrame, cache: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all results, new results): what the cache has, and ``compute`` on the rows it misses. Results: key and the cache's columns."""
    have = cache.join(rows.select(key).distinct(), key, "left_semi")
    new = compute(rows.join(cache.select(key), key, "left_anti")).select(*cache.columns)
    return have.select(*cache.columns).unionAll(new), new


def clip_name(name: Column) -> Column:
    """Struct index, voice, slug, take of names as '012-voice-some-words-t3.wav'; parts are NULL if it is none."""
    p = r"^(\d+)-([a-z0-9_]+)-([a-z0-9-]+?)(?:-t(\d+))?\.wav$"
    return F.struct(T.found(name, p, 1).try_cast("int").alias("index"), T.found(name, p, 2).alias("voice"), T.found(name, p, 3).alias("slug"), T.found(name, p, 4).try_cast("int").alias("take"))


def spoken_line(line: Column) -> Column:
    """Struct voice, text of 'NAME:: line'; the voice is NULL without one."""
    p = r"^\s*([^:]+?)\s*::\s*(.*)$"
    return F.struct(T.found(line, p, 1).alias("voice"), F.coalesce(T.found(line, p, 2), T.strip(line)).alias("text"))
