"""Names to voices: members of a group label, sheets to audio files, spoken spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelode.functions import text as T
from cinelode.sources.readers import compatible


def member_voices(labels: DataFrame, bank: DataFrame) -> DataFrame:
    """(show_id, label, voices): the bank's name for each member of a group label; empty if any member is unclear.

    A member names a speaker if each of its words is a prefix of a distinct word of the speaker's name, in order;
    exactly one speaker must fit. Labels: show_id, label. Bank: show_id, speaker.
    """
    m = labels.select("show_id", "label", F.posexplode(T.group_members(F.col("label"))).alias("n", "member"))
    b = bank.select(F.col("show_id").alias("__show"), "speaker")
    words = lambda c: F.split(F.upper(T.strip(c)), r"\s+")
    # Words of the member are taken in turn, each by the first later word of the name that begins with it.
    start = F.lit(0)
    step = lambda at, w: F.when(at < 0, -1).otherwise(
        F.coalesce(F.array_min(F.transform(F.filter(F.transform(words(F.col("speaker")), lambda x, i: F.struct(x.alias("w"), (i + 1).alias("i"))), lambda x: (x["i"] > at) & x["w"].startswith(w)), lambda x: x["i"])), F.lit(-1))
    )
    fits = F.aggregate(words(F.col("member")), start, step) > 0
    hits = m.join(b, (F.col("show_id") == F.col("__show")), "left").groupBy("show_id", "label", "n").agg(F.collect_set(F.when(fits, F.col("speaker"))).alias("hit"))
    whole = hits.groupBy("show_id", "label").agg(F.every(F.size("hit") == 1).alias("clear"), F.array_sort(F.collect_list(F.struct("n", F.get("hit", 0).alias("s")))).alias("v"))
    none = F.array().cast("array<string>")
    return whole.select("show_id", "label", F.when(F.col("clear"), F.transform("v", lambda x: x["s"])).otherwise(none).alias("voices"))


def sheets_of_audio(audio: DataFrame, sheets: DataFrame) -> DataFrame:
    """(id, sheet): the CUE sheet of an audio file of the same item: by the name in it, by its own, or as the only pair; first sheet wins.

    audio: item_id, id, name. sheets: item_id, sheet (number), sheet_name, named (file named in the sheet).
    """
    stem = lambda c: F.lower(T.stem(F.col(c)))
    a = audio.select("item_id", "id", stem("name").alias("stem"))
    s = sheets.select(F.col("item_id").alias("__item"), "sheet", stem("sheet_name").alias("own"), stem("named").alias("in_it"))
    alone = a.groupBy(F.col("item_id").alias("__i")).agg((F.count(F.lit(1)) == 1).alias("one_audio")).join(s.groupBy(F.col("__item").alias("__j")).agg((F.count(F.lit(1)) == 1).alias("one_sheet")), F.col("__i") == F.col("__j"))
    pairs = a.join(s, F.col("item_id") == F.col("__item")).join(alone.drop("__j"), F.col("item_id") == F.col("__i"))
    fit = (F.col("stem") == F.col("in_it")) | (F.col("stem") == F.col("own")) | (F.col("one_audio") & F.col("one_sheet"))
    return pairs.filter(F.coalesce(fit, F.lit(False))).groupBy("id").agg(F.min("sheet").alias("sheet"))


def speakable(df: DataFrame, text: str, lexicon: dict[str, str]) -> DataFrame:
    """``text`` in compatible form with whole words respelt; a capital first letter is kept. The lexicon is a setting of a few hundred words."""
    c = compatible(F.col(text))
    if not lexicon:
        return df.withColumn(text, c)
    table = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in (kv[0].lower(), kv[1])])
    tokens = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}'’]+|[^\p{L}\p{N}'’]+)"), 1)

    def swap(w):
        new = F.try_element_at(table, F.lower(w))
        return F.when(new.isNull(), w).when(F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1)), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, F.length(new)))).otherwise(new)

    return df.withColumn(text, F.array_join(F.transform(tokens, swap), ""))


def takes(df: DataFrame) -> DataFrame:
    """Takes of each phrase with the words a take missed. df: phrase, take, heard."""
    want = F.array_distinct(F.regexp_extract_all(F.lower("phrase"), F.lit("([a-z0-9']+)"), 1))
    have = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("heard", F.lit(""))), F.lit("([a-z0-9']+)"), 1))
    one = F.struct("take", F.array_except(want, have).alias("missed"))
    return df.groupBy("phrase").agg(F.array_sort(F.collect_list(one)).alias("takes"))


def trimmed(chunks: DataFrame, samples: str, rate: int, share: float = 0.06) -> DataFrame:
    """Samples without the silence at both ends: below ``share`` of the peak of their 20 ms means; an all-silent array stays."""
    width = max(1, rate // 50)
    level = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(samples) - 1) / width), F.lit(0))), lambda i: F.aggregate(F.slice(samples, (i * width + 1).cast("int"), width), F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))) / width)
    with_level = chunks.withColumn("__l", level)
    loud = F.filter(F.transform("__l", lambda v, i: F.when(v > share * F.array_max("__l"), i)), lambda i: i.isNotNull())
    first, last = F.array_min(loud), F.array_max(loud)
    cut = F.slice(samples, (first * width + 1).cast("int"), ((last - first + 1) * width).cast("int"))
    return with_level.withColumn(samples, F.when(F.size(loud) > 0, cut).otherwise(F.col(samples))).drop("__l")


def unison(voices: DataFrame, key: str, stagger: int) -> DataFrame:
    """(key, i, sample): voices of one line laid over each other, each ``stagger`` samples later, divided by the root of their number."""
    n = F.count(F.lit(1)).alias("n")
    count = voices.groupBy(F.col(key).alias("__k")).agg(n)
    s = voices.select(key, "voice", F.posexplode("samples").alias("p", "x")).select(key, (F.col("p") + F.col("voice") * stagger).alias("i"), "x")
    return s.groupBy(key, "i").agg(F.sum(F.col("x").cast("double")).alias("s")).join(count, F.col(key) == F.col("__k")).select(key, "i", (F.col("s") / F.sqrt("n")).alias("sample"))
