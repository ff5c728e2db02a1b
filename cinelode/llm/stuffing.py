"""Pages of stuffed keywords, link lists and product tags, found by the shapes of their lines.

Every line is cut into pieces (sentences, or list items), and each piece is reduced to a
shape: buckets of its word count, capitals, separators, digits, prices, links and tags, whether it ends as a sentence or bears a clock
time, and how much of it the page repeats. What a shape stands for is learnt from the corpus: a first look at the signs in each piece
makes pages lean to sentences or away from them, and a shape is a non-sentence if most of its characters, over all
pages, lie on pages that lean away. A page is flagged if such shapes hold most of its characters and few of them dominate.
Top-level names of links are learnt as well, from the full addresses of the corpus.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelode.session import cut

#: Share of a page's characters that non-sentence shapes must hold.
SHARE = 0.4
#: Few shapes dominate if this share of a page's non-sentence characters lies in no more shapes than FEW.
MAIN, FEW = 0.5, 6
#: Characters by which a shape's first look counts beside what the corpus says of it.
PRIOR = 400.0
#: A top-level name comes up in so many documents, and so often among all of them: broken addresses are rarer.
LEAST_HOSTS, LEAST_SHARE = 3, 0.001
#: A bare list is keywords if this share of its words comes back (REPEATED times or more), or so few of its words are distinct.
LIST_SHARE = 0.27
REPEATED = 3
#: Stuffed sentences: phrases that come twice in a sentence, in so many sentences, covering this share of the words.
STUFFED_SENTENCES = 2
STUFFED_SHARE = 0.2

_DOT = r"(?:\.|\s(?:dot|\[dot\]|\(dot\))\s|\[\.\]|\(\.\))"
_ADDRESS = r"(?:https?|hxxps?|ftp)\s?:\s?//\S+(?:\s(?:dot|\[dot\]|\(dot\))\s\S+)*|\bwww\s?(?:\.|dot)\s?\S+"
_ANCHOR = re.compile(r"<a\b[^>]*href[^>]*>([^<]*(?:<(?!/?a\b)[^<]*)*)</a>|\[([^\[\]\n]+)\]\(([^()\s]+)\)|\[url=[^\]]*\]([^\[]*(?:\[(?!/?url\b)[^\[]*)*)\[/url\]", re.I)
_TAGS = re.compile(r"<(?!https?:)/?[a-z][^<>]*>", re.I)
_BREAKING = re.compile(r"<(?:br|/?p|/?li|/?div|/?tr|/?ul|/?ol|/?h\d)\b[^<>]*>", re.I)
#: Angle brackets and white space, which an anchor loses as it becomes a line.
_SPACE = re.compile(r"[<>\s]+")
_HASHTAG = re.compile(r"(?<![\w&])[#＃]\w{2,}")
_PRICE = re.compile(r"(?:[$€£¥]\s?)?\b\d{1,6}[.,]\d{2}\b(?![\d:])(?:\s?(?:[$€£¥]|usd|eur|gbp))?|[$€£¥]\s?\d+|\b\d+\s?(?:[$€£¥]|usd|eur)(?!\w)|\bSKU[-\s]?\w*\d\w*", re.I)
_CLOCK = re.compile(r"(?<!\d)\d{1,2}:\d{2}(?::\d{2})?(?!\d)")
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?。！？…])[\"”’)»]?\s+|(?<=[。！？])")
_ENDS = re.compile(r"[.!?。！？…][\"”’)»\]*_]*\s*$")
_FIELDS = re.compile(r"\s+[|/»«›•·~►▸]+\s+|\s{2,}|\t+|;\s+|,\s+|\s+[-–—]\s+|[、，；｜()（）\[\]]|\s+\.{3}\s+|:\s+")
_LATIN = re.compile("[a-z]")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_LINES = re.compile(r"[\r\n\u2028\u2029\x85\x0b\x0c]+")
_STAMPED = re.compile(r"^\W*(?:\d{1,3}[.)]\s|\[?\(?\d{1,2}:\d{2}|Dialogue:)")
_TIMED = re.compile(r"\d{1,2}:\d{2}\)?\]?$")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]")


# Cyrillic letters that look like Latin ones.
_ALIKE = str.maketrans("аеорсухікмтв", "aeopcyxikmtb")

class Links(NamedTuple):
    """Patterns of links, given the top-level names, and the cheap sign without which a line holds none."""

    link: re.Pattern[str]
    sign: re.Pattern[str]


@lru_cache(16)
def links_of(tops: tuple[str, ...]) -> Links:
    top = "(?:" + "|".join(map(re.escape, tops)) + r")\b" if tops else "(?!)"
    bare = rf"\b[\w-]+(?:{_DOT}[\w-]+)*{_DOT}{top}(?:\.[a-z]{{2,3}}\b)?(?:/[^\s<>)\]]*)?"
    return Links(re.compile(f"{_ADDRESS}|{bare}", re.I), re.compile(rf"://|www|(?:\.|dot\s|\.\]|\.\)|dot\]\s|dot\)\s){top}", re.I))


def top_names(documents: DataFrame, text: str = "text") -> tuple[str, ...]:
    """Last labels of the hosts in full addresses, as often as LEAST_HOSTS and LEAST_SHARE say.

    Public names are some thousands and no more come from one more text, so they are collected (refused beyond 100,000).
    """
    hosts = F.regexp_extract_all(text, F.lit(r"(?i)(?:https?|hxxps?|ftp)://([^\s/:?#<>\"')\]]++)"), 1)
    last = F.transform(hosts, lambda h: F.lower(F.substring_index(h, ".", -1)))
    names = documents.filter(F.col(text).contains("://")).select(F.explode(F.array_distinct(last)).alias("top")).filter(F.col("top").rlike("^[a-z]{2,24}$"))
    found = names.groupBy("top").count().filter(F.col("count") >= LEAST_HOSTS).limit(100_001).collect()
    if len(found) > 100_000:
        raise ValueError("too many top-level names")
    total = sum(r["count"] for r in found)
    return tuple(sorted(r.top for r in found if r["count"] >= LEAST_SHARE * total))


_DIGIT = re.compile(r"\d")
_SEPARATORS = frozenset(":/|»-,;#*()[]")


def fold(text: str) -> str:
    """Lower case with Cyrillic look-alikes in Latin words undone."""
    if text.isascii():
        return text.casefold()
    t = unicodedata.normalize("NFKC", text).casefold()
    return t.translate(_ALIKE) if _LATIN.search(t) else t


def bucket(n: int) -> str:
    return str(n) if n < 4 else "4-7" if n < 8 else "8-15" if n < 16 else "16+"


def shape(piece: str, words: int, ends: bool, links: int, tags: bool, prices: int, clock: bool, repeats: int, digit: bool = True) -> str:
    """The shape of a piece. Its parts have 6 x 4 x 4 x 2 x 2 x 3 x 2 x 3 x 2 x 3 values, which bounds the number of shapes."""
    caps = "all" if piece.isupper() else "none" if piece.islower() else "-" if piece.swapcase() == piece else "some"
    signs = ("." if ends else "") + ("#" if tags else "") + ("t" if clock else "") + ("9" if digit and _DIGIT.search(piece) else "")
    return f"{bucket(words)}|{caps}|s{min(len(_SEPARATORS.intersection(piece)), 3)}|{signs}|l{min(links, 2)}|p{min(prices, 2)}|r{repeats}"


class Piece(NamedTuple):
    """A piece of a page, what it looks at first, and what its shape is made of."""

    kind: str
    text: str
    words: int
    ends: bool = False
    links: int = 0
    tags: bool = False
    prices: int = 0
    clock: bool = False
    #: The folded words of a sentence, and whether the piece may hold a digit.
    said: list[str] | None = None
    digit: bool = True


#: Top-level names where no corpus tells any.
NO_NAMES: tuple[str, ...] = ()


def pieces(text: str, tops: tuple[str, ...] = NO_NAMES) -> list[Piece]:
    """Pieces with their first look: link, tag, product, record, sentence, bare; a title beside a lone link is link."""
    link, sign = links_of(tops)
    t = html.unescape(text) if "&" in text else text
    if not t.isascii():
        t = _INVISIBLE.sub("", t)
    if "<" in t or "[" in t:
        t = _ANCHOR.sub(lambda m: "\n\x01 " + _SPACE.sub(" ", m[0]) + "\n", t)
        if "<" in t:
            t = _TAGS.sub(" ", _BREAKING.sub("\n", t))
    out: list[Piece] = []
    lone: list[bool] = []

    def put(piece: Piece, alone: bool = False) -> None:
        out.append(piece)
        lone.append(alone)

    for line in _LINES.split(t):
        line = line.strip()
        if not line:
            continue
        if line[0] == "\x01":
            line = line[1:].strip() or "-"
            put(Piece("link", line, len(_WORD.findall(line)), links=1))
            continue
        tags = _HASHTAG.findall(line) if "#" in line or "＃" in line else ()
        if tags and 2 * sum(map(len, tags)) >= len(line.replace(" ", "")):
            put(Piece("tag", line, len(_WORD.findall(line)), tags=True))
            continue
        digits = _DIGIT.search(line)
        if digits and _CLOCK.search(line) and (_STAMPED.match(line) or _TIMED.search(line)):
            put(Piece("record", line, len(_WORD.findall(line)), clock=True))
            continue
        links = link.findall(line) if sign.search(line) else ()
        if links and not (_ENDS.search(link.sub("\x02", line)) and not line.endswith(links[-1])):
            rest = link.sub(" ", line)
            sentences = [s for s in _SENTENCE.split(rest) if _ENDS.search(s) and len(_WORD.findall(s)) >= 4]
            if sum(map(len, sentences)) * 2 < len(line):
                put(Piece("link", line, len(_WORD.findall(line)), links=len(links)), not _WORD.search(rest))
                continue
        prices = _PRICE.findall(line) if digits else ()
        if prices:
            n = len(_WORD.findall(line))
            if (len(prices) >= 2 or n <= 9) and not _ENDS.search(_PRICE.sub("", line).rstrip() or "x") and 14 * len(prices) >= n:
                put(Piece("product", line, n, prices=len(prices)))
                continue
        for s in _SENTENCE.split(line):
            s = s.strip()
            if not s:
                continue
            said = _WORD.findall(fold(s))
            n = len(said)
            ends = _ENDS.search(s)
            is_sentence = ends and (n >= 2 or _UNSPACED.search(s)) or not ends and n >= 4 and "。" in s
            put(Piece("sentence" if is_sentence else "bare", s, n, ends=bool(is_sentence), links=len(links) and len(link.findall(s)), prices=len(prices) and len(_PRICE.findall(s)), said=said, digit=bool(digits)))
    for i, alone in enumerate(lone):
        if alone:
            for j in (i - 1, i + 1):
                # Titles and links alternate: the title goes with its link.
                if 0 <= j < len(out) and out[j].kind == "bare" and out[j].words <= 12 and (j == i - 1 or i + 2 >= len(lone) or not lone[i + 2] or i == 0):
                    out[j] = out[j]._replace(kind="link", links=1)
    return out


def judged(text: str, tops: tuple[str, ...] = NO_NAMES) -> list[tuple[str, str, int]]:
    """(first look, shape, characters) of a page's pieces, with bare lists and stuffed sentences told apart by what the page repeats."""
    found = pieces(text, tops)
    listed = repeats_itself([p.text for p in found if p.kind == "bare"])
    shares = stuffing([p.said for p in found if p.kind == "sentence"])
    out, at = [], 0
    for p in found:
        k, repeats = p.kind, 0
        if k == "sentence":
            if shares and shares[at] > 0:
                k, repeats = "stuffed", 2 if shares[at] >= 0.5 else 1
            at += 1
        elif k == "bare":
            k, repeats = ("keyword", 2) if listed else ("title", 0)
        out.append((k, shape(p.text, p.words, p.ends, p.links, p.tags, p.prices, p.clock, repeats, p.digit), len(p.text)))
    return out


def repeats_itself(bare: list[str]) -> bool:
    """Whether the bare items of a page are keywords: many words, or whole items, come back; one word alone makes none."""
    if not bare:
        return False
    fields = [x for p in bare for x in _FIELDS.split(fold(p))]
    items = Counter(" ".join(w) for x in fields if (w := _WORD.findall(x)))
    words: Counter[str] = Counter()
    for x, n in items.items():
        for w in x.split():
            if not w.isdigit():
                words[w] += n
    total = sum(words.values())
    back = sum(n for n in words.values() if n >= REPEATED)
    twice = sum(n * len(x.split()) for x, n in items.items() if n >= 2)
    return total >= 6 and len(words) > 1 and (back >= LIST_SHARE * total or twice >= LIST_SHARE * total)


def stuffing(said: list[list[str]]) -> list[float]:
    """Share of each sentence (its folded words) that stuffed phrases cover; empty if the page has none to speak of.

    A stuffed phrase comes twice within a sentence, in STUFFED_SENTENCES sentences or more, and all of them cover STUFFED_SHARE of the words.
    """
    hot: Counter[tuple[str, ...]] = Counter()
    for s in said:
        if len(s) - len(set(s)) < 2:
            continue  # a phrase can't come twice without two words that do
        pairs = list(zip(s, s[1:], strict=False))
        if len(set(pairs)) == len(pairs):
            continue
        for grams in (Counter(pairs), Counter(zip(s, s[1:], s[2:], strict=False))):
            hot.update({g for g, c in grams.items() if c >= 2 and len(set(g)) > 1})
    phrases = {g for g, c in hot.items() if c >= STUFFED_SENTENCES}
    if not phrases:
        return []
    shares, covered = [], 0
    for s in said:
        on = bytearray(len(s))
        for n in (2, 3):
            for i, g in enumerate(zip(*[s[i:] for i in range(n)], strict=False)):
                if g in phrases:
                    on[i : i + n] = b"\x01" * n
        shares.append(sum(on) / max(len(s), 1))
        covered += sum(on)
    return shares if covered >= STUFFED_SHARE * sum(map(len, said)) else []


#: First looks that speak against sentences, and for them; a title speaks for neither.
BAD = ("link", "tag", "product", "keyword", "stuffed")
GOOD = ("sentence", "record")


def shapes(documents: DataFrame, key: str = "doc_id", text: str = "text", tops: tuple[str, ...] | None = None) -> DataFrame:
    """(key, shapes): for each page its shapes as array<struct<kind, shape, pieces, chars>>.

    NULL, '' and blank texts have an empty array. Whole texts are read, whatever their length. Without ``tops`` they are learnt from these documents.
    """
    kind = documents.schema[key].dataType.simpleString()
    source = documents.select(key, F.col(text).cast("string").alias(text))
    known = top_names(source, text) if tops is None else tops

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, kinds, names, n_pieces, n_chars = [0], [], [], [], []
            for t in b.column(1).to_pylist():
                seen: dict[tuple[str, str], list[int]] = {}
                for k, s, c in judged(t, known) if t else ():
                    one = seen.setdefault((k, s), [0, 0])
                    one[0] += 1
                    one[1] += c
                for (k, s), (n, c) in seen.items():
                    kinds.append(k)
                    names.append(s)
                    n_pieces.append(n)
                    n_chars.append(c)
                ends.append(len(kinds))
            fields = {"kind": pa.array(kinds, pa.string()), "shape": pa.array(names, pa.string()), "pieces": pa.array(n_pieces, pa.int64()), "chars": pa.array(n_chars, pa.int64())}
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "shapes"])

    return source.mapInArrow(run, f"`{key}` {kind}, shapes array<struct<kind:string,shape:string,pieces:bigint,chars:bigint>>")


def _chars(kinds: tuple[str, ...]) -> Column:
    return F.aggregate(F.filter("shapes", lambda x: x["kind"].isin(*kinds)), F.lit(0).cast("bigint"), lambda a, x: a + x["chars"])


def shape_table(pages: DataFrame) -> DataFrame:
    """(shape, pieces, chars, away, weight): what the corpus says of each shape.

    ``away`` are its characters on pages whose other first looks lean away from sentences; ``weight`` is their share among those on pages that
    lean either way, together with its own first look for PRIOR characters. Only sums of each shape are shuffled.
    """
    leaning = pages.withColumn("lean", F.signum(_chars(BAD) - _chars(GOOD)))
    one = leaning.select("lean", F.inline("shapes"))
    look = F.when(F.col("kind").isin(*BAD), 1.0).when(F.col("kind").isin(*GOOD), 0.0).otherwise(0.25)
    sums = one.groupBy("shape").agg(
        F.sum("pieces").alias("pieces"), F.sum("chars").alias("chars"), F.sum(F.when(F.col("lean") > 0, F.col("chars")).otherwise(0)).alias("away"), F.sum(F.when(F.col("lean") != 0, F.col("chars")).otherwise(0)).alias("leaning"), F.sum(F.col("chars") * look).alias("looked")
    )
    weight = (F.col("away") + PRIOR * F.try_divide("looked", "chars")) / (F.col("leaning") + PRIOR)
    return sums.select("shape", "pieces", "chars", "away", F.coalesce(weight, F.lit(0.0)).alias("weight"))


def scored(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chars, bad_chars, bad_share, main_shapes): what non-sentence shapes hold of each page with any, and in how many of them MAIN of that lies.

    The table of shapes is broadcast; the parts of a shape bound it to 41,472 rows.
    """
    pages = cut(shapes(documents, key, text))
    # Equal shapes of different first looks are one.
    mine = pages.select(key, F.inline("shapes")).join(F.broadcast(shape_table(pages).select("shape", "weight")), "shape")
    one = mine.groupBy(key, "shape").agg(F.sum("chars").alias("chars"), F.first("weight").alias("weight"))
    bad = F.col("weight") >= 0.5
    page = one.groupBy(key).agg(F.sum("chars").alias("chars"), F.sum(F.when(bad, F.col("chars")).otherwise(0)).alias("bad_chars"), F.reverse(F.array_sort(F.collect_list(F.when(bad, F.col("chars"))))).alias("each"))
    # A page has no more shapes than there are.
    reach = F.aggregate("each", F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("n")), lambda a, x: F.when(a["sum"] >= MAIN * F.col("bad_chars"), a).otherwise(F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n"))))
    return page.withColumns({"bad_share": F.when(F.col("chars") > 0, F.col("bad_chars") / F.col("chars")).otherwise(0.0), "main_shapes": reach["n"]}).drop("each")


#: Pages with fewer characters are very short posts, which the statement takes out.
SHORT = 60


def flagged(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys of the pages dominated by few non-sentence shapes. Empty and very short pages are none.

    Repeated rows of a key are one page; NULL keys are one page too.
    """
    return scored(documents, key, text).filter((F.col("chars") >= SHORT) & (F.col("bad_share") >= SHARE) & (F.col("main_shapes") <= FEW)).select(key)
