"""Script lines with dirty labels and texts to clean, ordered speaker turns.

Lines are range-partitioned and sorted on (episode, start, id), so an episode may span any number of
partitions, and then read once:

1. A line is cut into segments by the names in it. A name is a noisy emission of a speaker: an exact role
   or actor has its bearers alone (they are the ones named), a misspelt one has every speaker of the show, at a cost
   for each error. Texts are cleaned. Segments are written to the shared folder.
2. A hidden Markov model of each show is learnt from the segments that name exactly one speaker: language
   profiles, those of the unnamed segments behind them, how often speakers talk, and how often the speaker changes,
   also from one partition to the next.
3. Viterbi decoding with back pointers between sure names. The state of a segment without a name is bound to the one
   before (an unnamed line continues the line before it), so its words are emitted by that state. Partitions first give
   the score transfer over the one or two episodes that cross their edges; these are composed in
   partition order, so each partition is then decoded with the states that hold at its edges.

Scores are whole numbers, so sums and ties don't depend on the number of partitions.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelode.llm.canonical import allowed, distance
from cinelode.llm.medianames import letters, tokens
from cinelode.operators.intervals import usable_time
from cinelode.session import cut

#: Hash buckets of the words in a language profile, and its smoothing.
BUCKETS = 64
SMOOTH = 1.0
#: Log-odds against an error in a written name (a letter is wrong about once in 50).
ERROR_COST = 4.0
#: :meth:`Cast.named` lists speakers whose names are up to so many errors farther than the nearest one. The model weighs all of them.
MARGIN = 2
#: Scores are kept in whole parts of a nat; below them a number made of the line's id and the speaker decides equal ones.
UNIT = 1_000_000
SPREAD = 1024

# Fixed value: sounds of hesitation, alone or stuttered.
HESITATION = r"(?:u+h*m+|u+h+|e+r+m*|h+m+|m+h*m+|m{2,}|a+h+m*|e+h+|uh+[- ]?huh)"
_HESITATION = re.compile(rf"(?<![\w'’])(?:[a-z]-)?{HESITATION}(?:-{HESITATION})*(?![\w'’-])(?:\s*(?:\.\.\.|…|,|—|–|-(?=\s)))?", re.I)
_DRAWING = re.compile(r"\{[^}]*\\p[1-9][^}]*\}.*?(?:\{[^}]*\\p0[^}]*\}|$)", re.S)
_OVERRIDE = re.compile(r"\{[^}]*\}")
_TAG = re.compile(r"</?(?:i|b|u|s|em|strong|font|span|c|v|ruby|rt|br)\b[^>]*>", re.I)
_STAMP = re.compile(r"[\[(<]?\b\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?\b[\])>]?(?:\s*-->\s*[\d:.,]+)?(?:\s*[-–—](?=\s))?")
_BREAK = re.compile(r"\\[Nnh]|<br\s*/?>|[\r\n]+|\u2028|\u2029")
_NOTE = re.compile(r"\(\([^()]*\)\)|\([^()]*\)|\[\[[^\[\]]*\]\]|\[[^\[\]]*\]|（[^（）]*）|【[^【】]*】|<[^<>]*>|\*[^*\n]+\*")
_MUSIC = re.compile(r"[♪♫♬#]+")
_DASH = re.compile(r"^\s*(?:>>+|[-–—•]+)\s*")
_SPACE = re.compile(r"[\s\u200b\u200e\u200f\ufeff]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")

_ASIDE = r"(?:\s*(?:\([^()]*\)|\[[^\[\]]*\]))*"


def _label(longest: int) -> tuple[re.Pattern[str], re.Pattern[str]]:
    """Patterns of a name with a colon or dash, at the start or after the end of a sentence, or alone in brackets, and of one behind a note.

    ``longest`` bounds a name's characters; it follows from the cast, so nothing that could match is cut off.
    """
    name = rf"[^\W_][\w.'’\" ,/&-]{{0,{longest}}}?[”\"*]?"
    return re.compile(
        rf"(?P<at>^|[.?!…»”\"♪]\s+|[.?!…]\s*[-–—]\s*|\n\s*)(?P<lead>(?:\d+[.)]\s+)?[-–—>•\s\"“]*)(?:(?P<colon>{name}){_ASIDE}[\s*]*[:：]+(?!\d)|(?P<dash>{name}){_ASIDE}\s+[-–—](?:\s|$))|(?P<box>[\[(<（【](?P<boxed>{name})[\])>）】])[ :：]*"
    ), re.compile(rf"\s*(?P<n>{name}){_ASIDE}\s*[:：]+(?!\d)")


#: Signs without which a text holds no name.
_MAYBE_NAMED = re.compile(r"[:：\[(<（【]|\s[-–—](?:\s|$)")
_AFTER_SPACE = re.compile(r"\s+([,.?!…])")
_DASHES = frozenset(">-–—•")
_NOTED = re.compile(r"[(\[（【<*]")
_UNSEEN = re.compile("[​‎‏﻿]")

_ASIDES = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|（[^（）]*）")
_MOOD = re.compile(r"\s+[-–—]\s+\w+\s*$|\s+[-–—*]+\s*$")
_COUNT = re.compile(r"^\s*(?:>>+|\d+[.)]|[-–—•#*]+)\s*")


class Cast:
    """The bank of one show: names of its speakers, by role and by actor."""

    def __init__(self, rows: list[tuple[str, str | None]]) -> None:
        self.speakers = sorted({s for s, _ in rows if s})
        at = {s: i for i, s in enumerate(self.speakers)}
        exact: dict[str, set[int]] = defaultdict(set)
        part: dict[str, set[int]] = defaultdict(set)
        longest = 0
        for speaker, actor in rows:
            if not speaker:
                continue
            longest = max(longest, len(speaker) + len(actor or ""))
            for name in (speaker, actor):
                words = tokens(name or "")
                if not words:
                    continue
                exact["".join(words)].add(at[speaker])
                if len(words) > 1:
                    exact["".join([words[-1], *words[:-1]])].add(at[speaker])
                    exact["".join([*words[1:], words[0]])].add(at[speaker])
                    exact["".join([w[0] for w in words[:-1]]) + words[-1]].add(at[speaker])
            words = tokens(speaker)
            if len(words) > 1:
                part[words[-1]].add(at[speaker])
        self.exact = dict(exact)
        self.part = {k: v for k, v in part.items() if k not in exact}
        self.by_length: dict[int, list[tuple[str, frozenset[str]]]] = defaultdict(list)
        for k in self.exact | self.part:
            self.by_length[len(k)].append((k, frozenset(k)))
        self.meant = lru_cache(50_000)(self._meant)
        # A name holds a role, an actor or both ("x as y"), with errors, a mood, spaces and a title's length of signs around it.
        self.label, self.behind = _label(2 * longest + 32)

    def _whole(self, words: list[str], fuzzy: bool) -> dict[int, int]:
        """Speakers that the words may mean, with the errors in them: exact ones alone; else, if a name is within the allowed distance, all of the show."""
        k = "".join(words)
        hit = self.exact.get(k) or self.part.get(k)
        if hit:
            return dict.fromkeys(hit, 0)
        if not fuzzy or len(k) < 4:
            return {}
        limit = allowed(len(k))
        if not any(e <= 1 or e * 10 <= len(name) * 4 for name, e in self._within(k, limit)):
            return {}
        return self._errors(k)

    @cached_property
    def _counted(self) -> tuple[list[str], dict[str, int], np.ndarray]:
        """All names, numbers of their letters, and how often each letter is in each name (a column more for other letters)."""
        names = [*self.exact, *self.part]
        alphabet = {c: i for i, c in enumerate(sorted({c for name in names for c in name}))}
        counts = np.zeros((len(names), len(alphabet) + 1), dtype=np.int32)
        for i, name in enumerate(names):
            for c in name:
                counts[i, alphabet[c]] += 1
        return names, alphabet, counts

    def _errors(self, k: str) -> dict[int, int]:
        """The fewest errors between ``k`` and a name of each speaker; one whose names have no letters is all letters of ``k`` away.

        An error changes the letters that are missing or too many by one at most, so names that can't be nearer than one already seen are left out.
        """
        names, alphabet, counts = self._counted
        own = np.zeros(counts.shape[1], dtype=np.int32)
        for c in k:
            own[alphabet.get(c, -1)] += 1
        extra = counts - own
        least = np.maximum(np.maximum(extra, 0).sum(axis=1), np.maximum(-extra, 0).sum(axis=1))
        found: dict[int, int] = {}
        for at, bound in zip(np.argsort(least, kind="stable").tolist(), np.sort(least).tolist(), strict=True):
            name = names[at]
            who = [s for s in self.exact.get(name) or self.part[name] if found.get(s, bound + 1) > bound]
            if who:
                e = distance(k, name, max(len(k), len(name)))
                for s in who:
                    found[s] = min(found.get(s, e), e)
        return {s: found.get(s, len(k)) for s in range(len(self.speakers))}

    def _within(self, k: str, limit: int) -> Iterator[tuple[str, int]]:
        """Names within ``limit`` errors of ``k``."""
        has = set(k)
        for n in range(len(k) - limit, len(k) + limit + 1):
            for name, letters_of in self.by_length.get(n, ()):
                if len(has - letters_of) <= limit and len(letters_of - has) <= limit and (e := distance(k, name, limit)) <= limit:
                    yield name, e

    def _meant(self, label: str, fuzzy: bool = True) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """(speakers that ``label`` may mean, fewest errors first, and their errors); empty if it names nobody of this show."""
        text = _COUNT.sub("", label.replace("_", " ").strip())
        inner = " ".join(x[1:-1] for x in _ASIDES.findall(text))
        outer = _ASIDES.sub(" ", text)
        outer = _MOOD.sub("", outer).strip(" \"“”'.:：*-–—>")
        tries = [outer]
        if m := re.fullmatch(r"(.+?)\s+as\s+(.+)", outer, re.I):
            tries = [m[2], m[1], outer]
        if m := re.match(r"the\s+(.+)", outer, re.I):
            tries.append(m[1])
        if inner:
            tries.append(inner)
        for exact in (True, False):
            for t in tries:
                words = tokens(t)
                if words and (fuzzy or exact) and (hit := self._whole(words, not exact)):
                    order = sorted(hit, key=lambda s: (hit[s], s))
                    return tuple(order), tuple(hit[s] for s in order)
        return (), ()

    def named(self, label: str, fuzzy: bool = True) -> tuple[int, ...]:
        """Speakers that ``label`` may mean, fewest errors first; of a misspelt one only the nearest."""
        who, errors = self.meant(label, fuzzy)
        return tuple(s for s, e in zip(who, errors, strict=True) if e <= errors[0] + MARGIN)


def clean(text: str) -> str:
    """Words of a piece of text: without markup, stamps, notes, music and hesitation."""
    return _tidy(_plain(text))


def _plain(text: str) -> str:
    """Text without markup, stamps and music, breaks and spaces as one space; costly patterns run only where a sign of theirs is."""
    t = text
    if "{" in t:
        t = _OVERRIDE.sub("", _DRAWING.sub(" ", t))
    if "<" in t or "\\" in t or "\n" in t or "\r" in t or not t.isascii():
        t = _TAG.sub("", _BREAK.sub(" ", t))
    if ":" in t:
        t = _STAMP.sub(" ", t)
    if "#" in t or not t.isascii():
        t = _UNSEEN.sub(" ", _MUSIC.sub(" ", t))
    return " ".join(t.split())


def _tidy(t: str) -> str:
    """A piece of plain text without notes and hesitation."""
    if _NOTED.search(t):
        t = _NOTE.sub(" ", t)
    t, gone = _HESITATION.subn(" ", t)
    if gone or "  " in t or t[:1] == " ":
        t = " ".join(t.split())
    if t[:1] in _DASHES:
        t = _DASH.sub("", t)
    return _AFTER_SPACE.sub(r"\1", t).strip(" ,;-–—")


def spoken(cleaned: str) -> bool:
    return bool(_WORD.search(cleaned))


class Segment(NamedTuple):
    """A piece of a line: speakers that may be meant, their errors, the cleaned words."""

    who: tuple[int, ...]
    errors: tuple[int, ...]
    text: str


NOBODY: tuple[tuple[int, ...], tuple[int, ...]] = ((), ())


def cut_up(text: str | None, label: str | None, cast: Cast) -> list[Segment]:
    """The pieces of a line, in order; only spoken ones.

    Words before the first name in the text belong to the label's speaker, words after a name to
    that name's. A name in the text that isn't in the bank is text or a note.
    """
    if not text:
        return []
    t = _plain(text)
    who = cast.meant(label) if label and label.strip() else NOBODY
    if not _MAYBE_NAMED.search(t):
        x = _tidy(t)
        return [Segment(*who, x)] if spoken(x) else []
    out, at, look = [], 0, 0
    while m := cast.label.search(t, look):
        name = m["colon"] or m["dash"] or m["boxed"]
        hit = cast.meant(name, m["box"] is None or m.start() == 0)
        if not hit[0]:
            look = m.start() + max(len(m["at"] or ""), 1) if m["box"] is None else m.end("box")
            if m["box"] is None and m.start() == 0 and not m["at"]:
                # A note may stand before the name: look behind it.
                look = m.start() + 1
                n = _NOTE.match(t)
                if n and n.end() < m.end():
                    x = cast.behind.match(t[n.end() :])
                    if x and (hit := cast.meant(x["n"], True))[0]:
                        who, at, look = hit, n.end() + x.end(), n.end() + x.end()
            continue
        out.append((who, t[at : m.start() + len(m["at"] or "")]))
        who, at = hit, m.end()
        look = at
    out.append((who, t[at:]))
    return [Segment(*w, x) for w, y in out if spoken(x := _tidy(y))]


def segments(text: str | None, label: str | None, cast: Cast) -> list[tuple[tuple[int, ...], str]]:
    """(speakers that may be meant, cleaned words) of the pieces of a line."""
    return [(s.who, s.text) for s in cut_up(text, label, cast)]


def profile_words(text: str) -> list[int]:
    """Hash buckets of a segment's words, as used by the language profiles."""
    low = text.lower() if text.isascii() else letters(text)
    return [_bucket(w) for w in low.split()]


@lru_cache(100_000)
def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS


def read_bank(bank: DataFrame) -> dict[int, list[tuple[str, str | None]]]:
    """Speakers and actors by show. The bank doesn't grow with the lines; refused beyond 500,000 rows."""
    rows = bank.select("show_id", "speaker", "actor").filter("show_id is not null and speaker is not null").limit(500_001).collect()
    if len(rows) > 500_000:
        raise ValueError("the bank is too large to be broadcast")
    out: dict[int, list[tuple[str, str | None]]] = defaultdict(list)
    for r in rows:
        out[r.show_id].append((r.speaker, r.actor))
    return dict(out)


#: who: a speaker's number in the cast of ``show``, NONE or SEVERAL (then cands and errors tell which). ``words`` stand at SEVERAL, and at NONE
#: where the name before isn't sure or isn't in the partition. Rows with who <= COUNTS hold counts to learn from instead: of a speaker's words
#: (show, cands: the speaker's number and buckets, errors: lines and counts), of unnamed words behind a sure name (BEHIND, alike) or ahead of any name of the
#: partition (AHEAD, buckets and counts), of changes, or (ENDS) the first and the last name of the partition (cands: 0 or 1, who).
SEGMENT = "part int, episode_id bigint, id bigint, show int, who int, cands array<int>, errors array<int>, words array<int>, text string"
NONE, SEVERAL, COUNTS, CHANGES, ENDS, BEHIND, AHEAD = -1, -2, -3, -4, -5, -6, -7


def parsed(lines: DataFrame, bank: dict[int, list[tuple[str, str | None]]], with_text: bool) -> DataFrame:
    """Segments (columns of SEGMENT) of all lines that count, in the global order (episode, start, id); repeats of a line once.

    Lines of other kinds, of groups, without usable time or spoken words are left out. Each partition ends in
    rows of counts over its sure segments and unnamed ones behind them, at most twice BUCKETS for a row of the bank, and its first and last name.
    """
    counts = lines.filter((F.col("kind") == "speech") & (F.col("is_group") == F.lit(False)))
    order = ["episode_id", "s_ms", "id"]
    counts = usable_time(counts).select(*order, "show_id", "speaker", "text")
    ranked = counts.repartitionByRange(*order).sortWithinPartitions(*order, "speaker", "text").withColumn("part", F.spark_partition_id())
    shared = lines.sparkSession.sparkContext.broadcast(bank)
    columns = [c.split()[0] for c in SEGMENT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        casts: dict[int | None, Cast] = {None: Cast([])}
        heard: dict[tuple[int, int], np.ndarray] = {}
        behind: dict[tuple[int, int], np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, dtype=np.int64))
        ahead: dict[tuple[int | None, int], np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, dtype=np.int64))
        moves: dict[int, list[int]] = {}
        before, first, last, part = None, None, None, 0
        open_ = True  # whether the words of a segment without a name can tell who was named before
        for pdf in batches:
            rows = []
            part = int(pdf["part"].iloc[0]) if len(pdf) else part
            for e, i, show, label, text in zip(pdf["episode_id"], pdf["id"], pdf["show_id"], pdf["speaker"], pdf["text"], strict=True):
                e = int(e) if e == e and e is not None else None
                if before is not None and before[0] != e:
                    open_ = False
                if before == (before := (e, i, label, text)):
                    continue  # an exact repeat
                key = int(show) if show == show and show is not None else None
                if key not in casts:
                    casts[key] = Cast(shared.value[key]) if key in shared.value else casts[None]
                for who, errors, said in cut_up(text, label, casts[key]):
                    one, several = len(who) == 1, len(who) > 1
                    words = profile_words(said)
                    here = who[0] if one else SEVERAL if several else NONE
                    if one:
                        n = heard.get((key, here))
                        if n is None:
                            n = heard[key, here] = np.zeros(BUCKETS + 1, dtype=np.int64)
                        n[BUCKETS] += 1
                        np.add.at(n, words, 1)
                        if last is not None and last[:2] == (e, key) and last[2] >= 0:
                            moves.setdefault(key, [0, 0])[last[2] != here] += 1
                    if who:
                        open_, last = several, (e, key, here)
                        first = first or last
                    elif key in shared.value:
                        if last is None and open_:
                            np.add.at(ahead[e, key], words, 1)
                        elif last is not None and last[:2] == (e, key) and last[2] >= 0:
                            np.add.at(behind[key, last[2]], words, 1)
                    rows.append((part, e, i, key, here, who if several else None, errors if several else None, words if several or not who and open_ else None, said if with_text else None))
            if rows:
                yield frame(rows)
        told = [(part, None, None, show, COUNTS, (who, *np.flatnonzero(n[:BUCKETS]).tolist()), (int(n[BUCKETS]), *n[:BUCKETS][n[:BUCKETS] > 0].tolist()), None, None) for (show, who), n in heard.items()]
        told += [(part, None, None, show, CHANGES, (0, 1), tuple(n), None, None) for show, n in moves.items()]
        told += [(part, None, None, show, BEHIND, (who, *np.flatnonzero(n).tolist()), (0, *n[n > 0].tolist()), None, None) for (show, who), n in behind.items()]
        told += [(part, e, None, show, AHEAD, tuple(np.flatnonzero(n).tolist()), tuple(n[n > 0].tolist()), None, None) for (e, show), n in ahead.items()]
        told += [(part, e, None, show, ENDS, (at, who), None, None, None) for at, (e, show, who) in enumerate((first, last) if first else ())]
        if told:
            yield frame(told)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        return out.astype({"episode_id": "Int64", "id": "Int64", "show": "Int32"})

    return ranked.mapInPandas(run, SEGMENT)


class Model(NamedTuple):
    """What is learnt of one show, in whole parts of a nat (times SPREAD): profile[speaker][bucket], behind[speaker][bucket] for segments without a name, share[speaker], and the logs of staying and changing."""

    profile: dict[int, np.ndarray]
    behind: dict[int, np.ndarray]
    share: dict[int, int]
    stay: int
    change: int
    #: Of a speaker who was never surely named.
    flat: int
    rare: int

    def begins(self, who: int) -> int:
        return self.share.get(who, self.rare)


def whole(x: float) -> int:
    return round(math.log(x) * UNIT) * SPREAD


def profiles(sums: pd.DataFrame, more: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Smoothed log shares of the buckets by speaker, of sums and of ``more`` counts."""
    counts = {w: n + SMOOTH for w, n in more.items()}
    for who, w in sums[sums["bucket"] < BUCKETS].groupby("speaker"):
        counts.setdefault(int(who), np.full(BUCKETS, SMOOTH))[w["bucket"].to_numpy()] += w["n"].to_numpy()
    return {w: np.round(np.log(n / n.sum()) * UNIT).astype(np.int64) * SPREAD for w, n in counts.items()}


def learnt(segs: DataFrame) -> dict[int, Model]:
    """The model of each show from all segments that name exactly one speaker.

    At most (rows of the bank) x (2 BUCKETS + 1) sums, and of each partition two names and the words ahead of the first, reach the driver, however many lines there are.
    """
    ends = segs.filter(F.col("who").isin(ENDS, AHEAD)).select("part", "episode_id", "show", "who", "cands", "errors").collect()
    crossed: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    carried: dict[tuple[int, int], np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, dtype=np.int64))
    before: tuple[int | None, int, int] | None = None
    for r in sorted(ends, key=lambda r: (r.part, r.who != AHEAD, r.who == ENDS and r.cands[0])):
        here = before is not None and before[:2] == (r.episode_id, r.show) and before[2] >= 0
        if r.who == AHEAD:
            if here:
                np.add.at(carried[r.show, before[2]], r.cands, r.errors)
        elif r.cands[0] == 0:
            if here and r.cands[1] >= 0:
                crossed[r.show][before[2] != r.cands[1]] += 1
        else:
            before = (r.episode_id, r.show, r.cands[1])
    told = segs.filter(F.col("who").isin(COUNTS, BEHIND, CHANGES)).filter("show is not null").select("show", "who", F.get("cands", 0).alias("speaker"), F.posexplode(F.arrays_zip("cands", "errors")).alias("at", "p"))
    bucket = F.when((F.col("who") != CHANGES) & (F.col("at") == 0), F.lit(BUCKETS)).otherwise(F.col("p.cands"))
    sums = told.groupBy("show", "who", F.when(F.col("who") != CHANGES, F.col("speaker")).otherwise(F.lit(0)).alias("speaker"), bucket.alias("bucket")).agg(F.sum("p.errors").alias("n")).toPandas()
    out: dict[int, Model] = {}
    for show, g in sums.groupby("show"):
        moved = g[g["who"] == CHANGES].set_index("bucket")["n"].to_dict()
        stays, changes = (moved.get(x, 0) + crossed[show][x] for x in (0, 1))
        heard = g[g["who"] == COUNTS]
        lines = heard[heard["bucket"] == BUCKETS].set_index("speaker")["n"].to_dict()
        total = sum(lines.values()) + len(lines) + 1
        unnamed = {w: n for (x, w), n in carried.items() if x == show}
        profile = profiles(heard, {})
        behind = profiles(g[g["who"] == BEHIND], unnamed)
        share = {int(w): whole((n + 1) / total) for w, n in lines.items()}
        out[int(show)] = Model(profile, behind, share, whole((stays + 1) / (stays + changes + 2)), whole((changes + 1) / (stays + changes + 2)), whole(1 / BUCKETS), whole(1 / total))
    return out


UNLEARNT = Model({}, {}, {}, whole(0.5), whole(0.5), whole(1 / BUCKETS), whole(0.5))


class Named(NamedTuple):
    """A segment with a name as the model sees it: codes of the speakers that may be meant, what each emits, begins with and costs after another."""

    codes: list[int]
    emits: list[int]
    begins: list[int]
    stay: int
    change: int


#: Entering states that aren't among the first segment's: any other speaker, or nobody yet. What holds for all of them, and words before the first name.
OTHER, NOBODY_YET, SHARED, HEAD = -1, -2, -3, -4


def step(scores: dict[int, int], n: Named) -> tuple[dict[int, int], dict[int, int]]:
    """(score, best predecessor) of each speaker of ``n``; ties go to the smallest code."""
    new, back = {}, {}
    top = max(scores.values())
    lead = min(q for q, v in scores.items() if v == top)
    for s, emit, begin in zip(n.codes, n.emits, n.begins, strict=True):
        if NOBODY_YET in scores:
            new[s], back[s] = emit + begin + scores[NOBODY_YET], NOBODY_YET
            continue
        move, stay = top + n.change + begin, scores[s] + n.stay if s in scores else None
        if lead == s:
            # The best of the others, should staying cost more than a change.
            others = [(-v, q) for q, v in scores.items() if q != s]
            move = -min(others)[0] + n.change + begin if others else None
            q = min(others)[1] if others else s
        else:
            q = lead
        if stay is not None and (move is None or stay > move or stay == move and s < q):
            new[s], back[s] = emit + stay, s
        else:
            new[s], back[s] = emit + move, q
    return new, back


def viterbi(stretch: list[Named], entry: int, leave: int | None) -> list[int]:
    """The best speakers of a stretch, given the state before it and, if known, the last one's."""
    scores, backs = {entry: 0}, []
    for n in stretch:
        scores, back = step(scores, n)
        backs.append(back)
    s = leave if leave is not None else min(scores, key=lambda x: (-scores[x], x))
    path = []
    for back in reversed(backs):
        path.append(s)
        s = back[s]
    return path[::-1]


class Edge(NamedTuple):
    """Score transfer over one episode's segments in a partition.

    ``base`` has a score for each entering class: the first named segment's speakers, OTHER and NOBODY_YET. To it comes
    scores[class][speaker], the best of the last named segment's speakers; scores[SHARED] if a sure name lies between, as all classes then go on alike.
    ``through`` are speakers who, entering, talk on to the end. ``head`` is what entering speakers emit (others nothing) before the first name. No base if none is named.
    """

    part: int
    episode: int | None
    base: dict[int, int]
    scores: dict[int, dict[int, int]]
    through: set[int]
    head: dict[int, int]


class Transfer:
    """Works out an :class:`Edge` segment by segment: a score table for each entering class up to the first sure name, one from there on; no segments."""

    def __init__(self) -> None:
        self.base: dict[int, int] = {}
        self.scores: dict[int, dict[int, int]] = {}
        self.on: set[int] = set()
        self.head: dict[int, int] = {}
        #: A segment whose name fits several, as long as words without a name may follow it.
        self.open: Named | None = None

    def add(self, n: Named, last: int | None = None, same: bool = True) -> None:
        """A named segment, or a run of sure ones: ``n`` its first, ``last`` the code of its last, ``same`` whether all are one speaker."""
        self._flush()
        if len(n.codes) > 1:
            self.open = n
        else:
            self._step(n, n.codes[0] if last is None else last, same)

    def _flush(self) -> None:
        if self.open is not None:
            self._step(self.open, None, True)
        self.open = None

    def _step(self, n: Named, sure: int | None, same: bool) -> None:
        if not self.scores:
            self.base = dict.fromkeys((*n.codes, OTHER, NOBODY_YET), 0)
            self.scores = {c: {c: 0} for c in self.base}
            self.on = set(n.codes)
        on, shared = set(), SHARED in self.scores
        for c, now in self.scores.items():
            self.scores[c], back = step(now, n)
            on |= {x for x in (self.on if shared else self.on & {c}) if same and back.get(x) == x}
        self.on = on
        if sure is not None:
            if shared:
                self.scores = {SHARED: {sure: self.scores[SHARED][n.codes[0]]}}
            else:
                self.base = {c: self.scores[c][n.codes[0]] for c in self.base}
                self.scores = {SHARED: {sure: 0}}

    def edge(self, part: int, episode: int | None) -> Edge:
        self._flush()
        return Edge(part, episode, self.base, self.scores, self.on, self.head)


def composed(edges: list[Edge]) -> dict[tuple[int, int | None], tuple[int, int | None, int]]:
    """(part, episode) -> (entering state, leaving state or None, part in which the entering run began or -1).

    ``edges``: at most two for a partition, whatever it holds. Episodes that lie in one partition need none of this.
    """
    out: dict[tuple[int, int | None], tuple[int, int | None, int]] = {}
    chains: dict[int | None, list[Edge]] = defaultdict(list)
    for e in sorted(edges, key=lambda e: e.part):
        chains[e.episode].append(e)
    for episode, chain in chains.items():
        if len(chain) < 2:
            continue
        scores, backs = {NOBODY_YET: 0}, []
        for e in chain:
            scores = {q: v + e.head.get(q, 0) for q, v in scores.items()}
            if not e.base:
                backs.append({q: q for q in scores})
                continue
            reached = {q: scores[q] + e.base[q if q in e.base else OTHER] for q in sorted(scores)}
            if SHARED in e.scores:
                # All go on alike from the sure name, so only the best of them counts.
                q = max(reached, key=reached.__getitem__)
                reached = {q: reached[q]}
            new: dict[int, int] = {}
            back: dict[int, int] = {}
            for q, v in reached.items():
                for s, x in e.scores[SHARED if SHARED in e.scores else q if q in e.base else OTHER].items():
                    if s not in new or v + x > new[s]:
                        new[s], back[s] = v + x, q
            scores = new
            backs.append(back)
        s = min(scores, key=lambda x: (-scores[x], x))
        ways = []
        for back in reversed(backs):
            ways.append((back[s], s))
            s = back[s]
        origin = -1
        for e, (enter, leave) in zip(chain, reversed(ways), strict=True):
            out[e.part, episode] = (enter, leave if e.base else None, origin)
            if not (enter == leave and (not e.base or enter in e.through)) or origin < 0:
                origin = e.part
    return out


class Piece(NamedTuple):
    """Columns of segments; ``codes`` are those of sure segments, -1 elsewhere."""

    codes: np.ndarray
    who: np.ndarray
    show: np.ndarray
    ids: np.ndarray
    cands: np.ndarray
    errors: np.ndarray
    words: np.ndarray


class Reader:
    """Turns batches of segments of one partition into pieces: the segments of one episode in it."""

    def __init__(self, bank: dict[int, list[tuple[str, str | None]]], models: dict[int, Model]) -> None:
        names = sorted({s for rows in bank.values() for s, _ in rows if s})
        self.names = np.array([*names, None], dtype=object)
        code = {s: i for i, s in enumerate(names)}
        self.codes = {show: np.array([code[s] for s in sorted({s for s, _ in rows if s})], dtype=np.int64) for show, rows in bank.items()}
        self.numbers = {show: {int(c): i for i, c in enumerate(codes)} for show, codes in self.codes.items()}
        self.models = models
        self.profiles: dict[tuple[int, bool], np.ndarray] = {}
        shows = sorted(self.codes)
        self.shows = np.array(shows, dtype=np.int64)
        self.offset = np.cumsum([0, *[len(self.codes[x]) for x in shows]])
        self.flat = np.concatenate([self.codes[x] for x in shows]) if shows else np.empty(0, np.int64)

    def sure(self, show: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Codes of sure segments, -1 elsewhere."""
        out = np.full(len(who), -1, dtype=np.int64)
        at = np.flatnonzero(who >= 0)
        if len(at):
            out[at] = self.flat[self.offset[np.searchsorted(self.shows, show[at])] + who[at]]
        return out

    def said(self, show: int, words: np.ndarray | None, codes: list[int], named: bool) -> np.ndarray:
        """What speakers emit by saying the words in a show, with a name or without; those it doesn't know are like ones never heard."""
        m = self.models.get(show)
        if m is None or words is None or not len(words):
            return np.zeros(len(codes), dtype=np.int64)
        if (show, named) not in self.profiles:
            flat = np.full(BUCKETS, m.flat, dtype=np.int64)
            of = m.profile if named else m.behind
            self.profiles[show, named] = np.stack([*(of.get(i, flat) for i in range(len(self.codes[show]))), flat])
        at = self.numbers[show]
        return self.profiles[show, named][[at.get(c, -1) for c in codes]] @ np.bincount(words, minlength=BUCKETS)

    def several(self, x: Piece, at: int) -> Named:
        """A segment whose name fits several."""
        show = int(x.show[at])
        m = self.models.get(show, UNLEARNT)
        cands = x.cands[at].tolist()
        codes = self.codes[show][cands].tolist()
        emits = self.said(show, x.words[at], codes, True) - round(ERROR_COST * UNIT) * SPREAD * x.errors[at].astype(np.int64)
        ties = [zlib.crc32(f"{x.ids[at]} {self.names[c]}".encode()) % SPREAD for c in codes]
        return Named(codes, [e + t for e, t in zip(emits.tolist(), ties, strict=True)], [m.begins(c) for c in cands], m.stay, m.change)

    def goes_on(self, n: Named, x: Piece, at: int) -> None:
        """Adds the words of a segment without a name to the one it continues."""
        n.emits[:] = [e + v for e, v in zip(n.emits, self.said(int(x.show[at]), x.words[at], n.codes, False).tolist(), strict=True)]

    def heads(self, head: dict[int, int], x: Piece, at: int) -> None:
        """Adds the words of a segment without a name to what entering speakers emit: how much more than one never heard."""
        show = int(x.show[at])
        if show in self.models:
            *known, flat = self.said(show, x.words[at], [*self.numbers[show], -1], False).tolist()
            for c, v in zip(self.numbers[show], known, strict=True):
                head[c] = head.get(c, 0) + v - flat

    def one(self, code: int, show: int) -> Named:
        m = self.models.get(int(show), UNLEARNT)
        return Named([code], [0], [m.begins(self.numbers[int(show)][code])], m.stay, m.change)

    def rows(self, pdf: pd.DataFrame) -> Piece:
        who = pdf["who"].to_numpy()
        show = pdf["show"].fillna(-1).to_numpy().astype(np.int64)
        return Piece(self.sure(show, who), who, show, *(pdf[c].to_numpy() for c in ("id", "cands", "errors", "words")))


def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int | None, pd.DataFrame | None]]:
    """(part, episode, rows) of the segments of a partition, batch by batch, and (part, episode, None) where an episode ends."""
    open_: tuple[int, int | None] | None = None
    for pdf in batches:
        pdf = pdf[pdf["who"].to_numpy() > COUNTS]
        if not len(pdf):
            continue
        part, e = int(pdf["part"].iloc[0]), pdf["episode_id"]
        filled = e.fillna(-1).to_numpy()
        null = e.isna().to_numpy()
        starts = np.flatnonzero(np.r_[True, (filled[1:] != filled[:-1]) | (null[1:] != null[:-1])])
        for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True):
            here = (part, None if null[a] else int(filled[a]))
            if open_ is not None and open_ != here:
                yield *open_, None
            open_ = here
            yield *here, pdf.iloc[a:b]
    if open_ is not None:
        yield *open_, None


def _of(episodes: list[int | None]) -> Column:
    """Whether a row is of one of the episodes, which may be NULL."""
    here = F.col("episode_id").isin([e for e in episodes if e is not None])
    return F.coalesce(here, F.lit(True)) if None in episodes else F.coalesce(here, F.lit(False))


def edges(segs: DataFrame, bank: dict[int, list[tuple[str, str | None]]], models: dict[int, Model]) -> dict[tuple[int, int | None], tuple[int, int | None, int]]:
    """The states at partition edges (see :func:`composed`) of the episodes that lie in several partitions.

    A partition has at most two such episodes, as it is sorted by them: so at most two rows of it reach the driver.
    """
    ends = segs.filter(F.col("who") > COUNTS).groupBy("part").agg(F.min(F.struct("episode_id"))["episode_id"].alias("low"), F.max(F.struct("episode_id"))["episode_id"].alias("high")).collect()
    seen: dict[int | None, int] = defaultdict(int)
    for r in ends:
        for e in {r.low, r.high}:
            seen[e] += 1
    split = [e for e, n in seen.items() if n > 1]
    if not split:
        return {}
    shared = segs.sparkSession.sparkContext.broadcast((bank, models))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, t = Reader(*shared.value), Transfer()
        for part, episode, pdf in pieces(batches):
            if pdf is None:
                e = t.edge(part, episode)
                rows = [(part, episode, c, v, list(e.scores.get(c, {})), list(e.scores.get(c, {}).values()), c in e.through) for c, v in e.base.items()]
                rows += [(part, episode, c, None, list(x), list(x.values()), False) for c, x in ((SHARED, e.scores.get(SHARED, {})), (HEAD, e.head))]
                yield pd.DataFrame(rows, columns=["part", "episode_id", "enter", "base", "leave", "score", "through"]).astype({"episode_id": "Int64", "base": "Int64"})
                t = Transfer()
                continue
            x = reader.rows(pdf)
            # Single ones are names that fit several and words without a name that count; between them are runs of sure names.
            single = np.flatnonzero((x.who == SEVERAL) | (x.who == NONE) & pdf["words"].notna().to_numpy())
            lo = 0
            for at in [*single, len(pdf)]:
                run_ = lo + np.flatnonzero(x.codes[lo:at] >= 0)
                if len(run_):
                    codes = x.codes[run_]
                    t.add(reader.one(int(codes[0]), int(x.show[run_[0]])), int(codes[-1]), bool((codes == codes[0]).all()))
                if at < len(pdf):
                    if x.who[at] == SEVERAL:
                        t.add(reader.several(x, at))
                    elif t.open is not None:
                        reader.goes_on(t.open, x, at)
                    elif not t.scores:
                        reader.heads(t.head, x, at)
                lo = at + 1

    found: dict[tuple[int, int | None], Edge] = {}
    for r in segs.filter((F.col("who") > COUNTS) & _of(split)).drop("text").mapInPandas(run, "part int, episode_id bigint, enter bigint, base bigint, leave array<bigint>, score array<bigint>, through boolean").collect():
        e = found.setdefault((r.part, r.episode_id), Edge(r.part, r.episode_id, {}, {}, set(), {}))
        table = dict(zip(r.leave, r.score, strict=True))
        if r.enter == HEAD:
            e.head.update(table)
            continue
        if table:
            e.scores[r.enter] = table
        if r.enter != SHARED:
            e.base[r.enter] = r.base
        if r.through:
            e.through.add(r.enter)
    return composed(list(found.values()))


PIECE = "origin int, number bigint, part int, seq bigint, episode_id bigint, first_id bigint, last_id bigint, speaker string, text string"


class Runs:
    """The runs of one speaker in an episode's segments of one partition, as segments come in order."""

    def __init__(self, part: int, episode: int | None, seq: int, entry: int, origin: int) -> None:
        self.part, self.episode, self.seq = part, episode, seq
        self.state = entry
        self.key = (origin, -1) if entry >= 0 else None
        self.open: list | None = None
        self.out: list[list] = []

    def add(self, states: np.ndarray, ids: np.ndarray, texts: np.ndarray | None) -> None:
        keep = states >= 0
        if not keep.all():
            states, ids, texts = states[keep], ids[keep], texts[keep] if texts is not None else None
        if not len(states):
            return
        starts = np.flatnonzero(np.r_[True, states[1:] != states[:-1]])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(states)], strict=True):
            said = texts[a:b].tolist() if texts is not None else []
            if self.open is not None and self.open[7] == states[a]:
                self.open[6] = ids[b - 1]
                self.open[8] += said
                continue
            self.close()
            key = self.key if self.key is not None and self.state == states[a] else (self.part, self.seq)
            self.open = [*key, self.part, self.seq, self.episode, ids[a], ids[b - 1], int(states[a]), said]
            self.key = None
            self.seq += 1

    def close(self, goes_on: bool = False) -> None:
        if self.open is not None:
            if goes_on and self.open[1] >= 0:
                self.open[1] = -1
            self.out.append(self.open)
        self.open = None


def decoded(segs: DataFrame, bank: dict[int, list[tuple[str, str | None]]], models: dict[int, Model], known: dict[tuple[int, int | None], tuple[int, int | None, int]], with_text: bool) -> DataFrame:
    """Runs of one speaker within each partition (columns of PIECE). A turn that lies in several has a run in each, with number -1 and the part in which it began.

    ``known`` are the states at partition edges. What is held is the rows from a name that fits several to the next sure one.
    """
    last = {e: max(p for p, x in known if x == e) for _, e in known}
    shared = segs.sparkSession.sparkContext.broadcast((bank, models, known, last))
    columns = [c.split()[0] for c in PIECE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cast, learnt_, known_, last_ = shared.value
        reader = Reader(cast, learnt_)
        runs: Runs | None = None
        held: pd.DataFrame | None = None
        entry, leave, seq, out = NOBODY_YET, None, 0, []

        def decode(pdf: pd.DataFrame, whole_piece: bool) -> pd.DataFrame | None:
            """Feed the rows up to the last sure name (all of them at the end of an episode); the rest is given back."""
            nonlocal entry
            x = reader.rows(pdf)
            codes = x.codes
            named = np.flatnonzero((codes >= 0) | (x.who == SEVERAL))
            rest = None
            if not whole_piece and len(named) and codes[named[-1]] < 0:
                sure = named[codes[named] >= 0]
                cut_at = int(sure[-1]) + 1 if len(sure) else 0
                rest, pdf = pdf.iloc[cut_at:], pdf.iloc[:cut_at]
                x = Piece(*(c[:cut_at] for c in x))
                codes, named = x.codes, named[named < cut_at]
                if not cut_at:
                    return rest
            several = np.flatnonzero(codes[named] < 0)
            for group in np.split(several, np.flatnonzero(np.diff(several) > 1) + 1) if len(several) else ():
                before = int(codes[named[group[0] - 1]]) if group[0] else entry
                stretch = []
                for g in group:
                    stretch.append(reader.several(x, int(named[g])))
                    for behind in range(named[g] + 1, named[g + 1] if g + 1 < len(named) else len(codes)):
                        reader.goes_on(stretch[-1], x, behind)
                after = group[-1] + 1
                if after < len(named):
                    stretch.append(reader.one(int(codes[named[after]]), int(x.show[named[after]])))
                path = viterbi(stretch, before, leave if after >= len(named) else None)
                codes[named[group]] = path[: len(group)]
            at = np.maximum.accumulate(np.where(codes >= 0, np.arange(len(codes)), -1))
            states = np.where(at >= 0, codes[np.maximum(at, 0)], entry)
            runs.add(states, pdf["id"].to_numpy(), pdf["text"].to_numpy() if with_text else None)
            entry = int(states[-1]) if len(states) else entry
            return rest

        for part, episode, pdf in pieces(batches):
            if pdf is None:
                if held is not None:
                    decode(held, True)
                runs.close(last_.get(episode, part) > part)
                out += runs.out
                seq, runs, held = runs.seq, None, None
                continue
            if runs is None:
                entry, leave, origin = known_.get((part, episode), (NOBODY_YET, None, -1))
                runs = Runs(part, episode, seq, entry, origin)
            held = decode(pdf if held is None else pd.concat([held, pdf]), False)
            out += runs.out
            runs.out = []
            if len(out) > 10_000:
                yield frame(out, reader)
                out = []
        if out:
            yield frame(out, reader)

    def frame(rows: list[list], reader: Reader) -> pd.DataFrame:
        pdf = pd.DataFrame(rows, columns=columns)
        pdf["speaker"] = reader.names[pdf["speaker"].to_numpy(dtype=np.int64)]
        pdf["text"] = [" ".join(x) for x in pdf["text"]] if with_text else None
        return pdf.astype({"episode_id": "Int64"})

    return segs.mapInPandas(run, PIECE)


def turns(lines: DataFrame, bank_table: DataFrame, with_text: bool = False) -> DataFrame:
    """Ordered turns: episode_id, first_id, last_id, speaker (and text).

    Lines of a NULL episode are one episode; a line of a show without bank names nobody; empty tables give
    no rows; other columns of the tables are ignored. Repeated lines count once.
    """
    bank = read_bank(bank_table)
    segs = cut(parsed(lines, bank, with_text))
    models = learnt(segs)
    known = edges(segs, bank, models)
    columns = ["episode_id", "first_id", "last_id", "speaker", *(["text"] if with_text else [])]
    whole = decoded(segs, bank, models, known, with_text).filter("number >= 0").select(*columns)
    if not known:
        return whole
    # Only episodes over partition edges are decoded again, for the runs at the edges: at most two of a partition, one a turn.
    runs = decoded(segs.filter((F.col("who") > COUNTS) & _of(list({e for _, e in known}))), bank, models, known, with_text).filter("number < 0")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), " ")
    merged = runs.groupBy("episode_id", "origin").agg(
        F.min(F.struct("part", "first_id"))["first_id"].alias("first_id"), F.max(F.struct("part", "last_id"))["last_id"].alias("last_id"), F.min("speaker").alias("speaker"), *([said.alias("text")] if with_text else [])
    )
    return whole.unionByName(merged.select(*columns))


def ambiguous(lines: DataFrame, bank_table: DataFrame) -> DataFrame:
    """How much the model decides: segments, named ones, and those whose name fits several speakers."""
    segs = parsed(lines, read_bank(bank_table), False).filter(F.col("who") > COUNTS)
    return segs.agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("who") != NONE).alias("named"), F.count_if(F.col("who") == SEVERAL).alias("several"))
