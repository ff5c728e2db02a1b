"""Freely typed values to entries of a reference list.

The reference entries, with their aliases and word-order forms, make a trie. A typed
value is searched in it once, with a universal Levenshtein automaton for the errors that its length allows: states are
sets of (offset, errors) relative to a position of the typed value, and a step depends only
on the state and on where the trie's letter occurs in the next few letters, so all steps
are kept in one table that all searches share. A swap of neighbours is one error. The walk leaves branches below
which no entry shares enough letter pairs with the typed value to be within reach, which loses none.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelode.llm import medianames

#: Errors allowed by length of the typed value: (shortest length, errors).
ERRORS = ((0, 0), (4, 1), (8, 2), (14, 3), (22, 4))

#: Share of a word that may be wrong if there are three errors or more.
WORD_SHARE = 0.45

State = tuple[tuple[int, int, int], ...]


def allowed(length: int) -> int:
    return max(e for n, e in ERRORS if length >= n)


class Automaton:
    """Universal automaton for up to ``k`` errors; steps are worked out when first needed."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.width = 2 * k + 2
        self.start: State = ((0, 0, 0),)
        self.steps: dict[tuple[State, int], tuple[int, State] | None] = {}

    def step(self, state: State, bits: int) -> tuple[int, State] | None:
        """(shift, next state) after a letter found at ``bits`` of the window, None if all is lost."""
        at = (state, bits)
        if at not in self.steps:
            self.steps[at] = self._step(state, bits)
        return self.steps[at]

    def _step(self, state: State, bits: int) -> tuple[int, State] | None:
        k, out = self.k, set()
        for i, e, swap in state:
            found = bits >> i
            if swap:
                if found & 1:
                    out.add((i + 2, e, 0))
                continue
            if found & 1:
                out.add((i + 1, e, 0))
                continue
            if e < k:
                out |= {(i, e + 1, 0), (i + 1, e + 1, 0)}
                if found & 2:
                    out.add((i, e + 1, 1))
                for j in range(1, k - e + 1):
                    if found >> j & 1:
                        out.add((i + j + 1, e + j, 0))
                        break
        kept = [p for p in out if p[2] or not any(q[2] == 0 and q[1] < p[1] and abs(q[0] - p[0]) <= p[1] - q[1] for q in out)]
        if not kept:
            return None
        shift = min(p[0] for p in kept)
        return shift, tuple(sorted((i - shift, e, s) for i, e, s in kept))


class Reference:
    """Reference entries as a trie: for each node its children and the entries that end in it."""

    def __init__(self, names: list[tuple[str, int]]) -> None:
        self.entries = entries(names)
        #: Whole words of the list, by which a typed title can be told from a misspelt one.
        self.vocabulary = {w for words, _ in self.entries for w in words if len(w) > 3}
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for number, (words, _) in enumerate(self.entries):
            node = 0
            for c in "".join(words):
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = nxt
            self.ends[node].append(number)
        #: Shortest and longest rest below a node, to leave branches that can't end in time.
        self.rest = [(0, 0)] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):
            below = [self.rest[x] for x in self.children[node].values()]
            short = 0 if self.ends[node] else min((a for a, _ in below), default=0) + 1
            self.rest[node] = (short, max((b + 1 for _, b in below), default=0))
        self.automata: dict[int, Automaton] = {}
        joined = ["".join(words) for words, _ in self.entries]
        self.exact: dict[str, int] = {}
        self.paths: list[list[int]] = []
        #: Entries by letter pair (with its number, if it comes more than once), and their lengths.
        pairs: dict[tuple[str, int], list[int]] = defaultdict(list)
        for number, name in enumerate(joined):
            self.exact[name] = min(self.exact.get(name, self.entries[number][1]), self.entries[number][1])
            path = [0]
            for c in name:
                path.append(self.children[path[-1]][c])
            self.paths.append(path)
            for pair in letter_pairs(name):
                pairs[pair].append(number)
        self.pairs = {k: np.asarray(v, dtype=np.int64) for k, v in pairs.items()}
        self.lengths = np.asarray([len(x) for x in joined], dtype=np.int64)

    def open_nodes(self, typed: str, k: int) -> set[int] | None:
        """Nodes on the way to entries that may be within ``k`` errors of ``typed``; None if all may be.

        An error spoils up to two letter pairs and a swap three, so an entry in reach shares at least len + 1 - 3k of them.
        """
        least = len(typed) + 1 - 3 * k
        if least < 1:
            return None
        lists = [self.pairs[x] for x in letter_pairs(typed) if x in self.pairs]
        if not lists:
            return set()
        shared = np.bincount(np.concatenate(lists), minlength=len(self.lengths))
        near = np.flatnonzero((shared >= least) & (np.abs(self.lengths - len(typed)) <= k))
        return {node for x in near for node in self.paths[x]}

    def search(self, typed: str, k: int) -> dict[int, int]:
        """Every entry within ``k`` errors of ``typed``: number -> fewest errors."""
        open_ = self.open_nodes(typed, k)
        if open_ is not None and not open_:
            return {}
        auto = self.automata.setdefault(k, Automaton(k))
        n, width, found = len(typed), auto.width, {}
        mask = (1 << width) - 1
        where: dict[str, int] = {}
        for i, c in enumerate(typed):
            where[c] = where.get(c, 0) | 1 << i
        stack = [(0, 0, auto.start)]
        while stack:
            node, base, state = stack.pop()
            if self.ends[node]:
                errors = min((e + n - base - i for i, e, s in state if not s and base + i <= n), default=k + 1)
                if errors <= k:
                    for x in self.ends[node]:
                        found[x] = min(found.get(x, k + 1), errors)
            for c, child in self.children[node].items():
                if open_ is not None and child not in open_:
                    continue
                short, long = self.rest[child]
                left = n - base
                if short > left + k or long + k + k + 2 < left:
                    continue
                nxt = auto.step(state, where.get(c, 0) >> base & mask)
                if nxt is not None:
                    stack.append((child, base + nxt[0], nxt[1]))
        return found

    def within(self, typed: str) -> dict[int, tuple[int, bool]]:
        """Every number with an entry within the distance that the typed value's length allows: (fewest errors, whether the entry is plausible).

        A plausible entry goes before one that isn't, then the one with fewer errors.
        """
        keys = list(dict.fromkeys("".join(w) for w in medianames.spellings(typed)))
        words = set(medianames.tokens(typed))
        foreign = words & self.vocabulary if len(words) > 1 else set()
        heads = {w[0] for w in words} if len(words) > 1 else set()
        out: dict[int, tuple[int, bool]] = {}
        for x in keys:
            for entry, errors in self.search(x, allowed(len(x))).items():
                number = self.entries[entry][1]
                old = out.get(number)
                if old is not None and old[1] and old[0] <= errors:
                    continue
                new = (errors, self.plausible(x, entry, errors, foreign, heads))
                if old is None or (not new[1], errors) < (not old[1], old[0]):
                    out[number] = new
        return out

    def nearest(self, typed: str) -> tuple[int, int]:
        """(number, errors) of the nearest plausible entry within the allowed distance, 0 if none is meant.

        Two different entries equally near, with errors, mean that neither is meant for sure: 0. Equal exact
        entries give the smallest number.
        """
        same = [self.exact[k] for w in medianames.spellings(typed) if (k := "".join(w)) in self.exact]
        if same:
            return min(same), 0
        found = {n: e for n, (e, fine) in self.within(typed).items() if fine}
        if not found:
            return 0, -1
        best = min(found.values())
        names = sorted(x for x, e in found.items() if e == best)
        return (0, best) if len(names) > 1 and best else (names[0], best)

    def plausible(self, typed: str, entry: int, errors: int, foreign: set[str], heads: set[str]) -> bool:
        """An exact check of a hit: no word of the entry may be another word.

        Words of the list that were typed but are not the entry's speak against it; with three or more
        errors, no single word may hold more of them than WORD_SHARE of its length, and one that holds three or more keeps
        its first letter (``heads``: those of the typed words, if there are several).
        """
        words = self.entries[entry][0]
        if not errors:
            return True
        if any(all(distance(w, x, 1) > 1 for x in words) for w in foreign if w not in words):
            return False
        return errors < 3 or all(e <= max(1, WORD_SHARE * len(w)) and (e < 3 or not heads or w[0] in heads) for w, e in zip(words, spread(typed, words), strict=True))


def letter_pairs(name: str) -> list[tuple[str, int]]:
    """Neighbouring letters of a name, its ends included, each with the number of its occurrence."""
    padded = f" {name} "
    seen: Counter[str] = Counter()
    out = []
    for x in map("".join, zip(padded, padded[1:], strict=False)):
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def spread(typed: str, words: tuple[str, ...]) -> list[int]:
    """Errors of ``typed`` against the joined ``words``, by word, in a cheapest alignment."""
    entry = "".join(words)
    n, m = len(typed), len(entry)
    d = [[i + j if not i * j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            same = typed[i - 1] == entry[j - 1]
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (not same))
            if i > 1 and j > 1 and typed[i - 1] == entry[j - 2] and typed[i - 2] == entry[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    owner = [k for k, w in enumerate(words) for _ in w]
    out, i, j = [0] * len(words), n, m
    while i or j:
        here = owner[max(j - 1, 0)]
        if i and j and typed[i - 1] == entry[j - 1] and d[i][j] == d[i - 1][j - 1]:
            i, j = i - 1, j - 1
            continue
        if i > 1 and j > 1 and typed[i - 1] == entry[j - 2] and typed[i - 2] == entry[j - 1] and d[i][j] == d[i - 2][j - 2] + 1:
            i, j = i - 2, j - 2
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
        out[here] += 1
    return out


def distance(a: str, b: str, limit: int) -> int:
    """Errors between two words (a swap of neighbours is one), ``limit`` + 1 if there are more.

    What both begin and end with is left out; a column of the rest is one number whose bits are the steps between
    its cells, so a letter costs a few operations whatever the length.
    """
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    head = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        head += 1
    end_a, end_b = len(a), len(b)
    while end_a > head and end_b > head and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[head:end_a], b[head:end_b]
    if not a or not b:
        return min(len(a) + len(b), limit + 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    top = 1 << (len(a) - 1)
    up, down, diagonal, before, errors = full, 0, 0, 0, len(a)
    for c in b:
        here = where.get(c, 0)
        swap = ((~diagonal & here) << 1) & before
        diagonal = (((here & up) + up) ^ up | here | down | swap) & full
        more, less = down | (full & ~(diagonal | up)), diagonal & up
        if more & top:
            errors += 1
        elif less & top:
            errors -= 1
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(diagonal | more)) & full, more & diagonal & full
        before = here
    return min(errors, limit + 1)


def entries(names: list[tuple[str, int]]) -> list[tuple[tuple[str, ...], int]]:
    """Trie entries of (name, number): a moved form gives way to another name's own form."""
    own = {("".join(w), n): w for name, n in names for w in medianames.spellings(name)}
    taken = {k for k, _ in own}
    moved = {("".join(w), n): w for name, n in names for w in medianames.forms(name) if "".join(w) not in taken}
    return sorted((w, n) for (_, n), w in (own | moved).items())


def listed(seasons: DataFrame) -> list[tuple[str, int]]:
    """(name, show_id) of the season table: show and aliases.

    The table has one row for a show and season and does not grow with the corpus; the
    distinct names are collected (refused beyond 200,000, some 20 MB).
    """
    names = (
        seasons.select("show_id", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("show"))).alias("name"))
        .filter(F.col("show_id").isNotNull() & F.col("name").isNotNull())
        .distinct()
        .limit(200_001)
        .collect()
    )
    if len(names) > 200_000:
        raise ValueError("the list of shows is too large to be broadcast")
    return sorted((r.name, r.show_id) for r in names)


_built: dict[int, Reference] = {}


def reference(names: list[tuple[str, int]]) -> Reference:
    """The reference of a list, built once in a worker."""
    key = hash(tuple(names))
    if key not in _built:
        _built.clear()
        _built[key] = Reference(names)
    return _built[key]


#: Titles whose result a task keeps, as files of a download share theirs.
KEPT = 200_000


def match(files: DataFrame, seasons: DataFrame) -> DataFrame:
    """(id, show_id, errors): the show that the title in ``name`` means, 0 if none is listed.

    One row for every distinct id, the smallest name standing for an id. NULL, blank
    and title-less names give 0 with errors -1. The title nearest to the file counts; the
    folders above it are asked where it has none or none that any entry is near to. A title
    between two shows gives 0 and is not asked further.
    """
    shared = files.sparkSession.sparkContext.broadcast(listed(seasons))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shows_of = reference(shared.value)
        known: dict[str, tuple[int, int]] = {}
        for pdf in batches:
            if len(known) > KEPT:
                known.clear()
            shows, errors = [], []
            for name in pdf["name"]:
                show, error = 0, -1
                for title in medianames.parse(name).titles:
                    if title not in known:
                        known[title] = shows_of.nearest(title)
                    show, error = known[title]
                    if show or error >= 0:
                        break
                shows.append(show)
                errors.append(error)
            yield pd.DataFrame({"id": pdf["id"], "show_id": shows, "errors": errors})

    one = files.groupBy("id").agg(F.min("name").alias("name"))
    return one.mapInPandas(run, "id bigint, show_id int, errors int")


def titles(files: DataFrame) -> DataFrame:
    """(title, files): every distinct title that a path holds, own or of a folder, with the number of ids whose path holds it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"title": [t for name in pdf["name"] for t in dict.fromkeys(medianames.parse(name).titles)]}, dtype="object")

    one = files.groupBy("id").agg(F.min("name").alias("name"))
    return one.mapInPandas(run, "title string").groupBy("title").agg(F.count(F.lit(1)).alias("files"))


def within_reach(files: DataFrame, seasons: DataFrame) -> DataFrame:
    """(title, files, show_id, errors, plausible): for every distinct typed title all shows with an entry within its distance, a row each.

    A title without any has one row with NULLs: the report of unmatched values. ``plausible`` is false where a whole word differs.
    """
    shared = files.sparkSession.sparkContext.broadcast(listed(seasons))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shows_of = reference(shared.value)
        for pdf in batches:
            rows = []
            for title, n in zip(pdf["title"], pdf["files"], strict=True):
                found = shows_of.within(title)
                rows += [(title, n, show, e, fine) for show, (e, fine) in sorted(found.items())] or [(title, n, None, None, None)]
            yield pd.DataFrame(rows, columns=["title", "files", "show_id", "errors", "plausible"]).astype({"show_id": "Int32", "errors": "Int32", "plausible": "boolean"})

    return titles(files).mapInPandas(run, "title string, files bigint, show_id int, errors int, plausible boolean")
