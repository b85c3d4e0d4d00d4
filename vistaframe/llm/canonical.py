"""Freely typed values to the entries of a reference list.

Method, in two stages, the first on every value:

1. ``automaton``: an Aho-Corasick automaton over the canonical names and their aliases (words written together, plurals)
   finds the embedded mentions, word by word; the longest mentions that do not overlap are kept. They decide if they account
   for all that the value says (articles, numbers and remarks about place or sight say nothing); several of them are one
   item if together they have its words, else the longest counts, or the first of equally long ones.
2. ``similarity``: the values that remain are held against the names as sets of words. A word of the value matches a word of
   the name within the edits its length allows (``EDIT_COST`` each), or as its beginning if it is written with a full stop;
   the score is twice the matches by the words of both, and counts from ``LEAST_SCORE``. The value's words written together
   are tried as one word too. Candidates come from a deletion index over the words of the names. Beside a mention, the best
   name counts only if it explains a word that the mentions leave over; without one, the longest mention decides.

The reference list and the aliases are small by contract (``MAX_ITEMS`` is checked) and broadcast; each worker builds
automaton and index once. Values are mapped where they are read: no shuffle, and each worker remembers the values it has seen.

Defined cases
* null: no row comes out of ``map_values`` (nothing was typed); empty, blank or only punctuation and numbers: item 0.
* a value that is, byte for byte, an item of its kind: that item (``p1_found`` leaves these out).
* two names that score equally: the one that is there with all its words, then the one with more words, the one written in
  full before its aliases, the one with the value's first letter; still
  two: item 0. Values without a mention whose best score is too low: item 0, reported.
* very long values and words: whole. A name's score cannot reach ``LEAST_SCORE`` if the value has too many words, nor can a
  word match one that is shorter by more than the edits, so what is left out there changes no result.
* repeated rows: mapped alike; columns besides those named: not read. An empty list: every value gets item 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Proven bound of the reference list and of the alias table, checked when they are read.
MAX_ITEMS = 20_000
#: Values a worker remembers before it starts afresh.
MEMO = 200_000
LEAST_SCORE, EDIT_COST, BEGINNING = 0.75, 0.1, 0.95

#: Words that add nothing to a name. Fixed values.
ARTICLES = {"a", "an", "the", "one", "some", "of"}
#: Remarks of annotators about place or sight. Fixed values.
REMARKS = {
    "far", "away", "left", "right", "back", "front", "partly", "hidden", "unclear", "top", "bottom", "near", "upper",
    "lower", "behind", "occluded", "partial", "partially", "visible", "blurry", "maybe", "probably",
}


def fold(text: str) -> str:
    """Without case and accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


_WORD = re.compile(r"[^\W\d_]+|\d+")


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def shortened(text: str) -> set[str]:
    """Words of a text that are followed by a full stop."""
    return {m[0] for m in _WORD.finditer(text) if text[m.end() : m.end() + 1] == "."}


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of letters that come to stand side by side) between a and b; most + 1 if
    there are more than most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b)
    last: dict[str, int] = {}
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, at = [far, i], 0
        for j, y in enumerate(b, 1):
            up, left = last.get(y, 0), at
            same = x == y
            if same:
                at = j
            row.append(min(rows[i][j + 1] + 1, row[j] + 1, rows[i][j] + (not same), rows[up][left] + (i - up - 1) + 1 + (j - left - 1)))
        last[x] = i
        rows.append(row)
    return min(rows[-1][-1], most + 1)


def edits_allowed(length: int) -> int:
    """Edits a spelling of so many letters may hold."""
    return 0 if length < 3 else 1 if length < 6 else 2


def deletions(text: str, most: int) -> set[str]:
    found, layer = {text}, {text}
    for _ in range(most):
        layer = {t[:i] + t[i + 1 :] for t in layer for i in range(len(t))}
        found |= layer
    return found


class Names:
    """The items of one kind, with their automaton and the deletion index of their words."""

    def __init__(self, items: Iterable[tuple[int, str]], together: Iterable[tuple[str, str]]) -> None:
        import ahocorasick

        self.exact: dict[str, int] = {}
        self.patterns: dict[tuple[str, ...], int] = {}
        for item_id, item in sorted(items):
            self.exact.setdefault(item, item_id)
            if name := tuple(words(fold(item))):
                self.patterns.setdefault(name, item_id)
        self.own = set(self.patterns)
        for name, item_id in list(self.patterns.items()):
            head, end = name[:-1], name[-1]
            for plural in (end + "s", end + "es", *([end[:-1] + "ies"] if end.endswith("y") else []), *([end[:-1] + "ves"] if end.endswith("f") else [])):
                self.patterns.setdefault((*head, plural), item_id)
            self.patterns.setdefault(("".join(name),), item_id)
        for combined, apart in together:
            if combined and apart and (item_id := self.patterns.get(tuple(words(fold(apart))))) and (name := tuple(words(fold(combined)))):
                self.patterns.setdefault(name, item_id)
        self.sets: dict[tuple[str, ...], set[int]] = {}
        for name, item_id in self.patterns.items():
            self.sets.setdefault(tuple(sorted(name)), set()).add(item_id)
        self.automaton = ahocorasick.Automaton()
        self.near: dict[str, list[str]] = {}
        self.begins: dict[str, list[str]] = {}
        self.by_word: dict[str, list[tuple[str, ...]]] = {}
        for name, item_id in self.patterns.items():
            # a space on both sides of each word, so that neighbouring mentions share none
            self.automaton.add_word("".join(f" {w} " for w in name), (len(name), item_id))
            for w in dict.fromkeys(name):
                self.by_word.setdefault(w, []).append(name)
        for w in self.by_word:
            for part in deletions(w, edits_allowed(len(w))):
                self.near.setdefault(part, []).append(w)
            for i in range(1, len(w)):
                self.begins.setdefault(w[:i], []).append(w)
        self.longest_word = max(map(len, self.by_word), default=0)
        self.most_words = max(map(len, self.patterns), default=0)
        if self.patterns:
            self.automaton.make_automaton()

    def mentions(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """(first word, words, item) of the longest mentions that do not overlap, in their order. Mentions are taken by length,
        so one that overlaps an earlier one covers it with its first or last word: two looks for each, not one for each pair."""
        if not self.patterns or not tokens:
            return []
        starts, at = {}, 0
        for k, t in enumerate(tokens):
            starts[at] = k
            at += len(t) + 2
        found: list[tuple[int, int, int, int]] = []
        for end, (n, item) in self.automaton.iter("".join(f" {t} " for t in tokens)):
            last = starts.get(end + 1, len(tokens))
            first = last - n
            found.append((sum(map(len, tokens[first:last])), first, n, item))
        kept, taken = [], bytearray(len(tokens))
        for _, first, n, item in sorted(found, key=lambda m: (-m[0], m[1])):
            if not taken[first] and not taken[first + n - 1]:
                taken[first : first + n] = b"\x01" * n
                kept.append((first, n, item))
        return sorted(kept)

    def matches(self, token: str, short: bool) -> dict[str, float]:
        """Words of the names that a word of a value may stand for, with how well."""
        found: dict[str, float] = {}
        if len(token) <= self.longest_word + 2:
            for part in deletions(token, edits_allowed(len(token))):
                for w in self.near.get(part, ()):
                    if w not in found:
                        most = edits_allowed(min(len(token), len(w)))
                        d = distance(token, w, most)
                        if d <= most:
                            found[w] = 1 - EDIT_COST * d
        if short:
            for w in self.begins.get(token, ()):
                found[w] = max(found.get(w, 0.0), BEGINNING)
        return found

    def similar(self, tokens: list[str], short: set[str]) -> tuple[int, set[int]]:
        """(item, positions of the words it explains) of the best token-set score, (0, nothing) if there is none or a tie."""
        if not tokens or LEAST_SCORE * len(tokens) > (2 - LEAST_SCORE) * self.most_words:
            return 0, set()
        at = [self.matches(t, t in short) for t in tokens]
        best: list[tuple[tuple, int, set[int]]] = []
        for name in {name for found in at for w in found for name in self.by_word[w]}:
            pairs = sorted(((s, -i, -k) for i, found in enumerate(at) for k, w in enumerate(name) if (s := found.get(w)) is not None), reverse=True)
            left, right, total = set(), set(), 0.0
            for s, i, k in pairs:
                if -i not in left and -k not in right:
                    left.add(-i)
                    right.add(-k)
                    total += s
            missing, whole = len(name) - len(right), len(name) == len(right)
            if missing and len(left) == len(tokens) and 0 in right and any(t in short for t in tokens):
                missing = 0  # a shortened name may leave out its further words
            score = 2 * total / (len(tokens) + len(right) + missing)
            if score >= LEAST_SCORE:
                best.append(((round(score, 6), whole, len(right), name in self.own, name[0][0] == tokens[0][0], len("".join(name)) >= len("".join(tokens))), self.patterns[name], left))
        if not best:
            return 0, set()
        top = max(b[0] for b in best)
        items = {item: left for rank, item, left in best if rank == top}
        return next(iter(items.items())) if len(items) == 1 else (0, set())

    def resolve(self, value: str) -> tuple[int, str]:
        """The item that a typed value stands for, 0 if none, and the stage that decided."""
        if value in self.exact:
            return self.exact[value], "exact"
        text = fold(value)
        tokens = [t for t in words(text) if not t.isdigit()]
        found = self.mentions(tokens)
        covered = {k for first, n, _ in found for k in range(first, first + n)}
        silent = {k for k, t in enumerate(tokens) if k not in covered and (t in ARTICLES or t in REMARKS)}
        rest = [k for k in range(len(tokens)) if k not in covered and k not in silent]
        longest = max(found, key=lambda m: (sum(map(len, tokens[m[0] : m[0] + m[1]])), -m[0]))[2] if found else 0
        if found and not rest:
            if len(found) > 1 and len(one := self.sets.get(tuple(sorted(tokens[k] for k in covered)), ())) == 1:
                return next(iter(one)), "automaton"
            return longest, "automaton"
        said = [k for k in range(len(tokens)) if k not in silent]
        # a remark may be a word of a name too ("back" in "back rest"): all words are tried if the others give nothing
        short = shortened(text)
        for tried in (said, [k for k, t in enumerate(tokens) if t not in ARTICLES]) if silent else (said,):
            item, explained = self.similar([tokens[k] for k in tried], short)
            if not item and len(tried) > 1:
                item, _ = self.similar(["".join(tokens[k] for k in tried)], set())
                explained = set(range(len(tried)))
            if item and (not found or any(tried[i] in rest for i in explained)):
                return item, "similarity"
        return (longest, "automaton") if found else (0, "none")


class Mapper:
    """``Names`` of every kind, with a memory."""

    def __init__(self, items: Iterable[tuple[int, str, str]], together: Iterable[tuple[str, str]]) -> None:
        self.items, self.together = tuple(items), tuple(together)
        self.kinds: dict[str, Names] | None = None
        self.memo: dict[tuple[str, str], tuple[int, str]] = {}

    def decide(self, kind: str | None, value: str | None) -> tuple[int, str]:
        """The item of a value and the stage that decided."""
        if self.kinds is None:
            self.kinds = {k: Names([(i, n) for i, n, kk in self.items if kk == k], self.together) for k in {k for _, _, k in self.items}}
        if value is None or kind not in self.kinds:
            return 0, "none"
        if (found := self.memo.get((kind, value))) is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[kind, value] = self.kinds[kind].resolve(value)
        return found

    def __call__(self, kind: str | None, value: str | None) -> int:
        return self.decide(kind, value)[0]


def read_mapper(items: DataFrame, together: DataFrame | None = None) -> Mapper:
    """Mapper of a reference list (item_id, item, kind) and of pairs (combined_word, separated_word)."""

    def bounded(df: DataFrame) -> list:
        rows = df.limit(MAX_ITEMS + 1).collect()
        if len(rows) > MAX_ITEMS:
            raise ValueError(f"a reference list of more than {MAX_ITEMS} entries")
        return rows

    listed = [(r[0], r[1], r[2]) for r in bounded(items.select("item_id", "item", "kind").dropna().distinct())]
    pairs = [] if together is None else [(r[0], r[1]) for r in bounded(together.select("combined_word", "separated_word").dropna().distinct())]
    return Mapper(sorted(listed), sorted(pairs))


_BUILT: dict[int, Mapper] = {}


def on_worker(shared) -> Mapper:
    """The worker's mapper of a broadcast list; automaton, index and memory last from task to task."""
    key = hash(shared.value)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Mapper(*shared.value)
    return _BUILT[key]


def map_values(df: DataFrame, mapper: Mapper, kind: str = "kind", value: str = "value", out: str = "item_id", stage: str = "stage") -> DataFrame:
    """df with the item of each value, 0 where it stands for none, and the stage that decided."""
    shared = df.sparkSession.sparkContext.broadcast((mapper.items, mapper.together))

    @F.pandas_udf("item bigint, stage string")
    def decided(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = on_worker(shared)
        for kinds, values in batches:
            yield pd.DataFrame([own.decide(k, v) for k, v in zip(kinds.array, values.array)], columns=["item", "stage"])

    mapped = df.where(F.col(value).isNotNull()).withColumn("_decided", decided(kind, value))
    return mapped.withColumns({out: F.col("_decided.item"), stage: F.col("_decided.stage")}).drop("_decided")


def not_exact(df: DataFrame, mapper: Mapper, kind: str = "kind", value: str = "value") -> DataFrame:
    """Rows whose value is not, byte for byte, an item of its kind: an anti join with the list, whose size is checked."""
    listed = df.sparkSession.createDataFrame([(k, n) for _, n, k in mapper.items], "_kind string, _item string")
    return df.join(F.broadcast(listed), (F.col(kind) == F.col("_kind")) & (F.col(value) == F.col("_item")), "left_anti")
