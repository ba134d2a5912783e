"""Spelling variants: words one edit apart, found by composing automata.

Words are counted over whole texts. Two words of which the shorter has `l`
letters differ at exactly one place i, the length of their longest common
prefix: one letter is replaced, or one is inserted before letter i of the
shorter. A word therefore stands in few *windows* [s, e) of such places: words
that meet there share their first s letters and the last l - e letters of the
shorter one. Windows are split until a group of words that share both ends is
small; each pair then meets in exactly one group, the one whose window holds i.

A group is one pair of initial states (its words of l and of l + 1 letters,
without the shared ends) of a minimised acceptor that all groups of a batch
share. The acceptor is composed with the one-edit transducer and with itself:
before the edit both sides read the same letters, the edit sends them to
different states, after it they read the same letters again. Results of state
pairs are kept, so shared endings are walked once. Words are addressed by the
number of accepted words before them, as counted in the states.

Null or empty texts have no words. A null id is written as nothing before the
colon of the checksum. Repeated rows count as often as they stand. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import if_small, lean
from ebbtide.operators.ordering import settle

SHORTEST = 5
LEAST = 3
DAMAGE = 97
#: Groups with more words are split into narrower windows, as are windows of more than WIDEST places.
GROUP_WORDS = 20_000
WIDEST = 32
#: Words that one acceptor holds, and distinct words that a counting task holds.
BATCH_WORDS = 30_000
HELD_WORDS = 200_000
CHUNK = 1 << 20

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_OUTSIDE = re.compile(rb"[^a-z\xc3\x80-\xbf]")


def _runs(text: bytes) -> Iterator[list[bytes]]:
    """Letter runs of a text in A-Z lower case, a bounded list at a time."""
    text = text.lower()
    first = 0
    while first < len(text):
        stop = _OUTSIDE.search(text, first + CHUNK)
        last = stop.start() if stop else len(text)
        yield _RUN.findall(text, first, last)
        first = last


def _damaged(doc: bytes, run: bytes) -> bytes:
    """The run, without one letter where the checksum of document and run says so."""
    mark = zlib.crc32(b"%b:%b" % (doc, run))
    if mark % DAMAGE:
        return run
    letters = run.decode()
    place = mark % len(letters)
    return (letters[:place] + letters[place + 1 :]).encode()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        words, counts = pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())
        return pa.RecordBatch.from_arrays([words.cast(pa.string()), counts], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch["doc"].cast(pa.binary()), batch["text"].cast(pa.large_binary()), strict=True):
            doc, text = doc.as_py() or b"", text.as_py() or b""
            for runs in _runs(text):
                for run, n in Counter(runs).items():
                    if len(run) >= SHORTEST:
                        word = _damaged(doc, run)
                        if len(word) - word.count(b"\xc3") >= SHORTEST:
                            held[word] += n
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
    if held:
        yield out()


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`word, n`: words of SHORTEST letters and LEAST occurrences or more."""
    rows = docs.select(F.col(doc_id).cast("string").alias("doc"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(lean(_counted), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _window(length: Column, start: Column, end: Column) -> Column:
    """A word's entry for the window [start, end) of pairs whose shorter word has `length` letters."""
    word = F.col("word")
    tail = F.greatest(length - end, F.lit(0))
    return F.struct(
        length.cast("int").alias("l"),
        start.cast("int").alias("s"),
        end.cast("int").alias("e"),
        F.xxhash64(length, start, end, F.substring(word, F.lit(1), start), F.right(word, tail)).alias("key"),
    )


def _entries(words: DataFrame) -> DataFrame:
    """Each word in the two halves of its places, as the shorter and as the longer of a pair."""
    size = F.char_length("word")
    kinds = [(size, F.lit(True)), (size - 1, size > SHORTEST)]
    windows = F.array(
        *[F.when(ok, _window(l, *ends)) for l, ok in kinds for ends in ((F.lit(0), F.floor(l / 2)), (F.floor(l / 2), l + 1))]
    )
    return words.select("word", "n", F.explode(F.filter(windows, lambda w: w.isNotNull())).alias("w")).select("word", "n", "w.*")


def _narrowed(entries: DataFrame) -> DataFrame:
    """Windows split until no group is large and no window wide; a window of one place has few words."""
    by = ["key", "l", "s", "e"]
    width = F.col("e") - F.col("s")
    while True:
        large = ((F.col("count") > GROUP_WORDS) & (width > 1)) | ((F.col("count") > 1) & (width > WIDEST))
        split = if_small(entries.groupBy(*by).count().where(large).select(*by))
        if split.isEmpty():
            return entries
        l, s, e = F.col("l"), F.col("s"), F.col("e")
        middle = F.floor((s + e) / 2)
        parts = F.explode(F.array(_window(l, s, middle), _window(l, middle, e))).alias("w")
        halves = entries.join(split, by, "left_semi").select("word", "n", parts).select("word", "n", "w.*")
        entries = settle(entries.join(split, by, "left_anti").select(*halves.columns).unionByName(halves))


class Acceptor:
    """A minimised acceptor of several sets of words, each of one length.

    States with the same endings are one state. `arcs[p]` lists (letter, next
    state, number of p's words before those); state 0 accepts.
    """

    def __init__(self) -> None:
        self.arcs: list[tuple[tuple[str, int, int], ...]] = [()]
        self.to: list[dict[str, tuple[int, int]]] = [{}]
        self.size = [1]
        self._known: dict[tuple, int] = {}

    def _state(self, arcs: tuple[tuple[str, int, int], ...]) -> int:
        found = self._known.get(arcs)
        if found is None:
            found = self._known[arcs] = len(self.arcs)
            self.arcs.append(arcs)
            self.to.append({letter: (state, before) for letter, state, before in arcs})
            self.size.append(arcs[-1][2] + self.size[arcs[-1][1]])
        return found

    def add(self, words: list[str]) -> int:
        """The initial state of distinct, sorted words of equal length."""
        length = len(words[0])

        def build(lo: int, hi: int, depth: int) -> int:
            if hi - lo == 1:
                state = 0
                for letter in reversed(words[lo][depth:]):
                    state = self._state(((letter, state, 0),))
                return state
            arcs, first = [], lo
            for i in range(lo + 1, hi + 1):
                if i == hi or words[i][depth] != words[first][depth]:
                    arcs.append((words[first][depth], build(first, i, depth + 1) if depth + 1 < length else 0, first - lo))
                    first = i
            return self._state(tuple(arcs))

        return build(0, len(words), 0) if length else 0


#: Two word numbers in one integer.
_PAIR = 1 << 24


class OneEdit:
    """Acceptor o one edit o acceptor: accepted pairs from a pair of initial states, each once."""

    def __init__(self, words: Acceptor) -> None:
        self.words = words
        self._equal: dict[tuple[int, int], list[int]] = {}
        self._insert: dict[tuple[int, int, bool], list[int]] = {}
        self._replace: dict[int, list[int]] = {0: []}

    def equal(self, p: int, q: int) -> list[int]:
        """After the edit: both sides read the same letters."""
        if p == q:
            return [k * (_PAIR + 1) for k in range(self.words.size[p])]
        found = self._equal.get((p, q))
        if found is None:
            found, other = [], self.words.to[q]
            for letter, state, before in self.words.arcs[p]:
                if letter in other:
                    state2, before2 = other[letter]
                    step = before * _PAIR + before2
                    found += [x + step for x in self.equal(state, state2)]
            self._equal[p, q] = found
        return found

    def replace(self, p: int) -> list[int]:
        """Pairs of p's words that differ in one letter."""
        found = self._replace.get(p)
        if found is None:
            found, arcs = [], self.words.arcs[p]
            for i, (_, state, before) in enumerate(arcs):
                found += [x + before * (_PAIR + 1) for x in self.replace(state)]
                for _, state2, before2 in arcs[i + 1 :]:
                    step = before * _PAIR + before2
                    found += [x + step for x in self.equal(state, state2)]
            self._replace[p] = found
        return found

    def insert(self, p: int, q: int, at_end: bool) -> list[int]:
        """Pairs of a word of p and one of q with one more letter.

        The letter goes behind the longest common prefix, so the next letter of
        the shorter word differs; at its very end only if `at_end`.
        """
        found = self._insert.get((p, q, at_end))
        if found is None:
            found, arcs, to = [], self.words.arcs, self.words.to
            for letter, state, before in arcs[p]:
                if letter in to[q]:
                    state2, before2 = to[q][letter]
                    step = before * _PAIR + before2
                    found += [x + step for x in self.insert(state, state2, at_end)]
            for extra, state2, before2 in arcs[q]:
                if p == 0 and at_end:
                    found.append(before2)
                rest = to[state2]
                for letter, state, before in arcs[p]:
                    if letter != extra and letter in rest:
                        state3, before3 = rest[letter]
                        step = before * _PAIR + before2 + before3
                        found += [x + step for x in self.equal(state, state3)]
            self._insert[p, q, at_end] = found
        return found


_PARTIAL = "word string, n bigint, n_near bigint, form_n bigint, form string"


def _summed(words: list[str], counts: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """Per word the number of its near words here and the one that counts most."""
    order = np.lexsort((np.arange(len(words)), -counts))  # words come sorted
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    near = np.bincount(left, minlength=len(words)) + np.bincount(right, minlength=len(words))
    best = np.full(len(words), len(words), np.int64)
    np.minimum.at(best, left, rank[right])
    np.minimum.at(best, right, rank[left])
    hit = np.flatnonzero(near)
    form = order[best[hit]]
    take = [words[i] for i in hit.tolist()], [words[i] for i in form.tolist()]
    columns = [pa.array(take[0], pa.string()), pa.array(counts[hit]), pa.array(near[hit]), pa.array(counts[form]), pa.array(take[1], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["word", "n", "n_near", "form_n", "form"])


def _group_pairs(groups: list[tuple[tuple[int, int, int], list[tuple[str, int]]]]) -> Iterator[pa.RecordBatch]:
    """Near words of some groups, whose words share one acceptor."""
    acceptor = Acceptor()
    starts = []
    for (length, start, end), rows in groups:
        tail = max(length - end, 0)
        sides = []
        for size in (length, length + 1):
            own = [i for i, (word, _) in enumerate(rows) if len(word) == size]
            middles = sorted((rows[i][0][start : size - tail], i) for i in own)
            sides.append((acceptor.add([m for m, _ in middles]) if own else None, np.array([i for _, i in middles], np.int64)))
        starts.append((end > length, sides))
    pairs = OneEdit(acceptor)
    for (at_end, ((short, own), (longer, others))), (_, rows) in zip(starts, groups, strict=True):
        found = np.array(pairs.replace(short), np.int64)
        left, right = own[found // _PAIR], own[found % _PAIR]
        if longer is not None:
            found = np.array(pairs.insert(short, longer, at_end), np.int64)
            left, right = np.append(left, own[found // _PAIR]), np.append(right, others[found % _PAIR])
        if len(left):
            yield _summed([w for w, _ in rows], np.array([n for _, n in rows], np.int64), left, right)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and word; whole groups are gathered into batches."""
    names = ("key", "l", "s", "e", "word", "n")
    rows = (row for batch in batches for row in zip(*[batch[c].to_numpy(zero_copy_only=False).tolist() for c in names], strict=True))
    held, size = [], 0
    for (_, *window), members in groupby(rows, key=lambda row: row[:4]):
        words = [row[4:] for row in members]
        short = sum(len(word) == window[0] for word, _ in words)
        if not short or len(words) < 2:
            continue
        held.append((tuple(window), words))
        size += len(words)
        if size >= BATCH_WORDS:
            yield from _group_pairs(held)
            held, size = [], 0
    if held:
        yield from _group_pairs(held)


def near_words(words: DataFrame) -> DataFrame:
    """`word, n, n_near, form_n, form` of words with their counts: how many words
    are one edit away, and the one of them that counts most (null if none)."""
    entries = _narrowed(_entries(words))
    groups = entries.repartition("key").sortWithinPartitions("key", "l", "s", "e", "word")
    found = groups.mapInArrow(lean(_near), _PARTIAL)
    alone = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("bigint").alias("form_n"), F.lit(None).cast("string").alias("form"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("minus"), F.col("form").alias("form"))))
    out = found.unionByName(alone).groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n", "n_near", (-F.col("b.minus")).alias("form_n"), F.col("b.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """`word, root` of the words that have a form, by doubling the steps taken."""
    steps = settle(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        ahead = if_small(steps.select(F.col("word").alias("root"), F.col("root").alias("further")))
        moved = settle(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`word, form, root, n, n_near, form_n` of all words of the documents.

    A word's form is its near word with the largest count (ties: the first in
    code-point order), if that is at least twice its own; its root follows the
    forms to the last.
    """
    words = settle(word_counts(docs, doc_id, text))
    near = near_words(words)
    enough = F.col("form_n") >= 2 * F.col("n")
    near = settle(near.withColumns({"form": F.when(enough, F.col("form")), "form_n": F.when(enough, F.col("form_n"))}))
    out = near.join(roots(near), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
