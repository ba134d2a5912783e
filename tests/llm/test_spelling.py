"""Spelling variants against plain counting and comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import pytest

from ebbtide.llm import spelling

DOCS = "doc_id bigint, text string, word string, n bigint, form string, key string"


@pytest.fixture(scope="module", autouse=True)
def workers_find_the_package(spark):
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def plain_words(rows):
    counts = Counter()
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = [best if best and words[best] >= 2 * n else None, w, n, len(near), words[best] if best and words[best] >= 2 * n else None]
    for w, row in out.items():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {(w, *row) for w, row in out.items()}


def random_rows(seed, letters, docs):
    r = random.Random(seed)
    stems = ["".join(r.choice(letters) for _ in range(r.randrange(5, 9))) for _ in range(14)]

    def word():
        w = r.choice(stems)
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            i = r.randrange(len(w) + 1)
            w = r.choice([w[:i] + r.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i + 1 :]])
        return w

    return [(i, " ".join(word() for _ in range(120))) for i in range(docs)]


def answer(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], DOCS).repartition(3)
    out = spelling.spelling_variants(docs).collect()
    found = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in out}
    assert len(found) == len(out)
    return found


@pytest.mark.parametrize("letters", ["ab", "abcé", "aàÿ÷xyz"])
def test_equals_comparison_of_all_words(spark, letters):
    rows = random_rows(7, letters, 12)
    assert answer(spark, rows) == plain_variants(rows)


def test_windows_are_split_without_losing_or_repeating_a_pair(spark, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP_WORDS", 6)
    rows = random_rows(11, "abc", 14)
    assert answer(spark, rows) == plain_variants(rows)


def test_awkward_rows(spark):
    long = "".join(random.Random(3).choice("abcd") for _ in range(3_000))
    changed = long[:1700] + "x" + long[1700:]
    rows = [
        (1, None), (2, ""), (3, " \n "), (None, "Apples apples APPLES applet applet applet"), (4, f"{long} {long} {long} {long}"),
        (5, f"{changed} {changed} {changed}, {long}!"), (6, "naïve naïve naïve naive naive naive naive naive naive ÀÉÎÕÜ"), (7, "abcde " * 5 + "abcd1abcde"),
        (7, "abcde " * 5), (8, "日本 \U0001f600 ł-words words words words"),
    ]
    assert answer(spark, rows) == plain_variants(rows)
    assert (changed, long) in {(w, f) for w, f, *_ in answer(spark, [*rows, (9, f"{long} " * 9)])}


def test_runs_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK", 5)
    assert [w for part in spelling._runs("Éclairé wonderful-things über  Ångström x".encode()) for w in part] == [
        w.encode() for w in ("Éclairé", "wonderful", "things", "über", "Ångström", "x")
    ]


def test_no_rows(spark):
    assert answer(spark, [(1, None)]) == set()
    empty = spark.createDataFrame([], DOCS)
    assert spelling.spelling_variants(empty).collect() == []
