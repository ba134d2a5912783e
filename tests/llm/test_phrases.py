"""Phrase mining against plain counting of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path

import pytest

from ebbtide.llm import phrases

DOCS = "doc_id bigint, text string, lang string, phrase string, a bigint, n int, rank int, shard int"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.fixture(scope="module", autouse=True)
def workers_find_the_package(spark):
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def plain(rows, threshold=10, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for (lang, *words), a in f.items():
        if len(words) < 2 or a < threshold:
            continue
        if len(words) == 2 and any(
            100 * c >= 50 * a and len(p) == 4 and p[0] == lang and tuple(words) in (p[1:3], p[2:4]) for p, c in f.items() if c >= threshold
        ):
            continue
        cuts = [(f[lang, *words[:k]], f[lang, *words[k:]]) for k in range(1, len(words))]
        l, r = min(cuts, key=lambda c: 10**6 * a * a // (c[0] * c[1]))
        out.setdefault(lang, []).append((-(10**6 * a * a // (l * r)), -a, " ".join(words).encode(), l, r))
    return {
        (lang, i, w.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, w, l, r) in enumerate(sorted(found)[:top], 1)
    }


def answer(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, lang, "x", 1, 2, 3, 0) for i, (t, lang) in enumerate(rows)], DOCS).repartition(4)
    out = [tuple(r[c] for c in COLUMNS) for r in phrases.collocations(docs, **options).collect()]
    assert len(set(out)) == len(out)
    return set(out)


def random_rows(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "日本", "don't", "ÿ\x1f"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = ["".join(w + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n"]) for w in r.choices(vocabulary, weights, k=r.randrange(60))) for _ in range(n)]
    return [(t, r.choice(["en", "de", "und", None])) for t in texts]


@pytest.mark.parametrize("shards", [1, 2, 4])
def test_equals_counting_of_all_phrases(spark, shards):
    rows = random_rows(5)
    assert answer(spark, rows, shards=shards) == plain(rows)


def test_shared_cells_do_not_change_counts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CELL_BITS", 3)
    rows = random_rows(6, 40)
    assert answer(spark, rows) == plain(rows)


def test_phrases_that_begin_late_are_counted_over_a_whole_cycle(spark):
    rare = [("alpha beta gamma", "en")] * 10 + [("delta epsilon", "en")] * 11
    r = random.Random(4)
    rows = [*rare, *random_rows(8, 30)]
    r.shuffle(rows)
    found = answer(spark, rows, shards=4)
    assert found == plain(rows)
    assert ("alpha beta gamma", 10) in {row[2:4] for row in found}


def test_top_and_ties(spark):
    rows = [(f"tie{i} end{i}", "en") for i in range(9) for _ in range(10)]
    assert answer(spark, rows, top=4) == plain(rows, top=4)


def test_awkward_rows(spark):
    rows = [(None, None), ("", "en"), (" \t ", "en"), ("..,;\n", "fr"), ("one", "de"), ("Same same SAME same " * 12, "en"), ("a b " * 4000, "en\nx")]
    rows += [("x" * 70_000 + " y", "en")] * 10
    assert answer(spark, rows) == plain(rows)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 8)
    text = b"one two, three four five six. seven\teight\nnine"
    parts = list(phrases._pieces(text))
    assert len(parts) > 2
    assert b"".join(parts) == b"one two\n three four five six\n seven eight\nnine"
    assert all(not p or p.startswith(b"\n") for p in parts[1:])


def test_no_rows(spark):
    assert answer(spark, [(None, "en")]) == set()
    assert phrases.collocations(spark.createDataFrame([], DOCS)).collect() == []
