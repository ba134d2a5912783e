"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton of the pieces lists all matches of a text in one
pass. A Viterbi pass over the end positions carries the best score and its
number of pieces. Ties go to the match that starts first, as in the tokenizer;
runs of unknown characters are one piece, or one per byte where the vocabulary
has byte pieces.

Pieces hold the space mark only at their start, so a text falls apart into
space-led words whose best scores add up; each distinct word is done once.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 400_000

Vocabulary = tuple[tuple[str, float], ...]
_counters: dict[tuple[str, int], UnigramCounter] = {}


def read_vocabulary(path: str) -> tuple[Vocabulary, bool]:
    """Pieces with their stored scores, read as log-probabilities, from a
    SentencePiece file; and whether bytes stand in for unknown characters.
    Control pieces are left out, as plain text never makes them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return tuple(pieces), any(model.is_byte(i) for i in ids)


class UnigramCounter:
    """Best score and piece count of words; `words` remembers them."""

    def __init__(self, vocabulary: Vocabulary, bytes_for_unknown: bool):
        self.automaton = ahocorasick.Automaton()
        best: dict[str, float] = {}
        for piece, score in vocabulary:
            best.setdefault(piece, score)
        for piece, score in best.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(best.values(), default=0.0) - UNKNOWN_PENALTY
        self.bytes_for_unknown = bytes_for_unknown
        inner = any(SPACE in p.lstrip(SPACE) for p in best)
        self.splits = not inner and SPACE in best
        self.words: dict[str, tuple[float, int]] = {}

    def word(self, text: str) -> tuple[float, int]:
        """Best score and number of pieces of one stretch of text.

        Matches come by end position, the earliest start first; a strictly
        better score is needed to replace an earlier one.
        """
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        pieces, unknown, single = [0] * (n + 1), [False] * (n + 1), [False] * (n + 1)
        best[0], done = 0.0, 0

        def settle(upto: int) -> None:
            """Characters that are no piece of their own may be unknown."""
            for at in range(done + 1, upto + 1):
                if single[at]:
                    continue
                total = best[at - 1] + self.unknown
                if best[at] is None or total > best[at]:
                    best[at], unknown[at] = total, True
                    if self.bytes_for_unknown:
                        pieces[at] = pieces[at - 1] + len(text[at - 1].encode())
                    else:
                        pieces[at] = pieces[at - 1] + (0 if unknown[at - 1] else 1)

        for last, (length, score) in self.automaton.iter(text):
            if last > done:
                settle(last)
                done = last
            end = last + 1
            start = end - length
            total = best[start] + score
            if best[end] is None or total > best[end]:
                best[end], pieces[end] = total, pieces[start] + 1
            if length == 1:
                single[end] = True
        settle(n)
        return best[n], pieces[n]

    def text(self, text: str) -> tuple[float, int]:
        """Best score and number of pieces of a whole text, spaces marked and one put before it."""
        if not text:
            return 0.0, 0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.splits:
            return self.word(marked)
        score, count, words = 0.0, 0, self.words
        if len(words) > CACHE_WORDS:
            words.clear()
        mark = ""
        # a run of space marks belongs to the word after it
        for part in marked.split(SPACE)[1:]:
            mark += SPACE
            if not part:
                continue
            key = mark + part if len(mark) > 1 else part
            got = words.get(key)
            if got is None:
                got = words[key] = self.word(mark + part)
            score, count, mark = score + got[0], count + got[1], ""
        if mark:
            tail = self.word(mark)
            score, count = score + tail[0], count + tail[1]
        return score, count


def counter(path: str) -> UnigramCounter:
    """One automaton and memory per Python worker."""
    if path not in _counters:
        _counters[path] = UnigramCounter(*read_vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, score of every row's whole text; null and empty texts
    have 0 tokens. Repeated rows are kept, extra columns ignored."""

    def rows(batches):
        c = counter(path)
        for batch in batches:
            got = [c.text(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[1] for g in got], pa.int64()), pa.array([g[0] for g in got], pa.float64())],
                ["doc_id", "n_tokens", "score"],
            )

    return docs.selectExpr(f"`{doc_id}` as doc_id", f"`{text}` as text").mapInArrow(rows, "doc_id bigint, n_tokens bigint, score double")
