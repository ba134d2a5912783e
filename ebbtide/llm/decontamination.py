"""Documents that hold benchmark items, re-parameterised ones included.

Texts become templates: numbers, units and names are typed placeholders, other
words stay, lower-cased and without outer punctuation. Windows of the items'
templates are joined with those of the documents by hash, and so are windows
with all words as they are, which also reach stretches of mostly numbers and
names. Neighbouring windows on one diagonal form a run; a part of a run counts
if the values in its slots rename consistently, one document value for one item
value and the other way round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import if_small, lean
from ebbtide.llm.shingles import BASE, BYTE, LOWER, SPACE, mix, powers, text_slices
from ebbtide.operators.ordering import settle

#: Template words of a window, and of a run that counts as a leak.
WINDOW, RUN = 8, 13
#: Items of fewer words than this are too common to look for.
SHORTEST = 4
#: Item windows mark cells of a bitmap of this fixed size, which documents are held against first.
BITMAP_BITS = 22
LITERAL, NUMBER, UNIT, NAME = range(4)
#: Forms of a window: its template, its words as they are, its template with a capitalised opening word as a name.
TEMPLATE, EXACT, NAMED = range(3)

# Words that count as units.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons tonne tonnes oz lb lbs pound pounds gram "
    "grams kilogram kilograms metre metres meter meters kilometre kilometres kilometer kilometers ml cl dl l litre litres liter "
    "liters gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents w kw mw v hz khz mhz ghz kb mb gb tb bit bits byte bytes mph kmh percent degree degrees"
).split()

_KEPT = np.ones(256, bool)
_KEPT[[c for c in range(128) if not chr(c).isalnum()]] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:|")] = True


def _lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the accented capitals of Latin-1 in lower case."""
    out = LOWER[data]
    accented = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
    out[accented] += 32
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, kinds, bounds, openers) of the words of all rows.

    A word's code is the hash of its letters and digits, lower-cased; words of
    punctuation alone are passed over. A word that starts with a digit is a
    number, one of UNITS a unit, and a capitalised one a name unless it starts
    a line, a sentence or the text; then it is an opener.
    """
    low = _lowered(data)
    space = SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    inner = offsets[offsets < len(data)]
    start[inner] = ~space[inner]
    keep = _KEPT[data] & ~space
    starts = np.flatnonzero(start)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(len(offsets), np.int64), np.zeros(0, bool)
    if not len(starts):
        return none
    before = np.cumsum(keep) - keep  # kept bytes before each byte
    word_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(data))))
    at = np.flatnonzero(keep)
    if not len(at):
        return none
    of = word_of[at - starts[0]]
    place = before[at] - before[starts][of]
    values = BYTE[low[at]] * powers(int(place.max()) + 1)[place]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    codes = mix(np.add.reduceat(values, first))
    word = of[first]  # words with a kept byte
    head = at[first]
    number = _DIGIT[data[head]]
    following = data[np.minimum(head + 1, len(data) - 1)]
    name = (_UPPER[data[head]] & (following >= ord("a"))) | ((data[head] == 0xC3) & (following >= 0x80) & (following <= 0x9E))
    # the bytes from the word before to this one: does a sentence or a line end there?
    breaks = np.cumsum((_STOP | (np.arange(256) == 10))[data])
    opens = np.ones(len(word), bool)
    opens[1:] = breaks[head[1:]] > breaks[head[:-1]]
    bounds = np.searchsorted(head, offsets)
    opens[bounds[:-1][bounds[:-1] < len(head)]] = True
    kinds = np.where(number, NUMBER, np.where(np.isin(codes, UNIT_CODES), UNIT, np.where(name & ~opens, NAME, LITERAL)))
    return codes, kinds.astype(np.int8), bounds, name & opens & (kinds == LITERAL)


UNIT_CODES = np.zeros(0, np.uint64)
UNIT_CODES = np.sort(
    np.concatenate([words(np.frombuffer(u.encode(), np.uint8), np.array([0, len(u)]))[0] for u in UNITS])
)


def windows(
    codes: np.ndarray, kinds: np.ndarray, bounds: np.ndarray, openers: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, form) of the windows inside a row: all of them in the
    exact form, those in which at least half the words are literal as templates."""
    n = len(codes) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)
    symbols = mix(np.arange(4, dtype=np.uint64) * BASE)
    shown = np.where(kinds == LITERAL, codes, symbols[kinds])
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = row[:n] == row[size - 1 :]
    sums = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
    literal = sums[size:] - sums[:-size]

    def hashed(at, seed, first, rest):
        out = mix(np.full(len(at), seed, np.uint64) + first)
        for j in range(1, size):
            out = mix(out + rest[at + j])
        return out

    template = np.flatnonzero(inside & (2 * literal >= size))
    exact = np.flatnonzero(inside)
    named = np.flatnonzero(inside & openers[:n] & (2 * (literal - 1) >= size))
    hashes = [
        hashed(template, size, shown[template], shown),
        hashed(exact, size + 64, codes[exact], codes),
        hashed(named, size, symbols[NAME], shown),
    ]
    forms = np.repeat(np.array([TEMPLATE, EXACT, NAMED], np.int8), [len(template), len(exact), len(named)])
    return np.concatenate([template, exact, named]), np.concatenate(hashes), forms


FOUND = "id bigint, size int, n int, pos int, hash bigint, form int, slots array<bigint>"


def _windows(rows: DataFrame, sizes=None, bitmap=None) -> DataFrame:
    """Windows of (id, text) of the given sizes whose cell in the bitmap is marked;
    without sizes each text's own: WINDOW, or all its words where it has fewer.
    `slots` has the code of every word of the window, 0 for literal ones."""

    def run(batches):
        for batch in batches:
            for top, data, offsets in text_slices(batch.column(1)):
                codes, kinds, bounds, openers = words(data, offsets)
                values = np.where(kinds == LITERAL, np.uint64(0), codes)
                length = np.diff(bounds)
                for size in sizes or range(SHORTEST, WINDOW + 1):
                    at, hashes, forms = windows(codes, kinds, bounds, openers, size)
                    row = np.searchsorted(bounds, at, "right") - 1
                    if bitmap is not None:
                        hit = bitmap.value[(hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)]
                    else:
                        hit = np.minimum(length[row], WINDOW) == size
                    at, hashes, forms, row = at[hit], hashes[hit], forms[hit], row[hit]
                    if not len(at):
                        continue
                    slots = values[at[:, None] + np.arange(size)]
                    slots[forms == NAMED, 0] = codes[at[forms == NAMED]]
                    ends = np.arange(len(at) + 1) * size
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(top + row)),
                            pa.array([size] * len(at), pa.int32()),
                            pa.array(length[row], pa.int32()),
                            pa.array(at - bounds[row], pa.int32()),
                            pa.array(hashes.view(np.int64)),
                            pa.array(forms, pa.int32()),
                            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(slots.ravel().view(np.int64))),
                        ],
                        ["id", "size", "n", "pos", "hash", "form", "slots"],
                    )

    return rows.mapInArrow(lean(run), FOUND)


def longest_part(pairs: list[tuple[int, int] | None]) -> tuple[int, bool]:
    """Words of the longest steady part of a run, and whether its values are the
    same on both sides (of parts of one length, if any's are).

    `pairs` has one entry per word, None where it is no slot. A run is cut
    where a slot stops renaming one to one since the last cut, once from its
    start and once from its end.
    """
    best = 0, False
    for line in (pairs, pairs[::-1]):
        there, back, start, same = {}, {}, 0, True
        for at, pair in enumerate(line):
            if pair is not None:
                a, b = pair
                if there.get(a, b) != b or back.get(b, a) != a:
                    there, back, start, same = {}, {}, at, True
                there[a], back[b] = b, a
                same &= a == b
            best = max(best, (at + 1 - start, same))
    return best


PARTS = "doc_id bigint, item_id bigint, n int, words int, verbatim boolean"


def _parts(batches):
    """The longest steady part of each run (doc_id, item_id, n, windows of (pos, ours, theirs))."""
    for batch in batches:
        lengths, verbatim = [], []
        for run in batch.column(3).to_pylist():
            run.sort(key=lambda w: w["pos"])
            first, last = run[0]["pos"], run[-1]["pos"] + len(run[-1]["ours"])
            pairs: list = [None] * (last - first)
            for w in run:
                for j, (a, b) in enumerate(zip(w["ours"], w["theirs"], strict=True), w["pos"] - first):
                    if a and b:
                        pairs[j] = a, b
            length, same = longest_part(pairs)
            lengths.append(length)
            verbatim.append(same)
        columns = [*batch.columns[:3], pa.array(lengths, pa.int32()), pa.array(verbatim, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n", "words", "verbatim"])


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, item_id, words, share, verbatim: one row per document and item it holds.

    A document holds an item if a run of at least RUN template words of it, or
    the whole of a shorter item, stands in the document with consistent slots;
    a run is split where its slots stop being so (see `longest_part`). Windows of mostly numbers,
    units and names count with their own values only. `words` is the longest
    such part, `share` its part of the item, `verbatim` says that the slot
    values are the item's own. Null and empty texts hold nothing; items under
    SHORTEST words are not found. Repeated rows count once; rows without an id are left
    out. Extra columns are ignored.
    """
    spark = docs.sparkSession
    items = settle(_windows(benchmark.select(F.col("item_id").cast("bigint"), F.col("text")).where("item_id is not null")).distinct())
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # WINDOW and shorter
    cells = items.select(F.shiftrightunsigned("hash", 64 - BITMAP_BITS).alias("cell")).distinct()
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    bitmap[cells.toArrow()["cell"].to_numpy()] = True  # as many rows as the bitmap has cells at most
    marked = spark.sparkContext.broadcast(bitmap)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col(text)).where("doc_id is not null")
    seen = _windows(rows, sizes or [WINDOW], marked).select(F.col("id").alias("doc_id"), "hash", F.col("pos").alias("at"), F.col("form").alias("their_form"), F.col("slots").alias("theirs"))
    item_side = items.select(F.col("id").alias("item_id"), "hash", "pos", "n", "form", F.col("slots").alias("ours"))
    met = seen.join(if_small(item_side), "hash").where(F.size("ours") == F.size("theirs"))
    line = ["doc_id", "item_id", "diagonal"]
    met = met.withColumn("diagonal", F.col("at") - F.col("pos"))
    met = met.groupBy(*line, "pos").agg(F.min(F.struct(F.greatest("form", "their_form").alias("form"), "n", "ours", "theirs")).alias("w"))
    # windows in a row have one difference of place and rank
    rank = F.row_number().over(Window.partitionBy(*line).orderBy("pos"))
    runs = (
        met.withColumn("run", F.col("pos") - rank)
        .groupBy(*line, "run")
        .agg(F.first("w.n").alias("n"), F.collect_list(F.struct("pos", "w.ours", "w.theirs")).alias("windows"))
    )
    # runs that are too short as a whole have no part that is long enough
    whole = F.size("windows") - 1 + F.size(F.col("windows")[0]["ours"])
    runs = runs.where(whole >= F.least(F.lit(RUN), F.col("n"))).select("doc_id", "item_id", "n", "windows")
    held = runs.mapInArrow(lean(_parts), PARTS).where(F.col("words") >= F.least(F.lit(RUN), F.col("n")))
    found = held.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", "n", "verbatim")).alias("top"))
    return found.select("doc_id", "item_id", F.col("top.words").cast("bigint").alias("words"), F.round(F.col("top.words") / F.col("top.n"), 4).alias("share"), "top.verbatim")
