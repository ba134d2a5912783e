"""Phrase collocations by dynamic itemset counting over cyclic shard scans.

The texts are dealt into SHARDS shards, written once. Step t scans shard
t mod SHARDS and counts, together, whatever is active: words from step 0 on,
and a longer phrase from the step after both phrases it consists of (without
its last and without its first word) have reached the threshold. Each phrase
stays active for one full cycle, so its count is complete, wherever in the
cycle it began; then it is kept if it reached the threshold, or dropped.

Which words and pairs have reached the threshold is told to the scans by two
arrays of fixed size: per hash cell the step after which a word (pair) of that
cell had done so. Phrases of a shared cell begin at the same step; that can
only let phrases be counted that need not be, and the counts stay exact.
Phrases are counted as words of a slice's dictionary, not as hashes.

Null texts are empty, a null language is `und`. Repeated rows count as often as
they stand. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import if_small, lean
from ebbtide.llm.shingles import mix, word_hashes
from ebbtide.operators.ordering import settle
from ebbtide.session import work_folder

THRESHOLD = 10
KEPT_PERCENT = 50
TOP = 2000
#: With more shards longer phrases begin sooner, and running counts are merged more often.
SHARDS = 2
CELL_BITS = 22
#: Bytes of text of one language that are counted together; a longer piece stays whole.
SLICE = 16 << 20
NEVER = 100
BUCKETS = 64
#: Scores are counted in bands this wide: about a thousand per language.
BAND = 1000

_BREAKS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\t", b"\n" * 10 + b" ")
_COUNTED = "key string, cell int, till int, n bigint"


def _cell(hashes: np.ndarray, cells: int) -> np.ndarray:
    """The first bits of the hashes; `cells` is a power of two."""
    return (hashes >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) + second)


class _Slice:
    """Words of some pieces of text as numbers of a dictionary, with their places."""

    def __init__(self, lang: str, data: bytes) -> None:
        text = np.frombuffer(data, np.uint8)
        gap = (text == 32) | (text == 10)
        first = ~gap
        first[1:] &= gap[:-1]
        starts = np.flatnonzero(first)
        sizes = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1 - starts
        ends = np.concatenate([[0], np.cumsum(sizes)])
        buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text[~gap])]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
        self.lang, self.words = lang, coded.dictionary
        self.at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.searchsorted(np.flatnonzero(text == 10), starts)
        self.follows = piece[1:] == piece[:-1]
        joined = np.frombuffer(b" ".join(self.words.to_numpy(zero_copy_only=False).tolist()), np.uint8)
        own = word_hashes(joined, np.array([0, len(joined)]))[0] if len(joined) else np.zeros(0, np.uint64)
        salt = np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64)
        self.hashes = mix(own + salt)

    def rows(self, parts: list[np.ndarray], cell: np.ndarray, till: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Counted phrases, given by the dictionary numbers of their words."""
        words = [self.words.take(pa.array(p)) for p in parts]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if len(words) > 1 else words[0]
        key = pc.binary_join_element_wise(pa.scalar(self.lang.encode() + b"\n", pa.large_binary()), phrase, pa.scalar(b"", pa.large_binary()))
        columns = [key.cast(pa.string()), pa.array(cell.astype(np.int32)), pa.array(till.astype(np.int32)), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["key", "cell", "till", "n"])

    def counts(self, ready: np.ndarray, step: int, shards: int) -> Iterator[pa.RecordBatch]:
        """Active phrases of one to three words with their counts.

        Cells of pairs follow those of words; phrases of three words need none.
        """
        at, size, most = self.at, len(self.words), ready.shape[1]
        if not size:
            return
        cells = _cell(self.hashes, most)
        if step < shards:
            yield self.rows([np.arange(size)], cells, np.full(size, shards - 1), np.bincount(at, minlength=size))
        known = ready[0][cells][at].astype(np.int16)
        begin2 = np.where(self.follows, np.maximum(known[:-1], known[1:]) + 1, NEVER)
        active = np.flatnonzero((begin2 <= step) & (step < begin2 + shards))
        if len(active):
            unique, where, n = np.unique(at[active] * size + at[active + 1], return_index=True, return_counts=True)
            a, b = unique // size, unique % size
            pairs = _cell(_pair_hash(self.hashes[a], self.hashes[b]), most) + most
            yield self.rows([a, b], pairs, begin2[active][where] + shards - 1, n)
        pair_cells = _cell(_pair_hash(self.hashes[at[:-1]], self.hashes[at[1:]]), most)
        whole = np.where(begin2 < NEVER, np.maximum(ready[1][pair_cells], begin2), NEVER)
        begin3 = np.maximum(whole[:-1], whole[1:]) + 1
        active = np.flatnonzero((begin3 <= step) & (step < begin3 + shards))
        if len(active):
            pair, number = np.unique(at[active] * size + at[active + 1], return_inverse=True)
            unique, where, n = np.unique(number * size + at[active + 2], return_index=True, return_counts=True)
            ab = pair[unique // size]
            yield self.rows([ab // size, ab % size, unique % size], np.full(len(n), -1), begin3[active][where] + shards - 1, n)


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text with line ends for breaks and spaces for tabs, in parts that end where a piece does."""
    text = text.lower().translate(_BREAKS)
    first = 0
    while first < len(text):
        last = len(text)
        if last - first > SLICE:
            last = text.rfind(b"\n", first, first + SLICE)
            last = last if last > first else text.find(b"\n", first + SLICE)
            last = last if last > first else len(text)
        yield text[first:last]
        first = last


def _scan(ready, step: int, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def count(lang: str) -> Iterator[pa.RecordBatch]:
            data = b"\n".join([*held.pop(lang), b""])
            del sizes[lang]
            yield from _Slice(lang, data).counts(ready.value, step, shards)

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.large_binary()), strict=True):
                for part in _pieces(text.as_py()):
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                    if sizes[lang] >= SLICE:
                        yield from count(lang)
            if sum(sizes.values()) >= 2 * SLICE:
                for lang in list(held):
                    yield from count(lang)
        for lang in list(held):
            yield from count(lang)

    return scan


def _dealt(docs: DataFrame, text: str, lang: str, shards: int) -> str:
    """A folder with one partition of (lang, text) per shard."""
    folder = work_folder(docs.sparkSession, "shards")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    shard = F.pmod(F.monotonically_increasing_id(), F.lit(shards))
    rows.withColumn("shard", shard).write.partitionBy("shard").parquet(folder)
    return folder


def _parts(key: Column) -> list[Column]:
    phrase = F.substring_index(key, "\n", -1)
    return [phrase.alias("phrase"), F.left(key, F.char_length(key) - F.char_length(phrase) - 1).alias("lang")]


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(`lang, phrase, size, f`: phrases of one to three words with their exact counts from
    the threshold on; `lang, n`: words in all)."""
    spark = docs.sparkSession
    folder = _dealt(docs, text, lang, shards)
    shape = "lang string, text string"
    ready = np.full((2, 1 << CELL_BITS), NEVER, np.int8)
    running = spark.createDataFrame([], _COUNTED)
    kept, totals, step = [], None, 0
    while True:
        steps = np.unique(ready[0][ready[0] < NEVER]) + 1
        seen = np.unique(np.concatenate([steps, ready[1][ready[1] < NEVER]])) + 1
        if not (step < shards or any(a <= step < a + shards for a in [*steps.tolist(), *seen.tolist()])):
            break
        shared = spark.sparkContext.broadcast(ready)
        shard = spark.read.schema(f"{shape}, shard int").parquet(folder).where(F.col("shard") == step % shards).select("lang", "text")
        rows = shard.mapInArrow(lean(_scan(shared, step, shards)), _COUNTED).unionByName(running)
        merged = settle(rows.groupBy("key", "cell", "till").agg(F.sum("n").alias("n")))
        reached = merged.where((F.col("cell") >= 0) & (F.col("n") >= threshold)).select("cell").distinct()
        cells = reached.toArrow()["cell"].to_numpy()  # at most the fixed number of cells
        flat = ready.reshape(-1)
        flat[cells] = np.minimum(flat[cells], step)
        kept.append(settle(merged.where((F.col("till") == step) & (F.col("n") >= threshold)).select("key", "n")))
        if step == shards - 1:
            words = merged.where((F.col("till") == step) & F.col("cell").between(0, (1 << CELL_BITS) - 1))
            totals = settle(words.select(*_parts(F.col("key")), "n").groupBy("lang").agg(F.sum("n").alias("n")))
        running = merged.where(F.col("till") > step)
        shared.unpersist()
        step += 1
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    phrases = found.select(*_parts(F.col("key")), F.col("n").alias("f"))
    size = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1
    return settle(phrases.withColumn("size", size)), totals


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, top: int = TOP, kept_percent: int = KEPT_PERCENT, shards: int = SHARDS
) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: each language's best phrases of two or three words.

    a, l and r are the counts of the phrase and of the two parts of its weakest
    cut, score = floor(10^6 a^2 / (l r)) in exact decimals. A phrase inside a
    longer one with at least `kept_percent` of its count is left out. Order:
    score and count descending, then the phrase's bytes.
    """
    counts, totals = phrase_counts(docs, text, lang, threshold, shards)
    single = if_small(counts.where("size = 1").select("lang", F.col("phrase").alias("word"), F.col("f").alias("f_word")))
    words = F.split("phrase", " ")
    pairs = counts.where("size = 2").select("lang", "phrase", F.col("f").alias("a"), words[0].alias("first"), words[1].alias("word"))
    pairs = pairs.join(single, ["lang", "word"]).withColumnRenamed("f_word", "r").drop("word").withColumnRenamed("first", "word")
    pairs = pairs.join(single, ["lang", "word"]).withColumnRenamed("f_word", "l").select("lang", "phrase", "a", F.lit(1).alias("k"), "l", "r")

    def cut(k: int) -> Column:
        pair, word = (F.slice(words, 2, 2), words[0]) if k == 1 else (F.slice(words, 1, 2), words[2])
        return F.struct(F.lit(k).alias("k"), F.array_join(pair, " ").alias("pair"), word.alias("word"))

    cuts = counts.where("size = 3").select("lang", "phrase", F.col("f").alias("a"), F.explode(F.array(cut(1), cut(2))).alias("c")).select("lang", "phrase", "a", "c.*")
    inside = cuts.groupBy("lang", F.col("pair").alias("phrase")).agg(F.max("a").alias("longer"))
    two = counts.where("size = 2").select("lang", F.col("phrase").alias("pair"), F.col("f").alias("f_pair"))
    cuts = cuts.join(two, ["lang", "pair"]).join(single, ["lang", "word"])
    first = F.col("k") == 1
    triples = cuts.select(
        "lang", "phrase", "a", "k", F.when(first, F.col("f_word")).otherwise(F.col("f_pair")).alias("l"), F.when(first, F.col("f_pair")).otherwise(F.col("f_word")).alias("r")
    )
    free = pairs.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < kept_percent * F.col("a"))).drop("longer")
    exact = "DECIMAL(15, 0)"
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS {exact}) * CAST(a AS {exact})) div (CAST(l AS {exact}) * CAST(r AS {exact}))")
    scored = free.unionByName(triples).withColumn("score", score)
    weakest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("w")
    scored = scored.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "w.*")
    # only scores that can be among the best, and of these the best of each bucket: no language is one task
    scored = settle(scored.withColumn("band", F.floor(F.col("score") / BAND)))
    down = Window.partitionBy("lang").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bands = scored.groupBy("lang", "band").agg(F.count(F.lit(1)).alias("rows"))
    needed = bands.withColumn("above", F.coalesce(F.sum("rows").over(down), F.lit(0))).where(F.col("above") < top)
    scored = scored.join(needed.select("lang", "band"), ["lang", "band"]).drop("band")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
    best = scored.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
