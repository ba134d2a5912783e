"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks.

Target sizes become seats of BLOCK words, given to sources and then to each
source's shards by highest quotients. A shard puts its documents in a seeded
order and takes a run of blocks from a seeded block on, around the end.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.operators.ordering import settle

BLOCK = 32
SHARD_DOCS = 4096
WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"
#: Up to this many rows of sources or shards are broadcast, more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def sainte_lague(votes: Sequence[float], seats: int) -> np.ndarray:
    """Seats per party by the highest quotients vote / (seats + 1/2); ties go to the earlier party."""
    votes = np.asarray(votes, np.float64)
    out = np.zeros(len(votes), np.int64)
    if seats <= 0 or votes.sum() <= 0:
        return out
    # a party's j-th seat has quotient vote / (j - 1/2): bisect the divisor, then hand out the last seats
    low, high = 0.0, 2.0 * votes.max() + 1.0
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if np.floor(votes / middle + 0.5).sum() > seats:
            low = middle
        else:
            high = middle
    out = np.floor(votes / high + 0.5).astype(np.int64)
    rest = seats - int(out.sum())
    if rest > 0:
        nearest = np.argsort(-(votes / (out + 0.5)), kind="stable")[:rest]
        out[nearest] += 1
    return out


def targets(sizes: Sequence[int], weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Target of each source, sources in order; what exceeds `most` times a size is reshared by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    caps = [most * s for s in sizes]
    left, weight, out = share * sum(sizes), sum(w), [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: caps[i] / w[i]):
        out[i] = min(caps[i], left * w[i] / weight)
        left, weight = left - out[i], weight - w[i]
    return out


def _plan(docs: DataFrame, source: str) -> DataFrame:
    """(source, source_size, target, seats, shards): one row per source, which is all that reaches the driver."""
    rows = docs.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["size"]) for r in rows]
    goal = targets(sizes)
    seats = sainte_lague(goal, round(sum(goal) / BLOCK))
    table = [
        (r["source"], s, float(t), int(k), -(-r["n"] // SHARD_DOCS)) for r, s, t, k in zip(rows, sizes, goal, seats, strict=True)
    ]
    out = docs.sparkSession.createDataFrame(table, "source string, source_size bigint, target double, seats bigint, shards bigint")
    return F.broadcast(out) if len(table) <= BROADCAST_SOURCES else out


def _quotas(shards: DataFrame) -> DataFrame:
    """(source, shard, words, quota): each source's seats over its shards, two blocks a block at most."""

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard", kind="stable")
        quota = sainte_lague(pdf["words"].to_numpy(), int(pdf["seats"].iloc[0])) * BLOCK
        return pdf.assign(quota=np.minimum(quota, 2 * pdf["words"]))[["source", "shard", "words", "quota"]]

    return shards.groupBy("source").applyInPandas(share, "source string, shard bigint, words bigint, quota bigint")


#: Columns that `apportion` adds.
SIZE, SOURCE_SIZE, TARGET, COPIES, SPANS, TAKEN = ("_mix_" + n for n in ("size", "source_size", "target", "copies", "spans", "taken"))


def apportion(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 7) -> DataFrame:
    """`docs` with SIZE, SOURCE_SIZE, TARGET, COPIES, SPANS and TAKEN.

    A document is taken COPIES times whole, and its words in each range of
    SPANS (from, to) once more; TAKEN counts those words, repeats included.
    Null text has no words; a null source is a source of its own, the last.
    Repeated rows are documents of their own, next to each other in the order.
    With no words at all nothing is taken. Other columns are kept, whatever
    their names, save those that start with _mix_.
    """
    words_of = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint")
    rows = docs.withColumns({SIZE: words_of, "_mix_key": F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), "_mix_source": F.col(source)})
    slim = settle(rows.select(F.col("_mix_source").alias("source"), F.col(SIZE).alias("size"), F.col("_mix_key").alias("key")))
    plan = _plan(slim, "source")
    shard = lambda key, shards: F.pmod(F.xxhash64(key), F.col(shards))
    per_shard = slim.join(plan, slim["source"].eqNullSafe(plan["source"])).select(slim["source"], shard("key", "shards").alias("shard"), "size", "seats")
    quotas = settle(_quotas(per_shard.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.max("seats").alias("seats"))))
    quotas = quotas.select(*[F.col(c).alias("_mix_q_" + c) for c in ("source", "shard", "words", "quota")])
    if quotas.count() <= BROADCAST_SOURCES:
        quotas = F.broadcast(quotas)

    named = plan.select(
        F.col("source").alias("_mix_p_source"), F.col("source_size").alias(SOURCE_SIZE), F.col("target").alias(TARGET), F.col("shards").alias("_mix_shards")
    )
    named = F.broadcast(named) if named.count() <= BROADCAST_SOURCES else named
    rows = rows.join(named, F.col("_mix_source").eqNullSafe(F.col("_mix_p_source"))).withColumn("_mix_shard", shard("_mix_key", "_mix_shards"))
    order = Window.partitionBy("_mix_source", "_mix_shard").orderBy("_mix_key", doc_id).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_mix_hi", F.sum(SIZE).over(order))
    rows = rows.join(quotas, F.col("_mix_source").eqNullSafe(F.col("_mix_q_source")) & (F.col("_mix_shard") == F.col("_mix_q_shard")))

    words, quota, hi = F.col("_mix_q_words"), F.col("_mix_q_quota"), F.col("_mix_hi")
    blocks = F.greatest(F.ceil(words / BLOCK), F.lit(1))
    first = F.pmod(F.xxhash64(F.lit(seed), F.col("_mix_shard"), F.col("_mix_source")), blocks) * BLOCK
    rest = F.when(words > 0, quota % words).otherwise(0)
    lo = hi - F.col(SIZE)
    ahead = (first, F.least(first + rest, words))
    around = (F.lit(0), first + rest - words)
    span = lambda r: F.struct(
        (F.greatest(lo, r[0]) - lo).cast("bigint").alias("from"), (F.least(hi, r[1]) - lo).cast("bigint").alias("to")
    )
    spans = F.filter(F.array(span(around), span(ahead)), lambda s: s["to"] > s["from"])
    rows = rows.withColumns({COPIES: F.when(words > 0, F.floor(quota / words)).otherwise(0).cast("bigint"), SPANS: spans})
    taken = F.col(COPIES) * F.col(SIZE) + F.aggregate(SPANS, F.lit(0).cast("bigint"), lambda a, s: a + s["to"] - s["from"])
    return rows.select(*docs.columns, SIZE, SOURCE_SIZE, TARGET, COPIES, SPANS, taken.alias(TAKEN))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    out = apportion(docs.select("doc_id", "text", "source"))
    return out.select(
        "doc_id", F.col(SIZE).alias("size"), F.col(SOURCE_SIZE).alias("source_size"), F.col(TARGET).alias("target"), F.col(TAKEN).alias("taken")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of `docs`: one row per copy or cut; a cut
    text runs from its first to its last word. n_chars, where present, is set anew."""
    columns = docs.columns
    at = columns.index("text")
    # a copy is the range of all words
    all_words = F.struct(F.lit(0).cast("bigint").alias("from"), F.col(SIZE).alias("to"))
    pieces = F.concat(F.array_repeat(all_words, F.col(COPIES).cast("int")), F.col(SPANS))
    cut = apportion(docs).where(F.size(pieces) > 0).withColumn("_mix_piece", F.explode(pieces))

    def slices(batches):
        for batch in batches:
            size, first, last = (batch.column(i).to_pylist() for i in (-3, -2, -1))
            out = [
                text.as_py() if b - a == n else _words(text.as_py() or "", a, b)
                for text, n, a, b in zip(batch.column(at), size, first, last, strict=True)
            ]
            arrays = [batch.column(i) if i != at else pa.array(out, pa.string()) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    out = cut.select(*columns, SIZE, "_mix_piece.from", "_mix_piece.to").mapInArrow(slices, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def _words(text: str, first: int, last: int) -> str:
    start = stop = 0
    for i, m in enumerate(re.finditer(WORD, text)):
        if i == first:
            start = m.start()
        if i == last - 1:
            stop = m.end()
            break
    return text[start:stop]
