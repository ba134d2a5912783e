"""URL filter: host and path rules first, a character language model for the rest.

Two variable-order Markov models over bytes are counted from the URLs that the
rules accept and reject. A byte's probability is interpolated from the longest
context down to a uniform one; the difference of the log-likelihoods over the
length, against a threshold calibrated on URLs kept out of the counts, judges
what no rule fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.shingles import mix
from ebbtide.operators.ordering import settle

Rule = tuple[str, str, str]  # verdict, host, path

ORDERS = 5
#: Counts of contexts and of context-byte pairs that are shipped to the workers at most, the most frequent ones; rarer ones are joined.
SHIPPED = 1_000_000
#: Cells per class where counts are given as arrays (`likelihood_gap`).
CELL_BITS = 20
STRENGTH = 2.0
#: Scores are counted in steps of BIN nats per byte when the threshold is chosen.
BIN, EDGE = 0.01, 10.0


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _first_fit(rules: Sequence[Rule], host: Column, path: Column, value) -> Column:
    """`value(rule)` of the longest rule that fits, null where none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule[1]) | F.endswith(host, F.lit("." + rule[1]))) & F.startswith(path, F.lit(rule[2]))
        out = F.when(fits, value(rule)).otherwise(out)
    return out


def _keys(url: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the contexts and of context and byte, (orders, bytes)."""
    data = np.frombuffer(url.encode(), np.uint8).astype(np.uint64)
    context = np.zeros(len(data), np.uint64)
    contexts, pairs = [], []
    for order in range(ORDERS + 1):
        seed = np.uint64(order + 1) << np.uint64(40)
        contexts.append(mix(context + seed))
        pairs.append(mix(mix(context + seed) + data + np.uint64(1)))
        # the context one byte longer; before the start stands a byte of its own
        older = np.concatenate([np.full(order + 1, 256, np.uint64), data])[: len(data)]
        context = mix(context * np.uint64(31) + older + np.uint64(1))
    return np.array(contexts), np.array(pairs)


def _slots(url: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the contexts and of context and byte, (orders, bytes)."""
    shift = np.uint64(64 - CELL_BITS)
    return tuple((keys >> shift).astype(np.int64) for keys in _keys(url))


def count(urls: DataFrame) -> DataFrame:
    """(key, n0, n1): how often each context and each context with its byte stands in (url, label); label 1 is accepted."""

    def rows(batches):
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), np.int64)
            keys = [np.concatenate(_keys(url)).ravel() for url in batch.column(0).to_pylist()]
            if not keys:
                continue
            of = np.repeat(labels, [len(k) for k in keys])
            found, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = [np.bincount(at[of == label], minlength=len(found)) for label in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *(pa.array(x, pa.int64()) for x in n)], ["key", "n0", "n1"])

    parts = urls.mapInArrow(rows, "key bigint, n0 bigint, n1 bigint")
    return settle(parts.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


class Counts(NamedTuple):
    """Exact counts: the most frequent keys as a broadcast (sorted keys, (2, keys) counts), the others as a table, None where there are none."""

    shipped: object
    others: DataFrame | None


def split_counts(table: DataFrame) -> Counts:
    """The table of `count`, so divided that SHIPPED keys at most reach the driver."""
    size, total = table.agg(F.count("*"), F.sum(F.col("n0") + F.col("n1"))).first()
    frequent, others = table, None
    if size > SHIPPED:
        # no more than SHIPPED keys can each have this share of the total
        often = (F.col("n0") + F.col("n1")) * SHIPPED >= total
        frequent, others = table.where(often), table.where(~often)
    found = frequent.toArrow()
    keys = found["key"].to_numpy()
    order = np.argsort(keys)
    values = np.array([found[n].to_numpy()[order] for n in ("n0", "n1")])
    return Counts(table.sparkSession.sparkContext.broadcast((keys[order], values)), others)


def _look_up(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted `known`, whether each key is there)."""
    if not len(known):
        return np.zeros(keys.shape, np.int64), np.zeros(keys.shape, bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def _gap(contexts: np.ndarray, pairs: np.ndarray) -> float:
    """Nats per byte by which the accepting model explains a url better; counts are (2, orders, bytes)."""
    gap = []
    for label in (0, 1):
        p = np.full(contexts.shape[2], 1.0 / 256)
        for order in range(ORDERS + 1):
            p = (pairs[label, order] + STRENGTH * p) / (contexts[label, order] + STRENGTH)
        gap.append(float(np.log(np.minimum(p, 1.0)).sum()))
    return (gap[1] - gap[0]) / contexts.shape[2]


def likelihood_gap(counts: np.ndarray, url: str | None) -> float:
    """`_gap` of a url with the counts (2, cells) of `_slots`; 0 for none."""
    if not url:
        return 0.0
    contexts, pairs = _slots(url)
    return _gap(counts[:, contexts], counts[:, pairs])


def _gaps(rows: DataFrame, counts: Counts) -> DataFrame:
    """`rows` (url last) with _gap."""
    names = [*rows.columns, "_gap"]
    kinds = rows.withColumn("_gap", F.lit(0.0)).schema
    shipped = counts.shipped

    def unknown(batches):
        known = shipped.value[0]
        for batch in batches:
            for url in batch.column(0).to_pylist():
                keys = np.unique(np.concatenate(_keys(url)).view(np.int64))
                keys = keys[~_look_up(keys, known)[1]]
                yield pa.RecordBatch.from_arrays([pa.array([url] * len(keys), pa.string()), pa.array(keys)], ["url", "key"])

    def score(batches):
        known, values = shipped.value
        for batch in batches:
            width = len(names) - 1
            urls = batch.column(width - 1).to_pylist()
            extra = batch.column(width).to_pylist() if batch.num_columns > width else [None] * len(urls)
            gaps = []
            for url, more in zip(urls, extra, strict=True):
                if not url:
                    gaps.append(0.0)
                    continue
                keys = np.array(_keys(url)).view(np.int64)
                at, there = _look_up(keys, known)
                seen = np.where(there, values[:, at], 0) if len(known) else np.zeros((2, *keys.shape), np.int64)
                if more:
                    own = np.array(sorted((m["key"], m["n0"], m["n1"]) for m in more), np.int64)
                    at, there = _look_up(keys, own[:, 0])
                    seen = np.where(there, own[:, 1:].T[:, at], seen)
                gaps.append(_gap(seen[:, 0], seen[:, 1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(gaps, pa.float64())], names)

    if counts.others is not None:
        urls = rows.select("url").where("url != ''").distinct()
        found = urls.mapInArrow(unknown, "url string, key bigint").join(counts.others, "key")
        found = found.groupBy("url").agg(F.collect_list(F.struct("key", "n0", "n1")).alias("_more"))
        rows = rows.join(found, "url", "left").select(*names[:-1], "_more")
    return rows.mapInArrow(score, kinds)


def threshold(kept_out: DataFrame) -> float:
    """The gap that best separates (label, _gap) by balanced accuracy; the one nearest 0 of equals."""
    step = F.round(F.greatest(F.least(F.col("_gap"), F.lit(EDGE)), F.lit(-EDGE)) / BIN).cast("int")
    rows = kept_out.groupBy(step.alias("step"), "label").count().collect()
    if len({r["label"] for r in rows}) < 2:
        return 0.0
    size = int(2 * EDGE / BIN) + 1
    seen = np.zeros((2, size + 1))
    for r in rows:
        seen[r["label"], r["step"] + size // 2] += r["count"]
    rejected = np.concatenate([[0.0], np.cumsum(seen[0])[:-1]]) / seen[0].sum()
    accepted = 1 - np.concatenate([[0.0], np.cumsum(seen[1])[:-1]]) / seen[1].sum()
    good = rejected + accepted
    best = np.flatnonzero(good >= good.max() - 1e-12)
    at = best[np.argmin(np.abs(best - size // 2))]
    return (float(at) - size // 2 - 0.5) * BIN


def judge_urls(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict and gap for every row of (page_id, url).

    A rule (verdict, host, path) fits its host and its subdomains where the
    path starts with the rule's; the longest one decides. Other URLs are
    accepted when their gap reaches the threshold; a null or empty url has gap
    0, and so has every url when the rules label none. Repeats are kept.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path}).withColumns(
        {
            "rule": _first_fit(rules, F.col("host"), F.col("path"), lambda r: F.lit(r[1] + r[2])),
            "ruled": _first_fit(rules, F.col("host"), F.col("path"), lambda r: F.lit(r[0])),
        }
    )
    labelled = rows.where("ruled is not null and url != ''").select((F.col("ruled") == "allow").cast("int").alias("label"), "url")
    keep_out = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    counts = split_counts(count(labelled.where(~keep_out).select("url", "label")))
    cut = threshold(_gaps(labelled.where(keep_out), counts))
    judged = _gaps(rows.select("page_id", "host", "path", "rule", "ruled", "url"), counts)
    verdict = F.coalesce("ruled", F.when(F.col("_gap") >= cut, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("_gap").alias("gap"))
