"""Similarity join on word n-grams by vertical partitioning of the n-gram order.

All n-grams stand in one global order, rare ones first, cut into fragments of
equal mass. A pair can only be similar if the documents share an n-gram early
in the order; such candidates get one partial overlap count per fragment, and
the sum per pair decides. Documents with equal sets are one node of the join.

Pairs inside a dense group are not enumerated. Each node is first compared with
the most typical node among its candidates, and the nodes so linked form a
block. Only pairs between different blocks that pass the length and position
bounds are then compared, which loses no component.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import fresh, if_small, lean
from ebbtide.llm.shingles import mix, shingle_hashes, text_slices, word_hashes
from ebbtide.operators.ordering import settle

#: n-gram counts are kept in 2**SKETCH_BITS cells; the size is fixed, whatever the input.
SKETCH_BITS = 22
SKETCH_PARTS = 64
FRAGMENTS = 4


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, data, offsets in text_slices(column):
        words, bounds = word_hashes(data, offsets)
        yield first, [np.unique(h) for h in shingle_hashes(words, bounds, size)]


def _needed(percent: int, n: int) -> int:
    """Overlap that a set of n n-grams needs with any partner."""
    return -(-percent * n // 100)


def gram_counts(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Documents per cell of the n-gram hash range, over the whole table.

    Every task adds its documents to one array of fixed size, and the arrays
    are added by cell range. Two n-grams in one cell only share their place in
    the order, which any total order serves.
    """

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for _, sets in _sets(batch.column(0), size):
                if sets:
                    np.add.at(total, _cell(np.concatenate(sets)), 1)
        for part, cells in enumerate(np.split(total, SKETCH_PARTS)):
            if cells.any():
                packed = zlib.compress(cells.tobytes(), 1)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "cells": pa.array([packed], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(cells.as_py()), np.uint32).astype(np.uint64)
        for part, total in sums.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, cells binary"
    rows = docs.select(text).mapInArrow(lean(count), schema).repartition(SKETCH_PARTS, "part").mapInArrow(lean(add), schema).collect()
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint64)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["cells"], np.uint64)
    return out.reshape(-1)


class GramOrder:
    """The global order: by the cell's count in 16-bit steps, then by hash."""

    def __init__(self, counts: np.ndarray):
        # exact up to 4096, about 0.1 % coarse above
        big = np.maximum(counts, 1).astype(np.float64)
        level = np.where(counts < 4096, counts, 4096 + (np.log2(big / 4096) * 1000)).clip(0, 65535)
        self.level = level.astype(np.uint16)
        mass = np.bincount(self.level, weights=counts.astype(np.float64), minlength=65536)
        mass /= max(mass.sum(), 1.0)
        self.width, self.below = mass, np.cumsum(mass) - mass

    def sort(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grams (ascending by hash) in the global order, and their levels."""
        level = self.level[_cell(grams)]
        by = np.argsort(level, kind="stable")
        return grams[by], level[by]

    def fragment(self, grams: np.ndarray) -> np.ndarray:
        level = self.level[_cell(grams)]
        share = self.below[level] + self.width[level] * (grams.astype(np.float64) / 2.0**64)
        return np.minimum((share * FRAGMENTS).astype(np.int64), FRAGMENTS - 1)


def _key(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    salted = mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return int(grams.sum(dtype=np.uint64).view(np.int64)), int(salted.sum(dtype=np.uint64).view(np.int64))


def _prefixes(docs: DataFrame, text: str, order, size: int, percent: int) -> DataFrame:
    """Per row: n, the set's key, how common its n-grams are, and its first n-grams in the order."""

    def rows(batches):
        for batch in batches:
            for first, sets in _sets(batch.column(1), size):
                keys = [_key(s) for s in sets]
                prefix, typical = [], []
                for s in sets:
                    grams, level = order.value.sort(s)
                    prefix.append(grams[: len(s) - _needed(percent, len(s)) + 1] if len(s) else grams)
                    typical.append(float(np.log2(level + 1.0).mean()) if len(s) else 0.0)
                ends = np.cumsum([0, *map(len, prefix)])
                values = np.concatenate(prefix).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sets)),
                        batch.column(2).slice(first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        pa.array(typical, pa.float32()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)),
                    ],
                    ["doc", "print", "n", "k1", "k2", "typical", "prefix"],
                )

    return docs.select("doc", text, "print").mapInArrow(
        lean(rows), "doc bigint, print bigint, n int, k1 bigint, k2 bigint, typical float, prefix array<bigint>"
    )


def _segments(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, order, size: int, repeats: bool) -> DataFrame:
    """(node, fragment, grams): the sets of the nodes in `pairs` cut along the global order."""

    def rows(batches):
        for batch in batches:
            node, k1, k2 = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for first, sets in _sets(batch.column(0), size):
                out_node, out_part, grams = [], [], []
                for i, s in enumerate(sets, first):
                    if _key(s) != (k1[i], k2[i]):
                        continue  # another row with the same id
                    part = order.value.fragment(s)
                    for p in np.unique(part).tolist():
                        out_node.append(node[i])
                        out_part.append(p)
                        grams.append(s[part == p])
                if grams:
                    ends = np.cumsum([0, *map(len, grams)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(out_node, pa.int64()),
                            pa.array(out_part, pa.int32()),
                            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(grams).view(np.int64))),
                        ],
                        ["node", "fragment", "grams"],
                    )

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = if_small(nodes.join(ends, "node").select(F.col("first.doc").alias("wanted"), F.col("first.print").alias("wanted_print"), "node", "k1", "k2"))
    # ids may be null or repeated; id and text together are not met by other rows
    texts = docs.join(wanted, F.col("doc").eqNullSafe(F.col("wanted")) & (F.col("print") == F.col("wanted_print")))
    cut = texts.select("body", "node", "k1", "k2").mapInArrow(lean(rows), "node bigint, fragment int, grams array<bigint>")
    return settle(cut.dropDuplicates(["node", "fragment"]) if repeats else cut)


def _links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, n_a, n_b) those that are similar: one count per fragment, summed."""
    pairs = if_small(pairs)
    sides = [
        segments.join(pairs, F.col("node") == F.col(end)).select(*pairs.columns, "fragment", F.col("grams").alias(f"grams_{end}")) for end in ("a", "b")
    ]
    both = sides[0].join(sides[1].drop("n_a", "n_b"), ["a", "b", "fragment"])
    partial = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("common"))
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
    return total.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def _blocks(links: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, block) along links (b, a) from each node to a more typical one, by
    pointer doubling. Long chains may end in several blocks; that costs
    comparisons, not results."""
    up = settle(links.select(F.col("b").alias("node"), F.col("a").alias("block")))
    for _ in range(rounds):
        on = up.select(F.col("node").alias("block"), F.col("block").alias("next"))
        up = settle(up.join(on, "block", "left").select("node", F.coalesce("next", "block").alias("block")))
    return up


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (a, b) reaches.

    Alternating large and small stars; every round is one table in the shared
    folder, and only a count and a checksum reach the driver.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        e = e.union(e.select("b", "a")) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = e.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        joined = e.join(low, "a")
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")) if large else joined.select(
            F.explode(F.array(F.struct("b", F.col("low")), F.struct(F.col("a").alias("b"), "low"))).alias("e")
        ).select(F.col("e.b").alias("a"), F.col("e.low").alias("b"))
        return out.where("a != b").distinct()

    state, edges = None, edges.where("a != b")
    while True:
        edges = settle(star(star(edges, True), False))
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = seen


def _bounds(percent: int) -> Column:
    """Can a pair (o, j) with this shared n-gram still reach the threshold?

    Before the n-gram they share at most the smaller number of their earlier
    shared n-grams, after it at most what is left of the shorter rest. The
    smaller set must show the n-gram within its own, shorter prefix.
    """
    o_small = (F.col("o.n") < F.col("j.n")) | ((F.col("o.n") == F.col("j.n")) & (F.col("o.node") < F.col("j.node")))
    small = lambda c: F.when(o_small, F.col(f"o.{c}")).otherwise(F.col(f"j.{c}"))
    total = F.col("o.n") + F.col("j.n")
    most = F.least("o.before", "j.before") + 1 + F.least(F.expr("o.n - o.pos - 1"), F.expr("j.n - j.pos - 1"))
    return (
        (100 * F.least("o.n", "j.n") >= percent * F.greatest("o.n", "j.n"))
        & ((100 + percent) * most >= percent * total)
        & (small("pos") < small("n") - F.ceil(2 * percent * small("n") / (100 + percent)) + 1)
    )


def _print(text: str) -> Column:
    """A hash of the text, to tell rows with one id (or none) apart."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def similarity_components(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their sets
    of `size`-word shingles. A text of fewer words is one shingle; null, empty
    and blank texts have no shingle, link with nothing and are their own
    component. component_id is the smallest doc_id of the component (null only
    if it holds null ids alone). Repeated rows are kept; rows with one id and
    different texts are compared on their own. Other columns are ignored.
    """
    found = _members(docs, text, doc_id, size, percent)
    return found.select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("first.doc")).alias("component_id"),
    )


def _members(docs: DataFrame, text: str, doc_id: str, size: int, percent: int) -> DataFrame:
    """(doc, print, n, first) of every row: `first` is the row (id, print) with
    the smallest id of its component, one with an id if there is any."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("body"), _print(text).alias("print"))
    order = spark.sparkContext.broadcast(GramOrder(gram_counts(docs, "body", size)))
    rows = settle(_prefixes(docs, "body", order, size, percent))
    repeats = bool(rows.groupBy("doc").count().where("count > 1").limit(1).count())

    classes = rows.groupBy("k1", "k2", "n").agg(
        F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "print")).alias("first"), F.first("typical").alias("typical"), F.first("prefix").alias("prefix")
    )
    nodes = settle(classes.withColumn("node", F.monotonically_increasing_id()))
    early = nodes.select("node", F.posexplode("prefix").alias("pos", "gram"))
    several = early.groupBy("gram").agg(F.count("*").alias("docs")).where("docs > 1").select("gram")
    here = Window.partitionBy("node").orderBy("pos")
    counted = early.join(several, "gram").join(nodes.select("node", "n", "typical"), "node")
    shared = settle(counted.withColumn("before", F.row_number().over(here) - 1))

    # each n-gram's most typical node; two documents that share one early n-gram
    # by chance mostly fail the bounds at once and are not seen again
    hubs = shared.groupBy("gram").agg(F.max(F.struct("typical", "node", "n", "pos", "before")).alias("hub"), F.count("*").alias("docs"))
    o, j = shared.alias("o"), hubs.select("gram", "docs", "hub.*").alias("j")
    can = (F.col("o.node") != F.col("j.node")) & _bounds(percent)
    hub = F.struct("j.typical", "j.node", "j.n").alias("hub")
    met = settle(o.join(j, F.col("o.gram") == F.col("j.gram")).where(can | (F.col("docs") > 2)).select("o.*", "docs", hub, can.alias("can")))

    # each node against the most typical node among its candidates
    reach = met.where("can").select(F.col("node").alias("b"), F.col("n").alias("n_b"), "hub", "docs")
    first = reach.groupBy("b", "n_b").agg(F.max("hub").alias("hub"))
    star = settle(first.select(F.col("hub.node").alias("a"), "b", F.col("hub.n").alias("n_a"), "n_b"))
    near = settle(_links(star, _segments(docs, nodes, star, order, size, repeats), percent))

    # then what is left between blocks; the largest block of an n-gram is not paired with itself
    block = settle(_blocks(near))
    blocked = settle(met.where("docs > 2").select("gram", "node", "n", "pos", "before").join(block, "node", "left").withColumn("block", F.coalesce("block", "node")))
    weights = blocked.groupBy("gram", "block").agg(F.count("*").alias("w"))
    largest = weights.groupBy("gram").agg(F.max(F.struct("w", "block")).alias("most"), F.count("*").alias("blocks"))
    mixed = largest.where("blocks > 1").select("gram", F.col("most.block").alias("largest"))
    sides = settle(blocked.join(mixed, "gram").withColumn("main", F.col("block") == F.col("largest")))
    o, j = sides.where("not main").alias("o"), sides.alias("j")
    between = (
        (F.col("o.gram") == F.col("j.gram"))
        & (F.col("o.block") != F.col("j.block"))
        & (F.col("j.main") | (F.col("o.node") < F.col("j.node")))
        & _bounds(percent)
    )
    rest = o.join(j, between).select(
        F.col("o.node").alias("a"), F.col("j.node").alias("b"), F.col("o.n").alias("n_a"), F.col("j.n").alias("n_b")
    )
    lone = reach.where("docs = 2").select(F.col("hub.node").alias("a"), "b", F.col("hub.n").alias("n_a"), "n_b")
    # one name per pair, and not those that were compared already
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = rest.union(lone).select(*pair, F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
                                   F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b")).distinct()
    rest = settle(rest.join(star.select(*pair), ["a", "b"], "left_anti"))
    links = near.union(_links(rest, _segments(docs, nodes, rest, order, size, repeats), percent))

    member = components(settle(links))
    named = nodes.select("node", "k1", "k2", "n", "first").join(member, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("first").alias("lowest"))
    labels = settle(named.join(lowest, "component").select("k1", "k2", "n", F.col("lowest").alias("first")))
    order.unpersist()
    return rows.select("doc", "print", "n", "k1", "k2").join(labels, ["k1", "k2", "n"]).select("doc", "print", "n", "first")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with their columns, that stand for their component:
    of the one with the smallest id. Rows are told apart by id and text, so
    another text with the id of a row that goes stays. Rows without an id or
    without a shingle stay; of rows repeated with one id and text, one stays."""
    found = _members(docs, text, doc_id, size, percent)
    other = ~F.col("doc").eqNullSafe(F.col("first.doc")) | (F.col("print") != F.col("first.print"))
    id_name, print_name = fresh("_gone_id", docs.columns), fresh("_gone_print", docs.columns)
    gone = found.where(F.col("doc").isNotNull() & (F.col("n") > 0) & other).select(F.col("doc").alias(id_name), F.col("print").alias(print_name))
    gone = if_small(gone.distinct())
    kept = docs.join(gone, (F.col(doc_id).cast("bigint") == F.col(id_name)) & (_print(text) == F.col(print_name)), "left_anti")
    if not _repeats(found):
        return kept
    return kept.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id, text]).unionByName(kept.where(F.col(doc_id).isNull()))


def _repeats(found: DataFrame) -> bool:
    """Are there rows with one id? Only a truth value reaches the driver."""
    return bool(found.where("doc is not null").groupBy("doc").count().where("count > 1").limit(1).count())
