"""Exact duplicates by composable polynomial fingerprints, then a chunkwise comparison.

A text is hashed in chunks. Over a prime modulus the hash of a || b is
hash(a) * base**len(b) + hash(b), so chunk hashes combine in any grouping. Rows
with equal fingerprints are then compared with their group's leader chunk by
chunk; no text is ever held beside another as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from ebbtide.llm.common import if_small, lean
from ebbtide.operators.ordering import settle

PRIME = (1 << 31) - 1
BASES = (911_382_323, 972_663_749, 1_357_913_579)
CHUNK = 1 << 16
KEY = ("f1", "f2", "bytes")
#: A group's leader is copied once for so many rows of the group, up to a limit.
GROUP_ROWS, MOST_COPIES = 2000, 256

Print = tuple[tuple[int, ...], int]
EMPTY: Print = ((0,) * len(BASES), 0)


def _power_table(base: int) -> np.ndarray:
    """base**(CHUNK - 1) .. base**0 modulo PRIME."""
    out = np.ones(1, np.uint64)
    while len(out) < CHUNK:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
    return out[:CHUNK][::-1].copy()


_TABLES = [_power_table(b) for b in BASES]


def chunks(data: bytes, size: int = CHUNK) -> Iterator[bytes]:
    return (data[i : i + size] for i in range(0, len(data), size))


def chunk_print(data: bytes) -> Print:
    """Fingerprint of at most CHUNK bytes; byte values count from 1, so that zeros matter."""
    values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(int(values @ t[CHUNK - len(values) :]) % PRIME for t in _TABLES), len(values)


def combine(a: Print, b: Print) -> Print:
    """Fingerprint of the concatenation."""
    return tuple((x * pow(base, b[1], PRIME) + y) % PRIME for x, y, base in zip(a[0], b[0], BASES, strict=True)), a[1] + b[1]


def text_print(prints: Iterable[Print]) -> Print:
    return reduce(combine, prints, EMPTY)


def _normal(text: str | None) -> bytes:
    return (text or "").encode().lower()  # of bytes, this lowers A-Z only


def _fingerprints(docs: DataFrame) -> DataFrame:
    def rows(batches):
        for batch in batches:
            prints, digests = [], []
            for text in batch["body"]:
                data = _normal(text.as_py())
                prints.append(text_print(map(chunk_print, chunks(data))))
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc"],
                    batch["print"],
                    pa.array([p[0][0] << 31 | p[0][1] for p in prints], pa.int64()),
                    pa.array([p[0][2] for p in prints], pa.int64()),
                    pa.array([p[1] for p in prints], pa.int64()),
                    pa.array(digests, pa.string()),
                ],
                ["doc", "print", "f1", "f2", "bytes", "digest"],
            )

    return docs.mapInArrow(lean(rows), "doc bigint, print bigint, f1 bigint, f2 bigint, bytes bigint, digest string")


def _cut(texts: DataFrame) -> DataFrame:
    """The chunks of texts, each with the texts' other columns; texts whose
    fingerprint is not the wanted one are other rows with the same id."""
    others = [c for c in texts.columns if c not in ("body", *KEY)]

    def rows(batches):
        for batch in batches:
            wanted = zip(*(batch[c].to_pylist() for c in KEY), strict=True)
            for i, (text, key) in enumerate(zip(batch["body"], wanted, strict=True)):
                data = _normal(text.as_py())
                lanes, length = text_print(map(chunk_print, chunks(data)))
                if (lanes[0] << 31 | lanes[1], lanes[2], length) != key:
                    continue
                parts = list(chunks(data)) or [b""]
                same = pa.array([i] * len(parts))
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].take(same) for c in others), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())],
                    [*others, "chunk_no", "chunk"],
                )

    return texts.mapInArrow(lean(rows), StructType([*(texts.schema[c] for c in others), StructField("chunk_no", IntegerType()), StructField("chunk", BinaryType())]))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after A-Z are lower-cased; null counts as
    empty, and empty texts equal one another. Of equal texts the row with the
    largest doc_id stays, null ids last; of rows repeated with that id one is
    marked kept. A row whose fingerprint equals its leader's by chance alone is
    grouped by its SHA-256 instead. Rows without an id, or with one id, are told
    apart by a hash of their text; where that is equal too, they are compared
    as one. Other columns are ignored.
    """
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("body"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("print"))
    rows = settle(_fingerprints(docs).withColumn("row", F.monotonically_increasing_id()))
    groups = rows.groupBy(*KEY).agg(F.max(F.struct("doc", "row", "print")).alias("top"), F.count("*").alias("size"))
    # the leader of a large group is copied, so that its group is compared in several tasks
    copies = F.least(F.lit(MOST_COPIES), F.floor(F.col("size") / GROUP_ROWS) + 1).cast("int")
    leader = (F.col("top.doc").alias("lead_doc"), F.col("top.print").alias("lead_print"))
    several = groups.where("size > 1").select(*KEY, *leader, copies.alias("copies"))

    who, led = ["doc", "print"], ["lead_doc", "lead_print", "copies"]
    suspects = rows.select(*who, *KEY).join(several, list(KEY))
    ids = if_small(suspects.select(F.col("doc").alias("wanted"), F.col("print").alias("wanted_print"), *led, *KEY).distinct())
    on = F.col("doc").eqNullSafe(F.col("wanted")) & (F.col("print") == F.col("wanted_print"))
    texts = docs.join(ids, on).select("body", *who, *led, *KEY)
    pieces = settle(_cut(texts))
    is_leader = F.col("doc").eqNullSafe(F.col("lead_doc")) & (F.col("print") == F.col("lead_print"))
    lead = pieces.where(is_leader).select(*led, "chunk_no", F.col("chunk").alias("lead_chunk")).dropDuplicates([*led, "chunk_no"])
    lead = lead.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    others = pieces.where(~is_leader).withColumn("copy", F.pmod(F.xxhash64(*who), F.col("copies")).cast("int")).drop("copies")
    a, b = others.alias("a"), lead.alias("b")
    meets = (
        F.col("a.lead_doc").eqNullSafe(F.col("b.lead_doc"))
        & (F.col("a.lead_print") == F.col("b.lead_print"))
        & (F.col("a.copy") == F.col("b.copy"))
        & (F.col("a.chunk_no") == F.col("b.chunk_no"))
    )
    same = a.join(b, meets, "left")
    differs = same.where(~F.col("chunk").eqNullSafe(F.col("lead_chunk"))).select(*(F.col(f"a.{c}").alias(c) for c in who)).distinct()

    if differs.limit(1).count():
        d = differs.select(F.col("doc").alias("odd"), F.col("print").alias("odd_print"))
        variant = F.when(F.col("odd_print").isNotNull(), F.col("digest"))
        marked = rows.join(d, F.col("doc").eqNullSafe(F.col("odd")) & (F.col("print") == F.col("odd_print")), "left").withColumn("variant", variant)
        sorted_out = settle(marked.drop("odd", "odd_print"))
    else:
        sorted_out = rows.withColumn("variant", F.lit(None).cast("string"))
    exact = sorted_out.groupBy(*KEY, "variant").agg(F.max(F.struct("doc", "row")).alias("top"), F.count("*").alias("group_size"))
    joined = sorted_out.withColumn("v", F.coalesce("variant", F.lit(""))).join(
        exact.withColumn("v", F.coalesce("variant", F.lit(""))).drop("variant"), [*KEY, "v"]
    )
    return joined.select(
        F.col("doc").alias("doc_id"),
        F.col("top.doc").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("top.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def fingerprint_pieces(pieces: DataFrame, doc_id: str, piece_no: str, text: str) -> DataFrame:
    """(doc_id, f1, f2, bytes) of documents stored as several rows: their pieces
    are hashed in parallel, each hash is shifted by the bytes after it, and the
    sums are the fingerprints of the whole documents."""

    def rows(batches):
        for batch in batches:
            prints = [text_print(map(chunk_print, chunks(_normal(t.as_py())))) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([p[0][i] for p in prints], pa.int64()) for i in range(3)), pa.array([p[1] for p in prints], pa.int64())],
                ["doc", "piece", "h0", "h1", "h2", "bytes"],
            )

    hashed = pieces.select(F.col(doc_id).cast("bigint"), F.col(piece_no).cast("bigint"), text).mapInArrow(
        rows, "doc bigint, piece bigint, h0 bigint, h1 bigint, h2 bigint, bytes bigint"
    )
    after = Window.partitionBy("doc").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    shifted = hashed.withColumn("tail", F.coalesce(F.sum("bytes").over(after), F.lit(0)))

    def shift(batches):
        for batch in batches:
            tail = batch.column(5).to_pylist()
            lanes = [
                pa.array([h * pow(base, t, PRIME) % PRIME for h, t in zip(batch.column(1 + i).to_pylist(), tail, strict=True)], pa.int64())
                for i, base in enumerate(BASES)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lanes, batch.column(4)], ["doc", "h0", "h1", "h2", "bytes"])

    moved = shifted.select("doc", "h0", "h1", "h2", "bytes", "tail").mapInArrow(shift, "doc bigint, h0 bigint, h1 bigint, h2 bigint, bytes bigint")
    total = moved.groupBy("doc").agg(*[(F.sum(f"h{i}") % PRIME).alias(f"h{i}") for i in range(3)], F.sum("bytes").alias("bytes"))
    return total.select(F.col("doc").alias("doc_id"), (F.shiftleft("h0", 31).bitwiseOR(F.col("h1"))).alias("f1"), F.col("h2").alias("f2"), "bytes")
