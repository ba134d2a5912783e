"""Token ids of a corpus as Huffman-coded blocks, and their reader.

Format: a folder with two Parquet tables. `codebook` (id, length) fixes a
canonical Huffman code, no code longer than MAX_BITS. `blocks` holds runs of
documents in ascending order of id:

    shard, first_seq, skip   place of the block in the file order
    first_id                 ids of all documents before the block's first id
    docs, counts, whole      documents in the block, their ids in it, their ids in all
    marks                    bit offset of every STEP-th id
    payload                  the code words, high bit first

A block is decoded on its own; its marks let many runs be decoded side by side.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import kept, lean
from ebbtide.llm.shingles import text_slices
from ebbtide.operators.ordering import settle
from ebbtide.session import work_folder

MAX_BITS = 20
BLOCK_IDS = 1 << 17
STEP = 64
END_ID = 0
#: Pieces that either generation of a worker's memory holds, and bytes of text that are encoded together.
CACHE_PIECES = 500_000
SLICE_BYTES = 4 << 20


class PieceCache:
    """Ids of pieces of text that start at a space, as bytes.

    The tokenizer's pattern breaks before a space that stands after or before
    something else than white space, so pieces can be encoded on their own;
    most pieces of a corpus are repeats. Of a new piece made of letters and
    marks each part is one pre-token, which goes straight to the tokenizer's
    model; other pieces go through the whole tokenizer, as do whole texts that
    hold the string of an added token.

    Pieces are remembered in two generations of bounded size: a piece that was
    not met while the younger one filled up is forgotten.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.kind = "H" if tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        # the printable stand-ins of the byte alphabet
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
        hidden = [c for c in range(256) if c not in shown]
        self.space = chr(256 + hidden.index(ord(" ")))
        self.stand_in = {**{c: c for c in shown}, **{c: 256 + i for i, c in enumerate(hidden)}}

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token."""
        ids = self.parts.get(part)
        if ids is None:
            if part.isascii() and part[1:].isalpha() and part[0] == " ":
                text = self.space + part[1:]  # letters stand for themselves
            else:
                text = part.encode().decode("latin-1").translate(self.stand_in)
            ids = array(self.kind, [t.id for t in self.model.tokenize(text)]).tobytes()
            if len(part) < 4:
                self.parts[part] = ids
        return ids

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, piece: str) -> bytes | None:
        ids = self.young.get(piece)
        if ids is None:
            ids = self.old.get(piece)
            if ids is not None:
                self.young[piece] = ids
        return ids

    def _letters(self, piece: str) -> bytes | None:
        """Ids of a piece of letters and marks, also of several at line ends; else None."""
        core = piece.rstrip(_MARKS)
        if core[core[:1] == " " :].isalpha():
            ids = self._known(core)
            if ids is None:
                ids = self.young[core] = self._part(core)
            if len(core) < len(piece):
                ids = self.young[piece] = ids + self._part(piece[len(core) :])
            return ids
        lines = piece.split("\n")
        # a line end between other characters than white space is a pre-token of its own
        if len(lines) > 1 and lines[0] != " " and all(x and x[-1] > " " for x in lines):
            found = [self._known(x) or self._letters(x) for x in lines]
            if None not in found:
                return self._part("\n").join(found)
        return None

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; those behind a space are given with it."""
        if len(self.young) > CACHE_PIECES:
            self.young, self.old = {}, self.young
        get = self.young.get
        found = [get(p) or self._known(p) or self._letters(p) for p in pieces]
        hard = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(hard, self._whole([pieces[i] for i in hard]), strict=True):
            found[i] = self.young[pieces[i]] = ids
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by END_ID, and how many each has.

        Texts are split at their spaces as Arrow columns, and every distinct
        piece is looked up once.
        """
        type_ = np.dtype(np.uint16 if self.kind == "H" else np.uint32)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, r" \s").to_numpy(zero_copy_only=False)
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        # the first piece of a text has no space before it, the others share theirs
        spaced = pc.if_else(pa.array(odd | whole), "", texts)
        lists = pc.split_pattern(spaced, " ")
        ends = lists.offsets.to_numpy()[1:] - lists.offsets.to_numpy()[0]
        coded = lists.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = np.append(0, ends[:-1])
        first, place = np.unique(code[heads], return_inverse=True)
        table = self.pieces([" " + w for w in words]) + self.pieces([words[i] for i in first.tolist()])
        code[heads] = len(words) + place
        for i in np.flatnonzero(odd | whole).tolist():
            text = texts[i].as_py()
            if whole[i]:
                ids = self._whole([text])[0]
            else:
                cut = _SPACE.split(text)
                ids = b"".join(self.pieces([cut[0], *(" " + w for w in cut[1:])]))
            code[heads[i]] = len(table)
            table.append(ids)
        code = np.insert(code, ends, len(table))
        table.append(array(self.kind, [END_ID]).tobytes())
        flat = np.frombuffer(b"".join(table), type_)
        size = np.array([len(t) for t in table], np.int64) // type_.itemsize
        start = np.cumsum(size) - size
        many = size[code]
        before = np.cumsum(many) - many
        ids = flat[np.repeat(start[code] - before, many) + np.arange(int(many.sum()))]
        edges = np.append(0, ends + np.arange(1, len(ends) + 1))
        totals = np.append(before, len(ids))[edges]
        return ids, np.diff(totals)


_SPACE = re.compile(r" (?=\S)")
_MARKS = ".,;:!?|"


def piece_cache(path: str) -> PieceCache:
    """One tokenizer and cache per Python worker."""
    loaded = kept("token_file")
    if path not in loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        loaded[path] = PieceCache(Tokenizer.from_file(path))
    return loaded[path]


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """(doc, shard, seq, before, n, ids) in ascending order of doc; rows of one id by text.

    `before` counts the ids that precede the document in its shard. Each task
    ends with a row that has no `seq`: its counts of ids, in 64 bits.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, "doc", F.xxhash64("body")).sortWithinPartitions("doc", F.xxhash64("body"))

    def rows(batches):
        cache = piece_cache(path)
        seq = before = 0
        counts = np.zeros(0, np.int64)
        names = ["doc", "shard", "seq", "before", "n", "ids"]
        for batch in batches:
            for at, _, offsets in text_slices(batch.column(2), SLICE_BYTES):
                part = batch.slice(at, len(offsets) - 1)
                ids, n = cache.encode(part.column(2))
                more = np.bincount(ids, minlength=len(counts))
                more[: len(counts)] += counts
                counts = more
                ends = np.append(0, np.cumsum(n)) * ids.itemsize
                stored = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                places = pa.array(np.arange(seq, seq + len(n)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), places, pa.array(before + np.cumsum(n) - n), pa.array(n), stored.cast(pa.binary())], names
                )
                seq += len(n)
                before += int(n.sum())
        if len(counts):
            row = [None, None, None, None, None, counts.astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.binary()], strict=True)], names)

    return ordered.select("doc", F.spark_partition_id().alias("shard"), "body").mapInArrow(
        lean(rows, "token_file"), "doc bigint, shard int, seq bigint, before bigint, n bigint, ids binary"
    )


def id_counts(counted: DataFrame) -> dict[int, int]:
    """How often each id occurs in the whole corpus, from the tasks' counts; as
    long as the vocabulary at most."""

    def rows(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                c = np.frombuffer(raw.as_py(), "<i8").copy()
                if len(c) < len(total):
                    c, total = total, c
                c[: len(total)] += total
                total = c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "c"])

    summed = counted.select("ids").mapInArrow(rows, "id bigint, c bigint").groupBy("id").agg(F.sum("c").alias("c"))
    return {r["id"]: r["c"] for r in summed.collect()}


def code_lengths(counts: dict[int, int], limit: int = MAX_BITS) -> dict[int, int]:
    """Lengths of an optimal prefix code with no code longer than `limit` (package-merge)."""
    ids = sorted(counts, key=lambda i: (counts[i], i))
    if len(ids) < 2:
        return {i: 1 for i in ids}
    limit = max(limit, (len(ids) - 1).bit_length())
    weights = np.array([counts[i] for i in ids], np.float64)
    # a package is the pair of its members in the next list; lists are kept by position only
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        levels.append(order)
        merged = merged[order]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    lengths = np.zeros(len(ids), np.int64)
    take = 2 * len(ids) - 2
    for order in reversed(levels):
        chosen = order[:take]
        lengths[chosen[chosen < len(ids)]] += 1
        take = 2 * int((chosen >= len(ids)).sum())
    return dict(zip(ids, lengths.tolist(), strict=True))


class Code:
    """Code words and the decoding table of canonical lengths."""

    def __init__(self, lengths: dict[int, int]):
        self.bits = max(lengths.values(), default=1)
        size = max(lengths, default=0) + 1
        self.length = np.zeros(size, np.int64)
        self.word = np.zeros(size, np.uint64)
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.used = np.zeros(1 << self.bits, np.int64)
        word = last = 0
        for i in sorted(lengths, key=lambda i: (lengths[i], i)):
            n = lengths[i]
            word <<= n - last
            last = n
            self.length[i], self.word[i] = n, word
            at = word << (self.bits - n)
            self.symbol[at : at + (1 << (self.bits - n))] = i
            self.used[at : at + (1 << (self.bits - n))] = n
            word += 1

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The payload and the bit offset of every STEP-th id."""
        n = self.length[ids]
        at = np.cumsum(n) - n
        cell, shift = at >> 5, (at & 31).astype(np.uint64)
        wide = self.word[ids] << (np.uint64(64) - n.astype(np.uint64) - shift)
        cells = int((at[-1] + n[-1] + 31) >> 5) + 1 if len(ids) else 1
        # bits of different ids never overlap, so sums are unions, exact in doubles
        high = np.bincount(cell, (wide >> np.uint64(32)).astype(np.float64), cells)
        low = np.bincount(cell + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), cells + 1)[:cells]
        return (high + low).astype(np.uint32).astype(">u4").tobytes(), at[::STEP]

    def decode(self, payload: bytes, marks: np.ndarray, total: int) -> np.ndarray:
        """The ids; every step reads the next id of all runs between marks at once."""
        data = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        window = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
        out = np.zeros((STEP, len(marks)), np.uint32)
        at = marks.astype(np.int64)
        rest = total - STEP * (len(marks) - 1)
        mask, top = np.uint32((1 << self.bits) - 1), 32 - self.bits
        for step in range(STEP if len(marks) else 0):
            if step == rest:
                at = at[:-1]
            if not len(at):
                break
            peek = window[at >> 3] >> (top - (at & 7)).astype(np.uint32) & mask
            out[step, : len(at)] = self.symbol[peek]
            at = at + self.used[peek]
        return out.T.reshape(-1)[:total]


BLOCKS = (
    "shard int, first_seq bigint, skip bigint, first_id bigint, docs array<bigint>, seqs array<bigint>, "
    "counts array<bigint>, whole array<bigint>, marks array<bigint>, payload binary"
)


def encode_blocks(tokens: DataFrame, code, offsets, type_: type) -> DataFrame:
    """Blocks of neighbouring documents of one shard. Rows come in file order; a
    block ends when it is full or when the next row is not its neighbour."""

    def rows(batches):
        held: list[tuple] = []  # (doc, seq, whole, first, ids)

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                ids = np.concatenate([h[4] for h in held])
                payload, marks = code.value.encode(ids)
                shard, (doc, seq, _, first, _) = here[0], held[0]
                values = [shard, seq, first, here[1], [h[0] for h in held], [h[1] for h in held], [len(h[4]) for h in held], [h[2] for h in held], marks, payload]
                schema = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 5, pa.binary()]
                names = ["shard", "first_seq", "skip", "first_id", "docs", "seqs", "counts", "whole", "marks", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema, strict=True)], names)
                held.clear()

        here, expected, room = (0, 0), None, BLOCK_IDS
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for doc, shard, seq, before, n, raw in zip(*columns, batch.column(5), strict=True):
                ids = np.frombuffer(raw.as_py(), type_)
                if (shard, seq) != expected:
                    yield from flush()
                expected, at = (shard, seq + 1), 0
                while at < n:
                    if not held:
                        here, room = (shard, offsets.value[shard] + before + at), BLOCK_IDS
                    part = ids[at : at + room]
                    held.append((doc, seq, n, at, part))
                    at, room = at + len(part), room - len(part)
                    if not room:
                        yield from flush()
        yield from flush()

    return tokens.mapInArrow(lean(rows), BLOCKS)


def write_token_files(docs: DataFrame, folder: str, path: str, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode every whole text (null: empty), append END_ID, write the two tables.

    Every row of `docs` becomes a document, repeated rows and null ids (first)
    included; the largest memory a task needs is one text or one block.
    """
    from tokenizers import Tokenizer

    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    type_ = np.uint16 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else np.uint32
    body = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("body"))
    scratch = work_folder(spark, "ids")
    tokenize(body, path).write.option("compression", "zstd").parquet(scratch)
    written = spark.read.parquet(scratch)
    tokens = written.where("seq is not null")
    lengths = code_lengths(id_counts(written.where("seq is null")))
    # one number per shard, as many as there are shuffle partitions
    sizes = {r["shard"]: r["n"] for r in tokens.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    offsets, before = {}, 0
    for shard in sorted(sizes):
        offsets[shard] = before
        before += sizes[shard]
    blocks = encode_blocks(tokens, sc.broadcast(Code(lengths)), sc.broadcast(offsets), type_)
    blocks.write.parquet(f"{folder}/blocks")
    rows = [(int(i), int(n)) for i, n in lengths.items()]
    spark.createDataFrame(rows, "id bigint, length int").coalesce(1).write.parquet(f"{folder}/codebook")
    _remove(spark, scratch)


def _remove(spark, folder: str) -> None:
    """Delete a work table of this module through the file system that holds it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_pieces(spark, folder: str) -> DataFrame:
    """(doc, shard, seq, start, n, whole, crc): the runs of ids of each document, decoded."""
    book = {r["id"]: r["length"] for r in spark.read.parquet(f"{folder}/codebook").collect()}
    code = spark.sparkContext.broadcast(Code(book))

    def rows(batches):
        for batch in batches:
            for i in range(len(batch)):
                docs, seqs, counts, whole, marks = (batch[c][i].values for c in ("docs", "seqs", "counts", "whole", "marks"))
                sizes = counts.to_numpy()
                ids = code.value.decode(batch["payload"][i].as_py(), marks.to_numpy(), int(sizes.sum())).astype("<u4")
                ends = np.cumsum(sizes)
                data = memoryview(ids).cast("B")
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                starts = pa.array(batch["first_id"][i].as_py() + ends - sizes)
                shard = pa.array([batch["shard"][i].as_py()] * len(crcs), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [docs, shard, seqs, starts, counts, whole, pa.array(crcs, pa.int64())], ["doc", "shard", "seq", "start", "n", "whole", "crc"]
                )

    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").mapInArrow(
        lean(rows), "doc bigint, shard int, seq bigint, start bigint, n bigint, whole bigint, crc bigint"
    )


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo CRC-32's, lowest power in the top bit."""
    out = 0
    for i in range(32):
        if a >> (31 - i) & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def crc_append(first: int, second: int, size: int) -> int:
    """CRC-32 of two byte strings joined; `size` is the second one's length."""
    shift, square, bits = 1 << 31, 1 << 23, size  # 1 and x**8
    while bits:
        if bits & 1:
            shift = _times(shift, square)
        square, bits = _times(square, square), bits >> 1
    return _times(shift, first) ^ second


def read_documents(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    pieces = settle(read_pieces(spark, folder))

    def join(batches):
        for batch in batches:
            crcs = []
            for runs in batch.column(4).to_pylist():
                crc = 0
                for r in sorted(runs, key=lambda r: r["start"]):
                    crc = crc_append(crc, r["crc"], 4 * r["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, 4)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    out = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    whole = pieces.where("n = whole").select(F.col("doc").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    cut = pieces.where("n < whole").groupBy("shard", "seq", "doc").agg(
        F.min("start").alias("start"), F.sum("n").alias("n"), F.collect_list(F.struct("start", "n", "crc")).alias("runs")
    )
    return whole.union(cut.select("seq", "doc", "start", "n", "runs").mapInArrow(join, out))


def token_files(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write `docs` to a new folder of the shared work folder and read it back."""
    folder = work_folder(docs.sparkSession, "tokens")
    write_token_files(docs, folder, path, text, doc_id)
    return read_documents(docs.sparkSession, folder)
