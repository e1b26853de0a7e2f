"""Token ids in files: canonical length-limited Huffman codes, in blocks that decode on their own."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlane.llm.common import id_type, parts, scratch, tidy, written
from graphlane.llm.tokens import drop_coders, encoder, unit_coder

LIMIT = 18  # bits of the longest code, unless there are more symbols than codes of so many bits
UNITS = 800_000  # distinct units whose ids a task keeps
STEP = 64  # ids between two checkpoints
BLOCK = 1 << 16  # ids from which a block ends; a document is never cut
PART_BYTES = 12 << 20  # stored bytes of a part


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of an optimal prefix code of at most `limit` bits, by merging packages; 0 for what doesn't occur. For many
    symbols the limit is one bit more than they need."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, (len(used) - 1).bit_length() + 1)
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    level, leaves = weights, [np.ones(len(weights), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.r_[weights, pairs]
        at = np.argsort(both, kind="stable")
        level = both[at]
        leaves.append(at < len(weights))
    take = 2 * (len(order) - 1)
    for leaf in reversed(leaves):
        own = int(leaf[:take].sum())
        out[order[:own]] += 1
        take = 2 * (take - own)
    return out


class Codes:
    """Canonical codes from their lengths: shorter first, then by symbol."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths.astype(np.int64)
        order = np.lexsort((np.arange(len(lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        ln = self.lengths[order]
        self.bits = int(ln.max(initial=1))
        spans = np.int64(1) << (self.bits - ln)
        begins = np.r_[0, np.cumsum(spans)[:-1]]
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[order] = begins >> (self.bits - ln)
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.size = np.ones(1 << self.bits, np.int64)
        self.symbol[: spans.sum()] = np.repeat(order, spans)
        self.size[: spans.sum()] = np.repeat(ln, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the bit offset of each STEP-th id."""
        if not len(ids):
            return b"", np.zeros(0, np.uint32)
        ln, code = self.lengths[ids], self.codes[ids].astype(np.uint64)
        ends = np.cumsum(ln)
        begins = ends - ln
        word, off = begins >> 5, begins & 31
        wide = code << (64 - off - ln).astype(np.uint64)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
        out[word[first]] = np.bitwise_or.reduceat(wide >> np.uint64(32), first)
        out[word[first] + 1] |= np.bitwise_or.reduceat(wide & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], begins[::STEP].astype(np.uint32)

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """Table lookups from all checkpoints side by side."""
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
        lanes = len(checkpoints)
        out = np.zeros((STEP, lanes), np.uint32)
        at, last = checkpoints.astype(np.int64), len(window) - 1
        shift, mask = np.int64(32 - self.bits), np.int64((1 << self.bits) - 1)
        for k in range(STEP):
            peek = window[np.minimum(at >> 3, last)].astype(np.int64) >> (shift - (at & 7)) & mask
            out[k] = self.symbol[peek]
            at += self.size[peek]
        return out.T.reshape(-1)[:n]


def encode_ordered(docs: DataFrame, path: str, end_id: int | None = None, block_ids: int = BLOCK, part_bytes: int = PART_BYTES) -> DataFrame:
    """Blocks of ids in ascending doc_id order: part, block, before (ids of the part before it), doc_ids, sizes, ids
    (little-endian 16 or 32 bits).

    docs needs doc_id and text, other columns don't matter; null texts count as empty, a null doc_id comes first,
    repeated ids stand in order of their texts. Parts are ranges of doc_id and the text's first characters, so that one
    id of many rows fills several parts. Memory: a batch of texts, the kept units, and a block with one document more.
    """
    kind = id_type(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, own, sizes, ids, held = TaskContext.get().partitionId(), 0, 0, [], [], [], 0
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        wide = encoder(path).library.get_vocab_size() > 1 << 16 or (end_id or 0) >= 1 << 16
        row_type = None

        def row() -> pa.RecordBatch:
            flat = np.concatenate(ids).astype("<u4" if wide else "<u2").tobytes()
            values = [pa.array([part], pa.int64()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([own], pa.list_(row_type)), pa.array([sizes], pa.list_(pa.int64())), pa.array([flat], pa.binary())]
            return pa.RecordBatch.from_arrays(values, ["part", "block", "before", "doc_ids", "sizes", "ids"])

        for batch in batches:
            row_type = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 250):
                some = batch.slice(at, 250)
                coded = unit_coder(path, UNITS).encode([t or "" for t in some.column("text").to_pylist()])
                for d, x in zip(some.column("doc_id").to_pylist(), coded, strict=True):
                    own.append(d)
                    ids += [x, tail]
                    sizes.append(len(x) + len(tail))
                    held += sizes[-1]
                    if held >= block_ids:
                        yield row()
                        block, before, own, sizes, ids, held = block + 1, before + held, [], [], [], 0
        if own:
            yield row()

    n = parts(docs.select("doc_id", "text"), each=part_bytes, least=1)
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(tidy(run), f"part long, block int, before long, doc_ids array<{kind}>, sizes array<long>, ids binary")


def _flat(ids: bytes, sizes: list[int]) -> np.ndarray:
    return np.frombuffer(ids, "<u4" if len(ids) == 4 * sum(sizes) and sum(sizes) else "<u2")


def write(docs: DataFrame, path: str, folder: str, end_id: int | None = None, block_ids: int = BLOCK, part_bytes: int = PART_BYTES) -> None:
    """Encodes docs and writes folder/codes (symbol, bits) and folder/blocks, Parquet that holds the coded blocks.

    A row of blocks: part, block, start (ids before it), doc_ids, sizes, n, payload, checkpoints (bit offset of each
    STEP-th id). Code lengths come from the counts of all ids. The driver gets one count per distinct id and one sum
    per part.
    """
    spark = docs.sparkSession
    coded = written(encode_ordered(docs, path, end_id, block_ids, part_bytes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_coders()
        total = np.zeros(0, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                c = np.bincount(_flat(batch.column("ids")[k].as_py(), batch.column("sizes")[k].as_py()))
                if len(c) > len(total):
                    c[: len(total)] += total
                    total = c
                else:
                    total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["symbol", "n"])

    counts = coded.select("ids", "sizes").mapInArrow(tidy(count), "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    totals = np.zeros(max([r.symbol for r in counts], default=0) + 1, np.int64)
    for r in counts:
        totals[r.symbol] = r.n
    lengths = code_lengths(totals)
    sums = coded.select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()
    starts = np.zeros(max([r.part for r in sums], default=0) + 2, np.int64)
    for r in sums:
        starts[r.part + 1] = r.n
    starts = np.cumsum(starts)
    kind = coded.schema["doc_ids"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_coders()
        codes = Codes(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                sizes = row.column("sizes")[0].as_py()
                payload, checkpoints = codes.encode(_flat(row.column("ids")[0].as_py(), sizes))
                start = int(starts[row.column("part")[0].as_py()]) + row.column("before")[0].as_py()
                extra = [pa.array([start], pa.int64()), pa.array([sum(sizes)], pa.int64()), pa.array([payload], pa.binary()), pa.array([checkpoints.astype("<u4").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([row.column("part"), row.column("block"), extra[0], row.column("doc_ids"), row.column("sizes"), *extra[1:]], ["part", "block", "start", "doc_ids", "sizes", "n", "payload", "checkpoints"])

    packed = coded.mapInArrow(tidy(pack), f"part long, block int, start long, doc_ids {kind}, sizes array<long>, n long, payload binary, checkpoints binary")
    packed.write.option("compression", "none").parquet(f"{folder}/blocks")
    used = [(int(s), int(lengths[s])) for s in np.flatnonzero(lengths)]
    spark.createDataFrame(used, "symbol long, bits int").coalesce(1).write.parquet(f"{folder}/codes")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a folder: doc_id, start (ids of all documents before it), n_tokens, ids as little-endian 32-bit
    integers. An empty folder of blocks gives no rows."""
    return _read(spark, folder, "ids binary", lambda x: x, pa.binary())


def _read(spark: SparkSession, folder: str, field: str, make, arrow_type: pa.DataType) -> DataFrame:
    codes = spark.read.parquet(f"{folder}/codes").collect()
    lengths = np.zeros(max([r.symbol for r in codes], default=0) + 1, np.int64)
    for r in codes:
        lengths[r.symbol] = r.bits
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_coders()
        table = Codes(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                start, sizes, n, payload, checkpoints = (row.column(c)[0].as_py() for c in ("start", "sizes", "n", "payload", "checkpoints"))
                ids = table.decode(payload, np.frombuffer(checkpoints, "<u4"), n).astype("<u4")
                ends = np.cumsum(np.array(sizes, np.int64))
                begins = ends - sizes
                raw = memoryview(ids.tobytes())
                own = [make(bytes(raw[4 * a : 4 * b])) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([row.column("doc_ids").flatten(), pa.array(start + begins, pa.int64()), pa.array(sizes, pa.int64()), pa.array(own, arrow_type)], ["doc_id", "start", "n_tokens", field.split()[0]])

    return blocks.mapInArrow(tidy(unpack), f"doc_id {kind}, start long, n_tokens long, {field}")


def digests(docs: DataFrame, path: str, end_id: int, block_ids: int = BLOCK, part_bytes: int = PART_BYTES) -> DataFrame:
    """Writes docs to a new folder of the shared place and reads it back: doc_id, start, n_tokens, ids_crc32.

    One row per row of docs: null and empty texts have the end id alone, rows with a null or repeated doc_id stay, each
    with its own start. Other columns are left out.
    """
    folder = scratch(docs.sparkSession)
    write(docs, path, folder, end_id, block_ids, part_bytes)
    return _read(docs.sparkSession, folder, "ids_crc32 long", zlib.crc32, pa.int64())
