"""Byte-level BPE: whole texts through the tokenizers library, long ones by concatenating trees of encoded pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.llm.common import tidy
from graphlane.llm.tokens import LONG, Piece, encoder, little_endian, unit_coder

def encode(docs: DataFrame, path: str, long: int = LONG) -> DataFrame:
    """docs with the column ids: the token ids of text as little-endian unsigned 32-bit integers.

    docs needs a column text. Null and empty texts have no ids. Texts of more than `long` characters are cut, their
    pieces encoded by as many tasks, and joined by document. Other columns and repeated rows stay; one named ids is
    replaced. Memory: a batch of texts; for joining, one text with its ids.
    """
    return _encoded(docs.drop("ids"), path, "ids binary", lambda ids: [pa.array(ids, pa.binary())], long)


def _encoded(docs: DataFrame, path: str, made: str, finish: Callable[[list[bytes]], list[pa.Array]], long: int = LONG) -> DataFrame:
    """docs with the columns of the schema `made`, which finish makes from the ids of a few texts."""
    size = F.length(F.coalesce("text", F.lit("")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    short = docs.where(size <= long).mapInArrow(_short(path, finish, made), f"{fields}, {made}")
    rest = docs.where(size > long)
    keyed = rest.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("row_no"))
    kind = keyed.schema["row"].dataType.simpleString()
    cut = keyed.mapInArrow(_cut(path, long), f"row_no long, section int, piece int, part string, row {kind}")
    coded = cut.repartition("row_no", "section", "piece").mapInArrow(_pieces(path), f"row_no long, section int, piece int, part string, starts array<int>, ids array<array<int>>, row {kind}")
    joined = coded.groupBy("row_no").applyInArrow(_joined(path, finish, made), f"row {kind}, {made}")
    return short.unionByName(joined.select("row.*", *_names(made)))


def _names(made: str) -> list[str]:
    return [f.split()[0] for f in made.split(", ")]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _short(path, finish, made):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches):
            ids = unit_coder(path, halves=True).encode([t or "" for t in some.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*some.columns, *finish([x.astype("<u4").tobytes() for x in ids])], [*some.schema.names, *_names(made)])

    return tidy(run)


def _cut(path, long):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.column("row").slice(k, 1)
                pieces = encoder(path).cut(row[0].as_py()["text"], long)
                first = pa.array([0] + [None] * (len(pieces) - 1), pa.int64())  # the row itself goes with its first piece only
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("row_no")[k].as_py()] * len(pieces), pa.int64()), pa.array([p[0] for p in pieces], pa.int32()), pa.array([p[1] for p in pieces], pa.int32()), pa.array([p[2] for p in pieces], pa.string()), row.take(first)],
                    ["row_no", "section", "piece", "part", "row"],
                )

    return run


def _pieces(path):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                some = batch.slice(at, 16)
                pieces = [encoder(path).piece(t) for t in some.column("part").to_pylist()]
                arrays = {"starts": pa.array([p.starts for p in pieces], pa.list_(pa.int32())), "ids": pa.array([p.ids for p in pieces], pa.list_(pa.list_(pa.int32())))}
                names = ["row_no", "section", "piece", "part", "starts", "ids", "row"]
                yield pa.RecordBatch.from_arrays([arrays[n] if n in arrays else some.column(n) for n in names], names)

    return run


def _joined(path, finish, made):
    def run(rows: pa.Table) -> pa.Table:
        columns = [rows.column(c).to_pylist() for c in ("section", "piece", "part", "starts", "ids")]
        pieces = [(s, p, None if p < 0 else Piece(t, starts, ids)) for s, p, t, starts, ids in zip(*columns, strict=True)]
        row = rows.column("row").combine_chunks()
        row = row.filter(row.is_valid())
        return pa.table([row, *finish([little_endian(encoder(path).assemble(pieces))])], ["row", *_names(made)])

    return run


def decode(coded: DataFrame, path: str) -> DataFrame:
    """coded with the column decoded: the text of ids as the library's decode(ids, skip_special_tokens=False) gives it.

    ids as encode() leaves them; null counts as none, which gives an empty text. A column named decoded is replaced.
    """
    coded = coded.drop("decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded(path, batch.column("ids").to_pylist()), pa.string())], [*batch.schema.names, "decoded"])

    return coded.mapInArrow(run, f"{fields}, decoded string")


def decoded(path: str, ids: list[bytes | None]) -> list[str]:
    out: list[str] = []
    for at in range(0, len(ids), 64):
        out += encoder(path).library.decode_batch([np.frombuffer(x or b"", "<u4").tolist() for x in ids[at : at + 64]], skip_special_tokens=False)
    return out


def digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns keep, n_tokens, ids_sha256, decoded_sha256 (see encode and decode)."""

    def finish(ids: list[bytes]) -> list[pa.Array]:
        sha = [hashlib.sha256(x).hexdigest() for x in ids]
        texts = [hashlib.sha256(t.encode()).hexdigest() for t in decoded(path, ids)]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())]

    made = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs.select(*keep, "text"), path, made, finish).select(*keep, *_names(made))
