"""Repeated passages: shards' Burrows-Wheeler transforms are merged by refining their interleave."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.llm.common import BYTE_VALUES, POWERS, block_of, id_type, parts

SPAN = 50  # bytes of a passage
GRAM = 24  # bytes of a hashed gram; each passage is dealt by the least hash of its grams
CHUNK = 1 << 18  # bytes that are hashed at once
MAX_SHARDS = 8  # of a share; a shard is what some blocks following one another have sent
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: not less than any
STRIDE = 16  # bytes by which the interleave is refined at once
BLOCK_BYTES = 4 << 20


class Passages:
    """The runs of consecutive passages of a text that have the same least hash: text, first passage, passages, hash."""

    def __init__(self, texts: list[bytes]) -> None:
        found = []
        first, size = 0, 0
        for k, t in enumerate([*texts, None]):
            if t is None or size >= CHUNK:
                if k > first:
                    doc, begin, count, value = self._runs(texts[first:k])
                    found.append((doc + first, begin, count, value))
                first, size = k, 0
            if t is not None:
                size += len(t)
        kinds = (np.int64, np.int64, np.int64, np.uint64)
        self.doc, self.begin, self.count, self.value = (np.concatenate([np.zeros(0, kind), *(f[i] for f in found)]) for i, kind in enumerate(kinds))

    @staticmethod
    def _runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        n = len(raw)
        if n < SPAN:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        up, down = POWERS.get(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[raw] * up[:n], out=sums[1:])
        h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        window, span, low = SPAN - GRAM + 1, 1, h
        while 2 * span <= window:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: n - SPAN + 1], low[window - span : window - span + n - SPAN + 1])
        doc = np.repeat(np.arange(len(texts)), sizes)[: n - SPAN + 1]
        inside = np.arange(n - SPAN + 1) + SPAN <= ends[doc]
        begins = inside.copy()
        begins[1:] &= (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(begins)
        # passages from a begin up to the next, but for those that the text's end cuts off
        kept = np.r_[0, np.cumsum(inside)]
        count = kept[np.r_[at[1:], len(inside)]] - kept[at] if len(at) else at
        return doc[at], at - (ends - sizes)[doc[at]], count, low[at]


def share_of(value: np.ndarray, shares: int) -> np.ndarray:
    return ((value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(shares)).astype(np.int64)


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys of so many bits, and the keys in that order."""
    place = max(1, len(key).bit_length())
    if bits + place > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    packed = key << np.uint64(place)
    packed |= np.arange(len(key), dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << place) - 1)).astype(np.int32 if place < 32 else np.int64)
    packed >>= np.uint64(place)
    return order, packed


def _ranks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions in order of the keys, first key first, and each position's dense rank; keys are ranks or small numbers."""
    bits = [max(1, int(k.max(initial=0)).bit_length()) for k in keys]
    key = keys[0].astype(np.uint64)
    for k, w in zip(keys[1:], bits[1:], strict=True):
        key <<= np.uint64(w)
        key |= k.astype(np.uint64)
    order, s = _sorted(key, sum(bits))
    step = np.zeros(len(s), np.uint32)
    step[1:] = s[1:] != s[:-1]
    rank = np.empty(len(s), np.uint32)
    rank[order] = np.cumsum(step, dtype=np.uint32)
    return order, rank


class Shard:
    """A text (strings, each with an end byte) as a circle, its positions sorted by 64 bytes, and what stands before each."""

    def __init__(self, raw: np.ndarray, letter: np.ndarray) -> None:
        """letter: the rank of the STRIDE bytes from each position on, among those of all shards."""
        self.raw, self.letter = raw, letter
        self.order, rank = _ranks(letter)
        span = STRIDE
        while span < SPAN and rank.max(initial=0) + 1 < len(raw):
            self.order, rank = _ranks(rank, np.roll(rank, -span))
            span *= 2


def shards_of(blocks: list[list[bytes]], most: int = MAX_SHARDS) -> list[Shard]:
    """The strings of blocks that follow one another make a shard, `most` at most. Letters of STRIDE bytes are ranked once for all."""
    sizes = np.cumsum([sum(map(len, b)) for b in blocks])
    of_block = np.minimum((sizes - 1) * most // max(1, int(sizes[-1])), most - 1)
    held: dict[int, list[bytes]] = {}
    for k, strings in zip(of_block.tolist(), blocks, strict=True):
        held.setdefault(k, []).extend(strings)
    raws = [np.frombuffer(b"\xff".join(x) + b"\xff", np.uint8) for x in held.values() if x]

    def ahead(parts: list[np.ndarray], by: int) -> np.ndarray:
        return np.concatenate([np.roll(p, -by) for p in parts])

    cuts = np.cumsum([len(r) for r in raws])[:-1]
    rank = np.concatenate(raws)
    span = 1
    while span < STRIDE:
        _, rank = _ranks(rank, ahead(np.split(rank, cuts), span))
        span *= 2
    return [Shard(r, e) for r, e in zip(raws, np.split(rank, cuts), strict=True)]


def common_prefixes(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the shards in the order of their first SPAN bytes, and for each how many of these it shares with
    the one before it: SPAN, or a number of bytes after which the two were still together one step before they parted.

    The order of each shard alone is known. Their interleave begins as one shard after the other, in order of no bytes
    at all. If it is in order of t bytes, dealing its positions out by the STRIDE bytes that stand before them, which
    each shard's transform has in that shard's order, puts the positions STRIDE bytes earlier in order of t + STRIDE
    bytes. Positions that part stay in their places from then on, so the step in which they part gives their common
    prefix; no suffix is compared again.
    """
    base = np.cumsum([0, *(len(s.raw) for s in shards)])
    n = int(base[-1])
    source = np.repeat(np.arange(len(shards), dtype=np.uint8), np.diff(base))
    interval = np.zeros(n, np.uint32)
    common = np.full(n, SPAN, np.uint8)
    common[:1] = 0
    rest = SPAN % STRIDE
    before = {STRIDE: np.concatenate([np.roll(s.letter, STRIDE)[s.order] for s in shards])}
    before[rest] = np.concatenate([sum((np.roll(s.raw, rest - j).astype(np.uint32) << np.uint32(8 * (rest - 1 - j)) for j in range(rest)), np.uint32(0))[s.order] for s in shards])
    letter = np.empty(n, np.uint64)
    step = np.zeros(n, bool)
    depth = 0
    for stride in [STRIDE] * (SPAN // STRIDE) + [rest]:
        letter[np.argsort(source, kind="stable")] = before[stride]
        order, dealt = _sorted(letter, int(before[stride].max()).bit_length())
        source, interval = source[order], interval[order]
        step[1:] = dealt[1:] != dealt[:-1]
        step[1:] |= interval[1:] != interval[:-1]
        common[step & (common == SPAN)] = depth
        interval = np.cumsum(step, dtype=np.uint32)
        depth += stride
    out = np.empty(n, np.int64)
    out[np.argsort(source, kind="stable")] = np.concatenate([b + s.order for b, s in zip(base, shards, strict=False)])
    return out, common


def seen_before(groups: list[tuple[list[bytes], np.ndarray]]) -> list[np.ndarray]:
    """groups: a block's strings and the least doc_id that has each. For each group, string after string, whether each
    passage is in a document with an id below that one."""
    distinct: dict[bytes, int] = {}
    blocks: list[list[bytes]] = []
    for strings, ids in groups:
        own = []
        for x, i in zip(strings, ids.tolist(), strict=True):
            known = distinct.get(x)
            if known is None:
                own.append(x)
            if known is None or known > i:
                distinct[x] = i
        blocks.append(own)
    if not distinct:
        return [np.zeros(0, bool) for _ in groups]
    strings = list(distinct)
    order, common = common_prefixes(shards_of(blocks))
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    begins = np.cumsum(sizes + 1) - sizes - 1
    counts = sizes - SPAN + 1
    passages = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    ids = np.full(len(order), NO_ID)
    ids[passages] = np.repeat(np.fromiter(distinct.values(), np.int64, len(strings)), counts)
    first = np.flatnonzero(common < SPAN)  # a repeated interval goes as far as SPAN bytes are common
    least = np.minimum.reduceat(ids[order], first)
    answer = np.empty(len(order), np.int64)
    answer[order] = np.repeat(least, np.diff(np.r_[first, len(order)]))
    place = dict(zip(strings, zip(begins.tolist(), counts.tolist(), strict=True), strict=True))
    return [np.concatenate([np.zeros(0, bool), *(answer[b : b + n] < i for (b, n), i in zip(map(place.__getitem__, own), own_ids.tolist(), strict=True))]) for own, own_ids in groups]


def cut(texts: list[bytes], removed: list[list[tuple[int, int]]]) -> list[bytes]:
    out = []
    for t, spans in zip(texts, removed, strict=True):
        end, kept = 0, []
        for a, b in spans:
            kept.append(t[end:a])
            end = b
        out.append(b"".join([*kept, t[end:]]))
    return out


def _bytes(column) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def _table(names: str, rows: list[tuple], kinds: tuple[pa.DataType, ...]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names.split(), columns, kinds, strict=True)})


class Runs:
    """A block's runs of passages whose least hash also is in another document, by share."""

    def __init__(self, texts: list[bytes], shares: int, bits: dict[int, bytes]) -> None:
        p = Passages(texts)
        often = np.zeros(len(p.value), bool)
        share = share_of(p.value, shares)
        for s, own in _by_share(share):
            values, back = np.unique(p.value[own], return_inverse=True)
            often[own] = np.unpackbits(np.frombuffer(bits[s], np.uint8), count=len(values)).astype(bool)[back]
        at = np.flatnonzero(often)
        self.doc, self.begin, self.count = p.doc[at], p.begin[at], p.count[at]
        self.by_share = list(_by_share(share[at]))

    def strings(self, texts: list[bytes], ids: np.ndarray) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
        """For each share its distinct strings, the least doc_id of each, and each run's string."""
        doc, begin, count = (x.tolist() for x in (self.doc, self.begin, self.count))
        for s, own in self.by_share:
            number: dict[bytes, int] = {}
            which = np.fromiter((number.setdefault(texts[doc[k]][begin[k] : begin[k] + count[k] + SPAN - 1], len(number)) for k in own.tolist()), np.int64, len(own))
            least = np.full(len(number), NO_ID)
            np.minimum.at(least, which, ids[self.doc[own]])
            yield s, list(number), least, which

    def removed(self, texts: list[bytes], ids: np.ndarray, answers: dict[int, tuple[bytes, bytes]]) -> list[list[tuple[int, int]]]:
        """answers: per share a bit for each passage of its strings, and each run's string. The bytes to remove of each text.

        A bit says that the passage is in a document before all of this block's that have the string; of these all but
        the first lose it anyway.
        """
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(sizes) - sizes
        places = [np.zeros(0, np.int64)]
        for s, own in self.by_share:
            bits, which = (np.frombuffer(x, kind) for x, kind in zip(answers[s], (np.uint8, "<u4"), strict=True))
            count, mine = self.count[own], ids[self.doc[own]]
            least = np.full(int(which.max()) + 1, NO_ID)
            np.minimum.at(least, which, mine)
            of_string = np.zeros(int(which.max()) + 1, np.int64)
            of_string[which] = count
            at = np.cumsum(of_string) - of_string
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            seen = np.unpackbits(bits, count=int(of_string.sum())).astype(bool)
            goes = seen[np.repeat(at[which], count) + step] | np.repeat(mine > least[which], count)
            places.append((np.repeat(first[self.doc[own]] + self.begin[own], count) + step)[goes])
        gone = np.zeros(int(sizes.sum()) + 1, bool)
        gone[np.concatenate(places)] = True  # where a passage to remove begins; its other bytes follow by doubling
        span = 1
        while span < SPAN:
            more = min(span, SPAN - span)
            gone[more:] |= gone[:-more].copy()
            span += more
        edge = np.zeros(len(gone) + 1, bool)
        edge[1:] = gone
        begins = edge[1:] & ~edge[:-1]
        inner = first[(sizes > 0) & (first > 0)]
        begins[inner] = gone[inner]  # a text's end ends a span
        a = np.flatnonzero(begins)
        ends = np.zeros(len(gone), bool)
        ends[1:] = edge[1:-1] & ~gone[1:]
        ends[inner] = gone[inner - 1]
        b = np.flatnonzero(ends)
        owner = np.searchsorted(first + sizes, a, side="right")
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for d, x, y in zip(owner.tolist(), (a - first[owner]).tolist(), (b - first[owner]).tolist(), strict=True):
            out[d].append((x, y))
        return out


def _by_share(share: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(share):
        return
    order = np.argsort(share, kind="stable")
    s = share[order]
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    for a, b in zip(at, [*at[1:], len(s)], strict=True):
        yield int(s[a]), order[a:b]


def removed_spans(docs: DataFrame, make, schema: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """make(rows, texts, spans) for each block of docs (a table with doc_id and text), spans being the maximal runs of bytes to remove.

    Blocks of documents deal the least hashes of their passages to shares, and learn which ones other documents have.
    The runs of those passages go to the shares as strings, equal ones of a block once; a share sorts them by shards,
    merges these, and answers with a bit for each passage: whether a document before the block's has it. A task holds
    one block or one share. The blocks' exchange of texts is made once and used three times, a partition for each block.
    """
    if docs.schema["doc_id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("doc_id must be an integer")
    blocks = parts(docs.select("doc_id", "text"), each=block_bytes, least=24)
    shares = 8 * blocks
    df = docs.select("doc_id", "text", block_of(blocks).alias("block")).repartitionById(blocks, F.col("block"))

    def in_order(rows: pa.Table) -> pa.Table:
        """A block's rows arrive in any order, and twice: runs are numbered alike only in one order."""
        return rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])

    def ids_of(rows: pa.Table) -> np.ndarray:
        return np.array([NO_ID if d is None else d for d in rows.column("doc_id").to_pylist()], np.int64)

    def hashes(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        texts = _bytes(rows.column("text"))
        p = Passages(texts)
        out = []
        for s, own in _by_share(share_of(p.value, shares)):
            values, back = np.unique(p.value[own], return_inverse=True)
            low, high = np.full(len(values), len(texts)), np.full(len(values), -1)
            np.minimum.at(low, back, p.doc[own])
            np.maximum.at(high, back, p.doc[own])
            out.append((key[0].as_py(), s, values.astype("<u4").tobytes(), np.packbits(low < high).tobytes()))
        return _table("block share hashes several", out, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))

    def common(rows: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, "<u4") for x in rows.column("hashes").to_pylist()]
        flat = np.concatenate(own)
        often = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(o)) for x, o in zip(rows.column("several").to_pylist(), own, strict=True)]).astype(bool)
        order, rank = _ranks(flat)
        many = np.zeros(int(rank.max(initial=0)) + 1, bool)
        many[rank[often]] = True
        often = many[rank] | (np.bincount(rank)[rank] > 1)
        bits = [np.packbits(x).tobytes() for x in np.split(often, np.cumsum([len(o) for o in own])[:-1])]
        return pa.table({"block": rows.column("block"), "share": rows.column("share"), "kind": pa.array([0] * len(bits), pa.int32()), "data": pa.array(bits, pa.binary()), "which": pa.nulls(len(bits), pa.binary())})

    def strings(key: tuple[pa.Scalar, ...], rows: pa.Table, said: pa.Table) -> pa.Table:
        rows = in_order(rows)
        texts = _bytes(rows.column("text"))
        runs = Runs(texts, shares, dict(zip(said.column("share").to_pylist(), said.column("data").to_pylist(), strict=True)))
        out = [(key[0].as_py(), s, b"".join(x), np.fromiter(map(len, x), "<u4", len(x)).tobytes(), least.tobytes(), which.astype("<u4").tobytes()) for s, x, least, which in runs.strings(texts, ids_of(rows))]
        return _table("block share strings sizes ids which", out, (pa.int32(), pa.int32(), *[pa.binary()] * 4))

    def merge(rows: pa.Table) -> pa.Table:
        groups = []
        for joined, sizes, ids in zip(*(rows.column(c).to_pylist() for c in ("strings", "sizes", "ids")), strict=True):
            ends = np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64)).tolist()
            groups.append(([joined[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], np.frombuffer(ids, "<i8")))
        answers = [np.packbits(x).tobytes() for x in seen_before(groups)]
        return pa.table({"block": rows.column("block"), "share": rows.column("share"), "kind": pa.array([1] * len(answers), pa.int32()), "data": pa.array(answers, pa.binary()), "which": rows.column("which")})

    def finish(key: tuple[pa.Scalar, ...], rows: pa.Table, said: pa.Table) -> pa.Table:
        rows = in_order(rows)
        texts = _bytes(rows.column("text"))
        bits, answers = {}, {}
        for s, kind, data, which in zip(*(said.column(c).to_pylist() for c in ("share", "kind", "data", "which")), strict=True):
            if kind:
                answers[s] = data, which
            else:
                bits[s] = data
        return make(rows, texts, Runs(texts, shares, bits).removed(texts, ids_of(rows), answers))

    answer = "block int, share int, kind int, data binary, which binary"
    told = df.groupBy("block").applyInArrow(hashes, "block int, share int, hashes binary, several binary").groupBy("share").applyInArrow(common, answer)
    by_block = lambda x: x.repartitionById(blocks, F.col("block")).groupBy("block")
    asked = df.groupBy("block").cogroup(by_block(told)).applyInArrow(strings, "block int, share int, strings binary, sizes binary, ids binary, which binary")
    merged = asked.groupBy("share").applyInArrow(merge, answer)
    return df.groupBy("block").cogroup(by_block(told.unionByName(merged))).applyInArrow(finish, schema)


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a passage of SPAN bytes that covers it also begins in a document with a smaller doc_id. Null and
    empty texts and those of fewer bytes lose nothing. A null doc_id is larger than all others; rows that share an id
    don't remove one another's bytes. Other columns are left out.
    """
    kind = id_type(docs)

    def make(rows: pa.Table, texts: list[bytes], spans: list[list[tuple[int, int]]]) -> pa.Table:
        numbers = {
            "n_bytes": [len(t) for t in texts],
            "n_removed": [sum(b - a for a, b in x) for x in spans],
            "n_spans": [len(x) for x in spans],
        }
        sha = [hashlib.sha256(t).hexdigest() for t in cut(texts, spans)]
        return pa.table({"doc_id": rows.column("doc_id"), **{n: pa.array(x, pa.int64()) for n, x in numbers.items()}, "kept_sha256": pa.array(sha, pa.string())})

    return removed_spans(docs, make, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text of each row, less its repeated passages; a character that loses a byte goes whole. A null text is
    empty afterwards; ids as in digests."""
    kind = id_type(docs)

    def make(rows: pa.Table, texts: list[bytes], spans: list[list[tuple[int, int]]]) -> pa.Table:
        return pa.table({"doc_id": rows.column("doc_id"), "text": pa.array([t.decode("utf-8", "ignore") for t in cut(texts, spans)], pa.string())})

    return removed_spans(docs, make, f"doc_id {kind}, text string")
