"""Near duplicates: an exact join of shingle sets by Jaccard similarity that skips by set relations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlane.llm.common import Words, id_type, parts, size_of, tidy, written

WORDS = 5  # words of a shingle
PERCENT = 80  # least similarity
WORD_BYTES = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])
SKETCH_BYTES = 1 << 24  # of the counters by which shingles are ordered, at most: the one array that is broadcast
SALTS = 32
PASSING = 128  # sets that pass by one read of the set that they are compared with
ROUNDS = 3  # rounds in which lists are looked through from some of their sets only, before all pairs of what is left
HUBS = 32  # sets of a list from which a round looks
STEPWISE = 3  # rounds of components in which nodes go two steps only
TRIES = 8  # pairs that a round compares for each component
BROADCAST_IDS = 1_000_000  # ids, or pairs of ids, that may be broadcast, 32 MB at most; beyond them they meet by a shuffle
NODE_BITS = np.uint64((1 << 63) - 1)
BRIEF = 4  # 64-bit words of the part of a signature that goes into the join of lists
ENTRY = np.dtype([("h", "<u4"), ("pos", "<u4"), ("n", "<u4"), ("node", "<u8")])


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; a text of fewer words has its whole sequence as one."""
    w = Words([(t or "").encode().lower() for t in texts], WORD_BYTES)
    begin = np.r_[0, np.cumsum(w.counts)]
    h, _ = w.grams(words)
    out = []
    for k, n in enumerate(w.counts.tolist()):
        if n >= words:
            out.append(np.unique(h[begin[k] : begin[k] + n - words + 1]))
        elif n:
            own = n
            for x in w.hash[begin[k] : begin[k + 1]].tolist():
                own = ((own ^ x) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
                own ^= own >> 29
            out.append(np.array([own], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of sets of n and m that are similar: 100 i >= percent (n + m - i)."""
    return -(-(n + m) * percent // (100 + percent))


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sketch(docs: DataFrame) -> np.ndarray:
    """How many documents have a shingle of each hash bucket, as twice the logarithm to base 2, in a byte.

    One bucket for each 128 stored bytes of docs, but SKETCH_BYTES at most; the order of shingles follows it, no result.
    """
    bits = min(SKETCH_BYTES.bit_length() - 1, max(16, (size_of(docs.select("text")) >> 7).bit_length()))
    chunks = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint16)
        for batch in _batches(batches):
            at = [s >> np.uint64(64 - bits) for s in shingle_sets(batch.column("text").to_pylist())]
            bucket, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *at]), return_counts=True)
            total[bucket.astype(np.int64)] = np.minimum(total[bucket.astype(np.int64)] + n, 65535).astype(np.uint16)
        own = [zstandard.ZstdCompressor(3).compress(c.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()) for c in np.split(total, chunks)]
        yield pa.RecordBatch.from_arrays([pa.array(range(chunks), pa.int32()), pa.array(own, pa.binary())], ["chunk", "n"])

    def add(rows: pa.Table) -> pa.Table:
        counts = (np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(2, -1) for x in rows.column("n").to_pylist())
        n = reduce(np.add, (low.astype(np.int64) + 256 * high.astype(np.int64) for low, high in counts))
        level = np.round(2 * np.log2(np.maximum(n, 1))).astype(np.uint8)
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "n": pa.array([level.tobytes()], pa.binary())})

    out = np.zeros(1 << bits, np.uint8)
    for r in docs.select("text").mapInArrow(tidy(count), "chunk int, n binary").groupBy("chunk").applyInArrow(add, "chunk int, n binary").collect():
        own = np.frombuffer(r.n, np.uint8)
        out[r.chunk * len(own) : (r.chunk + 1) * len(own)] = own
    return np.minimum(out, 63)


def ranked(s: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Shingles as numbers in one order for all sets: those of rare buckets first. 58 bits of the hash stay."""
    rank = rarity[(s >> np.uint64(65 - len(rarity).bit_length())).astype(np.int64)].astype(np.uint64)
    return np.sort(rank << np.uint64(58) | (s & np.uint64((1 << 58) - 1)))


def node_of(keys: np.ndarray) -> int:
    """The number of a set, or of a list of sets: 63 bits of a digest."""
    return int(np.frombuffer(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), np.uint64)[0] & NODE_BITS)


def signature(keys: np.ndarray) -> np.ndarray:
    """A bit for each residue of a set's shingles: whether an odd number of them has it. 64-bit words.

    There are as many bits as shingles at least, a power of 2. A shingle that only one of two sets has turns one bit, so
    the bits that differ are never more than the shingles that differ.
    """
    bits = 1 << max(64 * BRIEF - 1, len(keys) - 1).bit_length()
    odd = np.bincount((keys & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """The signature of fewer bits, for a comparison with one of so many words."""
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def prefix(n: int, percent: int) -> int:
    """So many first shingles of two similar sets have one in common."""
    return n - -(-n * percent // 100) + 1


def _pack(entries: np.ndarray) -> bytes:
    """Index entries, column by column, compressed: a set's entries stand together, so its number repeats."""
    return zstandard.ZstdCompressor(3).compress(b"".join(np.ascontiguousarray(entries[c]).tobytes() for c in ENTRY.names))


def _unpack(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = len(raw) // ENTRY.itemsize
    out, at = np.zeros(n, ENTRY), 0
    for c in ENTRY.names:
        size = n * ENTRY[c].itemsize
        out[c] = np.frombuffer(raw[at : at + size], ENTRY[c])
        at += size
    return out


def _indexed(docs: DataFrame, rarity: np.ndarray, shares: int, percent: int) -> DataFrame:
    """A row per document (share -1) with its set's number, size and signature, and index entries of the sets' prefixes as rows per share."""
    kind = id_type(docs)
    sent = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["share", "doc_id", "node", "n", "signature", "entries"]
        held: list[tuple[np.ndarray, ...]] = []
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            key, node, n, pos = (np.concatenate([h[i] for h in held]) for i in range(4))
            spread = key * np.uint64(0x9E3779B97F4A7C15)
            share = ((spread >> np.uint64(33)) % np.uint64(shares)).astype(np.int64)
            entry = np.zeros(len(key), ENTRY)
            entry["h"], entry["pos"], entry["n"], entry["node"] = (spread & np.uint64(0xFFFFFFFF)).astype(np.uint32), pos, n, node
            order = np.argsort(share, kind="stable")
            entry, share = entry[order], share[order]
            at = np.flatnonzero(np.r_[True, share[1:] != share[:-1]])
            rows = [_pack(entry[a:b]) for a, b in zip(at, [*at[1:], len(share)], strict=True)]
            m = len(rows)
            held.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(share[at], pa.int32()), pa.nulls(m, id_kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.array(rows, pa.binary())], names)

        size = 0
        id_kind = None
        for batch in _batches(batches):
            id_kind = batch.schema.field("doc_id").type
            nodes, sizes, signatures = [], [], []
            for s in shingle_sets(batch.column("text").to_pylist()):
                sizes.append(len(s))
                if not len(s):
                    nodes.append(None)
                    signatures.append(None)
                    continue
                keys = ranked(s, sent.value)
                nodes.append(node_of(keys))
                signatures.append(signature(keys).tobytes())
                if nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    p = prefix(len(s), percent)
                    held.append((keys[:p], np.full(p, nodes[-1], np.uint64), np.full(p, len(s), np.uint32), np.arange(p, dtype=np.uint32)))
                    size += p
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([-1] * m, pa.int32()), batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(signatures, pa.binary()), pa.nulls(m, pa.binary())], names)
            if size > 2_000_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"share int, doc_id {kind}, node long, n int, signature binary, entries binary")


def _lists(rows: pa.Table, percent: int) -> pa.Table:
    """Index lists of more than one set, each entry with the list's first set of which it may be similar.

    Lists are sorted by set size and skipped along: a set is looked up only among the sets at least `percent` of its
    size; entries so far back in both sets that what follows can't reach the needed intersection with any other don't count.
    """
    e = np.concatenate([_unpack(x) for x in rows.column("entries").to_pylist()])
    e = e[np.lexsort((e["node"], e["n"], e["h"]))]
    new = np.r_[True, (e["h"][1:] != e["h"][:-1]) | (e["node"][1:] != e["node"][:-1])]
    e = e[new]
    begins = np.flatnonzero(np.r_[True, e["h"][1:] != e["h"][:-1]])
    sizes = np.diff(np.r_[begins, len(e)])
    gid, nodes, ns, poss, leaders, times = [], [], [], [], [], []
    known: dict[int, int] = {}
    for b, m in zip(begins[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        own = e[b : b + m]
        n, pos = own["n"].astype(np.int64), own["pos"].astype(np.int64)
        # of two similar sets' first common entry, the smaller set's stands early; later entries need an early partner
        rest = n - pos
        early = np.flatnonzero(rest >= _needed(n, n, percent))
        if not len(early):
            continue
        sizes_of = n[early]
        at = np.searchsorted(sizes_of, -(-n * percent // 100))
        partner = sizes_of[np.minimum(at, len(early) - 1)]
        kept = (at < len(early)) & (partner <= n) & (rest >= _needed(np.minimum(partner, n), n, percent))
        kept[early] = True
        if kept.sum() < 2:
            continue
        own, n, pos = own[kept], n[kept], pos[kept]
        m = len(own)
        # equal lists are one that counts as many, here and by gid across shares; each set keeps its foremost place
        same = node_of(own["node"])
        if same in known:
            at = known[same]
            for k, p in enumerate(pos.tolist(), at):
                poss[k] = min(poss[k], p)
                times[k] += 1
            continue
        known[same] = len(gid)
        first = 0
        lead = []
        for k in range(m):
            while 100 * n[first] < percent * n[k]:  # block skip: sizes below can't come back
                first += 1
            lead.append(int(own["node"][first]))
        gid += [same] * m
        nodes += own["node"].tolist()
        ns += n.tolist()
        poss += pos.tolist()
        leaders += lead
        times += [1] * m
    return pa.table({"gid": pa.array(gid, pa.int64()), "node": pa.array(nodes, pa.int64()), "n": pa.array(ns, pa.int64()), "pos": pa.array(poss, pa.int64()), "leader": pa.array(leaders, pa.int64()), "times": pa.array(times, pa.int64())})


def components(links: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """node and component (its least node) for the nodes of links (a, b) and of state, an earlier result that they add to.

    Links become those between components of state. Each round every node goes to its least neighbour, then to where
    that one goes, after STEPWISE rounds on to the end. Links then join what their nodes went to, so what has become one
    and links of equal ends are not read again. Rounds are written; the last one's places go back through those before.
    """

    def moved(pairs: DataFrame, to: DataFrame) -> DataFrame:
        """Pairs whose nodes are replaced by what they have in to (node, up), each pair once, without those of one node."""
        for c in "ab":
            pairs = pairs.join(to.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}")), c, "left")
        a, b = F.coalesce("up_a", "a"), F.coalesce("up_b", "b")
        return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()

    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = written(pairs.distinct() if state is None else moved(pairs, state.withColumnRenamed("component", "up")))
    rounds = []
    while pairs.limit(1).count():
        both = pairs.union(pairs.select("b", "a"))
        to = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("up")).withColumnRenamed("a", "node"))
        far = True
        while far:
            then = to.select(F.col("node").alias("up"), F.col("up").alias("further"))
            to = written(to.join(then, "up").select("node", F.col("further").alias("up"), (F.col("further") != F.col("up")).alias("far")))
            far = len(rounds) >= STEPWISE and to.where("far").limit(1).count() > 0
        rounds.append(to.select("node", "up"))
        pairs = written(moved(pairs, rounds[-1]))
    if not rounds:
        return written(pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))) if state is None else state
    last = rounds.pop()
    while rounds:
        then = last.select(F.col("node").alias("up"), F.col("up").alias("further"))
        last = written(rounds.pop().join(then, "up", "left").select("node", F.coalesce("further", "up").alias("up")))
    if state is None:
        return last.withColumnRenamed("up", "component")
    then = last.select(F.col("node").alias("component"), F.col("up").alias("further"))
    old = state.join(then, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
    new = last.join(state.select("node"), "node", "left_anti").withColumnRenamed("up", "component")
    return written(old.unionByName(new))


def _signatures(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, signature and its brief form in BRIEF columns for the sets of nodes (node, distinct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            brief = np.array([folded(np.frombuffer(x, "<u8"), BRIEF) for x in batch.column("signature").to_pylist()], np.uint64).reshape(-1, BRIEF)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c.view(np.int64)) for c in np.ascontiguousarray(brief.T))], [*batch.schema.names, *(f"brief{k}" for k in range(BRIEF))])

    own, few = index.where("node is not null").select("node", "signature"), nodes.count() <= BROADCAST_IDS
    if few:
        own = own.join(F.broadcast(nodes), "node", "left_semi")
    own = own.groupBy("node").agg(F.min("signature").alias("signature"))
    if not few:
        own = own.join(nodes, "node", "left_semi")
    return own.mapInArrow(tidy(run), "node long, signature binary, " + ", ".join(f"brief{k} long" for k in range(BRIEF)))


def _within(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Of pairs (a, b, most) those whose signatures differ in at most `most` bits."""
    for c in "ab":
        pairs = pairs.join(signatures.select(F.col("node").alias(c), F.col("signature").alias(f"of_{c}")), c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, most in zip(*(batch.column(c).to_pylist() for c in ("of_a", "of_b", "most")), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                size = min(len(x), len(y))
                keep.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= most)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "most", "of_a", "of_b").mapInArrow(tidy(run), "a long, b long")


def _keyed(docs: DataFrame, rarity: np.ndarray) -> DataFrame:
    """node and keys of the set of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            keys = [ranked(s, sent.value) for s in shingle_sets(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(k) for k in keys], pa.int64()), pa.array([k.tobytes() for k in keys], pa.binary())], ["node", "keys"])

    return docs.select("text").mapInArrow(tidy(run), "node long, keys binary")


class Compared:
    """Pairs of sets that have been compared, in either order once, and the sets read for that."""

    def __init__(self, docs: DataFrame, members: DataFrame, rarity: np.ndarray, percent: int) -> None:
        self.docs, self.members, self.rarity, self.percent = docs, members, rarity, percent
        self.found: list[DataFrame] = []
        self.sets: list[DataFrame] = []

    def all(self) -> DataFrame:
        """a, b, n_a, n_b, common."""
        return reduce(DataFrame.unionByName, self.found)

    def links(self) -> DataFrame:
        """a, b of the similar ones of the pairs that were added last."""
        return self.found[-1].where(similar(F.col("n_a"), F.col("n_b"), F.col("common"), self.percent)).select("a", "b")

    def add(self, pairs: DataFrame) -> None:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.found:
            pairs = pairs.join(self.all().select("a", "b"), ["a", "b"], "left_anti")
        pairs = written(pairs)
        self._read(pairs)
        self.found.append(written(_overlaps(pairs, reduce(DataFrame.unionByName, self.sets))))

    def _read(self, pairs: DataFrame) -> None:
        """Makes the sets that aren't there yet, each from one document that has it.

        Sets that only rows without a doc_id have are found by making all of those rows' sets.
        """
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        for known in self.sets:
            nodes = nodes.join(known.select("node"), "node", "left_anti")
        one = written(self.members.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(nodes, "node", "left_semi"))
        wanted = one.where(F.col("doc_id").isNotNull()).select("doc_id")
        n = wanted.count()
        if n or not self.sets:
            self.sets.append(written(_keyed(self.docs.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, "doc_id", "left_semi"), self.rarity)))
        unnamed = one.where(F.col("doc_id").isNull()).select("node")
        if unnamed.limit(1).count():
            rest = _keyed(self.docs.where(F.col("doc_id").isNull()), self.rarity).join(unnamed, "node", "left_semi")
            self.sets.append(written(rest.dropDuplicates(["node"])))


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, common for each pair (a, b) of sets, a < b.

    Of a pair the set that is in more pairs is read once for each PASSING of its partners; the others pass by.
    """
    degree = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count("*").alias("k"))
    placed = pairs
    for c in "ab":
        placed = placed.join(degree.select(F.col("node").alias(c), F.col("k").alias(f"k_{c}")), c)
    turned = F.col("k_b") > F.col("k_a")
    placed = placed.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("other"), F.ceil(F.greatest("k_a", "k_b") / PASSING).alias("salts"))
    placed = written(placed.select("hub", "other", F.pmod(F.xxhash64("other"), F.col("salts")).alias("salt")))
    small = F.broadcast if placed.count() <= BROADCAST_IDS else lambda df: df  # sets stay where they are
    others = small(placed).join(sets.withColumnRenamed("node", "other"), "other").select("hub", "other", "salt", "keys")
    own = small(placed.select("hub", "salt").distinct()).join(sets.withColumnRenamed("node", "hub"), "hub").select("hub", F.lit(None).cast("long").alias("other"), "salt", "keys")
    dealt = own.unionByName(others).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("other").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for hub, other, keys in zip(*(batch.column(c).to_pylist() for c in ("hub", "other", "keys")), strict=True):
                keys = np.frombuffer(keys, np.uint64)
                if other is None:
                    held, first = hub, keys
                elif hub == held:
                    at = np.searchsorted(first, keys)
                    at[at == len(first)] = 0
                    sides = sorted([(hub, len(first)), (other, len(keys))])
                    out.append((sides[0][0], sides[1][0], sides[0][1], sides[1][1], int((first[at] == keys).sum())))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "n_a", "n_b", "common"])

    return dealt.select("hub", "other", "keys").mapInArrow(tidy(run), "a long, b long, n_a long, n_b long, common long")


def similar(n: Column, m: Column, common: Column, percent: int = PERCENT) -> Column:
    return 100 * common >= percent * (n + m - common)


def _tries(signed: DataFrame, known: DataFrame, brief: list[str], turn: int, may: Column, differ: Column, apart: Column) -> DataFrame:
    """a, b, most: for each component those few pairs with a set of another that its lists' hubs make most likely.

    A list has a hub for each residue of a hash, so at most HUBS of them; another each turn, half of them of the largest
    components. Smaller components look at hubs of larger ones. Pairs are chosen among those that may be similar and
    aren't known; the fewer bits of their brief signatures differ, the likelier.
    """
    columns = ("node", "n", "pos", "component", "size", *brief)
    dealt = signed.withColumn("k", F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(HUBS)))
    first = F.struct(F.when(F.col("k") % 2 == 0, -F.col("size")).otherwise(0).alias("large"), F.xxhash64(F.lit(turn), "node").alias("h"), *columns)
    hubs = dealt.groupBy("gid", "k").agg(F.min(first).alias("hub"))
    upward = (F.col("size_y") < F.col("size_x")) | ((F.col("size_y") == F.col("size_x")) & (F.col("component_y") < F.col("component_x")))
    hubs = hubs.select("gid", *(F.col(f"hub.{c}").alias(f"{c}_x") for c in columns))
    others = signed.select("gid", *(F.col(c).alias(f"{c}_y") for c in columns))
    pairs = others.join(hubs, "gid").where(upward & may).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"), "component_y", "node_x", differ.alias("differ"), apart.alias("most"))
    pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
    best = pairs.groupBy("component_y", F.pmod(F.xxhash64("node_x"), F.lit(TRIES)).alias("k")).agg(F.min(F.struct("differ", "a", "b", "most")).alias("best"))
    return best.select("best.a", "best.b", "best.most").distinct()


def grouped(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id that links of at least `percent` reach).

    docs needs doc_id (an integer) and text. Null texts and those without words have no shingles and no links. A null
    doc_id is linked like others, but never names a component unless all of its ids are null. Repeated rows have equal
    sets and so one component.

    Equal sets are one node. Of each node the prefix in the order of rarity is indexed. A first round compares each set
    of an index list with the list's first set of fitting size, if they share much of their prefixes; sets that those
    links connect need no further comparison. In some more rounds each component is compared with the few sets of others
    that are likeliest similar, by signature, among some sets of its lists: so a group of many sets becomes one component
    by a few comparisons of each. Lists that still hold several components are then paired, across components only. A pair is skipped if
    its places in the lists can't reach the needed intersection, if the sets' signatures differ in more bits than
    similar sets' shingles, or if what is known of both against the first set rules a link out; it is linked unread if that proves a link, and is compared otherwise. So every link between components is found, whatever the order.
    """
    ids = docs.select("doc_id", "text")
    rarity = sketch(ids)
    shares = 2 * parts(ids, each=8 << 20)
    index = written(_indexed(ids, rarity, shares, percent))
    members = index.where("share = -1").select("doc_id", F.col("node"), F.col("n").cast("long").alias("n_shingles"))
    lists = written(index.where("share >= 0").select("share", "entries").groupBy("share").applyInArrow(lambda t: _lists(t, percent), "gid long, node long, n long, pos long, leader long, times long").groupBy("gid", "node").agg(F.min("n").alias("n"), F.min("pos").alias("pos"), F.min("leader").alias("leader"), F.sum("times").alias("times")))
    alpha = F.expr(f"(({percent} * (n_x + n_y) + {99 + percent}) div {100 + percent})")
    beyond = F.expr(f"greatest((n_x * {percent} + 99) div 100, (n_y * {percent} + 99) div 100) - 1")  # what one of them has after its prefix
    hopeful = (9 * F.col("shared") + beyond >= alpha) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
    leading = lists.where("node = leader").select("gid", F.col("leader"), F.col("n").alias("n_x"))
    star = lists.where("node <> leader").join(leading, ["gid", "leader"]).select(F.col("leader").alias("node_x"), F.col("node").alias("node_y"), "n_x", F.col("n").alias("n_y"), "times")
    compared = Compared(ids, members, rarity, percent)
    sums = star.groupBy("node_x", "node_y", "n_x", "n_y").agg(F.sum("times").alias("shared"))
    compared.add(sums.where(hopeful).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")))
    brief = [f"brief{k}" for k in range(BRIEF)]
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in brief))
    apart = F.col("n_x") + F.col("n_y") - 2 * alpha  # shingles that only one of two similar sets has, at most
    reaches = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) >= alpha
    may = (F.col("component_x") != F.col("component_y")) & reaches & (differ <= apart) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
    open_lists, signatures, state, linked = lists, None, None, 0
    for turn in range(ROUNDS + 1):
        state = components(compared.links(), state)
        sized = state.join(state.groupBy("component").agg(F.count("*").alias("size")), "component")
        placed = open_lists.drop("component", "size").join(sized, "node", "left").withColumns({"component": F.coalesce("component", "node"), "size": F.coalesce("size", F.lit(1))})
        mixed = placed.groupBy("gid").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("gid")
        open_lists = written(placed.join(mixed, "gid", "left_semi"))
        if signatures is None:
            signatures = written(_signatures(index, open_lists.select("node").distinct()))
        signed = open_lists.join(signatures.select("node", *brief), "node")
        before, linked = linked, state.count()
        if turn == ROUNDS or turn and linked <= 1.003 * before:
            break
        compared.add(_within(_tries(signed, compared.all(), brief, turn, may, differ, apart), signatures))
    found = compared.all()
    x, y = (signed.select("gid", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "pos", "leader", "component", *brief))) for s in "xy")
    first_of = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("node_x") < F.col("node_y")))
    pairs = x.join(y, (x.gid == y.gid) & first_of & may).select("node_x", "node_y", "n_x", "n_y", F.when(F.col("leader_x") == F.col("leader_y"), F.col("leader_x")).alias("leader"))
    pairs = pairs.groupBy("node_x", "node_y", "n_x", "n_y").agg(F.min("leader").alias("leader"))
    known = found.select(F.col("a").alias("leader"), F.col("b"), F.col("n_a").alias("n_leader"), "common")
    known = known.union(found.select(F.col("b"), F.col("a"), F.col("n_b"), "common"))
    of = lambda s: known.select("leader", F.col("b").alias(f"node_{s}"), F.col("common").alias(f"common_{s}"), *([F.col("n_leader")] if s == "x" else []))
    pairs = pairs.join(of("x"), ["leader", "node_x"], "left").join(of("y"), ["leader", "node_y"], "left")
    most = F.least("common_x", "common_y") + F.least(F.col("n_x") - F.col("common_x"), F.col("n_y") - F.col("common_y"))
    least = F.col("common_x") + F.col("common_y") - F.col("n_leader")
    pairs = written(pairs.select(F.col("node_x").alias("a"), F.col("node_y").alias("b"), apart.alias("most"), F.coalesce(most < alpha, F.lit(False)).alias("never"), F.coalesce(least >= alpha, F.lit(False)).alias("proved")))
    compared.add(_within(pairs.where("not never and not proved"), signatures))
    state = components(compared.links().union(pairs.where("proved and not never").select("a", "b")), state)
    own = members.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    linked_nodes = own.join(state, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    salted = linked_nodes.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked_nodes = written(linked_nodes.select("node", "component", "salt").join(salted, ["component", "salt"]).select("node", "component_id"))
    named = written(own.join(linked_nodes, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id")))
    return members.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of each group of near duplicates the row with the least doc_id, with the columns of docs. Documents without
    words stay; so do rows with a null doc_id, which can't be told apart. docs needs distinct doc_id values otherwise."""
    gone = grouped(docs, percent).where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
