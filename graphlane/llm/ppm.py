"""Language-model scores: prediction by partial matching over bytes, beside a base model of words."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.llm.common import block_of, held_out, id_type, parts, written

ORDER = 5  # bytes of the longest context
NEAREST = 3  # bytes of context by which keys are dealt to shares; counts of shorter contexts go to all tasks
START, END = 0xFE, 0xFF  # bytes that UTF-8 never has: what stands before a text, and the symbol that ends it
SYMBOLS = 256
DOC_BITS = 64 - 8 * (ORDER + 1)
CHUNK_BYTES = 1 << 22
BLOCK_BYTES = 6 << 20  # stored bytes of a block of documents, about 10 MB of text
PIECES = 16  # in which the counts of short contexts are summed


def keys(texts: list[bytes]) -> np.ndarray:
    """For each symbol of each text its key with the text's index in the low bits.

    A key is the context, nearest byte first, and then the symbol: sorted keys are the trie of contexts in order.
    """
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join(bytes([START]) * ORDER + t + bytes([END]) for t in texts), np.uint8).astype(np.uint64)
    n = len(raw)
    out = raw[ORDER:].copy()
    for j in range(1, ORDER + 1):
        out |= raw[ORDER - j : n - j] << np.uint64(8 * (ORDER + 1 - j))
    begins = np.cumsum(sizes + ORDER)[:-1]
    own = np.ones(len(out), bool)  # a text's last ORDER places would see the next text's beginning
    for j in range(1, ORDER + 1):
        own[begins - j] = False
    return out[own] << np.uint64(DOC_BITS) | np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)


def runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted keys of some texts at a time, each with its text's index in the low bits, counted from the first text, whose index comes along."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES or i - first + 1 == 1 << DOC_BITS or i + 1 == len(texts):
            k = keys(texts[first : i + 1])
            k.sort()
            yield first, k
            first, size = i + 1, 0


def block_counts(texts: list[bytes], learn: np.ndarray, sorted_chunks: list[tuple[int, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a block, and how often each occurs in the texts to learn from."""
    found = []
    for first, both in sorted_chunks if sorted_chunks is not None else chunks(texts):
        k = both >> np.uint64(DOC_BITS)
        at = runs(k)
        doc = (both & np.uint64((1 << DOC_BITS) - 1)).astype(np.int32)
        found.append((k[at], np.add.reduceat(learn[first:][doc].astype(np.int64), at)))
    return summed(*(np.concatenate([np.zeros(0, kind), *(f[i] for f in found)]) for i, kind in enumerate((np.uint64, np.int64))))


def summed(k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(k, kind="stable")
    k = k[order]
    at = runs(k)
    return k[at], np.add.reduceat(c[order], at) if len(at) else c[:0]


def log_probabilities(k: np.ndarray, c: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the probability of each key's symbol in its context.

    k: sorted distinct keys that hold, for each of their contexts of NEAREST bytes, all keys there are; c: their counts.
    low: the same over all contexts of fewer bytes, of NEAREST - 1, from all documents. In a context with n symbols learned, d of them
    distinct, a symbol seen c times has (c - 1/2) / n and the rest, d / 2n, goes to the context that is one byte
    shorter; there, symbols that the longer one knows are left out of n and d. What no context knows is uniform over
    the symbols that are left.
    """
    zero = np.bincount((low[0] & np.uint64(255)).astype(np.int64), weights=low[1], minlength=SYMBOLS)
    known0 = zero > 0
    d0 = known0.sum()
    down = np.full(SYMBOLS, 1.0 / max(1, SYMBOLS - d0))  # probability after escaping from order 0
    levels = [summed(_shorten(low[0], NEAREST - 1 - order), low[1]) for order in range(1, NEAREST)]
    for order in range(NEAREST, ORDER + 1):
        levels.append(summed(_shorter(k, order), c) if order < ORDER else (k, c))
    up_k, up_c, up_g = np.arange(SYMBOLS, dtype=np.uint64), zero, np.where(known0, 0.0, down)
    for order, (lk, lc) in enumerate(levels, 1):
        context = lk >> np.uint64(8)
        parent = ((context >> np.uint64(8)) << np.uint64(8)) | (lk & np.uint64(255)) if order > 1 else lk & np.uint64(255)
        at = np.searchsorted(up_k, parent)
        pc, pg = up_c[at], up_g[at]
        parent_context = up_k >> np.uint64(8)
        begin = runs(parent_context)
        pn, pd = np.add.reduceat(up_c, begin), np.add.reduceat((up_c > 0).astype(np.int64), begin)
        row = np.searchsorted(parent_context[begin], parent >> np.uint64(8))
        pn, pd = pn[row], pd[row]
        own = runs(context)
        size = np.diff(np.r_[own, len(lk)])
        seen = lc > 0
        left_n = pn - np.repeat(np.add.reduceat(np.where(seen, pc, 0), own), size)
        left_d = pd - np.repeat(np.add.reduceat(seen.astype(np.int64), own), size)
        total = np.maximum(left_n, 1e-300)
        g = np.where(pc > 0, (pc - 0.5) / total, np.where(left_d > 0, 0.5 * left_d / total, 1.0) * pg)
        up_k, up_c, up_g = lk, lc, g
    context = up_k >> np.uint64(8)
    own = runs(context)
    size = np.diff(np.r_[own, len(up_k)])
    n = np.repeat(np.add.reduceat(up_c, own), size)
    d = np.repeat(np.add.reduceat((up_c > 0).astype(np.int64), own), size)
    p = np.where(up_c > 0, (up_c - 0.5) / np.maximum(n, 1), np.where(d > 0, 0.5 * d / np.maximum(n, 1), 1.0) * up_g)
    return np.log10(p)


def _shorten(k: np.ndarray, by: int) -> np.ndarray:
    """Keys without the farthest `by` bytes of their contexts."""
    return (k >> np.uint64(8 * (by + 1))) << np.uint64(8) | (k & np.uint64(255))


def _shorter(k: np.ndarray, order: int) -> np.ndarray:
    """Keys with only the nearest `order` bytes of context."""
    return _shorten(k, ORDER - order)


def _texts(column) -> list[bytes]:
    return [(t or "").encode().lower() for t in column.to_pylist()]


def _tokens(texts: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Distinct words in order, and each text's words as places in that order."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    own = [np.fromiter(map(number.__getitem__, t.split()), np.int32) for t in texts]
    words = sorted(number)
    place = np.empty(len(words), np.int32)
    place[np.fromiter(map(number.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
    return words, [place[x] for x in own]


def _positions(share: np.ndarray) -> dict[int, np.ndarray]:
    """Positions of each share, by one sort."""
    order = np.argsort(share.astype(np.uint16) if share.max(initial=0) < 1 << 16 else share, kind="stable")
    s = share[order]
    at = runs(s)
    return {int(s[a]): order[a:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(s)], strict=True)}


NO_PLACES = np.zeros(0, np.int64)


def _dealt(words: list[bytes], k: np.ndarray, shares: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Positions of words and of keys by their share: words by their hash, keys by their last NEAREST bytes."""
    of_word = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shares
    of_key = (((k >> np.uint64(8 * (ORDER + 1 - NEAREST))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shares
    return _positions(of_word), _positions(of_key)


def _ints(x: np.ndarray, kind: str = "<i8") -> bytes:
    return x.astype(kind).tobytes()


def scores(docs: DataFrame, modulus: int = 7, remainder: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs needs doc_id and text; other columns are left out. Learns from all documents whose crc32 of the id isn't
    `remainder` modulo `modulus`, those without an id too. Null and empty texts have just the end. Repeated rows are
    learned and scored each for itself. No rows give no rows. Probabilities travel as logarithms of 32 bits: a score is
    right to about 1e-7 of itself.

    Documents meet in blocks by hash. Each block deals its distinct words and contexts with their counts to shares by
    hash, and each share sums them and answers each block for what the block asked. So no task holds more than a
    block's or a share's part, and nothing that grows with the corpus is broadcast: that are only the counts of single
    bytes after two bytes, in 12 bytes each: 256**3 at most, and far fewer in UTF-8 (11,000 in 13 MB of prose).
    """
    blocks = parts(docs.select("doc_id", "text"), each=block_bytes)
    shares = max(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))
    df = docs.select("doc_id", "text", held_out("doc_id", modulus, remainder).alias("held_out"), block_of(blocks).alias("block")).repartitionById(blocks, F.col("block"))
    kind = id_type(docs)

    def gather(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        learn = ~np.array(rows.column("held_out").to_pylist(), bool)
        texts = _texts(rows.column("text"))
        words, own = _tokens(texts)
        n = np.zeros(len(words), np.int64)
        for x, yes in zip(own, learn.tolist(), strict=True):
            if yes and len(x) > len(n) >> 4:
                n += np.bincount(x, minlength=len(n))
        few = np.concatenate([NO_PLACES, *(x for x, yes in zip(own, learn.tolist(), strict=True) if yes and len(x) <= len(n) >> 4)])
        n += np.bincount(few, minlength=len(n))
        k, c = block_counts(texts, learn)
        by_word, by_key = _dealt(words, k, shares)
        low = summed(_shorter(k, NEAREST - 1), c)
        piece = low[0] % np.uint64(PIECES)
        # shares below 0: pieces of the counts of short contexts; the ends of texts to learn from come with the first
        out = [(-1 - j, b"", _ints(np.array([learn.sum() * (j == 0)])), low[0][piece == j].astype("<u4").tobytes(), _ints(low[1][piece == j])) for j in range(PIECES)]
        for s in sorted(by_word.keys() | by_key.keys()):
            w, x = by_word.get(s, NO_PLACES), by_key.get(s, NO_PLACES)
            out.append((s, b" ".join([words[i] for i in w.tolist()]), _ints(n[w], "<i4"), k[x].tobytes(), _ints(c[x], "<i4")))
        cols = list(zip(*out, strict=True))
        return pa.table({"block": pa.array([key[0].as_py()] * len(out), pa.int32()), "share": pa.array(cols[0], pa.int32()), **{m: pa.array(x, pa.binary()) for m, x in zip(("words", "n", "keys", "c"), cols[1:], strict=True)}})

    asked = written(df.groupBy("block").applyInArrow(gather, "block int, share int, words binary, n binary, keys binary, c binary"))

    def fold(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        n = sum(int(np.frombuffer(x, "<i8")[0]) for x in rows.column("n").to_pylist())
        k, c = (np.concatenate([np.frombuffer(x, t) for x in rows.column(m).to_pylist()]) for m, t in (("keys", "<u4"), ("c", "<i8")))
        k, c = summed(k, c)
        return pa.table({"share": pa.array([key[0].as_py()], pa.int32()), "n": [_ints(np.array([n]))], "keys": [k.astype("<u4").tobytes()], "c": [_ints(c)]})

    folded = "share int, n binary, keys binary, c binary"
    salted = asked.where("share < 0").select("share", "n", "keys", "c", F.pmod("block", F.lit(64)).alias("salt"))
    pieces = salted.groupBy("share", "salt").applyInArrow(fold, folded).groupBy("share").applyInArrow(fold, folded).collect()  # PIECES rows
    low = summed(*(np.concatenate([np.zeros(0, t), *(np.frombuffer(r[m], t) for r in pieces)]) for m, t in (("keys", "<u4"), ("c", "<i8"))))
    low = low[0].astype(np.uint64), low[1]
    ends = sum(int(np.frombuffer(r.n, "<i8")[0]) for r in pieces)
    sent = docs.sparkSession.sparkContext.broadcast(low)

    def answer(rows: pa.Table) -> pa.Table:
        total: Counter[bytes] = Counter()
        asked_words = [x.split() for x in rows.column("words").to_pylist()]
        for words, n in zip(asked_words, rows.column("n").to_pylist(), strict=True):
            for w, c in zip(words, np.frombuffer(n, "<i4").tolist(), strict=True):
                total[w] += c
        own = [np.frombuffer(x, np.uint64) for x in rows.column("keys").to_pylist()]
        k, c = summed(np.concatenate(own), np.concatenate([np.frombuffer(x, "<i4") for x in rows.column("c").to_pylist()]).astype(np.int64))
        p = log_probabilities(k, c, sent.value) if len(k) else np.zeros(0)
        values = np.fromiter(total.values(), np.int64, len(total))
        # the share's own tokens and distinct tokens ride on its first row, for the sums over all shares
        extra = [int(values.sum()), int((values > 0).sum())]
        first = [1] + [0] * (rows.num_rows - 1)
        return pa.table(
            {
                "block": rows.column("block"),
                "share": rows.column("share"),
                "n": pa.array([_ints(np.fromiter(map(total.__getitem__, w), np.int64, len(w))) for w in asked_words], pa.binary()),
                "p": pa.array([p[np.searchsorted(k, x)].astype("<f4").tobytes() for x in own], pa.binary()),
                "tokens": pa.array([extra[0] * f for f in first], pa.int64()),
                "distinct": pa.array([extra[1] * f for f in first], pa.int64()),
            }
        )

    answers = written(asked.where("share >= 0").groupBy("share").applyInArrow(answer, "block int, share int, n binary, p binary, tokens long, distinct long"))
    sums = answers.agg(F.sum("tokens"), F.sum("distinct")).first()
    train_tokens, distinct = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)
    denominator = train_tokens + distinct + 1

    def score(rows: pa.Table, said: pa.Table) -> pa.Table:
        texts = _texts(rows.column("text"))
        learn = np.zeros(len(texts), bool)
        words, own_words = _tokens(texts)
        ordered = list(chunks(texts))
        distinct_keys, _ = block_counts(texts, learn, ordered)
        by_word, by_key = _dealt(words, distinct_keys, shares)
        c, p = np.zeros(len(words) + 1, np.int64), np.zeros(len(distinct_keys), np.float32)
        for s, n, q in zip(*(said.column(m).to_pylist() for m in ("share", "n", "p")), strict=True):
            c[by_word.get(s, NO_PLACES)] = np.frombuffer(n, "<i8")
            p[by_key.get(s, NO_PLACES)] = np.frombuffer(q, "<f4")
        c[-1] = ends
        value = np.log10((c + 1.0) / denominator)
        total = np.zeros(len(texts))
        for first, both in ordered:
            k = both >> np.uint64(DOC_BITS)
            at = runs(k)
            each = np.repeat(p[np.searchsorted(distinct_keys, k[at])], np.diff(np.r_[at, len(k)]))
            own = np.bincount((both & np.uint64((1 << DOC_BITS) - 1)).astype(np.int32), weights=each)
            total[first : first + len(own)] = own
        n_tokens = [len(x) + 1 for x in own_words]
        n_known = [int((c[x] > 0).sum()) + (ends > 0) for x in own_words]
        base = [float(value[x].sum() + value[-1]) for x in own_words]
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "held_out": rows.column("held_out"),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([train_tokens] * len(texts), pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(total, pa.float64()),
            }
        )

    told = answers.select("block", "share", "n", "p").repartitionById(blocks, F.col("block"))
    return df.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
