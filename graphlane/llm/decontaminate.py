"""Benchmark decontamination by winnowing."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.llm.common import Words, member, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD_BYTES = np.array([bool(WORD.fullmatch(bytes([b]))) for b in range(256)])
SPAN, GRAM = 10, 5  # words of a window; words of a hashed k-gram
WINDOW = SPAN - GRAM + 1  # a minimum of so many k-grams: a span of SPAN words always keeps one


def winnow(h: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Positions kept by robust winnowing: the last smallest hash of each `window` consecutive hashes of a group.

    Of a group with fewer hashes its last smallest one is kept.
    """
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    best = np.arange(n)
    for j in range(1, min(window, n)):
        at = np.flatnonzero((group[j:] == group[:-j]) & (h[j:] <= h[best[:-j]]))
        best[at] = at + j
    left = np.repeat(first + size, size) - np.arange(n)  # hashes from here to the group's end
    return np.unique(best[left >= np.minimum(window, np.repeat(size, size))])


class Index:
    """Fingerprints of benchmark items: hash -> places. Items of fewer than SPAN words are kept by their whole hash."""

    def __init__(self, items: list[tuple[str, bytes]]) -> None:
        self.ids = [i for i, _ in items]
        self.words = [WORD.findall(t.lower()) for _, t in items]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        if not items:
            return
        w = Words([t.lower() for _, t in items], WORD_BYTES)
        begin = np.r_[0, np.cumsum(w.counts)]
        h, same = w.grams(GRAM)
        at = np.flatnonzero(same & (w.counts[w.doc[: len(h)]] >= SPAN))
        for p in at[winnow(h[at], w.doc[at], WINDOW)]:
            self.places[int(h[p])].append((int(w.doc[p]), int(p - begin[w.doc[p]])))
        for n in range(1, SPAN):
            for d in np.flatnonzero(w.counts == n):
                self.short[n][int(w.grams(n)[0][begin[d]])].append(int(d))
        self.keys = np.sort(np.fromiter(self.places, np.uint64, len(self.places)))

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[int]]]]:
        """Word counts, and for each text with hits its merged word ranges and the items found."""
        w = Words([t.lower() for t in texts], WORD_BYTES)
        begin = np.r_[0, np.cumsum(w.counts)]
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # text -> (word, item, item's word)
        if self.places:
            h, same = w.grams(GRAM)
            at = np.flatnonzero(same)
            at = at[winnow(h[at], w.doc[at], WINDOW)]
            for p in at[member(h[at], self.keys)]:
                d = int(w.doc[p])
                found[d] += [(int(p - begin[d]), i, q) for i, q in self.places[int(h[p])]]
        for n, items in self.short.items():
            h, same = w.grams(n)
            for p in np.flatnonzero(same & member(h, np.sort(np.fromiter(items, np.uint64, len(items))))):
                d = int(w.doc[p])
                found[d] += [(int(p - begin[d]), i, 0) for i in items[int(h[p])]]
        out = {}
        for d, places in found.items():
            if hit := self.extend(WORD.findall(texts[d].lower()), places):
                out[d] = hit
        return w.counts, out

    def extend(self, words: list[bytes], places: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], set[int]] | None:
        """Grows each place to the longest common run of words; runs of a whole window count."""
        done: dict[tuple[int, int], int] = {}  # item and diagonal -> end of the last run looked at
        ranges, items = [], set()
        for p, i, q in sorted(places):
            item = self.words[i]
            if done.get((i, p - q), -1) > p:
                continue
            a = 0
            while a < min(p, q) and words[p - a - 1] == item[q - a - 1]:
                a += 1
            b = 0
            while p + b < len(words) and q + b < len(item) and words[p + b] == item[q + b]:
                b += 1
            done[i, p - q] = p + b
            if a + b >= min(SPAN, len(item)):
                ranges.append((p - a, p + b))
                items.add(i)
        return (merged(ranges), items) if items else None


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


FOUND = ["n_words", "hit_ranges", "hit_items"]


def overlaps(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """docs with the columns n_words, hit_ranges (array of begin and end in turn) and hit_items (item ids as text).

    docs needs a column text, benchmark the columns item_id and text. The benchmark goes to the executors in blocks of
    about block_bytes of text, each a pass over docs; passes after the first carry on what was found. Null and empty
    texts have no words and no hits; a null item_id counts as an empty id. Other columns of docs stay, but for columns
    of those three names, which are replaced. Repeated rows are judged each for itself.
    """
    total = benchmark.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    df = docs.drop(*FOUND).withColumns({"n_words": F.lit(0).cast("long"), "hit_ranges": F.array().cast("array<int>"), "hit_items": F.array().cast("array<string>")})
    items = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text")
    for k in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "text"), F.lit(blocks)) == k)
        sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r.i, r.text.encode()) for r in mine.collect()]))
        df = df.mapInArrow(_passes(sent), df.schema)
        if k + 1 < blocks:
            df = written(df)
    return df


INDEXES: dict[str, Index] = {}  # the index that this process uses, by its block's name


def _index(name: str, items: list[tuple[str, bytes]]) -> Index:
    if name not in INDEXES:
        INDEXES.clear()
        INDEXES[name] = Index(items)
    return INDEXES[name]


def _passes(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                old_ranges, old_items = (part.column(c).to_pylist() for c in ("hit_ranges", "hit_items"))
                counts, found = index.hits(texts)
                for d, (ranges, items) in found.items():
                    r = old_ranges[d]
                    old_ranges[d] = [x for ab in merged(ranges + list(zip(r[::2], r[1::2], strict=True))) for x in ab]
                    old_items[d] = sorted({*old_items[d], *(index.ids[i] for i in items)})
                new = {"n_words": pa.array(counts, pa.int64()), "hit_ranges": pa.array(old_ranges, pa.list_(pa.int32())), "hit_items": pa.array(old_items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(n, part.column(n)) for n in part.schema.names], part.schema.names)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words. Rows with a null or repeated doc_id stay, each for itself; other columns are left
    out. An empty benchmark hits nothing.
    """
    found = overlaps(docs.select("doc_id", "text"), benchmark, block_bytes)
    ranges = F.col("hit_ranges")
    n_hit = F.aggregate(F.transform(ranges, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_items") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any benchmark window, with all columns of docs as they are, whatever their names. Null
    texts and ids and repeated rows stay."""
    aside = {c: f"own_{c}" for c in docs.columns if c in FOUND}
    left = overlaps(docs.withColumnsRenamed(aside), benchmark).where(F.size("hit_items") == 0)
    return left.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))
