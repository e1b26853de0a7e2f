"""Language identification by cross-parsing: whose sample covers a text with the fewest longest matches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.llm.common import held_out, id_type, tidy

SAMPLE_BYTES = 32 << 10  # learned text of a language
SAMPLE_DOCS = 64  # documents that it comes from
TABLE_ENTRIES = 1 << 25  # of all languages' automata together, about; with many languages each one's sample is smaller
LEAST_BYTES = 256  # learned text of a language, however many there are
DRAWN = 4096  # characters that are taken of a document
SEGMENT = 512  # symbols that are parsed at a stretch; a phrase never crosses the end
LANES = 1 << 13
UNKNOWN = "und"
KEEP_SCORE = 0.3  # a clear win among few languages; scores fall as languages are added, so the filter doesn't use it

IS_LETTER = np.zeros(256, bool)
IS_LETTER[128:] = True
for _b in range(26):
    IS_LETTER[ord("a") + _b] = True


def symbols(text: str) -> np.ndarray:
    """Bytes of the text in lower case, each run of ASCII characters that aren't letters as one space."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    letter = IS_LETTER[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, raw, 32)[keep].astype(np.uint8)


class SuffixAutomaton:
    """The least automaton of all substrings of a text, as a table for greedy parsing.

    step[state * width + symbol]: twice the next state times the width, plus 1 if a new phrase begins. Symbol 0 pads
    and changes nothing, symbol 1 stands for bytes that the text doesn't have; own: the text's symbol of each byte.
    """

    def __init__(self, text: bytes) -> None:
        known = sorted({*text})
        width = len(known) + 2
        code = np.ones(256, np.int64)
        code[known] = np.arange(2, width)
        self.own = np.r_[np.int32(0), code.astype(np.int32)]  # by the byte plus 1; 0 pads
        to: list[dict[int, int]] = [{}]
        link, size, last = [-1], [0], 0
        for s in code[np.frombuffer(text, np.uint8)].tolist():
            new = len(to)
            to.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and s not in to[p]:
                to[p][s] = new
                p = link[p]
            if p >= 0:
                q = to[p][s]
                if size[q] == size[p] + 1:
                    link[new] = q
                else:
                    twin = len(to)
                    to.append(dict(to[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p >= 0 and to[p].get(s) == q:
                        to[p][s] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        root = np.ones(width, np.int64)  # a symbol unknown at the root is a phrase of its own
        for s, t in to[0].items():
            root[s] = 2 * t * width + 1
        step = np.repeat(root[None], len(to), 0)
        for state, out in enumerate(to):
            for s, t in out.items():
                step[state, s] = 2 * t * width
            step[state, 0] = 2 * state * width
        # the first symbol of a segment begins a phrase
        step[0, 1:] |= 1
        self.step = step.astype(np.int32 if step.max() < 1 << 31 else np.int64).ravel()

    def phrases(self, lanes: np.ndarray) -> np.ndarray:
        """lanes: bytes plus 1 (0 pads) x segments. The phrases of each segment."""
        state = np.zeros(lanes.shape[1], self.step.dtype)
        count = np.zeros(lanes.shape[1], np.int32)
        for row in lanes:
            v = self.step[state + self.own[row]]
            count += v & 1
            state = v >> 1
        return count


class Model:
    def __init__(self, samples: tuple[tuple[str, bytes], ...]) -> None:
        self.languages = [name for name, _ in samples]
        self.automata = [SuffixAutomaton(t) for _, t in samples]
        self.bits = np.array([math.log2(max(2, len(t))) for _, t in samples])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lettered = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        names, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages or not lettered:
            return names, sure
        coded = [symbols(texts[k]) for k in lettered]
        sizes = np.array([len(c) for c in coded])
        n_segments = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(coded)), n_segments)
        first = np.cumsum(n_segments) - n_segments
        flat = np.zeros(int(n_segments.sum()) * SEGMENT, np.int16)
        for c, f in zip(coded, first.tolist(), strict=True):
            flat[f * SEGMENT : f * SEGMENT + len(c)] = c.astype(np.int16) + 1
        segments = flat.reshape(-1, SEGMENT)
        counts = np.zeros((len(self.languages), len(coded)))
        for at in range(0, len(segments), LANES):
            lanes = np.ascontiguousarray(segments[at : at + LANES].T)
            for j, automaton in enumerate(self.automata):
                counts[j] += np.bincount(owner[at : at + LANES], weights=automaton.phrases(lanes), minlength=len(coded))
        cost = counts * self.bits[:, None] / np.maximum(sizes, 1)  # bits per symbol
        best = cost.argmin(0)
        weight = (cost.min(0) / np.maximum(cost, 1e-9)) ** 8
        share = 1 / weight.sum(0)
        for k, b, s in zip(lettered, best.tolist(), share.tolist(), strict=True):
            names[k], sure[k] = self.languages[b], float(min(1.0, s))
        return names, sure


@cache
def model(samples: tuple[tuple[str, bytes], ...]) -> Model:
    return Model(samples)


def learn(rows: DataFrame, sample_bytes: int = SAMPLE_BYTES, sample_docs: int = SAMPLE_DOCS) -> tuple[tuple[str, bytes], ...]:
    """For each language of rows (lang, text) a sample of at most sample_bytes from DRAWN characters of each of at most
    sample_docs documents. With many languages samples are smaller, so that all automata stay within about TABLE_ENTRIES
    entries (of 4 bytes) as long as LEAST_BYTES of each allow it.

    Documents are chosen by the hash of their text: all different texts of a language share one chance, about three times
    sample_docs of them are drawn, the least hashes stay. Copies of a text and repeated lines count once.
    """
    labelled = rows.where(F.col("lang").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) > 0)).select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count_distinct("h").alias("n")).collect()}
    if not sizes:
        return ()
    chance = F.create_map(*(F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, 3.0 * sample_docs / n))))
    drawn = labelled.where(F.pmod("h", F.lit(1 << 20)) < F.element_at(chance, F.col("lang")) * (1 << 20))
    drawn = drawn.select("lang", "h", F.substring("text", F.lit(1) + F.pmod("h", F.greatest(F.length("text") - 2048, F.lit(1))).cast("int"), F.lit(DRAWN)).alias("text"))
    drawn = drawn.dropDuplicates(["lang", "h"])
    lists = drawn.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "text"))), 1, sample_docs).alias("texts")).collect()
    out = []
    for r in sorted(lists, key=lambda r: r["lang"]):
        lines = dict.fromkeys(x for t in r["texts"] for x in t["text"].split("\n"))
        text = symbols(" ".join(lines)).tobytes()[:sample_bytes]
        most = TABLE_ENTRIES // (2 * len(sizes) * (len({*text}) + 2))  # an automaton has up to two states a byte
        out.append((r["lang"], text[: max(LEAST_BYTES, most)]))
    return tuple(x for x in out if x[1])


def predicted(docs: DataFrame, samples: tuple[tuple[str, bytes], ...]) -> DataFrame:
    """docs with the columns lang_pred and score (0 to 1, how clearly the language wins).

    docs needs a column text. Null texts and those without a letter are `und` with score 0, as all are if nothing was
    learned. Equal costs go to the language that sorts first. Other columns and repeated rows stay; columns of those
    two names are replaced.
    """
    return _predicted(docs.drop("lang_pred", "score"), samples, lambda batch: batch.column("text"))


def _predicted(docs: DataFrame, samples: tuple[tuple[str, bytes], ...], text_of: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                names, sure = model(samples).predict(text_of(part).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(sure, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(tidy(run), f"{fields}, lang_pred string, score double")


def identified(docs: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score; learns from what isn't held out.

    docs needs doc_id, text and lang; other columns are left out. Rows with a null or repeated doc_id stay, each
    predicted for itself; a null id isn't held out. Null texts, texts without a letter, and all texts if there is
    nothing to learn from are `und` with score 0.
    """
    rows = docs.select("doc_id", "text", "lang", held_out("doc_id", modulus, remainder).alias("held_out"))
    samples = learn(rows.where(~F.col("held_out")))
    return predicted(rows.select("doc_id", "held_out", "text"), samples).select(F.col("doc_id").cast(id_type(docs)), "held_out", "lang_pred", "score")


def with_language(docs: DataFrame) -> DataFrame:
    """The documents of docs in which a learned language is found, with the columns of docs. How clearly it wins isn't
    asked: the score depends on how many languages, or labels of one language, are learned."""
    rows = docs.select(F.struct(*docs.columns).alias("_kept"))
    found = _predicted(rows, learn(docs), lambda batch: pc.struct_field(batch.column("_kept"), "text"))
    return found.where(F.col("lang_pred") != UNKNOWN).select("_kept.*")
