"""Secret scans with one combined deterministic automaton."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Kind, regex, letters in either case, and what a match needs: (part, least bytes).
# part "all": the whole match; "tail": the longest end of the match after its last byte of `:=`-or-quote syntax.
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 11, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("pem", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
]
BASE_KINDS = 3


class Parser:
    """Regexes of bytes -> fragments of a nondeterministic automaton.

    Known: literals, \\xHH and escaped bytes, classes with ranges, groups, |, ?, *, +, {n,} and {n,m}.
    """

    def __init__(self) -> None:
        self.arcs: list[list[tuple[frozenset[int] | None, int]]] = []

    def state(self) -> int:
        self.arcs.append([])
        return len(self.arcs) - 1

    def parse(self, regex: str, fold: int) -> tuple[int, int]:
        """fold: letters of the first so many groups' text count in either case (here: those of group 1 if fold > 0)."""
        self.text, self.at, self.fold = regex, 0, False
        self.fold_groups = fold > 0
        return self.alternatives()

    def alternatives(self) -> tuple[int, int]:
        a, b = self.state(), self.state()
        while True:
            x, y = self.sequence()
            self.arcs[a].append((None, x))
            self.arcs[y].append((None, b))
            if self.at >= len(self.text) or self.text[self.at] != "|":
                return a, b
            self.at += 1

    def sequence(self) -> tuple[int, int]:
        a = b = self.state()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            begin = self.at
            x, y = self.atom()
            end = self.at
            low, high = self.count()
            after = self.at
            for k in range(max(low, 1, high or 0)):
                if k:
                    self.at = begin
                    x, y = self.atom()
                    assert self.at == end
                if k >= low:
                    self.arcs[x].append((None, y))
                if high is None and k + 1 == max(low, 1):
                    self.arcs[y].append((None, x))
                self.arcs[b].append((None, x))
                b = y
            self.at = after
            tail = self.state()
            self.arcs[b].append((None, tail))
            b = tail
        return a, b

    def count(self) -> tuple[int, int | None]:
        c = self.text[self.at] if self.at < len(self.text) else ""
        if c and c in "?*+":
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c == "{":
            end = self.text.index("}", self.at)
            low, comma, high = self.text[self.at + 1 : end].partition(",")
            self.at = end + 1
            return int(low), (int(high) if high else None if comma else int(low))
        return 1, 1

    def atom(self) -> tuple[int, int]:
        c = self.text[self.at]
        if c == "(":
            self.at += 1
            self.fold = self.fold_groups and self.at == 1
            x = self.alternatives()
            self.fold = False
            assert self.text[self.at] == ")"
            self.at += 1
            return x
        if c == "[":
            self.at += 1
            chosen: set[int] = set()
            while self.text[self.at] != "]":
                low = self.byte()
                if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    chosen |= {*range(low, self.byte() + 1)}
                else:
                    chosen.add(low)
            self.at += 1
        else:
            chosen = {self.byte()}
        if self.fold:
            chosen |= {b ^ 32 for b in chosen if chr(b).isalpha()}
        a, b = self.state(), self.state()
        self.arcs[a].append((frozenset(chosen), b))
        return a, b

    def byte(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "\\":
            c = self.text[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)


Arcs = list[list[tuple[frozenset[int] | None, int]]]


def byte_classes(arcs: Arcs) -> np.ndarray:
    """The class of each byte: bytes that no arc tells apart are one. Class 0 holds byte 0, which no rule has."""
    sets = {on for out in arcs for on, _ in out if on is not None}
    number: dict[tuple[bool, ...], int] = {}
    return np.array([number.setdefault(tuple(b in s for s in sets), len(number)) for b in range(256)], np.uint8)


def determinize(arcs: Arcs, classes: np.ndarray, starts: list[int], accept: dict[int, int], anywhere: bool) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction, then minimisation by refining sets of states.

    accept: state -> rule. anywhere: matches may begin at each byte. Returns the transitions (states x classes) and the
    bit mask of accepted rules per state. The start is state 0; a state that can reach nothing more is kept as any other.
    """
    some_byte = {int(c): b for b, c in enumerate(classes.tolist())}
    on_class = [[([c for c, b in some_byte.items() if b in on], to) for on, to in out if on is not None] for out in arcs]
    free = [[to for on, to in out if on is None] for out in arcs]

    def closure(states) -> frozenset[int]:
        todo, seen = [*states], {*states}
        while todo:
            for to in free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    first = closure(starts)
    ids, order, rows = {first: 0}, [first], []
    known: dict[frozenset[int], int] = {}
    for states in order:
        moves: list[set[int]] = [set() for _ in some_byte]
        for s in states:
            for own, to in on_class[s]:
                for c in own:
                    moves[c].add(to)
        row = []
        for move in moves:
            key = frozenset(move)
            if key not in known:
                to = closure(key) | (first if anywhere else frozenset())
                if to not in ids:
                    ids[to] = len(order)
                    order.append(to)
                known[key] = ids[to]
            row.append(known[key])
        rows.append(row)
    table = np.array(rows, np.int64)
    masks = np.array([sum({1 << accept[s] for s in states if s in accept}) for states in order], np.int64)
    kind = np.unique(masks, return_inverse=True)[1].ravel()
    while True:
        new = kind.copy()
        for c in range(table.shape[1]):
            new = np.unique(new * (kind.max() + 1) + kind[table[:, c]], return_inverse=True)[1].ravel()
        if new.max() == kind.max():
            break
        kind = new
    _, pick, number = np.unique(kind, return_index=True, return_inverse=True)
    place = np.argsort(np.argsort(pick))[number.ravel()]  # numbered as first met, so the start keeps number 0
    pick = np.sort(pick)
    return place[table[pick]], masks[pick]


class Automata:
    """The combined automaton over all rules, the same over reversed rules, and one anchored automaton per rule, as arrays.

    Transitions are by byte class. The combined automaton's states that accept a rule have the highest numbers.
    """

    TILE = 1024  # bytes of each text that are laid out side by side
    LANES = 48  # texts below which a step in Python costs less than a step of arrays

    def __init__(self, rules=RULES) -> None:
        self.rules = rules
        parser, starts, accept, flipped = Parser(), [], {}, []
        for k, (_, regex, fold, _) in enumerate(rules):
            a, b = parser.parse(regex, fold)
            starts.append(a)
            accept[b] = k
            flipped.append((a, b))
        self.classes = byte_classes(parser.arcs)
        table, masks = determinize(parser.arcs, self.classes, starts, accept, True)
        order = np.argsort(masks > 0, kind="stable")
        place = np.argsort(order)
        self.table, self.masks = place[table[order]].astype(np.int32), masks[order]
        self.begin, self.accepting = int(place[0]), int((masks == 0).sum())
        self.anchored = [determinize(parser.arcs, self.classes, [a], {b: k}, False) for k, (a, b) in enumerate(flipped)]
        back: Arcs = [[] for _ in parser.arcs]
        for s, out in enumerate(parser.arcs):
            for on, to in out:
                back[to].append((on, s))
        self.backward = determinize(back, self.classes, [b for _, b in flipped], {a: k for k, (a, _) in enumerate(flipped)}, True)
        self.lists: dict = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lists": {}}

    def listed(self, which: str | int) -> tuple[list[list[int]], list[int], int]:
        """Rows by byte, masks and the state that reaches nothing (or -1) of an automaton, for steps in Python."""
        if which not in self.lists:
            table, masks = (self.table, self.masks) if which == "combined" else self.backward if which == "backward" else self.anchored[which]
            own = np.arange(len(table))[:, None]
            dead = np.flatnonzero((table == own).all(1) & (masks == 0))
            self.lists[which] = table[:, self.classes].tolist(), masks.tolist(), int(dead[0]) if len(dead) else -1
        return self.lists[which]

    def ends(self, texts: list[bytes]) -> dict[int, int]:
        """For each text in which rules match the rules whose matches end somewhere in it, as a mask: one pass over all bytes.

        Texts stand side by side, one step of arrays for a byte of each; the ends of the longest ones go byte by byte.
        """
        found: dict[int, int] = {}
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-sizes, kind="stable")
        lengths = sizes[order]
        raw = self.classes[np.frombuffer(b"".join([*texts, b"\0"]), np.uint8)]
        first = (np.cumsum(sizes) - sizes)[order]
        width = self.table.shape[1]
        flat = (self.table * width).ravel()
        limit = self.accepting * width
        state = np.full(len(texts), self.begin * width, np.int32)
        at = 0
        while (lanes := int(np.searchsorted(-lengths, -at, side="left"))) >= self.LANES:
            place = np.minimum(np.arange(at, at + self.TILE)[:, None], lengths[:lanes])
            tile = raw.take(first[:lanes] + place, mode="clip").astype(np.int32)
            tile[place >= lengths[:lanes]] = 0  # past a text's end
            now = state[:lanes]
            for row in tile:
                now = flat.take(now + row)
                if now.max() >= limit:
                    hit = np.flatnonzero(now >= limit)
                    for k, mask in zip(order[hit].tolist(), self.masks[now[hit] // width].tolist(), strict=True):
                        found[k] = found.get(k, 0) | mask
            state[:lanes] = now
            at += self.TILE
        if lanes:
            rows, masks, _ = self.listed("combined")
            for lane in range(lanes):
                k, s, seen = int(order[lane]), int(state[lane]) // width, 0
                for b in texts[k][at:]:
                    s = rows[s][b]
                    if s >= self.accepting:
                        seen |= masks[s]
                if seen:
                    found[k] = found.get(k, 0) | seen
        return found

    def spans(self, data: bytes, rules: int) -> list[tuple[int, int, int]]:
        """(begin, kind, end) in bytes of the given rules (a mask): per kind the leftmost, longest matches that don't overlap, then the least sizes."""
        table, masks, _ = self.listed("backward")
        s, begins = 0, []
        for i in range(len(data) - 1, -1, -1):
            s = table[s][data[i]]
            if masks[s]:
                begins.append((i, masks[s]))
        begins.reverse()
        out = []
        for k, (_, _, fold, least) in enumerate(self.rules):
            if not rules >> k & 1:
                continue
            (table, masks, dead), end = self.listed(k), 0
            for i, mask in begins:
                if i < end or not mask >> k & 1:
                    continue
                s, best = 0, -1
                for j in range(i, len(data)):
                    s = table[s][data[j]]
                    if masks[s]:
                        best = j + 1
                    elif s == dead:
                        break
                end = best
                if (value_bytes(data[i:best]) if fold else best - i) >= least:
                    out.append((i, k, best))
        return sorted(out)


VALUE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def value_bytes(match: bytes) -> int:
    """Bytes of the value of an assignment: what follows its first `:` or `=`, spaces and a quote."""
    at = min(x for x in (match.find(b":"), match.find(b"=")) if x >= 0) + 1
    rest = match[at:].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


@cache
def automata() -> Automata:
    return Automata()


def scan(docs: DataFrame) -> DataFrame:
    """docs with the columns secrets: array of (kind, begin, end) in code points, sorted by begin, then kind as listed.

    docs needs a column text; null and empty texts have none. Rows keep their other columns (one named secrets is
    replaced) and repeated rows are scanned each for itself. The driver compiles the rules once and sends the arrays
    (of the rules' size, some MB). Memory of a task: a batch of texts and the arrays.
    """
    df = docs.drop("secrets")
    kind = "array<struct<kind:string,begin:bigint,end:bigint>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"secrets {kind}"])
    return df.mapInArrow(_scanned(_sent(docs)), schema)


def _sent(docs: DataFrame):
    return docs.sparkSession.sparkContext.broadcast(automata())


ROWS = 1000  # texts that are scanned side by side


def _spans_of(compiled: Automata, texts: list[str | None]) -> list[list[dict]]:
    raw = [(t or "").encode() for t in texts]
    out: list[list[dict]] = [[] for _ in raw]
    for k, rules in compiled.ends(raw).items():
        found = compiled.spans(raw[k], rules)
        if len(raw[k]) != len(texts[k]):
            points = np.r_[0, np.cumsum((np.frombuffer(raw[k], np.uint8) & 0xC0) != 0x80)]
            found = [(int(points[i]), kind, int(points[j])) for i, kind, j in found]
        out[k] = [{"kind": compiled.rules[kind][0], "begin": i, "end": j} for i, kind, j in found]
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _scanned(sent):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = pa.array(_spans_of(sent.value, batch.column("text").to_pylist()), kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "secrets"])

    return run


def _digest(sent):
    names = [r[0] for r in RULES[:BASE_KINDS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = _spans_of(sent.value, batch.column("text").to_pylist())
            joined = [",".join(f"{s['kind']}:{s['begin']}:{s['end']}" for s in r) for r in rows]
            base = [",".join(f"{s['kind']}:{s['begin']}:{s['end']}" for s in r if s["kind"] in names) for r in rows]
            counts = [pa.array([sum(s["kind"] == n for s in r) for r in rows], pa.int64()) for n in names]
            sha = pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, sha, pa.array(joined, pa.string())], ["doc_id", *(f"n_{n}" for n in names), "base_sha256", "spans"])

    return run


def digests(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans and the digest of an empty text. Rows with a null or repeated doc_id stay, each
    for itself; other columns are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_digest(_sent(docs)), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _masked(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = batch.column("text").to_pylist()
            sizes = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else []
            for k, spans in enumerate(_spans_of(sent.value, texts)):
                if spans:
                    out, end = [], 0
                    for s in spans:
                        if s["begin"] >= end:
                            out += [texts[k][end : s["begin"]], f"[{s['kind']}]"]
                        end = max(end, s["end"])
                    texts[k] = "".join([*out, texts[k][end:]])
                    if sizes:
                        sizes[k] = len(texts[k])
            new = {"text": pa.array(texts, pa.string())}
            if sizes:
                new["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)

    return run


def masked(docs: DataFrame) -> DataFrame:
    """docs with each secret in text replaced by its kind in brackets; n_chars, if there, is the length of a text that
    changed. All rows and columns stay, null texts and ids and repeated rows too."""
    return docs.mapInArrow(_masked(_sent(docs)), docs.schema)
