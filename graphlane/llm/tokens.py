"""Token ids of texts: the tokenizers library, long texts in pieces, many texts by their distinct units."""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

from graphlane.llm.common import Powers, mix, span_hashes

LONG = 1 << 16  # characters from which a text is encoded in pieces
UNSPLIT = 12  # letters up to which a part that the splitting rule leaves whole is encoded at once, not in halves
AT_ONCE = 1 << 19  # characters given to the library at once, which bounds the memory of its results
PAIRS = 500_000  # pairs of neighbours that are remembered
BETWEEN = "\0"  # stands between parts that are split already; no byte letter


class Encoder:
    """encode() gives what the library's encode(text, add_special_tokens=False).ids gives."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.greedy = {t.content for t in added.values() if t.lstrip or t.rstrip or t.single_word}  # these look at what stands beside them
        self.split = self.library.pre_tokenizer.pre_tokenize_str
        self.plain = Tokenizer.from_file(path)  # without splitting: for parts that are split already, in the library's byte letters
        from tokenizers import pre_tokenizers

        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(BETWEEN)
        self.plain.no_truncation()
        self.plain.no_padding()
        if hasattr(self.plain.model, "_resize_cache"):  # what it gets is distinct, so its cache only costs
            self.plain.model._resize_cache(0)
        self.letters_alone = self.library.normalizer is None and not any(re.fullmatch(" ?[A-Za-z]+", t) for t in self.special)  # such units are never split
        self.letters = {i: t for t, i in self.library.get_vocab(with_added_tokens=False).items()}
        self.width = np.zeros(self.library.get_vocab_size(), np.int64)  # bytes of each token
        for i, letters in self.letters.items():
            self.width[i] = len(letters)
        for text, i in self.special.items():
            self.width[i] = len(text.encode())
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halved = 0  # parts that were encoded by halves

    def batch(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        todo: list[str] = []
        size = 0
        for t in [*texts, None]:
            if todo and (t is None or size + len(t) > AT_ONCE):
                out += [e.ids for e in self.library.encode_batch_fast(todo, add_special_tokens=False)]
                todo, size = [], 0
            if t is not None:
                todo.append(t)
                size += len(t)
        return out

    def direct(self, letters: str) -> list[int]:
        return self.plain.encode(letters, add_special_tokens=False).ids

    def plain_batch(self, letters: list[str]) -> list[list[int]]:
        """The ids of parts that are split already, many at once."""
        out: list[list[int]] = []
        at = 0
        while at < len(letters):
            end, size = at, 0
            while end < len(letters) and (end == at or size + len(letters[end]) <= AT_ONCE):
                size += len(letters[end])
                end += 1
            out += [e.ids for e in self.plain.encode_batch_fast(letters[at:end], add_special_tokens=False)]
            at = end
        return out

    def agreeing(self, pairs: set[tuple[int, int]]) -> dict[tuple[int, int], bool]:
        """Whether each two neighbours encode to themselves."""
        new = [p for p in pairs if p not in self.pairs]
        if len(self.pairs) + len(new) > PAIRS:
            self.pairs, new = {}, list(pairs)
        for p, ids in zip(new, self.plain_batch([self.letters[a] + self.letters[b] for a, b in new]), strict=True):
            self.pairs[p] = ids == [*p]
        return self.pairs

    def whole(self, parts: list[str]) -> list[list[int]]:
        """Parts that aren't split: their halves of halves are encoded side by side and joined level by level."""
        rows = [[x[k : k + UNSPLIT] for k in range(0, len(x), UNSPLIT)] for x in parts]
        self.halved += sum(len(r) > 1 for r in rows)
        leaves = list({leaf for r in rows for leaf in r})
        known = dict(zip(leaves, self.plain_batch(leaves), strict=True))
        trees = [[known[leaf] for leaf in r] for r in rows]
        while any(len(t) > 1 for t in trees):
            joins = [(t[k], t[k + 1]) for t in trees for k in range(0, len(t) - 1, 2)]
            done = iter(self.join_all(joins))
            trees = [[next(done) if k + 1 < len(t) else t[k] for k in range(0, len(t), 2)] for t in trees]
        return [t[0] if t else [] for t in trees]

    def join_all(self, joins: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """For each (a, b) the encoding of the joined letters of two encodings.

        An encoding is the right one exactly if each two neighbours encode to themselves. So a growing window round
        the join is encoded again until it agrees with its neighbours on both sides.
        """
        out: list[list[int]] = [a + b for a, b in joins]
        lines = {k: ([], a[-1], b[0]) for k, (a, b) in enumerate(joins) if a and b}  # the window's ids, and those beside it
        w = 0
        while lines:
            ends = {k: [p for p in ((left, (middle or [right])[0]), ((middle or [left])[-1], right)) if None not in p] for k, (middle, left, right) in lines.items()}
            same = self.agreeing({p for own in ends.values() for p in own})
            open_joins = []
            for k, own in ends.items():
                if all(same[p] for p in own):
                    a, b = joins[k]
                    out[k] = a[: max(0, len(a) - w)] + lines[k][0] + b[w:]
                else:
                    open_joins.append(k)
            w = max(1, 2 * w)
            windows = ["".join([self.letters[i] for i in joins[k][0][-w:] + joins[k][1][:w]]) for k in open_joins]
            distinct = list(dict.fromkeys(windows))
            coded = dict(zip(distinct, self.plain_batch(distinct), strict=True))
            lines = {k: (coded[x], joins[k][0][-w - 1] if len(joins[k][0]) > w else None, joins[k][1][w] if len(joins[k][1]) > w else None) for k, x in zip(open_joins, windows, strict=True)}
        return out

    def join_ids(self, a: list[int], b: list[int]) -> list[int]:
        return self.join_all([(a, b)])[0]

    def parts(self, letters: list[str]) -> list[list[int]]:
        distinct = list(dict.fromkeys(letters))
        known = dict(zip(distinct, self.whole(distinct), strict=True))
        return [known[x] for x in letters]

    def split_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts, by the parts that the splitting rule makes and by halves of these."""
        out: list[list[int]] = [[] for _ in texts]
        place, found = [], []
        for k, t in enumerate(texts):
            if any(x in t for x in self.special):
                out[k] = self.long(t)
                continue
            own = [x for x, _ in self.split(t)]
            place.append((k, len(found), len(found) + len(own)))
            found += own
        ids = self.parts(found)
        for k, a, b in place:
            out[k] = [i for part in ids[a:b] for i in part]
        return out

    def piece(self, text: str) -> Piece:
        """A piece without special tokens."""
        split = self.split(text)
        return Piece(text, [s for _, (s, _) in split], self.parts([x for x, _ in split]))

    def join(self, a: Piece, b: Piece) -> Piece:
        """The piece of both texts: a growing window round the join is split and encoded again.

        From a place on where a part begins in the window and in b alike, b's encoding holds; up to the place where
        the window begins, a's does.
        """
        if not a.text or not b.text:
            return a if a.text else b
        m, text, k = len(a.text), a.text + b.text, 2
        b_starts = [m + s for s in b.starts]
        at = {s: i for i, s in enumerate(b_starts)}
        while True:
            i = max(0, len(a.starts) - k)
            begin = a.starts[i]
            end = b_starts[k] if k < len(b_starts) else len(text)
            split = [(x, begin + s, begin + e) for x, (s, e) in self.split(text[begin:end])]
            sync = next((n for n, (_, s, _) in enumerate(split) if s >= m and s in at), None)
            if sync is not None or end == len(text):
                break
            k *= 2
        middle = split if sync is None else split[:sync]
        ids = [None if s == a.starts[-1] and e == (b_starts[1] if len(b_starts) > 1 else len(text)) else x for x, s, e in middle]
        coded = iter(self.parts([x for x in ids if x is not None]))
        middle_ids = [self.join_ids(a.ids[-1], b.ids[0]) if x is None else next(coded) for x in ids]
        j = len(b.starts) if sync is None else at[split[sync][1]]
        return Piece(text, a.starts[:i] + [s for _, s, _ in middle] + b_starts[j:], a.ids[:i] + middle_ids + b.ids[j:])

    def tree(self, pieces: list[Piece]) -> Piece:
        while len(pieces) > 1:
            pieces = [self.join(*pieces[k : k + 2]) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
        return pieces[0]

    def cut(self, text: str, size: int = LONG) -> list[tuple[int, int, str]]:
        """(section, piece, text): sections end at special tokens, whose own section has the number of the id, negative, as its piece."""
        out, rest, section = [], text, 0
        while True:
            found = min(((rest.find(t), -len(t), t) for t in self.special if t in rest), default=None)
            own = rest if found is None else rest[: found[0]]
            out += [(section, k // size, own[k : k + size]) for k in range(0, len(own), size)]
            if found is None:
                return out
            out.append((section + 1, -1 - self.special[found[2]], ""))
            rest, section = rest[found[0] - found[1] :], section + 2

    def long(self, text: str, size: int = LONG) -> list[int]:
        return self.assemble([(s, p, None if p < 0 else self.piece(t)) for s, p, t in self.cut(text, size)])

    def assemble(self, pieces: list[tuple[int, int, Piece | None]]) -> list[int]:
        sections: dict[int, list] = {}
        for s, p, x in sorted(pieces, key=lambda y: y[:2]):
            sections.setdefault(s, []).append((p, x))
        out: list[int] = []
        for own in sections.values():
            out += [-1 - own[0][0]] if own[0][0] < 0 else self.tree([x for _, x in own]).flat()
        return out


class Piece:
    """A text, where its parts by the splitting rule begin, and the ids of each part."""

    def __init__(self, text: str, starts: list[int], ids: list[list[int]]) -> None:
        self.text, self.starts, self.ids = text, starts, ids

    def flat(self) -> list[int]:
        return [i for part in self.ids for i in part]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def little_endian(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


# White space that takes more than a byte, or that not all libraries count as such: texts with it go to the library whole.
RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
MARKS = "!#$%&*,.:;?"
MARK = np.isin(np.arange(256), [*MARKS.encode()])
ENDS = MARK | (np.arange(256) == 10)
STRETCH = 1 << 20  # characters that are taken to units at once
BREAK = re.compile(r"(?<=\S) ")


def stretches(text: str, size: int = STRETCH) -> list[str]:
    """The text cut where units begin, each stretch as long as `size` or up to the next such place."""
    out, begin = [], 0
    while len(text) - begin > size:
        found = BREAK.search(text, begin + size)
        if found is None:
            break
        out.append(text[begin : found.start()])
        begin = found.start()
    return [*out, text[begin:]]


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all spans, one after another."""
    total = np.cumsum(size)
    return np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)


SHORT = 32  # bytes up to which a unit is hashed and compared by 64-bit words
KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first bytes of a word


def words_of(raw: np.ndarray) -> np.ndarray:
    """The 64-bit word that begins at each byte, and at the end; after the end come zeros."""
    padded = np.r_[raw, np.zeros(SHORT + 8, np.uint8)]
    return np.ndarray(len(raw) + SHORT + 1, "<u8", padded.data, strides=(1,))


def unit_hashes(raw: np.ndarray, words: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of units: of their words, of long ones as spans. They only choose candidates."""
    h = size.astype(np.uint64) * np.uint64(Powers.BASE)
    short = np.flatnonzero(size <= SHORT)
    if len(short) < len(at):
        far = np.flatnonzero(size > SHORT)
        ends = np.cumsum(size[far])
        bytes_of = np.repeat(at[far] - (ends - size[far]), size[far]) + np.arange(ends[-1])
        h[far] = span_hashes(raw[bytes_of], ends - size[far], ends)
    for k in range(0, SHORT, 8):
        short = short[size[short] > k]
        if not len(short):
            break
        h[short] = mix(h[short] ^ words[at[short] + k] & KEPT[np.minimum(size[short] - k, 8)])
    return h


class Column:
    """An array that grows in place; some bytes more than it needs can be read."""

    def __init__(self, dtype: type) -> None:
        self.all, self.n = np.zeros(1 << 10, dtype), 0

    def add(self, more: np.ndarray) -> None:
        n = self.n + len(more)
        if n + SHORT + 8 > len(self.all):
            larger = np.zeros(max(2 * len(self.all), n + SHORT + 8), self.all.dtype)
            larger[: self.n] = self.all[: self.n]
            self.all = larger
        self.all[self.n : n] = more
        self.n = n

    def now(self) -> np.ndarray:
        return self.all[: self.n]


class Places:
    """The number of each of many different 64-bit hashes, in the order in which they came: open addressing."""

    def __init__(self) -> None:
        self.hashes, self.bits = Column(np.uint64), 12
        self.table = np.full(1 << self.bits, -1, np.int32)

    def _first(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(Powers.BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers, -1 for what isn't there."""
        if not self.hashes.n:
            return np.full(len(h), -1, np.int32)
        at = self._first(h)
        out = self.table[at]
        todo = np.flatnonzero((out >= 0) & (self.hashes.all[out] != h))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.table) - 1)
            own = self.table[at[todo]]
            out[todo] = own
            todo = todo[(own >= 0) & (self.hashes.all[own] != h[todo])]
        return out

    def add(self, h: np.ndarray) -> None:
        """Different hashes that aren't there yet."""
        first = self.hashes.n
        self.hashes.add(h)
        if 2 * self.hashes.n > len(self.table):
            self.bits = (4 * self.hashes.n - 1).bit_length()
            self.table, first = np.full(1 << self.bits, -1, np.int32), 0
        h = self.hashes.now()[first:]
        number, at = np.arange(first, first + len(h), dtype=np.int32), self._first(h)
        while len(number):
            free = self.table[at] < 0
            self.table[at[free]] = number[free]
            left = self.table[at] != number
            number, at = number[left], (at[left] + 1) & (len(self.table) - 1)


class UnitCoder:
    """Encodes texts by their units: what lies between places where a space follows another character than white space.

    Units also end between an ASCII letter and one of MARKS or a line feed, between one of MARKS and a line feed, and
    between a line feed that doesn't follow white space and an ASCII letter: so words of many surroundings are one unit.
    The library splits there whatever else stands in the text, and goes on as at the beginning of a text. So the ids of
    a text are those of its units. Each distinct unit is encoded once; its bytes and ids are kept for later texts. Units
    are found by a hash and compared byte by byte; a text with a unit that only shares the hash goes to the library whole.
    `halves`: what the splitting rule leaves whole is encoded by tree concatenation, otherwise by the library at once.
    """

    def __init__(self, path: str, most: int = 300_000, halves: bool = False) -> None:
        """most: units that are kept; with more, those that weren't met again are forgotten, or all."""
        self.most, self.halves = most, halves
        self.encoder = encoder(path)
        self.whole = [t for t in self.encoder.special if any(x in t for x in " \n" + MARKS) or t in self.encoder.greedy]
        self.clear()

    @property
    def known(self) -> np.ndarray:
        return self.places.hashes.now()

    def clear(self) -> None:
        self.places, self.again = Places(), Column(bool)
        self.unit, self.length, self.bytes = Column(np.int64), Column(np.int64), Column(np.uint8)
        self.begin, self.size, self.flat = Column(np.int64), Column(np.int64), Column(np.uint32)

    def forget(self) -> None:
        """Keeps the units that were met again, if they are less than half of what may be kept."""
        old, kept = self.__dict__.copy(), np.flatnonzero(self.again.now())
        self.clear()
        if not 0 < len(kept) <= self.most // 2:
            return
        length, size = old["length"].all[kept], old["size"].all[kept]
        self._keep(old["places"].hashes.all[kept], old["bytes"].all[spans(old["unit"].all[kept], length)], length, old["flat"].all[spans(old["begin"].all[kept], size)], size)

    def _keep(self, values: np.ndarray, data: np.ndarray, length: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        self.unit.add(np.cumsum(length) - length + self.bytes.n)
        self.begin.add(np.cumsum(size) - size + self.flat.n)
        for column, more in ((self.length, length), (self.size, size), (self.bytes, data), (self.flat, flat), (self.again, np.zeros(len(values), bool))):
            column.add(more)
        self.places.add(values)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        held: list[tuple[int, str]] = []
        size = 0
        for k, t in enumerate(texts):
            if RARE_SPACE.search(t) or any(x in t for x in self.whole):
                out[k] = np.array(self.encoder.batch([t])[0], np.uint32)
                continue
            for part in stretches(t):
                if size + len(part) > 2 * STRETCH and held:
                    self._encode(held, out)
                    held, size = [], 0
                held.append((k, part))
                size += len(part)
        self._encode(held, out)
        return out

    def _encode(self, parts: list[tuple[int, str]], out: list[np.ndarray]) -> None:
        flat, sizes, sure = self.units([t.encode() for _, t in parts])
        ends = np.cumsum(sizes).tolist()
        for (k, t), a, b, good in zip(parts, [0, *ends], ends, sure.tolist(), strict=False):
            ids = flat[a:b] if good else np.array(self.encoder.batch([t])[0], np.uint32)
            out[k] = np.concatenate([out[k], ids]) if len(out[k]) else ids

    def units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts, how many each one has, and whether all of its units were compared equal."""
        buffer = b"".join(texts)
        raw = np.frombuffer(buffer, np.uint8)
        n = len(raw)
        sure = np.ones(len(texts), bool)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64), sure
        first = np.cumsum(lengths) - lengths
        starts = np.zeros(n, bool)
        at = np.flatnonzero(raw[1:] == 32)
        starts[at[~SPACE[raw[at]]] + 1] = True
        at = np.flatnonzero(ENDS[raw])  # few
        at = at[at > 0]
        line, before = raw[at] == 10, raw[at - 1]
        starts[at[LETTER[before] | (line & MARK[before])]] = True
        after = at[line & ~SPACE[before]] + 1
        after = after[after < n]
        starts[after[LETTER[raw[after]]]] = True
        starts[first[lengths > 0]] = True
        at = np.flatnonzero(starts)
        size, words = np.diff(at, append=n), words_of(raw)
        hashes = unit_hashes(raw, words, at, size)
        if len(self.known) > self.most:
            self.forget()
        place = self.places.find(hashes)
        new = np.flatnonzero(place < 0)
        self.again.all[place[place >= 0]] = True
        if len(new):
            values, where, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            where = new[where]
            had = self.places.hashes.n
            order = self.learn(values, [buffer[a : a + b] for a, b in zip(at[where].tolist(), size[where].tolist(), strict=True)])
            number = np.empty(len(order), np.int32)
            number[order] = np.arange(had, had + len(order))
            place[new] = number[back]
        counts = self.size.all[place]
        flat = self.flat.all[spans(self.begin.all[place], counts)]
        owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, first), append=len(at)))
        alike = self.length.all[place] == size
        known, unit = np.ndarray(len(self.bytes.all) - 7, "<u8", self.bytes.all.data, strides=(1,)), self.unit.all[place]
        short = size <= SHORT
        left = np.flatnonzero(alike & short)
        a, b, rest = at[left], unit[left], size[left]
        for _ in range(0, SHORT, 8):
            unlike = ((words[a] ^ known[b]) & KEPT[np.minimum(rest, 8)]) != 0
            alike[left[unlike]] = False
            more = np.flatnonzero((rest > 8) & ~unlike)
            if not len(more):
                break
            left, a, b, rest = left[more], a[more] + 8, b[more] + 8, rest[more] - 8
        for k in np.flatnonzero(alike & ~short).tolist():
            alike[k] = (raw[at[k] : at[k] + size[k]] == self.bytes.all[unit[k] : unit[k] + size[k]]).all()
        sure[owner[~alike]] = False
        return flat, np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64), sure

    def learn(self, values: np.ndarray, units: list[bytes]) -> np.ndarray:
        """The order in which the units now stand.

        Units of ASCII letters, after a space or not, are never split: they are encoded with a mark between them. Others
        that begin with a space and don't end with white space are encoded in one text, which splits between them.
        """
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        data, ends = np.frombuffer(b"".join(units), np.uint8), np.cumsum(sizes)
        whole = (sizes <= UNSPLIT) if self.halves else np.ones(len(units), bool)
        begins, other = ends - sizes, ~LETTER[data]
        space = data[begins] == 32
        other[begins[space & (sizes > 1)]] = False
        kind = np.where(space & ~SPACE[data[ends - 1]], 1, 2)
        if self.encoder.letters_alone:
            kind[whole & ~np.logical_or.reduceat(other, begins)] = 0
        kind[~whole] += 2
        order = np.argsort(kind, kind="stable")
        units, kind = [units[k] for k in order.tolist()], kind[order]
        sizes, upto = sizes[order], np.searchsorted(kind, range(6)).tolist()
        coded = self.encoder.plain_batch([x.replace(" ", "\u0120") for x in self._joined(units[: upto[1]], BETWEEN)])
        coded += self.encoder.batch(self._joined(units[upto[1] : upto[2]]) + [u.decode() for u in units[upto[2] : upto[3]]])
        if upto[3] < len(units):
            coded += self.encoder.split_batch(self._joined(units[upto[3] : upto[4]]) + [u.decode() for u in units[upto[4] :]])
        flat = np.concatenate([np.array(x, np.uint32) for x in coded])
        upto = np.searchsorted(np.cumsum(self.encoder.width[flat]), np.cumsum(sizes), side="right")
        self._keep(values[order], np.frombuffer(b"".join(units), np.uint8), sizes, flat, np.diff(upto, prepend=0))
        return order

    @staticmethod
    def _joined(units: list[bytes], between: str = "", at_once: int = 1500) -> list[str]:
        """Texts of so many units, some 16 KB."""
        return [between.encode().join(units[k : k + at_once]).decode() for k in range(0, len(units), at_once)]


@cache
def unit_coder(path: str, most: int = 300_000, halves: bool = False) -> UnitCoder:
    return UnitCoder(path, most, halves)


def drop_coders() -> None:
    """Forgets what this process keeps for encoding."""
    unit_coder.cache_clear()
    encoder.cache_clear()
