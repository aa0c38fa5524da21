"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut into units that no piece crosses; the distinct units, one behind the
other, are indexed by a suffix array. Every piece of the vocabulary finds its occurrences as
a range of the array by binary search. The occurrences are edges of the units' lattices; sorted by
end position they are relaxed from left to right.

The vocabulary's merges are byte-pair merges in order of score, for which every prefix of a unit has
exactly one encoding: an edge relaxes its end when the piece before its start and its own piece are
stable next to each other, that is, when no merge across their border comes before the merges that
form them. That gives the same ids as the merge procedure itself; characters without a
piece fall back to bytes.

The model file is read on each executor from the installed package (its path is a parameter). One pass
over the texts, nothing is shuffled.

Defined cases: a NULL text has NULL ids; the empty text has none. A text that holds U+2581 decodes to spaces
in its place, as the vocabulary cannot tell them apart. Special pieces are never matched in texts. Repeated rows
give equal results. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shelfwise.llm.common import text_chunks

MODEL_FILE = "piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of text of one batch, characters of one index, units that the cache keeps.
CHUNK, INDEX_CHARS, CACHE_UNITS = 2 << 20, 150_000, 150_000
_RAW_BYTES = re.compile("[\udc00-\udcff]+")
_NEVER = np.int64(1) << 40


def default_model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(MODEL_FILE)


class Vocabulary:
    """Pieces of a byte-pair model, with the order and the halves of each merge."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        score = {self.pieces[i]: sp.get_score(i) for i in plain}
        number = {self.pieces[i]: i for i in plain}
        ranked = sorted((i for i in plain if len(self.pieces[i]) > 1), key=lambda i: -score[self.pieces[i]])
        self.order = np.full(n + 1, -1, np.int64)  # single characters and, as number n, characters without a piece: no merge
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        rank: dict[str, int] = {}
        for k, i in enumerate(ranked):
            rank[self.pieces[i]] = k
        usable = [i for i in plain if len(self.pieces[i]) == 1]
        keys, values = [], []
        for i in ranked:
            text = self.pieces[i]
            symbols = list(text)
            while len(symbols) > 2:
                best = min(range(len(symbols) - 1), key=lambda j: rank.get(symbols[j] + symbols[j + 1], 1 << 40))
                if symbols[best] + symbols[best + 1] not in rank:
                    break
                symbols[best:best + 2] = [symbols[best] + symbols[best + 1]]
            if len(symbols) == 2 and all(len(s) == 1 or s in rank for s in symbols):
                self.order[i] = rank[text]
                halves = [number.get(s, n) for s in symbols]
                if n not in halves:
                    self.left[i], self.right[i] = halves
                    keys.append(halves[0] * (n + 1) + halves[1])
                    values.append(rank[text])
                    usable.append(i)
        at = np.argsort(keys)
        self.pair_keys, self.pair_order = np.array(keys, np.int64)[at], np.array(values, np.int64)[at]
        self.n = n
        usable = sorted(usable, key=lambda i: len(self.pieces[i]))
        self.usable = np.array(usable)
        self.size = np.array([len(self.pieces[i]) for i in usable])
        self.codes = np.zeros((len(usable), int(self.size.max())), np.uint32)
        for k, i in enumerate(usable):
            self.codes[k, :self.size[k]] = [ord(c) for c in self.pieces[i]]
        self.longest = int(self.size.max())
        self.unit = self._units([self.pieces[i] for i in usable])
        self.decoded = [p.replace(SPACE, " ") for p in self.pieces]
        for byte, i in self.byte_ids.items():
            self.decoded[i] = chr(0xDC00 + byte)  # a lone surrogate stands for a raw byte until the end
        for i in range(n):
            if sp.is_control(i):
                self.decoded[i] = ""

    @staticmethod
    def _units(pieces: list[str]) -> re.Pattern:
        """Units end where no piece can go on: before a space mark, and between letters and other characters."""
        numbers = "".join(sorted({c for p in pieces for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()}))
        letters, others = f"[^\\W\\d_{numbers}]+", f"(?:(?!{SPACE})[\\W\\d_{numbers}])+"
        kinds = f"{SPACE}*(?:{letters}|{others})|{SPACE}+"
        if all(re.fullmatch(kinds, p) for p in pieces):
            return re.compile(kinds)
        if all(SPACE not in p.lstrip(SPACE) for p in pieces):
            return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        return re.compile(".+", re.S)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces ``a`` and ``b`` stay apart when their characters are merged together."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        limit = np.full(len(a), _NEVER)
        while len(live):
            key = x * (self.n + 1) + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merge = np.where(self.pair_keys[at] == key, self.pair_order[at], _NEVER)
            bad = merge < limit
            good[live[bad]] = False
            later_x = self.order[x] > self.order[y]
            go = ~bad & (np.maximum(self.order[x], self.order[y]) >= 0)
            limit = np.where(later_x, self.order[x], self.order[y] + 1)[go]
            x, y, live = np.where(later_x, self.right[x], x)[go], np.where(later_x, y, self.left[y])[go], live[go]
        return good


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``codes`` in the order of their first ``depth`` characters, by prefix doubling."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    order, width = np.argsort(rank, kind="stable"), 1
    while width < min(depth, n):  # beyond n all suffixes are told apart
        behind = np.zeros(n, np.int64)
        behind[:n - width] = rank[width:]
        key = rank * (int(rank.max()) + 1) + behind
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[1], 1 + np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        width *= 2
    return order


def occurrences(codes: np.ndarray, array: np.ndarray, words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of the suffix array in which each word occurs, by binary search character after character."""
    n = len(codes)
    low, high = np.zeros(len(words), np.int64), np.full(len(words), n, np.int64)
    padded = np.concatenate([codes, np.zeros(words.shape[1], codes.dtype)])
    for p in range(words.shape[1]):
        live = np.flatnonzero((size > p) & (low < high))
        if len(live) == 0:
            break
        want = words[live, p]
        for upper in (False, True):
            a, b = low[live], high[live]
            while True:
                open_ = a < b
                if not open_.any():
                    break
                mid = (a + b) >> 1
                char = padded[array[np.minimum(mid, n - 1)] + p]
                right = open_ & ((char <= want) if upper else (char < want))
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            if upper:
                high[live] = a
            else:
                first = a
        low[live] = first
    return low, high


def encode_units(units: list[str], v: Vocabulary) -> list[bytes]:
    """Ids of every unit, little-endian 32-bit."""
    length = np.array([len(u) for u in units])
    codes = np.frombuffer("\0".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
    start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    array = suffix_array(codes, v.longest)
    low, high = occurrences(codes, array, v.codes, v.size)
    count = np.maximum(high - low, 0)
    word = np.repeat(np.arange(len(count)), count)
    place = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count) + np.repeat(low, count)
    begin, piece, width = array[place], v.usable[word], v.size[word]
    # characters without a piece are edges of their own
    inside = np.ones(len(codes) + 1, bool)
    inside[start + length] = False  # separators and the end
    bare = inside.copy()
    bare[begin[width == 1]] = False
    extra = np.flatnonzero(bare)
    begin, piece = np.concatenate([begin, extra]), np.concatenate([piece, np.full(len(extra), v.n)])
    width = np.concatenate([width, np.ones(len(extra), np.int64)])
    unit = np.searchsorted(start, begin, side="right") - 1
    end = begin + width
    local = end - start[unit]
    order = np.argsort(local, kind="stable")
    begin, piece, end, local, unit = begin[order], piece[order], end[order], local[order], unit[order]
    last = np.full(len(codes) + 2, -1, np.int64)  # by end position: the piece that ends there
    back = np.zeros(len(codes) + 2, np.int64)
    cut = np.searchsorted(local, np.arange(1, int(length.max()) + 2))
    fresh = begin == start[unit]
    for lo, hi in zip(cut[:-1], cut[1:]):
        e = slice(lo, hi)
        before = last[begin[e]]
        ok = fresh[e].copy()
        try_ = np.flatnonzero(~ok & (before >= 0))
        ok[try_] = v.stable(before[try_], piece[e][try_])
        at = end[e][ok]
        last[at] = piece[e][ok]
        back[at] = begin[e][ok]
    # ends are read backwards, all units at once
    here, who = start + length, np.arange(len(units))
    found_unit, found_at, found_id = [], [], []
    while True:
        live = here > start[who]
        here, who = here[live], who[live]
        if len(who) == 0:
            break
        found_unit.append(who)
        found_id.append(last[here])
        here = back[here]
        found_at.append(here)
    if not found_unit:
        return [b""] * len(units)
    who, at, ids = np.concatenate(found_unit), np.concatenate(found_at), np.concatenate(found_id)
    order = np.lexsort((at, who))
    who, at, ids = who[order], at[order], ids[order]
    if (ids == v.n).any():  # bytes of characters without a piece
        rows = [[i] if i != v.n else [v.byte_ids.get(b, v.unknown) for b in chr(codes[p]).encode("utf-8", "surrogatepass")]
                for i, p in zip(ids.tolist(), at.tolist())]
        who = np.repeat(who, [len(r) for r in rows])
        ids = np.array([i for r in rows for i in r], np.int64)
    raw = ids.astype("<u4").tobytes()
    edge = (np.searchsorted(who, np.arange(len(units) + 1)) * 4).tolist()
    return [raw[a:b] for a, b in zip(edge, edge[1:])]


class Encoder:
    """Encodes batches of texts; keeps the ids of frequent units."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        split = [self.vocabulary.unit.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        young, old = self.young, self.old
        missing = set().union(*split).difference(young)
        known = missing.intersection(old)
        young.update((u, old[u]) for u in known)
        fresh = sorted(missing - known, key=len)
        lo, chars = 0, 0
        for k, u in enumerate(fresh):
            chars += len(u) + 1
            if chars >= INDEX_CHARS or k + 1 == len(fresh):
                young.update(zip(fresh[lo:k + 1], encode_units(fresh[lo:k + 1], self.vocabulary)))
                lo, chars = k + 1, 0
        for units in split:
            yield b"".join(map(young.__getitem__, units))
        if len(young) >= CACHE_UNITS:
            self.old, self.young = {u: i for u, i in young.items() if len(u) <= 64}, {}

    def text(self, ids: bytes) -> str:
        table = self.vocabulary.decoded
        text = "".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
        if not text.isascii():
            text = _RAW_BYTES.sub(lambda m: bytes(ord(c) - 0xDC00 for c in m[0]).decode("utf-8", "replace"), text)
        return text[1:] if text.startswith(" ") else text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def code_column(path: str | None = None):
    """A column function ``text -> struct(ids, decoded)``: both directions in one pass over the texts."""
    path = path or default_model_path()

    @F.arrow_udf("ids binary, decoded string")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path)
        for column in batches:
            ids: list[bytes | None] = []
            texts: list[str | None] = []
            for first, last, _, _ in text_chunks(column, CHUNK):
                part = column.slice(first, last - first).to_pylist()
                for text, found in zip(part, enc.ids([t or "" for t in part])):
                    ids.append(None if text is None else found)
                    texts.append(None if text is None else enc.text(found))
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["ids", "decoded"])

    return code


def encode_column(path: str | None = None):
    """A column function ``text -> ids`` (binary, little-endian unsigned 32-bit)."""
    path = path or default_model_path()

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path)
        for column in batches:
            out: list[bytes | None] = []
            for first, last, _, _ in text_chunks(column, CHUNK):
                texts = column.slice(first, last - first).to_pylist()
                out += [i if t is not None else None for t, i in zip(texts, enc.ids([t or "" for t in texts]))]
            yield pa.array(out, pa.binary())

    return encode


def decode_column(path: str | None = None):
    """A column function ``ids -> text``, the inverse of ``encode_column``."""
    path = path or default_model_path()

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path)
        for column in batches:
            yield pa.array([None if i is None else enc.text(i) for i in column.to_pylist()], pa.string())

    return decode
