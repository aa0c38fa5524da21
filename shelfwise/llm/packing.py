"""Best-fit packing of tokenised documents into sequences of fixed length.

Method: the lengths of all pieces form a histogram of at most ``capacity`` counts. A
configuration linear program over it (a configuration is a multiset of lengths that fits
one sequence) is solved by multiplicative weights: every length has a weight, a knapsack
dynamic program prices the best configuration, that configuration is used for a step, and
the weights of the lengths it covers shrink, until every length is covered. The fractional solution is rounded up as
far as the counts go, the fullest configurations first; what then is left is packed best-fit, longest first. The plan holds configurations and how often each
is used; every piece finds its place from its rank among pieces of equal length, so no
task ever holds all pieces.

The driver holds the histogram and the plan only. Both are bounded by ``capacity`` and ``steps``, not by the corpus.

Defined cases: a NULL text is the empty text, which is the separator id alone. Repeated
rows are packed each for itself. Other columns are ignored. An empty table packs nothing.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.llm.common import materialize, text_chunks

CAPACITY = 2048
SEPARATOR_ID = 0
TOKENIZER_FILE = "word_bpe_49k.json"
#: Even parts that the program's solution is made of; lengths that are covered within a part cut it into more steps.
STEPS = 250
#: How fast the weight of a covered length falls, and how much more a long one weighs.
ETA = 1.0
LONG_BONUS = 0.1
#: Entries a worker's word cache keeps before the older half goes.
CACHE_WORDS = 80_000
#: Signs that may stand behind a word; a run of them is one unit of its own. The apostrophe
#: and the characters of special tokens are left out.
SIGNS = ".,;:!?\"#$%&()*+-/=@[\\]^_`{}~"
#: Pieces that one ranking group is planned to hold.
RANK_GROUP = 5_000


def default_tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER_FILE)


# ---------------------------------------------------------------- tokens

def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + extra)
            extra += 1
    return table


class WordMerger:
    """Byte-pair merging of many words at once.

    One row per word; every round merges, in each row that still has a pair to merge, the
    pair of lowest rank (the leftmost of equal ones), and ranks the two pairs it touches anew.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[x] << 16) | vocab[y] for x, y in pairs], np.uint32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[x + y] for x, y in pairs], np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.NONE)

    def __call__(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        for low, high in ((0, 8), (8, 16), (16, 32), (32, 256)):
            pick = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(pick):
                width = int(sizes[pick].max())
                text = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in pick), np.uint8).reshape(-1, width)
                ids = self._merge(text, sizes[pick])
                kept = ids >= 0
                flat, ends = ids[kept].astype("<u4").tobytes(), kept.sum(1).cumsum() * 4
                start = 0
                for i, stop in zip(pick.tolist(), ends.tolist()):
                    out[i] = flat[start:stop]
                    start = stop
        return out

    def _merge(self, text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n, width = text.shape
        row, column = np.arange(n), np.arange(width)
        ids = np.where(column < sizes[:, None], self.inner[text], -1)
        ids[row, sizes - 1] = self.final[text[row, sizes - 1]]
        after = np.where(column + 1 < sizes[:, None], column + 1, width).astype(np.int16)
        before = np.broadcast_to(column - 1, (n, width)).astype(np.int16).copy()
        rank = np.full((n, width), self.NONE, np.int32)
        if width > 1:
            has = column[1:] < sizes[:, None]
            rank[:, :-1][has] = self._rank(ids[:, :-1][has], ids[:, 1:][has])
        active = row
        while len(active):
            at = rank[active].argmin(1)
            best = rank[active, at]
            go = best < self.NONE
            active, at, best = active[go], at[go], best[go]
            right = after[active, at].astype(np.int64)
            ids[active, at] = self.merged[best]
            ids[active, right] = -1
            rank[active, right] = self.NONE
            follow = after[active, right].astype(np.int64)
            after[active, at] = follow
            rank[active, at] = self.NONE
            has = follow < width
            a, i, j = active[has], at[has], follow[has]
            before[a, j] = i
            rank[a, i] = self._rank(ids[a, i], ids[a, j])
            lead = before[active, at].astype(np.int64)
            has = lead >= 0
            a, i, j = active[has], lead[has], at[has]
            rank[a, i] = self._rank(ids[a, i], ids[a, j])
        return ids


class CachedEncoder:
    """Token ids of whole texts through a cache of words.

    The tokenizer drops white space and never joins over it, so a text's ids are those of
    its white-space separated words in turn. Words of letters, with signs behind,
    are merged in batches; all others go through the whole tokenizer. Of another tokenizer than
    ``TOKENIZER_FILE`` nothing of this is known: whole texts go through it.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = WordMerger(path) if path.endswith(TOKENIZER_FILE) else None
        self.limit = cache_words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that the cache does not hold."""
        out: dict[str, bytes] = {}
        parts: dict[str, tuple[str, str]] = {}
        cores: dict[str, bytes] = {"": b""}
        for word in words:
            if len(word) <= 64 and "Σ" not in word:
                low = (word if word.isascii() else unicodedata.normalize("NFC", word)).lower()
                core = low.rstrip(SIGNS)
                if core.isalpha() or not core:
                    parts[word] = core, low[len(core):]
                    cores[core] = cores[low[len(core):]] = b""
                    continue
            out[word] = self._whole(word)
        cores = dict(zip(cores, self.merge([c.encode() for c in cores])))
        for word, (core, sign) in parts.items():
            out[word] = cores[core] + cores[sign]
        return out

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.merge is None:
            yield from map(self._whole, texts)
            return
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        young, old = self.young, self.old
        young[""] = b""
        missing = set().union(*split).difference(young)
        known = missing.intersection(old)
        young.update((w, old[w]) for w in known)
        young.update(self._learn(list(missing - known)))
        if len(young) >= self.limit:  # before the ids: a caller may leave after the last of them
            self.old, self.young = young, {}
        for words in split:
            yield b"".join(map(young.__getitem__, words))


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY,
           separator: int = SEPARATOR_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise every text, add the separator id, cut what is longer than ``capacity``."""
    path = tokenizer_path or default_tokenizer_path()
    tail = int(separator).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            doc_ids = batch.column(0).to_pylist()
            for first, last, _, _ in text_chunks(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(first, last - first).to_pylist()]
                for doc_id, ids in zip(doc_ids[first:last], enc.ids(texts)):
                    ids += tail
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        for column, value in zip(rows, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(cut, PIECE_SCHEMA)


# ---------------------------------------------------------------- plan

@dataclass
class Plan:
    """Configurations in the order of their sequences.

    For length ``l``, the pieces of rank ``first_rank[k] .. first_rank[k+1]`` go to slot ``k``:
    sequences ``sequence[k], sequence[k] + 1, ...`` at ``offset[k]``.
    """

    n_sequences: int
    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _price(weights: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of greatest weight, by a knapsack dynamic program over capacities."""
    dense = np.full(capacity + 1, -1.0)
    dense[lengths] = weights
    longest = int(lengths.max())
    best = np.zeros(capacity + 1)  # from the end: best[capacity - c] is the value of capacity c
    pick = np.zeros(capacity + 1, np.int64)
    gain = np.empty(longest)
    for c in range(1, capacity + 1):
        top, at = min(c, longest), capacity - c + 1
        np.add(best[at:at + top], dense[1:top + 1], out=gain[:top])
        size = int(gain[:top].argmax())
        best[at - 1] = best[at]
        if gain[size] > best[at] + 1e-15:
            best[at - 1], pick[c] = gain[size], size + 1
    position = {int(v): k for k, v in enumerate(lengths)}
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if not pick[c]:
            c -= 1
            continue
        k = position[int(pick[c])]
        if out.get(k, 0) < counts[k]:
            out[k] = out.get(k, 0) + 1
        c -= int(lengths[k])
    return out


def solve_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int, steps: int) -> list[tuple[dict[int, int], float]]:
    """Fractional uses of configurations that together cover every length, by multiplicative weights.

    The weight of a length starts at its share of the capacity, a little more for long ones
    (``LONG_BONUS``: they are the hard ones, and short ones can fill any gap later), and falls
    exponentially with the part of its count that is covered, compared with the length that is
    furthest behind. A step uses the priced configuration for an even part of the total, or until
    one of its lengths is covered; so there are about as many steps as parts and lengths together.
    """
    covered = np.zeros(len(lengths))
    used: list[tuple[dict[int, int], float]] = []
    size = lengths / capacity
    base = size * (1.0 + LONG_BONUS * size)
    part = max(1.0, float(counts @ lengths) / capacity / steps)
    while len(open_ := np.flatnonzero(covered < counts - 1e-9)):
        share = covered[open_] / counts[open_]
        weights = base[open_] * np.exp(-ETA * (share - share.min()))
        missing = np.ceil(counts[open_] - covered[open_] - 1e-9).astype(np.int64)
        config = {int(open_[k]): a for k, a in _price(weights, lengths[open_], missing, capacity).items()}
        step = min(part, *((counts[k] - covered[k]) / a for k, a in config.items()))
        for k, a in config.items():
            covered[k] += a * step
        used.append((config, float(step)))
    return used


def round_uses(solution: list[tuple[dict[int, int], float]], lengths: np.ndarray, counts: np.ndarray,
               capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole uses of the solution's configurations, and best fit for what they leave.

    Every configuration is used as often as its fractional use rounded up, as far as the counts go, the fullest first. The
    last configurations of a solution hold what did not fit elsewhere; those that waste more than a limit are left
    to best fit. Limits are tried from none to the whole capacity; the fewest sequences win, of equal ones those that
    best fit adds least to.
    """
    filled = [(sum(a * int(lengths[k]) for k, a in config.items()), x, config) for config, x in solution]
    filled.sort(key=lambda f: (-f[0], -f[1]))
    found, least = [], None
    limits = [0, *(1 << b for b in range(capacity.bit_length()))]
    for limit in limits:
        left, uses = counts.copy(), []
        for fill, x, config in filled:
            if capacity - fill > limit:
                break
            n = min(int(np.ceil(x - 1e-9)), *(int(left[k]) // a for k, a in config.items()))
            if n > 0:
                uses.append((config, n))
                for k, a in config.items():
                    left[k] -= a * n
        rest = _best_fit(lengths, left, capacity)
        added = sum(n for _, n in rest)
        total = sum(n for _, n in uses) + added
        if least is None or (total, added) < least:
            found, least = uses + rest, (total, added)
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Plan:
    """Pack the histogram by the rounded configuration program; see ``solve_lp`` and ``round_uses``."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[int(v)] for v in lengths], dtype=np.int64)
    if len(lengths) and lengths[-1] > capacity:
        raise ValueError(f"length {lengths[-1]} is over the capacity {capacity}")
    uses = round_uses(solve_lp(lengths, counts.astype(float), capacity, steps), lengths, counts, capacity)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    ranks, sequence = np.zeros(len(lengths), np.int64), 0
    for config, n in uses:
        offset = 0
        for k in sorted(config, reverse=True):
            for _ in range(config[k]):
                slots.setdefault(int(lengths[k]), []).append((int(ranks[k]), sequence, offset))
                ranks[k] += n
                offset += int(lengths[k])
        sequence += n
    assert (ranks == counts).all()
    return Plan(sequence, {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in slots.items()})


def _best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit over counts: the longest open length starts a sequence, which then takes the longest that fits
    until it is full; the same filling is used as often as the counts allow."""
    left, out = left.copy(), []
    top = len(lengths) - 1
    while True:
        while top >= 0 and left[top] == 0:
            top -= 1
        if top < 0:
            return out
        config: dict[int, int] = {}
        room, k = capacity, top
        while k >= 0 and room > 0:
            k = min(k, int(np.searchsorted(lengths, room, side="right")) - 1)
            while k >= 0 and left[k] - config.get(k, 0) <= 0:
                k -= 1
            if k < 0:
                break
            a = min(int(left[k]) - config.get(k, 0), room // int(lengths[k]))
            config[k] = config.get(k, 0) + a
            room -= a * int(lengths[k])
        n = min(int(left[k]) // a for k, a in config.items())
        for k, a in config.items():
            left[k] -= a * n
        out.append((config, n))


# ---------------------------------------------------------------- places

def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR_ID,
         steps: int = STEPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    cut = materialize(pieces(docs, tokenizer_path, capacity, separator, id_col, text_col), "pack-pieces")
    n = cut.count()
    groups = max(1, -(-n // RANK_GROUP))
    # Rank among equal lengths: a length may hold a third of all pieces, so ranks are counted
    # in groups of a length and the groups' sizes summed up.
    keyed = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    sizes = keyed.groupBy("length", "g").agg(F.count("*").alias("n"))
    by_length = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    layout = plan(by_length, capacity, steps)
    before = sizes.select("length", "g", (F.sum("n").over(
        Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("base"))
    place = Window.partitionBy("length", "g").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("r", F.row_number().over(place)).join(before, ["length", "g"]) \
        .withColumn("rank", F.col("base") + F.col("r") - 1) \
        .select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    slots = layout.slots

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for same in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, seq, off = slots[int(length[same[0]])]
                slot = np.searchsorted(first, rank[same], side="right") - 1
                sequence[same] = seq[slot] + rank[same] - first[slot]
                offset[same] = off[slot]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(5)] + [pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        assign, PIECE_SCHEMA + ", sequence_id long, offset long")

