"""LM scoring by context-tree weighting over byte contexts.

A byte is eight binary decisions; each decision has a node in the tree of the ``DEPTH``
bytes before it. A node at depth d holds the Krichevsky-Trofimov estimate of its bits and
is weighted, half and half, against the product of its children. Learned once, the tree
is frozen: the conditional probability of a byte after ``DEPTH`` bytes is a fixed number,
the mixture of all depths, so scoring is one look-up per byte.

The tree is never held in one place. Its leaves are the (context, byte) pairs of the
corpus. They are counted by hash buckets; groups of leaves with the same ``NEAR`` nearest
bytes (at most 256^3 leaves, whatever the corpus) are mixed to depth ``NEAR`` on their
own; nodes of depth 2 are mixed by their two bytes, and only the nodes of depth 1 and 0
(at most 257 * 255) meet on the driver. Pairs that only held-out text has join with count
0, which changes no node: they get what the tree gives to unseen contexts.

Text is cut into blocks by bytes. A block's pairs travel packed, a row per bucket, and
come back with their values; its texts then stream past the block's own part of the
model, so a task holds the pairs of one block and never a block's text. Wherever a table
meets what belongs to its keys, rows of both are dealt by key and sorted so that the
table's rows come first, and one pass with the state of one key follows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.decontam import LOWER
from cairn.llm.words import crc_mod
from cairn.session import checkpoint, scratch, small_or_shuffled

DEPTH = 5
NEAR = 3
#: Bytes that UTF-8 never uses: the context before a text, and its end.
BEFORE, END = 0xFE, 0xFF
#: Bytes of text in a block.
BLOCK = 48 << 20
#: Bytes of text gathered before counts are formed.
PIECE = 2 << 20
#: Distinct words of a block held before they are handed on in parts, and pairs before
#: equal ones are merged (and, if that many are distinct, handed on).
HELD, HELD_PAIRS = 600_000, 3_000_000
#: Bytes of text per hash bucket of pairs, and the least number of buckets (log2).
BUCKET, LEAST_BITS = 64 << 20, 6
#: Leaves that are mixed at once; a group of equal nearest bytes is never cut.
MIX = 400_000
#: Neighbouring input partitions among which small ones are joined to a block.
SPAN = 1024
ADD = 0.1


def split_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.translate(LOWER).split() if text else []


def coded(words: list[bytes]) -> bytes:
    """A token sequence as bytes: its context, the words between blanks, the end."""
    return bytes([BEFORE] * DEPTH) + b" ".join(words) + bytes([END])


def grams(data: bytes) -> np.ndarray:
    """(context, byte) pairs as integers, one per byte; those that predict ``BEFORE``
    (between two texts) are left in."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    n = len(b) - DEPTH
    key = b[:n].copy()
    for i in range(1, DEPTH + 1):
        key = (key << np.uint64(8)) | b[i : i + n]
    return key


# -- packed rows ---------------------------------------------------------------
def packed(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, plane by plane: equal high bytes of sorted
    numbers stand together, which any codec then removes."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    m = len(data) // width
    out = np.zeros((m, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, m).T
    return out.reshape(-1).view("<u8")


KEY, COUNT, WORD_COUNT = DEPTH + 1, 4, 6


def bucket_of(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def bucket_of_word(word: bytes, bits: int) -> int:
    return zlib.crc32(word) >> (32 - bits)


def _merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its counts."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


class _Pairs:
    """Pairs with counts, merged whenever many have gathered."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.size, self.limit = 0, HELD_PAIRS

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(keys)
        self.n.append(n)
        self.size += len(keys)
        if self.size > self.limit:
            self.take()

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        keys, n = _merged(np.concatenate(self.keys), np.concatenate(self.n))
        self.keys, self.n, self.size = [keys], [n], len(keys)
        self.limit = max(HELD_PAIRS, 2 * len(keys))
        return keys, n


# -- counts per block -----------------------------------------------------------
COUNTS = "bucket int, block int, keys binary, n binary, words binary, wn binary"


class _Block:
    """What a task has read of one block."""

    def __init__(self):
        self.parts: list[list[bytes]] = [[], []]
        self.size = [0, 0]
        self.pairs, self.words = _Pairs(), Counter()

    def add(self, text: bytes | None, test: bool) -> None:
        words = split_words(text)
        self.parts[test].append(coded(words))
        self.size[test] += len(self.parts[test][-1])
        if test:
            for w in words:
                self.words.setdefault(w, 0)
        else:
            self.words.update(words)
        if self.size[test] >= PIECE:
            self.close(test)

    def close(self, test: bool) -> None:
        """Counts the gathered texts; held-out ones count 0."""
        parts, self.parts[test], self.size[test] = self.parts[test], [], 0
        if parts:
            key = grams(b"".join(parts))
            key = np.sort(key[(key & np.uint64(255)) != BEFORE])
            if len(key):
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                n = np.diff(np.append(first, len(key)))
                self.pairs.add(key[first], np.zeros_like(n) if test else n)

    def rows(self, block: int, bits: int) -> Iterator[pa.RecordBatch]:
        """All gathered so far, packed by bucket; the state starts anew."""
        self.close(False)
        self.close(True)
        keys, n = self.pairs.take()
        at = bucket_of(keys, bits)
        order = np.argsort(at, kind="stable")  # keys stay sorted within a bucket
        keys, n, at = keys[order], n[order], at[order]
        cut = np.searchsorted(at, np.arange((1 << bits) + 1))
        own: dict[int, list] = {}
        for w, c in self.words.items():
            own.setdefault(bucket_of_word(w, bits), []).append((w, c))
        out = []
        for b in range(1 << bits):
            k, words = slice(cut[b], cut[b + 1]), own.get(b)
            if k.start < k.stop or words:
                out.append((
                    b, block, packed(keys[k], KEY), packed(n[k], COUNT),
                    b" ".join(w for w, _ in words) if words else b"",
                    packed(np.array([c for _, c in words]), WORD_COUNT) if words else b"",
                ))
            if out and (len(out) == 256 or b + 1 == 1 << bits):
                cols = list(zip(*out, strict=True))
                kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["bucket", "block", "keys", "n", "words", "wn"])
                out = []
        self.pairs, self.words = _Pairs(), Counter()


def block_counts(bits: int):
    """Per block: pairs and words with their counts in training text (0 for those of
    held-out text alone), packed by hash bucket."""

    def run(batches):
        held: dict[int, _Block] = {}
        for batch in batches:
            for block, test, text in zip(*(batch.column(c) for c in ("block", "held_out", "text")), strict=True):
                block = block.as_py()
                state = held.setdefault(block, _Block())
                state.add(text.as_py(), test.as_py())
                # a block of many distinct words or pairs is handed on in parts
                if len(state.words) > HELD or state.pairs.size > 2 * HELD_PAIRS:
                    yield from state.rows(block, bits)
        for block, state in held.items():
            yield from state.rows(block, bits)

    return run


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches of equal keys."""
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    yield from zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True) if len(key) else ()


LEARNED = "bucket int, gram bigint, word binary, n bigint"


def learn(batches):
    """Packed counts in order of bucket -> each distinct pair and word with its count."""

    def flush(bucket, pairs: _Pairs, words: Counter):
        keys, n = pairs.take()
        for at in range(0, len(keys), 1 << 18):
            k = keys[at : at + (1 << 18)].astype(np.int64)
            m = len(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, bucket, dtype=np.int32)), pa.array(k), pa.nulls(m, pa.binary()), pa.array(n[at : at + m].astype(np.int64))],
                ["bucket", "gram", "word", "n"],
            )
        items = [(w, c) for w, c in words.items() if c]
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            m = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, bucket, dtype=np.int32)), pa.nulls(m, pa.int64()), pa.array([w for w, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())],
                ["bucket", "gram", "word", "n"],
            )

    now, pairs, words = None, _Pairs(), Counter()
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("bucket", "keys", "n", "words", "wn")]
        for bucket, keys, n, w, wn in zip(*cols, strict=True):
            if bucket != now:
                if now is not None:
                    yield from flush(now, pairs, words)
                now, pairs, words = bucket, _Pairs(), Counter()
            pairs.add(unpacked(keys, KEY), unpacked(n, COUNT).astype(np.int64))
            for x, c in zip(w.split(b" ") if w else (), unpacked(wn, WORD_COUNT).tolist(), strict=True):
                words[x] += c
    if now is not None:
        yield from flush(now, pairs, words)


# -- the tree ---------------------------------------------------------------------
def _bits(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its eight (prefix node, bit) decisions."""
    i = np.arange(8)
    prefix = (1 << i) | (byte[:, None] >> (8 - i))
    return prefix, (byte[:, None] >> (7 - i)) & 1


_SMALL = 4096
_HALF = np.array([math.lgamma(k + 0.5) for k in range(_SMALL)])
_WHOLE = np.array([math.lgamma(k + 1.0) for k in range(_SMALL)])


def _lgamma(count: np.ndarray, table: np.ndarray, add: float) -> np.ndarray:
    """log of the gamma function of ``count`` + ``add``: a table, then Stirling's series."""
    out = table[np.minimum(count, _SMALL - 1).astype(np.int64)]
    big = np.flatnonzero(count >= _SMALL)
    if len(big):
        x = count[big] + add
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the KT block probability of a zeros and b ones, in any order."""
    return _lgamma(a, _HALF, 0.5) + _lgamma(b, _HALF, 0.5) - _lgamma(a + b, _WHOLE, 1.0) - math.log(math.pi)


def _mixed(a, b, below):
    """(log weighted probability, weight of the node's own estimate)."""
    own = _kt(a, b)
    gap = own - below
    return np.logaddexp(own, below) - math.log(2), 1 / (1 + np.exp(-np.clip(gap, -700, 700)))


def mix_leaves(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Leaves of whole groups of equal ``NEAR`` nearest bytes -> mixture down to that depth.

    Returns per leaf the probabilities of its eight bits, seen from depth ``NEAR``, and
    the nodes of that depth (near, prefix, a zeros, b ones, lw: log weighted probability).
    The eight bits go one by one, which bounds the memory to a few numbers per leaf.
    """
    p_all = np.empty((len(gram), 8), dtype=np.float32)
    tops: dict[str, list] = {c: [] for c in ("near", "prefix", "a", "b", "lw")}
    byte, n = gram & 255, n.astype(float)
    for i in range(8):
        prefix, bit = (1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1
        p = child = below = None
        for depth in range(DEPTH, NEAR - 1, -1):
            ctx = (gram >> 8) & ((1 << (8 * depth)) - 1)
            nodes, where = np.unique((ctx << 8) | prefix, return_inverse=True)
            a = np.bincount(where, n * (bit == 0), len(nodes))
            b = np.bincount(where, n * (bit == 1), len(nodes))
            own = (np.where(bit == 0, a[where], b[where]) + 0.5) / (a + b + 1)[where]
            if depth == DEPTH:
                weighted, p = _kt(a, b), own
            else:
                # each child lies under one parent: the farthest byte of its context aside
                up = np.empty(child, dtype=np.int64)
                up[below] = where
                weighted, w = _mixed(a, b, np.bincount(up, weighted, len(nodes)))
                p = w[where] * own + (1 - w[where]) * p
            child, below = len(nodes), where
        p_all[:, i] = p
        for c, x in zip(tops, (nodes >> 8, nodes & 255, a, b, weighted), strict=True):
            tops[c].append(x)
    return p_all, {c: np.concatenate(x) for c, x in tops.items()}


MIXED = "near int, keys binary, p binary, prefix int, a double, b double, lw double"


def mix(batches):
    """(near, gram, n) in order of near -> per near its leaves with their mixture, packed,
    and its nodes."""

    def out(gram, n):
        near = (gram >> 8) & ((1 << 8 * NEAR) - 1)
        order = np.argsort(near, kind="stable")
        gram, n, near = gram[order], n[order], near[order]
        p, tops = mix_leaves(gram, n)
        rows = [(int(near[i]), packed(gram[i:j], KEY), p[i:j].tobytes()) for i, j in _runs(near)]
        m, k = len(rows), len(tops["near"])
        leaf = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(leaf[0], pa.int32()), pa.array(leaf[1], pa.binary()), pa.array(leaf[2], pa.binary()), pa.nulls(m, pa.int32()), *[pa.nulls(m, pa.float64())] * 3],
            ["near", "keys", "p", "prefix", "a", "b", "lw"],
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(tops["near"].astype(np.int32)), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(tops["prefix"].astype(np.int32)), *[pa.array(tops[c]) for c in ("a", "b", "lw")]],
            ["near", "keys", "p", "prefix", "a", "b", "lw"],
        )

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("near", "gram", "n")))
        size += len(batch)
        if size >= MIX:
            near, gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.searchsorted(near, near[-1]))  # rows come in order of near
            if last:
                yield from out(gram[:last], n[:last])
            held, size = [(near[last:], gram[last:], n[last:])], len(near) - last
    if size:
        _, gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
        yield from out(gram, n)


def weigh_nodes(batches):
    """Nodes of depth 2 (near, prefix, a, b, lw of their children) with their own lw and
    the weight of their own estimate."""
    for batch in batches:
        a, b, lw = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "lw"))
        weighted, own = _mixed(a, b, lw)
        yield pa.RecordBatch.from_arrays(
            [batch.column("near"), batch.column("prefix"), pa.array(a), pa.array(b), pa.array(weighted), pa.array(own)],
            ["near", "prefix", "a", "b", "lw", "own"],
        )


def top_mixture(rows: list) -> np.ndarray:
    """The part of depths 0 and 1, from rows (near, prefix, a, b, lw) summed over depth 2.

    Entry [near, prefix, bit] is (constant, factor): the probability of the bit is the
    constant plus the factor times what depth 2 says.
    """
    out = np.zeros((256, 256, 2, 2))
    out[..., 0], out[..., 1] = 0.0, 1.0
    if not rows:
        return out
    near, prefix, a, b, lw = (np.array(x, dtype=float) for x in zip(*rows, strict=True))
    near, prefix = near.astype(int), prefix.astype(int)
    w1, own = _mixed(a, b, lw)
    a0, b0 = np.bincount(prefix, a, 256), np.bincount(prefix, b, 256)
    _, own0 = _mixed(a0, b0, np.bincount(prefix, w1, 256))
    for bit, c1, c0 in ((0, a, a0), (1, b, b0)):
        kt1 = (c1 + 0.5) / (a + b + 1)
        kt0 = ((c0 + 0.5) / (a0 + b0 + 1))[prefix]
        g = own0[prefix]
        out[near, prefix, bit, 0] = g * kt0 + (1 - g) * own * kt1
        out[near, prefix, bit, 1] = (1 - g) * (1 - own)
    return out


class Depth2:
    """The nodes of one pair of nearest bytes, by prefix."""

    def __init__(self, prefix, a, b, own):
        self.kt, self.own = np.full((256, 2), 0.5), np.zeros(256)
        self.kt[prefix, 0], self.kt[prefix, 1] = (a + 0.5) / (a + b + 1), (b + 0.5) / (a + b + 1)
        self.own[prefix] = own

    def values(self, gram: np.ndarray, p: np.ndarray, head: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of the leaves' bytes, from what depth ``NEAR`` says."""
        prefix, bit = _bits((gram & np.uint64(255)).astype(np.int64))
        own = self.own[prefix]
        c = head[int(gram[0] >> np.uint64(8)) & 255][prefix, bit]
        return np.log10(c[..., 0] + c[..., 1] * (own * self.kt[prefix, bit] + (1 - own) * p)).sum(axis=1)


def finish(head, bits: int):
    """Nodes of depth 2, then leaves, in order of their two bytes -> value of each leaf."""

    def run(batches):
        nodes: list[tuple] = []
        now, table = None, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("two", "kind", "prefix", "a", "b", "own", "keys", "p")]
            grams_, values = [], []
            for two, kind, prefix, a, b, own, keys, p in zip(*cols, strict=True):
                if two != now:
                    now, nodes, table = two, [], None
                if kind == 0:
                    nodes.append((prefix, a, b, own))
                    continue
                if table is None:
                    cols_ = [np.array(x) for x in zip(*nodes, strict=True)]
                    table = Depth2(cols_[0].astype(np.int64), *cols_[1:])
                gram = unpacked(keys, KEY)
                grams_.append(gram)
                values.append(table.values(gram, np.frombuffer(p, dtype=np.float32).reshape(-1, 8), head.value))
            if grams_:
                gram = np.concatenate(grams_)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket_of(gram, bits).astype(np.int32)), pa.array(gram.astype(np.int64)), pa.array(np.concatenate(values).astype(np.float32))],
                    ["bucket", "gram", "value"],
                )

    return run


# -- back to the blocks -----------------------------------------------------------
VALUES = "block int, keys binary, v binary, words binary, wn binary"


def look_up(batches):
    """Model rows, then packed counts, in order of bucket -> each block's pairs with their
    values and its known words with their counts."""
    now, parts, words, keys = None, [], {}, None
    for batch in batches:
        cols = {c: batch.column(c) for c in batch.schema.names}
        bucket = cols["bucket"].to_numpy(zero_copy_only=False)
        kind = cols["kind"].to_numpy(zero_copy_only=False)
        out = []
        for i, j in _runs(bucket.astype(np.int64) * 2 + kind):
            if bucket[i] != now:
                now, parts, words, keys = bucket[i], [], {}, None
            if kind[i] == 0:
                gram, word = cols["gram"].slice(i, j - i), cols["word"].slice(i, j - i)
                is_gram = gram.is_valid().to_numpy(zero_copy_only=False)
                v = cols["value"].slice(i, j - i).to_numpy(zero_copy_only=False)
                n = cols["n"].slice(i, j - i).to_numpy(zero_copy_only=False)
                parts.append((gram.drop_null().to_numpy(zero_copy_only=False).astype(np.uint64), v[is_gram].astype(np.float32)))
                words.update(zip(word.drop_null().to_pylist(), n[~is_gram].astype(np.int64).tolist(), strict=True))
                continue
            if keys is None:
                keys, value = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.float32))
                order = np.argsort(keys, kind="stable")
                keys, value, parts = keys[order], value[order], []
            rows = zip(*(cols[c].slice(i, j - i).to_pylist() for c in ("block", "keys", "words")), strict=True)
            for block, own, w in rows:
                known = [(x, words[x]) for x in (w.split(b" ") if w else ()) if x in words]
                out.append((
                    block, own, value[np.searchsorted(keys, unpacked(own, KEY))].tobytes(),
                    b" ".join(x for x, _ in known), packed(np.array([c for _, c in known], dtype=np.int64), WORD_COUNT),
                ))
        if out:
            kinds = (pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "keys", "v", "words", "wn"])


class _Lookup:
    """Positions of 64-bit keys in a fixed set of them (open addressing, vectorised);
    other keys get the position after the last."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(int(2 * len(keys) + 1).bit_length(), 4)
        self.keys = np.append(keys.astype(np.uint64), np.uint64(2**64 - 1))
        self.slots = np.full(1 << self.bits, len(keys), dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(self.keys[:-1])
        while len(left):
            free = self.slots[slot] == len(keys)
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        at = self.slots[slot]
        none = len(self.keys) - 1
        left = np.flatnonzero((self.keys[at] != keys) & (at != none))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            at[left] = self.slots[slot[left]]
            left = left[(self.keys[at[left]] != keys[left]) & (at[left] != none)]
        return at


class BlockModel:
    """The pairs and words of one block, with what the model says of them."""

    def __init__(self, total: int, distinct: int, ends: int):
        self.total = total
        self.floor = math.log10(total + ADD * (distinct + 1))
        self.none = math.log10(ADD) - self.floor
        self.end = math.log10(ends + ADD) - self.floor
        self.known: dict[bytes, float] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.find = None
        self.ends = ends

    def add(self, keys: bytes, v: bytes, words: bytes, wn: bytes) -> None:
        self.parts.append((unpacked(keys, KEY), np.frombuffer(v, dtype=np.float32)))
        if words:
            n = np.log10(unpacked(wn, WORD_COUNT).astype(float) + ADD) - self.floor
            self.known.update(zip(words.split(b" "), n.tolist(), strict=True))

    def _close(self) -> None:
        keys, values = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.float32))
        self.parts = []
        keys, first = np.unique(keys, return_index=True)  # a block read by two tasks repeats some
        self.log_p, self.find = np.append(values[first], np.float32(0)), _Lookup(keys)

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        if self.find is None:
            self._close()
        m = len(texts)
        n, seen, size = (np.zeros(m, dtype=np.int64) for _ in range(3))
        base, score = np.zeros(m), np.zeros(m)
        parts: list[bytes] = []
        first, held = 0, 0

        def flush(upto: int):
            key = grams(b"".join(parts))
            lp = self.log_p[self.find(key)].astype(float)
            lp[(key & np.uint64(255)) == BEFORE] = 0.0
            score[first:upto] = np.add.reduceat(lp, np.cumsum([0, *(len(x) for x in parts[:-1])]))

        known, none = self.known, self.none
        for i, text in enumerate(texts):
            w = split_words(text.as_py())
            values = [known[x] for x in w if x in known]
            miss = len(w) - len(values)
            n[i], seen[i] = len(w) + 1, len(values) + (self.ends > 0)
            base[i] = math.fsum(values) + miss * none + self.end
            parts.append(coded(w))
            size[i] = len(parts[-1]) - DEPTH
            held += len(parts[-1])
            if held >= PIECE // 2:
                flush(i + 1)
                parts, first, held = [], i + 1, 0
        if parts:
            flush(m)
        return {
            "n_tokens": n, "n_known": seen, "train_tokens": np.full(m, self.total, dtype=np.int64),
            "base_score": base, "score": score, "bits_per_byte": -score * math.log2(10) / np.maximum(size, 1),
        }


def score_blocks(total: int, distinct: int, ends: int):
    """A block's part of the model, then its texts, in order of block -> scores."""

    def run(batches):
        now, model = None, None
        for batch in batches:
            block, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "kind"))
            for i, j in _runs(block.astype(np.int64) * 2 + kind):
                part = batch.slice(i, j - i)
                if block[i] != now:
                    now, model = block[i], BlockModel(total, distinct, ends)
                if kind[i] == 0:
                    for row in zip(*(part.column(c).to_pylist() for c in ("keys", "v", "words", "wn")), strict=True):
                        model.add(*row)
                else:
                    made = model.score(part.column("text"))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), part.column("held_out"), *[pa.array(x) for x in made.values()]], ["doc_id", "held_out", *made]
                    )

    return run


def place_blocks(parts: DataFrame, block: int) -> DataFrame:
    """(part, bytes) -> (part, k, base): row r of a part lies in block base + r mod k.

    Parts of more than ``block`` bytes are cut; smaller neighbours are joined until they
    hold that many, so that no block has more than twice as many. One narrow row per
    input partition.
    """
    cut = F.greatest(F.ceil(F.col("bytes") / block), F.lit(1)).cast("int")
    sized = parts.withColumn("k", cut).withColumn("_span", F.floor(F.col("part") / SPAN))
    before = Window.partitionBy("_span").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    small = F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("bytes"))).over(before), F.lit(0))
    one = sized.withColumn("_no", F.when(F.col("k") == 1, F.floor(small / block)).otherwise(-1 - F.col("part")))
    lead = F.min("part").over(Window.partitionBy("_span", "_no"))
    led = checkpoint(one.select("part", "k", lead.alias("_lead")))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("k").over(order), F.lit(0)).cast("int")
    leads = led.filter("part = _lead").select("part", "k", base.alias("base")).select(F.col("part").alias("_l"), "base")
    return led.join(leads, F.col("_lead") == F.col("_l")).select("part", "k", "base")


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _met(first: DataFrame, then: DataFrame, key: str, n: int, by_id: bool = True) -> DataFrame:
    """Rows of both dealt by ``key``, those of ``first`` (kind 0) before those of ``then``."""
    both = first.withColumn("kind", F.lit(0)).unionByName(then.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartitionById(n, F.col(key)) if by_id else both.repartition(n, key)
    return dealt.sortWithinPartitions(key, "kind")


def score_texts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, held_out) -> tokens, base score and CTW score per row.

    The text is the sequence of its lower-cased words and one end; ``score`` is the log10
    probability of that sequence (words between blanks, then the end) and
    ``bits_per_byte`` its code length. Null and empty texts are the end alone. Rows with
    held_out teach nothing; with no training rows every byte gets what an empty tree
    gives. Repeated rows score alike and teach each time; null ids are kept; texts of any
    length are scored whole; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    top = scratch(spark, "ctw")
    # writing the rows fixes their partition and place in it, which name their block
    text = F.col("text").cast("binary").alias("text")
    rows = _write(
        docs.select(
            "doc_id", "held_out", text, F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"),
            F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"),
        ),
        f"{top}/rows",
    )
    place = checkpoint(place_blocks(rows.groupBy("part").agg(F.sum("size").alias("bytes")), BLOCK))
    size, blocks = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], place.agg(F.max(F.col("base") + F.col("k"))).first()[0] or 1
    bits = max(LEAST_BITS, (size // BUCKET).bit_length())
    buckets = 1 << bits
    placed = rows.join(small_or_shuffled(place), "part").withColumn("block", (F.col("base") + F.pmod("row", "k")).cast("int"))
    counts = _write(placed.select("block", "held_out", "text").mapInArrow(block_counts(bits), COUNTS), f"{top}/counts")

    dealt = counts.select("bucket", "keys", "n", "words", "wn").repartitionById(buckets, F.col("bucket"))
    learned = _write(dealt.sortWithinPartitions("bucket").mapInArrow(learn, LEARNED), f"{top}/learned")
    near = F.shiftright("gram", 8).bitwiseAND((1 << 8 * NEAR) - 1).cast("int").alias("near")
    leaves = learned.filter("gram is not null").select(near, "gram", "n")
    mixed = _write(leaves.repartition(buckets, "near").sortWithinPartitions("near").mapInArrow(mix, MIXED), f"{top}/mixed")

    sums = [F.sum(c).alias(c) for c in ("a", "b", "lw")]
    two = F.col("near").bitwiseAND(0xFFFF)
    deep = mixed.filter("prefix is not null").groupBy(two.alias("near"), "prefix").agg(*sums)
    deep = checkpoint(deep.mapInArrow(weigh_nodes, "near int, prefix int, a double, b double, lw double, own double"))
    upper = deep.groupBy(F.col("near").bitwiseAND(0xFF).alias("near"), "prefix").agg(*sums)
    head = spark.sparkContext.broadcast(top_mixture([tuple(r) for r in upper.collect()]))  # at most 256 * 255 rows
    packs = mixed.filter("prefix is null").select(two.alias("two"), "keys", "p")
    nodes = deep.select(F.col("near").alias("two"), "prefix", "a", "b", "own")
    model = _met(nodes, packs, "two", buckets, False).mapInArrow(finish(head, bits), "bucket int, gram bigint, value float")

    vocab = learned.filter("word is not null").select("bucket", "word", "n")
    tot, kinds = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = rows.filter(~F.col("held_out")).count()
    told = model.unionByName(vocab, allowMissingColumns=True)
    own = _met(told, counts.select("bucket", "block", "keys", "words"), "bucket", buckets).mapInArrow(look_up, VALUES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _met(own, placed.select("block", "doc_id", "held_out", "text"), "block", blocks).mapInArrow(
        score_blocks(tot + ends, kinds + (1 if ends else 0), ends),
        f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double, bits_per_byte double",
    )


def op7_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(crc_mod(F.col("doc_id"), 10) == 0, F.lit(False))
    return score_texts(docs.withColumn("held_out", held))
