"""An adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

A block's ids are cut into lanes of ``LANE`` ids, which numpy codes side by side, one id of every lane a step. Each id is coded under a
mixture of three predictions: order 0 gives the frequencies of all ids; order 1 and order 2 give the id that followed the same id, or
the same two ids, before. The weights of the mixture depend on how often order 1 and order 2 were right in this context (16 pairs of
confidences), and move towards each prediction's share in the probability of the ids seen (one step of expectation-maximisation an
epoch). All of it is learned from the block itself, anew after each epoch, so that writer and reader hold the same model; epochs are one step
long at first and grow to ``EPOCH`` steps, so that little is coded by a model that knows nothing. Nothing is kept from block to block.

Layout (little-endian): ``CXR4``, u32 documents, u64 ids, u32 vocabulary, the documents' ids (i64, nulls by a bit mask) and numbers of ids (u32),
the lanes' numbers of 16-bit words (u32), the words, u32 crc32 of all before.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"CXR4"
LANE, EPOCH = 256, 16
#: Bits of the weights of a mixture and of the frequencies of order 0; their products share out a step's range.
MIX_BITS, ID_BITS = 12, 20
_TOP, _BOT, _16, _48 = np.uint64(1 << 48), np.uint64(1 << 40), np.uint64(16), np.uint64(48)
_STEP, _32, _LOW = np.uint64(MIX_BITS + ID_BITS), np.uint64(32), np.uint64(0xFFFFFFFF)
_PAIR_BITS = 18
#: Which orders have a prediction at each pair of confidences.
_THERE = np.array([[1, k % 4 > 0, k >= 4] for k in range(16)], np.int64)


class Model:
    """What the ids of a block so far tell about the next ones.

    Orders 1 and 2 keep one number a context: the id that followed, times 4, plus how sure that is (0, for nothing, to 3).
    """

    def __init__(self, vocabulary: int) -> None:
        if vocabulary > 1 << (ID_BITS - 1):
            raise ValueError("the vocabulary is too large for the coder")
        self.size = vocabulary
        self.counts = np.zeros(vocabulary, np.int64)
        self.follow = [np.zeros(n, np.int64) for n in (vocabulary, 1 << _PAIR_BITS)]
        #: By pair of confidences (order 2 times 4, plus order 1): shares of orders 0, 1 and 2 in what was seen.
        self.shares = np.tile(np.array([1024, 256, 512], np.int64), (16, 1)) * _THERE
        self.renew()

    def renew(self) -> None:
        total = int(self.counts.sum())
        share = np.r_[0, np.cumsum(self.counts)]
        room = (1 << ID_BITS) - self.size
        cum = np.arange(self.size + 1) + (share * room // total if total else np.arange(self.size + 1) * room // self.size)
        #: Start (upper half) and frequency (lower half) of each id in order 0.
        self.order0 = (cum[:-1] << 32 | np.diff(cum)).astype(np.uint64)
        weights = _THERE + self.shares * ((1 << MIX_BITS) - 3) // self.shares.sum(axis=1, keepdims=True)
        weights[:, 0] += (1 << MIX_BITS) - weights.sum(axis=1)
        #: Weight of order 0, and the mass that orders 1 and 2 add to their ids.
        self.base = weights[:, 0].astype(np.uint64)
        self.mass = (weights[:, 1:] << ID_BITS).astype(np.uint64).T.copy()

    def names(self) -> np.ndarray:
        """For readers: the id of each value of order 0."""
        return np.repeat(np.arange(self.size, dtype=np.uint16 if self.size <= 1 << 16 else np.uint32), (self.order0 & _LOW).astype(np.int64))

    def look(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where order 2 keeps what followed ``one`` after ``two``, and what order 1 and order 2 keep."""
        at = (two * 0x9E3779B1 ^ one * 0x85EBCA6B) >> 14 & ((1 << _PAIR_BITS) - 1)
        return at, self.follow[0][one], self.follow[1][at]

    def weights(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The context, and the weights there, of what orders 1 and 2 keep."""
        context = (second & 3) * 4 + (first & 3)
        return context, *(t.take(context, mode="clip") for t in (self.base, *self.mass))

    def interval(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the mixture puts ``ids``, and how wide, when orders 1 and 2 say ``a`` and ``b``."""
        cum, freq = self.parts(ids, w)
        return cum + (a < ids) * wa + (b < ids) * wb, freq + (a == ids) * wa + (b == ids) * wb

    def parts(self, ids: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for order 0 alone."""
        own = self.order0[ids]
        return (own >> _32) * w, (own & _LOW) * w

    def learn(self, ids: np.ndarray, one: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """Take in an epoch's ids, with their contexts and what ``look`` gave for them."""
        a, b, context = first >> 2, second >> 2, (second & 3) * 4 + (first & 3)
        # order 0 alone predicted most ids
        hit = np.flatnonzero(((a == ids) & ((first & 3) > 0)) | ((b == ids) & ((second & 3) > 0)))
        self.shares[:, 0] += np.bincount(context, minlength=16) << 8
        x, a, b, (c, w, wa, wb) = ids[hit], a[hit], b[hit], self.weights(first[hit], second[hit])
        parts = np.stack([(self.order0[x] & _LOW) * w, (a == x) * wa, (b == x) * wb])
        parts = (parts << np.uint64(8)) // parts.sum(axis=0)
        for k in range(3):
            self.shares[:, k] += np.bincount(c, parts[k], 16).astype(np.int64)
        self.shares[:, 0] -= np.bincount(c, minlength=16) << 8
        self.counts += np.bincount(ids, minlength=self.size)
        for table, place, was in ((self.follow[0], one, first), (self.follow[1], at, second)):
            sure = was & 3
            hit = ((was >> 2) == ids) & (sure > 0)
            table[place] = np.where(hit, was + (sure < 3), np.where(sure > 1, was - 1, ids * 4 + 1))
        self.renew()


def _shape(n: int) -> tuple[int, int]:
    """Lanes, and the length of the last one."""
    lanes = max(1, -(-n // LANE))
    return lanes, n - (lanes - 1) * LANE


def _epochs(steps: int) -> Iterator[tuple[int, int]]:
    """(first step, steps) of each epoch: as many steps as came before, one at least and EPOCH at most."""
    at = 0
    while at < steps:
        size = min(max(1, at), EPOCH)
        yield at, size
        at += size


def _moving(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """Lanes whose first 16 bits are settled or whose range is too small."""
    return ((low ^ (low + rng)) < _TOP) | (rng < _BOT)


def _shift(low: np.ndarray, rng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both past the first 16 bits; a small range that isn't settled is cut at the next bound first."""
    unsettled = (low ^ (low + rng)) >= _TOP
    rng = np.where(unsettled, (~low + np.uint64(1)) & (_BOT - np.uint64(1)), rng)
    return low << _16, rng << _16


class _Writer:
    def __init__(self, lanes: int) -> None:
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.words, self.used = np.zeros((lanes, 6 * LANE + 8), np.uint16), np.zeros(lanes, np.int64)

    def put(self, cum: np.ndarray, freq: np.ndarray, n: int) -> None:
        low, rng = self.low[:n], self.range[:n]
        rng >>= _STEP
        low += cum * rng
        rng *= freq
        go = np.flatnonzero(_moving(low, rng))
        while len(go):
            some, width, to = low[go], rng[go], self.used[go]
            self.words[go, to] = some >> _48
            self.used[go] = to + 1
            some, width = _shift(some, width)
            low[go], rng[go] = some, width
            go = go[_moving(some, width)]

    def close(self) -> None:
        for shift in (48, 32, 16, 0):
            self.words[np.arange(len(self.used)), self.used] = (self.low >> np.uint64(shift)) & np.uint64(0xFFFF)
            self.used += 1


class _Reader:
    def __init__(self, words: np.ndarray, used: np.ndarray) -> None:
        lanes = len(used)
        self.words, self.at = np.r_[words, np.zeros(8, np.uint16)], np.cumsum(used) - used
        self.low, self.range, self.code = np.zeros(lanes, np.uint64), np.full(lanes, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(lanes, np.uint64)
        for _ in range(4):
            self.code = (self.code << _16) | self.words[self.at]
            self.at += 1

    def value(self, n: int) -> np.ndarray:
        self.range[:n] >>= _STEP
        return (self.code[:n] - self.low[:n]) // self.range[:n]

    def take(self, cum: np.ndarray, freq: np.ndarray, n: int) -> None:
        low, rng, code = self.low[:n], self.range[:n], self.code[:n]
        low += cum * rng
        rng *= freq
        go = np.flatnonzero(_moving(low, rng))
        while len(go):
            some, width, at = low[go], rng[go], self.at[go]
            code[go] = (code[go] << _16) | self.words[at]
            self.at[go] = at + 1
            some, width = _shift(some, width)
            low[go], rng[go] = some, width
            go = go[_moving(some, width)]


def code_ids(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """The lanes' 16-bit words in turn, and the number of words of each lane."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint16), np.empty(0, np.uint32)
    lanes, last = _shape(n)
    lane = np.zeros(lanes * LANE, np.int64)
    lane[:n] = ids
    x = np.zeros((LANE + 2, lanes), np.int64)  # two rows of 0 stand before the lanes' ids
    x[2:] = lane.reshape(lanes, LANE).T
    model, out = Model(vocabulary), _Writer(lanes)
    for at, size in _epochs(LANE if lanes > 1 else last):
        ids, one, two = x[at + 2 : at + 2 + size], x[at + 1 : at + 1 + size], x[at : at + size]
        place, first, second = model.look(one, two)
        cum, freq = model.interval(ids, first >> 2, second >> 2, *model.weights(first, second)[1:])
        for s in range(size):
            m = lanes if at + s < last else lanes - 1
            if m:
                out.put(cum[s, :m], freq[s, :m], m)
        _learn(model, at, size, lanes, last, ids, one, place, first, second)
    out.close()
    return out.words[np.arange(out.words.shape[1]) < out.used[:, None]], out.used.astype(np.uint32)


def _learn(model: Model, at: int, size: int, lanes: int, last: int, *rows: np.ndarray) -> None:
    """The model takes in the ``size`` steps from ``at`` on, but for what the last lane doesn't have."""
    if at + size <= last:
        model.learn(*(r.ravel() for r in rows))
    else:
        there = np.ones((size, lanes), bool)
        there[:, -1] = np.arange(at, at + size) < last
        model.learn(*(r[there] for r in rows))


def decode_ids(words: np.ndarray, used: np.ndarray, n: int, vocabulary: int) -> np.ndarray:
    """The ``n`` ids that ``code_ids`` coded."""
    if not n:
        return np.empty(0, np.uint32)
    lanes, last = _shape(n)
    x = np.zeros((LANE + 2, lanes), np.int64)
    model, source = Model(vocabulary), _Reader(words, used.astype(np.int64))
    place, first, second = (np.zeros((EPOCH, lanes), np.int64) for _ in range(3))
    for at, size in _epochs(LANE if lanes > 1 else last):
        names = model.names()
        for s in range(size):
            m = lanes if at + s < last else lanes - 1
            if not m:
                break
            place[s, :m], one, two = model.look(x[at + s + 1, :m], x[at + s, :m])
            first[s, :m], second[s, :m] = one, two
            _, w, wa, wb = model.weights(one, two)
            a, b = one >> 2, two >> 2
            v = source.value(m)
            below, same = b < a, a == b
            at_a, wide_a = model.parts(a, w)
            at_b, wide_b = model.parts(b, w)
            at_a += below * wb
            at_b += (a < b) * wa
            past_a, past_b = v >= at_a + wide_a + wa + same * wb, v >= at_b + wide_b + wb + same * wa
            is_a, is_b = (v >= at_a) & ~past_a, (v >= at_b) & ~past_b
            # what orders 1 and 2 put before the id
            added = past_a * wa + past_b * wb
            ids = names.take(((v - added) // w).view(np.int64), mode="clip").astype(np.int64)
            np.copyto(ids, b, where=is_b)
            np.copyto(ids, a, where=is_a)
            cum, freq = model.parts(ids, w)
            source.take(cum + added, freq + is_a * wa + is_b * wb, m)
            x[at + s + 2, :m] = ids
        _learn(model, at, size, lanes, last, x[at + 2 : at + 2 + size], x[at + 1 : at + 1 + size], place[:size], first[:size], second[:size])
    return x[2:].T.ravel()[:n].astype(np.uint32)


def write_block(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    words, used = code_ids(ids, vocabulary)
    known = np.array([d is not None for d in doc_ids], bool)
    body = b"".join((
        MAGIC, struct.pack("<IQI", len(doc_ids), len(ids), vocabulary), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.packbits(known).tobytes(),
        np.asarray(counts, "<u4").tobytes(), used.astype("<u4").tobytes(), words.astype("<u2").tobytes(),
    ))
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids) of a block; ValueError if it isn't whole."""
    body, (crc,) = block[:-4], struct.unpack("<I", block[-4:])
    if body[:4] != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("a block of token ids is damaged")
    docs, n, vocabulary = struct.unpack_from("<IQI", body, 4)
    at = 20

    def part(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, kind, count, at)
        at += out.nbytes
        return out

    doc_ids = part("<i8", docs)
    known = np.unpackbits(part("u1", -(-docs // 8)), count=docs).astype(bool)
    counts = part("<u4", docs)
    used = part("<u4", _shape(n)[0] if n else 0)
    words = part("<u2", int(used.sum()))
    return [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)], counts, decode_ids(words, used, n, vocabulary)
