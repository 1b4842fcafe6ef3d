"""Byte-level BPE token ids through the tokenizers library, by batches of whole texts.

The vocabulary's pre-tokenizer starts a new piece wherever white space follows another character, and pieces are encoded each for
itself. So a text is cut into units there, each a stretch of white space and what follows it; each distinct unit of a batch goes
through the tokenizer once, and the ids of the texts are gathered from those of their units. A unit is named by its word alone
after one space, by line feed and word after one line feed, and by ``RAW`` and its own text in all other cases.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of all kinds and its like; only a space or line feed without any of these beside it is cut without a closer look.
_ODD = r"\x00-\x20\x7f-\xa0 ᠎ -‏ -  -⁤　﻿"
_CUT = re.compile(rf"(?<=[^\s{_ODD}])(?=[ \n])")
#: The same for Arrow.
_ARROW_ODD = r"[\x00-\x20\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}]"
_UNSAFE = rf"[ \n]{_ARROW_ODD}|{_ARROW_ODD}[ \n]|\x00"
_REGULAR = re.compile(rf"[ \n][^\s{_ODD}]")
#: Mark of units whose name is their own text.
RAW = "\0"
#: Words of Latin letters after a space or line feed, and the punctuation after them, which is a piece of its own.
_PLAIN = r"^(?P<stem>\n?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]{1,40})(?P<mark>[!-/:-@\[-`{-~]{0,8})$"
#: The vocabulary writes bytes as characters: printable ones stand for themselves, the others follow from 256 on.
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
_SPACE, _FEED = chr(_BYTES[32]), chr(_BYTES[10])
#: Characters of ``plain`` that need no such writing.
_SAME = {*map(chr, range(128)), _SPACE, _FEED}
#: Units a worker keeps, and the longest name that is kept.
CACHE, LONGEST = 300_000, 64
#: Bytes of text, and texts, that go through at once.
CHUNK, ROWS = 4_000_000, 1 << 18


def vocabulary() -> str:
    """Path of the public byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all runs ``starts[i] .. starts[i] + lengths[i]`` in turn."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


class PieceTokenizer:
    """Encodes batches of texts; keeps the ids of units met lately.

    A word of plain Latin letters is one piece. Such words go through the vocabulary's own BPE model joined, in the byte alphabet of the
    vocabulary; all other units go through the tokenizer as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
        # new words alone go through it, so that a cache of its own would only cost time
        self.pieces = Tokenizer(models.BPE(spec["vocab"], merges, cache_capacity=0, ignore_merges=spec.get("ignore_merges", False)))
        self.pieces.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        # words of letters go through side by side where no merge leads from one into the next
        letters = {*map(chr, range(65, 91)), *map(chr, range(97, 123)), *(chr(_BYTES.get(b, b)) for b in (0xC3, *range(0x80, 0xC0)))}
        crossing = any((y[0] in (_SPACE, _FEED) and x[-1] in letters and letters.issuperset(x.lstrip(_SPACE + _FEED))) or (x[-1] == _FEED and letters.issuperset(y)) for x, y in merges)
        self.together = 1 if crossing else 8
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t[0] in (_SPACE, _FEED)]] = True
        self.words = pa.array([], pa.large_string())
        self.table = Ragged.empty()
        self.seen = np.empty(0, np.int32)

    def as_they_are(self, texts: list[str]) -> Ragged:
        ids = [e.ids for i in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return Ragged(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths)

    def plain(self, stems: pa.Array) -> Ragged:
        """The ids of words of plain letters, after a space or line feed."""
        out = Ragged.empty()
        for i in range(0, len(stems), 16384):
            some = stems[i : i + 16384]
            lead = pc.if_else(pc.starts_with(some, "\n"), pa.scalar(_FEED, pa.large_string()), pa.scalar(_SPACE, pa.large_string()))
            end = pc.if_else(pa.array(np.arange(1, len(some) + 1) % self.together == 0), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
            written = pc.binary_join_element_wise(lead, some, end, pa.scalar("", pa.large_string()))
            written = written.buffers()[2].to_pybytes().decode()
            for c in set(written) - _SAME:
                written = written.replace(c, "".join(chr(_BYTES.get(b, b)) for b in c.encode()))
            ids = np.array(self.pieces.encode_batch_fast([written], add_special_tokens=False)[0].ids, np.uint32)
            out = out.then(Ragged(ids, np.diff(np.flatnonzero(self.opens[ids]), append=len(ids))))
        return out

    def learn(self, units: pa.Array) -> Ragged:
        """The ids of new, distinct units."""
        split = pc.extract_regex(units, _PLAIN)
        fits = np.asarray(split.is_valid().to_numpy(zero_copy_only=False), bool)
        stem, mark = (split.filter(pa.array(fits)).field(k).dictionary_encode() for k in (0, 1))
        place = pc.index_in(stem.dictionary, self.words)
        fresh = place.is_null()
        rest = units.filter(pa.array(~fits)).to_pylist()
        own = self.as_they_are([u[1:] if u[:1] == RAW else u if u[:1] == "\n" else f" {u}" for u in rest])
        marks = self.as_they_are(mark.dictionary.to_pylist())
        parts = self.table.then(self.plain(stem.dictionary.filter(fresh))).then(marks).then(own)
        new, known = np.asarray(fresh.to_numpy(zero_copy_only=False), bool), len(self.table)
        at = np.asarray(place.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        at[new] = known + np.arange(int(new.sum()))
        # a unit is a stem and its mark, or one of the rest and nothing
        first, second = np.empty(len(units), np.int64), np.full(len(units), -1)
        known += int(new.sum())
        first[fits], second[fits] = at[stem.indices.to_numpy()], known + mark.indices.to_numpy()
        first[~fits] = known + len(marks) + np.arange(len(rest))
        pairs = np.c_[first, second].ravel()
        there = pairs >= 0
        both, sizes = parts.take(pairs[there]), np.zeros(len(pairs), np.int64)
        sizes[there] = both.lengths
        return Ragged(both.flat, sizes.reshape(-1, 2).sum(axis=1))

    def keep(self, units: pa.Array, ids: Ragged, places: np.ndarray) -> None:
        """Keep new units too; of more than ``CACHE``, those of most batches, whose counts fade."""
        self.seen = np.r_[self.seen, np.zeros(len(units), np.int32)]
        self.seen[places] += 1
        self.words, self.table = pa.concat_arrays([self.words, units]), ids
        if len(self.words) > CACHE:
            short = np.asarray(pc.less_equal(pc.binary_length(self.words), LONGEST).to_numpy(zero_copy_only=False), bool)
            best = np.flatnonzero(short & (self.seen > 1))
            kept = np.sort(best[np.argsort(-self.seen[best], kind="stable")[: CACHE // 2]])
            self.words, self.table, self.seen = self.words.take(pa.array(kept)), self.table.take(kept), np.minimum(self.seen[kept] // 2 + 1, 8)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of all texts in turn, and the number of ids of each. No text is null."""
        n = len(texts)
        if not n:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        texts = texts.cast(pa.large_string())
        unsafe = np.asarray(pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False), bool)
        marked = pc.binary_join_element_wise(pa.scalar(RAW, pa.large_string()), texts.filter(pa.array(~unsafe)), pa.scalar("", pa.large_string()))
        parts = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
        counts = np.ones(n, np.int64)
        counts[~unsafe] = np.diff(parts.offsets.to_numpy())
        odd = [[named(u, k == 0) for k, u in enumerate(_CUT.split(x))] for x in texts.filter(pa.array(unsafe)).to_pylist()]
        counts[unsafe] = [len(x) for x in odd]
        units = pa.concat_arrays([parts.flatten(), pa.array(list(chain.from_iterable(odd)), pa.large_string())]).dictionary_encode()
        codes, mine = np.empty(int(counts.sum()), np.int64), np.repeat(unsafe, counts)
        usual = len(codes) - int(mine.sum())
        indices = units.indices.to_numpy()
        codes[~mine], codes[mine] = indices[:usual], indices[usual:]
        places = pc.index_in(units.dictionary, self.words)
        fresh = units.dictionary.filter(places.is_null())
        table = self.table.then(self.learn(fresh))
        new = np.asarray(places.is_null().to_numpy(zero_copy_only=False), bool)
        places = np.asarray(places.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        places[new] = len(self.words) + np.arange(len(fresh))
        codes = places[codes]
        n_ids = table.lengths[codes]
        out = table.flat[ragged(table.starts[codes], n_ids)], np.add.reduceat(n_ids, np.cumsum(counts) - counts)
        self.keep(fresh, table, places)
        return out


class Ragged:
    """Runs of ids, one after another."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat, self.lengths = flat, lengths
        self.starts = np.cumsum(lengths) - lengths

    def __len__(self) -> int:
        return len(self.lengths)

    @classmethod
    def empty(cls) -> Ragged:
        return cls(np.empty(0, np.uint32), np.empty(0, np.int64))

    def then(self, more: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.flat, more.flat]), np.concatenate([self.lengths, more.lengths]))

    def take(self, rows: np.ndarray) -> Ragged:
        return Ragged(self.flat[ragged(self.starts[rows], self.lengths[rows])], self.lengths[rows])


def named(unit: str, first: bool) -> str:
    """The name of a unit; the first of a text stands after nothing."""
    if first or not _REGULAR.match(unit):
        return RAW + unit
    return unit[1:] if unit[0] == " " else unit


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text and ``ROWS`` rows, so that memory follows one slice (or one very long text)."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        past = int(sizes[at - 1]) if at else 0
        to = min(max(at + 1, int(np.searchsorted(sizes, past + most, side="right"))), at + ROWS)
        yield batch.slice(at, to - at)
        at = to


_kept: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    """This worker's tokenizer of ``path``."""
    if path not in _kept:
        _kept[path] = PieceTokenizer(path)
    return _kept[path]
