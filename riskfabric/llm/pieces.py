"""Pre-tokens of byte-level BPE for all texts of a block at once, and a table that remembers their token ids.

The pre-tokenizer cuts texts by the pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`. Over an array of character
classes (letter, number, white space, other) this is: a piece starts where the class changes; the last white space of a run before other text
starts one too, and, if it is a blank, takes the following run with it; a quote that starts a piece takes one of the seven endings and cuts after it.
The class of a character is asked of the library itself, once per process. Added tokens (their strings in a text) are pieces of their own.

Pieces of up to sixteen bytes are compared as two 64-bit integers and a length, so a look-up is exact.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

#: Bytes of text in a block; entries that a process remembers; bytes of longer pieces that it remembers; bytes of a piece that a table compares; new pieces
#: with a leading blank that are encoded in one text (each starts with a token that starts with a blank, and no other token does).
BLOCK, REMEMBERED, LONG_BYTES, SHORT, TOGETHER = 1 << 20, 3 << 18, 1 << 24, 16, 256
LETTER, NUMBER, WHITE, OTHER, UNKNOWN = 0, 1, 2, 3, 255
# The endings that stay with a quote.
ONE_LETTER, TWO_LETTERS = b"stmd", (b"re", b"ve", b"ll")
_CUT = re.compile(rb"(?<=[!-~])[ \t\n\r]")
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def blocks(texts: pa.Array, limit: int = BLOCK, cut: re.Pattern = _CUT) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive texts; a null text is empty. A text beyond the limit is cut at matches of `cut`; its row then stands
    in several blocks. By default that is white space after a visible ASCII character, which always starts a piece."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(buffers[2]) if buffers[2] is not None else memoryview(b"")
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        low, high = int(offsets[at]), int(offsets[end])
        if high - low <= limit:
            yield np.arange(at, end), data[low:high].tobytes(), offsets[at : end + 1] - low
        else:
            while high - low > limit:
                found = cut.search(data, low + limit, high)
                if not found:
                    break
                yield np.array([at]), data[low : found.start()].tobytes(), np.array([0, found.start() - low])
                low = found.start()
            yield np.array([at]), data[low:high].tobytes(), np.array([0, high - low])
        at = end


class Table:
    """Pieces of up to SHORT bytes by open addressing, with an entry number each. Frozen copies may be broadcast."""

    def __init__(self, bits: int):
        self.bits = bits
        self.slots = np.full(1 << bits, -1, np.int32)
        self.low, self.high, self.size = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint8))

    def _slot(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = low * _K[0] ^ (high + size) * _K[1]
        h = (h ^ (h >> np.uint64(29))) * _K[2]
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entry numbers, -1 where there is none."""
        out = np.full(len(low), -1, np.int64)
        if not len(self.low):
            return out
        left, slot = np.arange(len(low)), self._slot(low, high, size)
        while len(left):
            entry = self.slots[slot]
            same = (self.low[entry] == low[left]) & (self.high[entry] == high[left]) & (self.size[entry] == size[left]) & (entry >= 0)
            out[left[same]] = entry[same]
            on = ~same & (entry >= 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> None:
        """Adds distinct pieces that the table does not hold; their numbers go on from the last one."""
        first = len(self.low)
        self.low, self.high, self.size = np.concatenate([self.low, low]), np.concatenate([self.high, high]), np.concatenate([self.size, size])
        number, slot = np.arange(first, len(self.low), dtype=np.int32), self._slot(low, high, size)
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]  # of several that want a slot one gets it
            on = self.slots[slot] != number
            number, slot = number[on], (slot[on] + 1) & ((1 << self.bits) - 1)


def packed(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of up to SHORT bytes as the integers a table compares."""
    flat = np.frombuffer(b"".join(p.ljust(SHORT, b"\0") for p in found), "<u8").reshape(-1, 2)
    return flat[:, 0].copy(), flat[:, 1].copy(), np.array([len(p) for p in found], np.uint8)


class Pieces:
    """The pieces of one block: byte ranges, the range of pieces of each text, and the integers of the short ones."""

    def __init__(self, coder: Coder, data: bytes, offsets: np.ndarray):
        self.data = data
        self.starts = coder.starts(data, offsets)
        self.ends = np.append(self.starts[1:], len(data))
        self.bounds = np.searchsorted(self.starts, offsets)
        size = self.ends - self.starts
        self.short = size <= SHORT
        words = np.ndarray((len(data) + SHORT - 7,), "<u8", data + bytes(SHORT), strides=(1,))
        self.size = np.minimum(size, 255).astype(np.uint8)
        self.low = words[self.starts] & _MASK[np.minimum(size, 8)]
        self.high = words[np.minimum(self.starts + 8, len(data) + SHORT - 8)] & _MASK[np.clip(size - 8, 0, 8)]

    def __len__(self) -> int:
        return len(self.starts)

    def texts(self, at: np.ndarray) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())]


class Coder:
    """Token ids of the pieces of texts. Pieces that were met before are looked up; new ones are encoded by the library on their own."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        cutter, model, added = parts["pre_tokenizer"] or {}, parts["model"], parts["added_tokens"] or []
        if cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) or parts["normalizer"] or model["type"] != "BPE" or model.get("dropout") \
                or any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")) or any(re.search(r"\s", t["content"]) for t in added):
            raise ValueError(f"{path} is no plain byte-level BPE")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        names = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self._ask(np.arange(0x80))
        self.remembered = remembered
        self._forget()

    def _ask(self, points: np.ndarray) -> None:
        """Learns the classes of characters: a character that continues a letter is a letter, and so on."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            self.kinds[p] = next((kind for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(cut(before + chr(p))) == 1), WHITE)

    def _classes(self, data: np.ndarray, lead: np.ndarray) -> np.ndarray:
        byte = data[lead]
        if len(lead) == len(data):
            return self.kinds[byte]
        points = byte.astype(np.int32)
        for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
            at = np.flatnonzero((byte >= low) & (byte < high))
            value = byte[at].astype(np.int32) & mask
            for k in range(1, more + 1):
                value = (value << 6) | (data[lead[at] + k] & 0x3F)
            points[at] = value
        kinds = self.kinds[points]
        if (new := points[kinds == UNKNOWN]).size:
            self._ask(np.unique(new))
            kinds = self.kinds[points]
        return kinds

    def starts(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        """The places where pieces start in texts that lie behind each other."""
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            return np.zeros(0, np.int64)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        byte, kind = raw[lead], self._classes(raw, lead)
        n = len(lead)
        spans = [(m.start(), m.end()) for m in self.added.finditer(data)] if self.added else []
        spans = np.array(spans, np.int64).reshape(-1, 2)
        inside = np.searchsorted(offsets, spans[:, 0], side="right") == np.searchsorted(offsets, spans[:, 1] - 1, side="right")
        spans = spans[inside]
        first = np.zeros(n + 2, bool)
        first[np.searchsorted(lead, offsets[:-1])] = True  # an empty last text marks place n, which is cut off
        first[np.searchsorted(lead, spans.ravel())] = True
        new = np.ones(n, bool)
        new[1:] = kind[1:] != kind[:-1]
        white = kind == WHITE
        last = white[:-1] & ~white[1:] & ~first[1:n]
        new[:-1] |= last
        new[1:] &= ~(last & (byte[:-1] == 0x20))
        new |= first[:n]
        quote = np.flatnonzero((byte == 0x27) & new)
        if len(quote):
            wide = np.append(byte, np.zeros(2, np.uint8))
            one, two = wide[quote + 1], wide[quote + 2]
            short = np.isin(one, np.frombuffer(ONE_LETTER, np.uint8)) & ~first[quote + 1]
            long = np.zeros(len(quote), bool)
            for a, b in TWO_LETTERS:
                long |= (one == a) & (two == b)
            long &= ~first[quote + 1] & ~first[quote + 2]
            new[quote[short] + 1] = False
            new[quote[long] + 1] = False
            ends = np.concatenate([quote[short] + 2, quote[long] + 3])
            new[ends[ends < n]] = True
        for low, high in np.searchsorted(lead, spans).tolist():
            new[low + 1 : high] = False
        return lead[new]

    def _forget(self) -> None:
        self.table = Table(max(8, (2 * self.remembered).bit_length()))
        self.pool, self.at, self.count, self.stamp, self.clock = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.long: dict[bytes, np.ndarray] = {}
        self.long_bytes = 0

    def library(self, found: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The pieces in another order, their ids behind each other, and the numbers of ids."""
        joined, alone = [], []
        for p in found:
            (joined if len(p) > 1 and p[0] == 0x20 and (0x20 < p[1] < 0x7F or 0xC2 < p[1] < 0xE0) else alone).append(p)
        runs = [b"".join(joined[k : k + TOGETHER]).decode() for k in range(0, len(joined), TOGETHER)]
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast([*runs, *[p.decode() for p in alone]], add_special_tokens=False)]
        front = np.fromiter(chain.from_iterable(encoded[: len(runs)]), self.dtype)
        back = np.fromiter(chain.from_iterable(encoded[len(runs) :]), self.dtype)
        starts = np.flatnonzero(self.opens[front])
        if len(starts) != len(joined):
            raise ValueError("tokens reach across pieces")
        return [*joined, *alone], np.concatenate([front, back]), np.concatenate([np.diff(np.append(starts, len(front))), np.array([len(i) for i in encoded[len(runs) :]], np.int64)])

    def _evict(self, room: int) -> None:
        """Only the half that was met last stays, and what the present block holds."""
        keep = np.flatnonzero(self.stamp >= np.sort(self.stamp)[len(self.stamp) // 2]) if len(self.at) else np.zeros(0, np.int64)
        table = Table(max(8, (2 * max(self.remembered, len(keep) + room)).bit_length()))
        table.add(self.table.low[keep], self.table.high[keep], self.table.size[keep])
        self.pool, self.count, self.stamp, self.table = gathered(self.pool, self.at[keep], self.count[keep]), self.count[keep], self.stamp[keep], table
        self.at = np.cumsum(self.count) - self.count

    def _grow(self, new: list[bytes]) -> None:
        if len(self.at) + len(new) > self.remembered:
            self._evict(len(new))
        new, ids, counts = self.library(new)
        self.table.add(*packed(new))
        self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.stamp = np.concatenate([self.stamp, np.full(len(new), self.clock)])
        self.pool = np.concatenate([self.pool, ids])

    def entries(self, found: Pieces, at: np.ndarray) -> np.ndarray:
        """Entry numbers of short pieces; they hold until the next call."""
        self.clock += 1
        low, high, size = found.low[at], found.high[at], found.size[at]
        entry = self.table.find(low, high, size)
        self.stamp[entry[entry >= 0]] = self.clock
        if (missing := np.flatnonzero(entry < 0)).size:
            table = self.table
            self._grow(list(set(found.texts(at[missing]))))
            if self.table is table:
                entry[missing] = table.find(low[missing], high[missing], size[missing])
            else:
                entry = self.table.find(low, high, size)
        return entry

    def long_ids(self, found: Pieces, at: np.ndarray) -> list[np.ndarray]:
        """Ids of longer pieces."""
        texts = found.texts(at)
        new = [p for p in dict.fromkeys(texts) if p not in self.long]
        if new:
            if self.long_bytes > LONG_BYTES:
                self.long = {p: self.long[p] for p in dict.fromkeys(texts) if p in self.long}
                self.long_bytes = sum(map(len, self.long))
            new, ids, counts = self.library(new)
            self.long.update(zip(new, np.split(ids, np.cumsum(counts)[:-1])))
            self.long_bytes += sum(map(len, new))
        return [self.long[p] for p in texts]

    def encode(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a block, behind each other, and their offsets per text."""
        found = Pieces(self, data, offsets)
        if not len(found):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        short = np.flatnonzero(found.short)
        entry = self.entries(found, short)
        where, count, pool = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64), self.pool
        where[short], count[short] = self.at[entry], self.count[entry]
        if len(short) < len(found):
            at = np.flatnonzero(~found.short)
            ids = self.long_ids(found, at)
            count[at] = [len(i) for i in ids]
            where[at] = len(pool) + np.cumsum(count[at]) - count[at]
            pool = np.concatenate([pool, *ids])
        return gathered(pool, where, count), np.concatenate([[0], np.cumsum(count)])[found.bounds]

    def counts(self, found: Pieces, at: np.ndarray) -> np.ndarray:
        """Numbers of ids of some pieces."""
        out, short = np.zeros(len(at), np.int64), found.short[at]
        if short.any():
            entry = self.entries(found, at[short])  # may renew the counts
            out[short] = self.count[entry]
        if not short.all():
            out[~short] = [len(i) for i in self.long_ids(found, at[~short])]
        return out


def gathered(pool: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ranges [at, at + count) of a pool behind each other."""
    before = np.cumsum(count) - count
    total = int(before[-1] + count[-1]) if len(count) else 0
    return pool[np.repeat(at - before, count) + np.arange(total)]


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)
