"""Byte-pair token ids of whole texts: each distinct piece of a chunk is encoded once, texts are put together from them.

A text is cut only where the tokenizer's own rule always separates: before a single space between two visible
characters, on both sides of a single newline between them, and between an ASCII letter and an ASCII mark after it. The
ids of the pieces, joined, are those of the text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

TOKENIZER = "byte_bpe_50k.json"
NEWLINE = "\n"
BATCH_PIECES = 512
MOST_KNOWN = 1_500_000
PLAIN = re.compile(r" ?\S(?:[^\n]*\S)?")  # visible at both ends, without a newline


@lru_cache(maxsize=4)
def tokenizer(name: str):
    """The named public tokenizer (or one in a file of that path), loaded once in a process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    found = Tokenizer.from_file(name)
    found.encode_special_tokens = True
    return found


def _visible() -> np.ndarray:
    seen = np.zeros(256, bool)
    seen[0x21:0x7F] = True
    return seen


_SEEN = _visible()
_LETTER = np.array([chr(i).isalpha() for i in range(128)] + [False] * 128)
_MARK = _SEEN & np.array([not chr(i).isalnum() for i in range(256)])


def _cuts(data: np.ndarray) -> np.ndarray:
    """Marks the byte positions at which a text may be cut: white space with a sure visible character on both sides, and marks after a letter."""
    sure = _SEEN[data]
    # a two-byte letter other than those led by 0xC2, where no-break space and next-line are
    lead = (data >= 0xC3) & (data <= 0xDF)
    before = sure.copy()
    before[1:] |= lead[:-1]
    after = sure | lead
    inner = np.zeros(len(data) + 1, bool)
    inner[1:-2] = before[:-2] & after[2:]
    line = inner[:-1] & (data == 0x0A)
    inner[:-1] &= (data == 0x20) | (data == 0x0A)
    inner[1:] |= line
    inner[1:-1] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    return inner


def _encode(pieces: list[str], tok) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces, one after the other, and how many each has; most go many at a time, as lines of one text."""
    newline = tok.encode(NEWLINE, add_special_tokens=False).ids
    values, lengths = [], np.zeros(len(pieces), np.int64)
    for a in range(0, len(pieces), BATCH_PIECES):
        part = pieces[a : a + BATCH_PIECES]
        if len(newline) == 1 and all(map(PLAIN.fullmatch, part)):
            ids = np.array(tok.encode_batch_fast([NEWLINE.join(part)], add_special_tokens=False)[0].ids, np.int32)
            line = ids == newline[0]
            ends = np.flatnonzero(line)
            if len(ends) == len(part) - 1:
                lengths[a : a + len(part)] = np.diff(np.concatenate(([-1], ends, [len(ids)]))) - 1
                values.append(ids[~line])
                continue
        each = [x.ids for x in tok.encode_batch_fast(part, add_special_tokens=False)]
        lengths[a : a + len(part)] = [len(x) for x in each]
        values.append(np.array([i for x in each for i in x], np.int32))
    return np.concatenate(values) if values else np.empty(0, np.int32), lengths


class Known:
    """Pieces that this process has encoded, by hash: sorted keys, and where their ids are in one array."""

    def __init__(self, name: str):
        self.tok = tokenizer(name)
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.begin, self.length, self.values = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def ids_of(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece begin in self.values, and how many there are."""
        if len(self.keys) > MOST_KNOWN:
            self.clear()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces))
        order = np.argsort(hashes)  # sought in order, neighbours lie close together
        sought = hashes[order]
        at = np.searchsorted(self.keys, sought)
        old = np.zeros(len(pieces), bool)
        if len(self.keys):
            old = self.keys[np.minimum(at, len(self.keys) - 1)] == sought
        new = np.flatnonzero(~old)
        if len(new):
            values, lengths = _encode([pieces[i] for i in order[new].tolist()], self.tok)
            place = at[new]
            self.keys = np.insert(self.keys, place, sought[new])
            self.begin = np.insert(self.begin, place, len(self.values) + np.cumsum(lengths) - lengths)
            self.length = np.insert(self.length, place, lengths)
            self.values = np.concatenate((self.values, values))
            at += np.cumsum(~old) - ~old  # each stands behind the new ones before it
        where = np.empty(len(pieces), np.int64)
        where[order] = at
        at = where
        return self.begin[at], self.length[at]


@lru_cache(maxsize=2)
def known(name: str) -> Known:
    return Known(name)


def encode_texts(col: pa.Array, name: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows (int32) and the n + 1 offsets of the rows in them; col holds large strings without nulls."""
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    edges = offsets - offsets[0]
    if not edges[-1]:
        return np.empty(0, np.int32), np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    mark = _cuts(data)
    mark[edges] = True
    cuts = np.flatnonzero(mark)
    pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
    cache = known(name)
    begin, length = cache.ids_of(pieces.dictionary.to_numpy(zero_copy_only=False))
    at = pieces.indices.to_numpy(zero_copy_only=False)
    n = length[at]
    ends = np.cumsum(n)
    ids = cache.values[np.repeat(begin[at] - (ends - n), n) + np.arange(int(ends[-1]))]
    return ids, np.concatenate(([0], ends))[np.searchsorted(cuts, edges)]
