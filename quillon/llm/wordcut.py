"""Texts cut into words as arrays, without a Python object for each word.

All work is on the UTF-8 bytes of slices of texts. A table of 256 kinds says
what a byte is: kind 0 stands between words, and neighbouring bytes of one
other kind are a word; no word goes from one text into the next. A word's hash
is the sum of its bytes' random numbers times the powers of an odd number by
place, which prefix sums give for all words of a slice at once, mixed to 64
bits. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a slice; a longer text is a slice of its own.
SLICE = 500_000
#: The same where distinct chunks are looked up, and the number of those that a
#: ChunkCache keeps at most.
CHUNK_SLICE, CACHE_CHUNKS = 4_000_000, 150_000

#: A-Z lower-cased, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Kind 0: ASCII white space.
BETWEEN_SPACE = np.ones(256, np.uint8)
BETWEEN_SPACE[[9, 10, 11, 12, 13, 32]] = 0

_rng = np.random.default_rng(2027)
_NUMBERS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
MIX = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93], np.uint64)


class Slice(NamedTuple):
    """first: the first text's place in its column; data: the bytes of the
    slice's texts; ends: where each text ends in them."""

    first: int
    data: np.ndarray
    ends: np.ndarray


def slices(column: pa.Array, most: int = SLICE) -> Iterator[Slice]:
    """A column of strings in slices of about so many bytes."""
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, raw = column.buffers()
    places = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(places, places[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield Slice(first, data[places[first] : places[last]], places[first + 1 : last + 1] - places[first])
        first = last


def cut(data: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words begin and stop, and how many there are up to each text's
    end."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, np.zeros(len(ends), np.int64)
    kind = kinds[data]
    change = np.empty(len(data) + 1, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[ends] = True
    at = np.flatnonzero(change)
    begins, stops = at[:-1], at[1:]
    solid = kind[begins] != 0
    begins, stops = begins[solid], stops[solid]
    return begins, stops, np.searchsorted(begins, ends)


_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, min(SLICE, 2 * n)), base, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if len(held) <= SLICE:
            _powers[base] = held
    return held[:n]


def mixed(x: np.ndarray, by: int = 0) -> np.ndarray:
    """64-bit numbers stirred; by: which of several ways."""
    x = (x ^ (x >> np.uint64(31))) * MIX[by % 3]
    x = (x ^ (x >> np.uint64(29))) * MIX[(by + 1) % 3]
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, begins: np.ndarray, stops: np.ndarray, letters: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each word. letters: what each byte counts as."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    total = np.cumsum(_NUMBERS[letters][data] * _powers_of(_STEP, len(data)))
    before = np.where(begins > 0, total[begins - 1], np.uint64(0))
    own = (total[stops - 1] - before) * _powers_of(_BACK, len(data))[begins]
    return mixed(own + (stops - begins).astype(np.uint64) * MIX[2])


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z and the capitals from U+00C0 to U+00DE lower-cased."""
    out = LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    if len(lead):
        second = out[lead]
        out[lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]] += 32
    return out


def chunks_of(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased chunks between ASCII white space, and how many there are
    up to each text's end. Chunks with ``<|``, which may begin a special token,
    keep their letters."""
    begins, stops, upto = cut(data, ends, BETWEEN_SPACE)
    low = lowered(data)
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    for k in np.unique(np.searchsorted(begins, special, "right") - 1) if len(special) else ():
        low[begins[k] : stops[k]] = data[begins[k] : stops[k]]
    places = np.concatenate([[0], np.cumsum(stops - begins)])
    solid = low[BETWEEN_SPACE[data] != 0]
    return pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(places), pa.py_buffer(solid)]), upto


class ChunkCache:
    """What distinct chunks give, worked out once and kept, up to a number.

    learn: gives the values (byte strings) of some distinct chunks.
    """

    def __init__(self, learn: Callable[[list[str]], list], most: int = CACHE_CHUNKS):
        self.learn, self.most, self.kept = learn, most, {}

    def of(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
        """By slices: the first text's place, the number of chunks up to each
        text's end, each chunk's number, and the values by number."""
        for first, data, ends in slices(column, CHUNK_SLICE):
            chunks, upto = chunks_of(data, ends)
            coded = chunks.dictionary_encode()
            own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            values = list(map(self.kept.get, own))
            missing = [c for c, v in zip(own, values, strict=True) if v is None]
            if missing:
                new = dict(zip(missing, self.learn(missing), strict=True))
                values = [new[c] if v is None else v for c, v in zip(own, values, strict=True)]
                self.kept.update(new)
            numbers = np.asarray(coded.indices)
            if len(self.kept) > self.most:  # what occurs again stays
                often = np.flatnonzero(np.bincount(numbers) > 1)[: self.most].tolist()
                self.kept = {own[k]: values[k] for k in often}
            yield first, upto, numbers, values

    def clear(self) -> None:
        self.kept = {}


def joined(values: list[bytes], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that the numbers name, one after another, and where each
    begins; one more place is the end."""
    taken = pa.array(values, pa.large_binary()).take(pa.array(numbers))
    _, places, raw = taken.buffers()
    places = np.frombuffer(places, np.int64)[taken.offset : taken.offset + len(taken) + 1]
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), places
