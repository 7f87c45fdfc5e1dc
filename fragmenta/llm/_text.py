"""Words of many texts at once, found and hashed over the bytes of an Arrow column.

A batch's texts lie one behind the other in one buffer. All words' first eight bytes are mixed
into their hashes at once, then the next eight of those that have more, and so on; a step is a
bijection of what it mixes in, so words of up to eight bytes and one length never collide, and no
two words do by the form of their letters. Only words over LONGEST bytes become Python objects.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
PRIME = U(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one.
LONGEST = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: White space as the contracts define it.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and all ASCII signs.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
_TAILS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def block(data: np.ndarray, start: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of spans as numbers, zeros beyond the ``left`` bytes of each; ``data`` has eight bytes to spare."""
    found = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))[start]
    return found & _TAILS[np.minimum(left, 8)]


def spare(data: np.ndarray) -> np.ndarray:
    """A copy with eight zeros behind it."""
    out = np.zeros(len(data) + 8, np.uint8)
    out[: len(data)] = data
    return out


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """64-bit hashes of byte spans of ``data``, which has eight bytes to spare; spans over ``longest`` bytes one by one."""
    size = end - start
    with np.errstate(over="ignore"):
        out = mix(mix(size.astype(U) * PRIME) ^ block(data, start, size))
        more = np.flatnonzero(size > 8)
        for k in range(8, longest, 8):
            if not len(more):
                break
            out[more] = mix(out[more] ^ block(data, start[more] + k, size[more] - k))
            more = more[size[more] > k + 8]
    for i in more.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed=61)
    return out


class Words(NamedTuple):
    data: np.ndarray  # bytes of the chunk
    bounds: np.ndarray  # texts' byte bounds, one more than texts
    start: np.ndarray  # words' byte bounds
    end: np.ndarray
    first: np.ndarray  # texts' word bounds, one more than texts
    hash: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def chunks(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, byte bounds) of runs of texts of about ``most`` bytes, or of one longer text. Null: empty."""
    texts = column.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        yield row, data[bounds[row] : bounds[last]], bounds[row : last + 1] - bounds[row]
        row = last


def words(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = WHITE) -> Words:
    """All words of a chunk; none reaches over the end of its text."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, bounds, none, none, np.zeros(len(bounds), np.int64), np.zeros(0, U))
    gap = separators[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begins = ~gap
    begins[1:] &= gap[:-1] | edge[1:n]
    ends = ~gap
    ends[:-1] &= gap[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, bounds, start, end, np.searchsorted(start, bounds), hashes_of(spare(FOLD[data]), start, end))


_TURNS = mix(np.arange(1, 65, dtype=U) * U(0xD1342543DE82EF95)) | U(1)


def windows(found: Words, offsets: list[int] | range) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every place where the words at ``offsets`` all lie in one text."""
    n, span = len(found.hash), offsets[-1] + 1
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, U)
    with np.errstate(over="ignore"):
        total = np.zeros(n - span + 1, U)
        for k, o in enumerate(offsets):
            total += found.hash[o : n - span + 1 + o] * _TURNS[k]
        total = mix(total + U(len(offsets)))
    last = np.repeat(found.first[1:], np.diff(found.first))
    place = np.flatnonzero(np.arange(n - span + 1) + span <= last[: n - span + 1])
    return place, total[place]
