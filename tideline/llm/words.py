"""Words of many texts at once, as byte positions and 64-bit hashes in numpy.

A word is a maximal run of word bytes. Bytes of 0x80 and above, which make up every
character beyond ASCII in UTF-8, belong to words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is one piece of its own.
PIECE_BYTES = 1 << 19

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_BYTE_VALUES = np.random.default_rng(20240917).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

#: Every byte but the space and 0x09-0x0D.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, a-z and bytes of characters beyond ASCII.
LETTER_OR_DIGIT = np.zeros(256, bool)
LETTER_OR_DIGIT[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a one-to-one map."""
    x = x ^ (x >> _S33)
    x *= _MIX1
    x ^= x >> _S33
    x *= _MIX2
    x ^= x >> _S33
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown from call to call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 21:
            _powers[base] = have
    return have[:n]


class Words:
    """Words of the texts of one piece: ``starts``/``ends`` in ``data``, ``counts`` per text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> None:
        self.data = data
        self.offsets = offsets
        mask = kept[data]
        n = len(data)
        first = mask.copy()
        first[1:] &= ~mask[:-1]
        last = mask.copy()
        last[:-1] &= ~mask[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        first[cuts] = mask[cuts]
        last[cuts - 1] = mask[cuts - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        at = np.searchsorted(self.starts, offsets)
        #: text i has the words bounds[i] .. bounds[i + 1].
        self.bounds = at
        self.counts = np.diff(at)

    def hashes(self) -> np.ndarray:
        """One well mixed 64-bit hash for each word."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        sizes = self.ends - self.starts
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        letters = self.data[place + np.repeat(self.starts, sizes)]
        values = _BYTE_VALUES[letters] * powers(int(_MULT), int(sizes.max()))[place]
        sums = np.add.reduceat(values, ends - sizes)
        return mix(sums + sizes.astype(np.uint64))


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of each ``width`` consecutive hashes, by prefix sums."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(base, n), out=sums[1:])
    back = powers(pow(base, -1, 1 << 64), n - width + 1)
    return mix((sums[width:] - sums[:-width]) * back)


def pieces(
    texts: pa.Array, kept: np.ndarray, lower: bool = False, size: int = PIECE_BYTES
) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) over ``texts`` in pieces of bounded bytes. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        part = whole[offsets[row] : offsets[end]]
        yield row, end, Words(_LOWER[part] if lower else part, offsets[row : end + 1] - offsets[row], kept)
        row = end
