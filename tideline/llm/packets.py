"""Counts of texts per group, packed by bucket, as the divergence audit sends them.

A packet holds the entries of one bucket: each distinct text once with the number of its
entries, and for an entry the group, the occurrences and the documents. Distinct documents
are counted exactly up to ``limit`` (at most 3): below it the first and the last document name
them all, so entries can be merged in any order in a bounded space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tideline.llm.words import _BYTE_VALUES, _MULT, mix, powers

#: Entries held before they are merged or sent.
HELD = 1 << 19
#: Buckets that a task deals to; more are reached in two steps, so that packets stay large.
FAN = 4096

PACKET = pa.schema([("bucket", pa.int32()), ("packet", pa.binary())])
PACKET_SQL = "bucket int, packet binary"

_GROUPS = pa.schema([("lang", pa.string()), ("source", pa.string())])
_TEXTS = pa.schema([("text", pa.string()), ("entries", pa.int32())])
_ENTRIES = pa.schema([("group", pa.int32()), ("n", pa.int64()), ("docs", pa.int8()), ("first", pa.int64()), ("last", pa.int64())])


def text_hashes(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each text."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], sizes)
    sums = np.zeros(len(raw) + 1, np.uint64)
    if len(raw):
        np.cumsum(_BYTE_VALUES[raw] * powers(int(_MULT), int(sizes.max()))[place], out=sums[1:])
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + sizes.astype(np.uint64))


@dataclass
class Counts:
    """Entries with the indexes of their text and group; ``first``/``last`` count below the limit only."""

    texts: pa.Array
    groups: list[tuple[str, str]]
    text: np.ndarray
    group: np.ndarray
    n: np.ndarray
    docs: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def __len__(self) -> int:
        return len(self.n)

    def take(self, at: np.ndarray) -> Counts:
        return Counts(self.texts, self.groups, self.text[at], self.group[at], self.n[at], self.docs[at], self.first[at], self.last[at])


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the (sorted) keys begins."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.concatenate([[True], new]))


def summed(c: Counts, limit: int) -> Counts:
    """One entry for each text and group, ordered by text."""
    order = np.lexsort((c.group, c.text))
    c = c.take(order)
    cut = runs(c.text, c.group)
    if len(cut) == len(c):
        return c
    of = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(c))))
    many = np.maximum.reduceat(c.docs, cut) >= limit
    few = ~many[of]
    ends = np.concatenate([c.first[few], c.last[few]])
    entry = np.concatenate([of[few], of[few]])
    order = np.lexsort((ends, entry))
    ends, entry = ends[order], entry[order]
    one = runs(entry, ends)
    ends, entry = ends[one], entry[one]
    docs = np.bincount(entry, minlength=len(cut))
    at = runs(entry)
    first, last = np.zeros(len(cut), np.int64), np.zeros(len(cut), np.int64)
    first[entry[at]] = ends[at]
    last[entry[at]] = ends[np.append(at[1:], len(ends))[: len(at)] - 1]
    docs = np.where(many, limit, np.minimum(docs, limit))
    return Counts(c.texts, c.groups, c.text[cut], c.group[cut], np.add.reduceat(c.n, cut), docs, first, last)


def merged(parts: list[Counts], limit: int) -> Counts:
    """All entries under one numbering of texts and groups, summed."""
    if len(parts) == 1:
        return summed(parts[0], limit)
    texts = pa.chunked_array([p.texts for p in parts], pa.string()).combine_chunks().dictionary_encode()
    codes = texts.indices.to_numpy().astype(np.int64)
    number: dict[tuple[str, str], int] = {}
    text, group, start = [], [], 0
    for p in parts:
        text.append(codes[start : start + len(p.texts)][p.text])
        group.append(np.array([number.setdefault(g, len(number)) for g in p.groups], np.int64)[p.group])
        start += len(p.texts)
    rest = [np.concatenate([getattr(p, f) for p in parts]) for f in ("n", "docs", "first", "last")]
    return summed(Counts(texts.dictionary, list(number), np.concatenate(text), np.concatenate(group), *rest), limit)


def packed(c: Counts) -> bytes:
    """``c``, which is ordered by text, with its own texts and groups only."""
    cut = runs(c.text)
    used, group = np.unique(c.group, return_inverse=True)
    batches = (
        pa.RecordBatch.from_arrays([pa.array([c.groups[g][0] for g in used], pa.string()), pa.array([c.groups[g][1] for g in used], pa.string())], schema=_GROUPS),
        pa.RecordBatch.from_arrays([c.texts.take(pa.array(c.text[cut])), pa.array(np.diff(np.append(cut, len(c))).astype(np.int32))], schema=_TEXTS),
        pa.RecordBatch.from_arrays([pa.array(x.astype(t.to_pandas_dtype())) for x, t in zip((group, c.n, c.docs, c.first, c.last), _ENTRIES.types, strict=True)], schema=_ENTRIES),
    )
    parts = [b.serialize().to_pybytes() for b in batches]
    head = np.array([len(p) for p in parts], np.int64).tobytes()
    whole = head + b"".join(parts)
    return np.int64(len(whole)).tobytes() + pa.compress(whole, "zstd", asbytes=True)


def unpacked(data: bytes) -> Counts:
    whole = pa.decompress(data[8:], int(np.frombuffer(data, np.int64, 1)[0]), "zstd", asbytes=True)
    sizes, at, batches = np.frombuffer(whole, np.int64, 3).tolist(), 24, []
    for size, schema in zip(sizes, (_GROUPS, _TEXTS, _ENTRIES), strict=True):
        batches.append(pa.ipc.read_record_batch(pa.py_buffer(whole[at : at + size]), schema))
        at += size
    groups, texts, entries = batches
    text = np.repeat(np.arange(texts.num_rows), texts["entries"].to_numpy())
    values = [entries[f].to_numpy().astype(np.int64) for f in ("group", "n", "docs", "first", "last")]
    return Counts(texts["text"], list(zip(groups["lang"].to_pylist(), groups["source"].to_pylist(), strict=True)), text, *values)


def dealt(c: Counts, buckets: int, coarse: int = 1) -> Iterator[pa.RecordBatch]:
    """Packets of ``c`` by a hash of the text; of the buckets of one coarse bucket if there are such."""
    where = (text_hashes(c.texts) % np.uint64(buckets * coarse)).astype(np.int64)[c.text]
    order = np.lexsort((c.group, c.text, where))
    c, where = c.take(order), where[order]
    cut = runs(where)
    ends = np.append(cut[1:], len(c))
    for lo in range(0, len(cut), 64):
        part = slice(lo, lo + 64)
        packets = [packed(c.take(np.arange(a, b))) for a, b in zip(cut[part].tolist(), ends[part].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(where[cut[part]].astype(np.int32)), pa.array(packets, pa.binary())], schema=PACKET)
