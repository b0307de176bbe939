"""Periodic runs: stretches of words that repeat one period at least three times.

Multi-scale minimizers. For the periods of one scale, (half, 3/4] or (3/4, 1] of a power of
two, every window of words has a minimum under a random order of the words. Inside a run
of period q the windows repeat q words later, and so do their minima; each minimum is named
by the words that follow it, as many as the longest period of the scale. A stretch as long
as q of a run with smallest period q stands again after q words and not before, so the pairs
of equal minimizers that follow each other give the period, and a run of three periods
holds at least one such pair. Each pair is extended word by word to both sides. Periods up
to SHORT are too short for that and are found by direct scans at each lag.

Names are hashes that are compared word by word before they are believed; where two
different stretches share a hash, the words themselves are the names. Words are numbered
exactly. So every run is found, and only runs.

Texts are handled in pieces of bounded size in which all steps are numpy over all texts at
once; a text above that size is a piece of its own. Every document is judged alone, so no
shuffle is needed and no key can be hot.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.words import mix, powers

#: Periods found by direct scans; from here on the scales begin. A power of two.
SHORT = 16
#: Bytes of text handled at once.
PIECE_BYTES = 4 << 20

_BASE = 0x9FB21C651E98DF25
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of the runs of True that are at least ``least`` long."""
    edge = np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - first >= least
    return first[long], end[long]


def _agree(words: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from ``a`` on (before ``a`` if step is -1) equal those from ``b`` > ``a`` on."""
    done, size = 0, 64
    while True:
        if step > 0:
            n = min(size, len(words) - b - done)
            differ = np.flatnonzero(words[a + done : a + done + n] != words[b + done : b + done + n])
        else:
            n = min(size, a - done)
            differ = np.flatnonzero(words[a - done - n : a - done][::-1] != words[b - done - n : b - done][::-1])
        if len(differ):
            return done + int(differ[0])
        done += n
        if n < size:
            return done
        size *= 2


def _primes(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + [n] * (n > 1)


def _primitive(words: np.ndarray, start: int, period: int) -> bool:
    """Whether no shorter period divides ``period``: then it is the smallest of a stretch of three."""
    one = words[start : start + period]
    return all((one[: period - period // p] != one[period // p :]).any() for p in _primes(period))


def _short_runs(words: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    for q in range(1, min(SHORT, len(words) // times) + 1):
        first, end = _stretches(words[q:] == words[:-q], max(least, times * q) - q)
        for s, e in zip(first.tolist(), end.tolist(), strict=True):
            if _primitive(words, s, q):
                yield s, e + q - s, q


def _equal_next(words: np.ndarray, sums: np.ndarray, back: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``at`` and the next ones from which the same ``width`` words follow."""
    at = at[at + width <= len(words)]
    names = mix((sums[at + width] - sums[at]) * back[at])
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    a, b = at[order[:-1][same]], at[order[1:][same]]
    step = max(1, (1 << 20) // width)
    for lo in range(0, len(a), step):
        reach = np.arange(width)
        if (words[a[lo : lo + step, None] + reach] != words[b[lo : lo + step, None] + reach]).any():
            break
    else:
        return a, b
    # two different stretches have one hash: go by the words
    last: dict[bytes, int] = {}
    pairs = []
    for p in np.unique(np.concatenate([a, b])).tolist():
        name = words[p : p + width].tobytes()
        if name in last:
            pairs.append((last[name], p))
        last[name] = p
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _long_runs(words: np.ndarray, longest: int, seed: int = 1) -> Iterator[tuple[int, int, int]]:
    """Runs with a period above SHORT and up to ``longest``, in texts that are parted by words of their own."""
    n = len(words)
    bits = np.uint64(n.bit_length())
    place = np.arange(n, dtype=np.uint64)
    # a random order of the words; the first of equal ones is least
    least = (mix(words.astype(np.uint64) + np.uint64(seed)) >> bits << bits) | place
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(words.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
    back = powers(pow(_BASE, -1, 1 << 64), n)
    spot = (np.uint64(1) << bits) - np.uint64(1)
    window, top = 1, 2 * SHORT
    while top // 2 < longest and top // 2 < n:
        for part, low, high in ((top // 4, top // 2, top // 4 * 3), (top // 2, top // 4 * 3, top)):
            while window < part:
                least = np.minimum(least[:-window], least[window:]) if len(least) > window else least[:0]
                window *= 2
            if not len(least):
                return
            new = np.concatenate([[True], least[1:] != least[:-1]])
            at = np.unique((least[new] & spot).astype(np.int64))
            a, b = _equal_next(words, sums, back, at, high)
            q = b - a
            fit = (q > low) & (q <= high)
            a, q = a[fit], q[fit]
            order = np.lexsort((a, q))
            done = (0, -1)
            for p, period in zip(a[order].tolist(), q[order].tolist(), strict=True):
                if done[0] == period and p < done[1]:
                    continue
                start = p - _agree(words, p, p + period, -1)
                end = p + period + _agree(words, p, p + period, 1)
                done = (period, end - period)
                yield start, end - start, period
        top *= 2


def find_runs(words: np.ndarray, longest: int, least: int, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, ordered by start and period.

    ``longest``: words of the longest text in ``words``.
    """
    found = set(_short_runs(words, least, times))
    if longest // times > SHORT:
        for start, length, q in _long_runs(words, longest // times):
            if length >= max(least, times * q) and _primitive(words, start, q):
                found.add((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _piece(texts: list[str | None], least: int) -> tuple[list[int], list[list[dict]], list[str]]:
    """Words, runs and collapsed text of each text."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    split = [(t or "").encode().split() for t in texts]
    sizes = np.array([len(w) for w in split])
    runs: list[list[dict]] = [[] for _ in split]
    kept = [b" ".join(w) for w in split]
    some = np.flatnonzero(sizes >= least)
    if not len(some):
        return sizes.tolist(), runs, [k.decode() for k in kept]
    # texts of about one length together: long periods are looked for in long texts only
    level = np.frexp(sizes[some] // 3)[1]
    for height in np.unique(level):
        own = some[level == height]
        parts = []
        for k, i in enumerate(own.tolist()):
            parts.append(np.fromiter(map(number.__getitem__, split[i]), np.int64, len(split[i])))
            parts.append(np.array([-1 - k]))
        words = np.concatenate(parts)
        first = np.concatenate([[0], np.cumsum(sizes[own] + 1)])
        for start, length, q in find_runs(words, int(sizes[own].max()), least):
            k = int(np.searchsorted(first, start, "right")) - 1
            runs[own[k]].append({"start": int(start - first[k]), "length": length, "period": q})
    for i, found in enumerate(runs):
        if found:
            stay = np.ones(sizes[i], bool)
            for r in found:
                stay[r["start"] + r["period"] : r["start"] + r["length"]] = False
            kept[i] = b" ".join(w for w, s in zip(split[i], stay.tolist(), strict=True) if s)
    return sizes.tolist(), runs, [k.decode() for k in kept]


def _judge(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held = 0, 0
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for end, size in enumerate(sizes, 1):
                held += size
                if held >= PIECE_BYTES or end == len(sizes):
                    n, runs, kept = _piece(batch.column(1).slice(start, end - start).to_pylist(), least)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, end - start), pa.array(n, pa.int64()), pa.array(runs, _RUNS), pa.array(kept, pa.string())],
                        names=["doc_id", "n_words", "runs", "text"],
                    )
                    start, held = end, 0

    return run


def collapse_runs(docs: DataFrame, least: int = 24) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, ``runs`` and the text with runs collapsed.

    Words are runs of bytes other than blanks, numbered from 0. A run is a stretch with
    smallest period q of at least ``least`` and 3 q words that no neighbour extends; ``runs``
    has start, length and period of all, by start and period. Words of a run after its first q
    ones go; the kept words are joined by a space. A null or empty text has no words, no runs
    and becomes the empty text; rows are judged one by one, so repeated rows get equal results.
    doc_id keeps its type and may be null; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    return texts.mapInArrow(_judge(least), f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, text string")


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest exact length / period; ties: smallest start, then period. Null if none."""
    fields = F.lit(None).cast("struct<start: long, length: long, period: long>")
    more = lambda a, b: (b["length"] * a["period"] > a["length"] * b["period"])
    # runs come by start and period, so the first of equals stays
    return F.aggregate(runs, fields, lambda best, r: F.when(best.isNull() | more(best, r), r).otherwise(best))
