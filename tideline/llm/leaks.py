"""Benchmark decontamination with a generalised suffix automaton of the benchmark items.

The automaton accepts every run of words of every item. A document's words are streamed
through it and the length of the longest item run that ends at each word is tracked; where
it reaches ``window`` the last ``window`` words are a window of some item. The state that
holds exactly these words names the items. Runs of document words that the items know are
found in numpy first, so that the stream only walks runs that can hold a window.

An automaton is built for at most SHARD_BYTES of item text, so what a task receives is
bounded; a larger benchmark is split by item and the documents are streamed once per shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.tables import text_bytes
from tideline.llm.words import LETTER_OR_DIGIT, pieces
from tideline.session import materialise

#: Item text per automaton.
SHARD_BYTES = 4 << 20

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Automaton:
    """Suffix automaton over the word numbers of several items."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.len)
        names: list[set[str]] = [set() for _ in range(n)]
        short: list[set[tuple[int, str]]] = [set() for _ in range(n)]
        for name, words in items:
            s = 0
            for i, w in enumerate(words, 1):
                s = self.next[s][w]
                if i >= window:
                    t = s
                    while self.len[self.link[t]] >= window:
                        t = self.link[t]
                    names[t].add(name)
            if len(words) < window:
                t = s
                while self.len[self.link[t]] >= len(words):
                    t = self.link[t]
                short[t].add((len(words), name))
        #: For each state, the one on its chain that holds the runs of exactly ``window`` words.
        self.top = list(range(n))
        for s in sorted(range(1, n), key=self.len.__getitem__):
            up = self.link[s]
            if self.len[up] >= window:
                self.top[s] = self.top[up]
            if up > 0:
                short[s] |= short[up]
        self.names = [tuple(x) for x in names]
        self.short = [tuple(x) for x in short]
        self.least = min((min(len(words), window) for _, words in items), default=window)

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            old = self.next[last][w]
            return old if self.len[old] == self.len[last] + 1 else self._split(last, w, old)
        new = self._state(self.len[last] + 1, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            old = self.next[p][w]
            self.link[new] = old if self.len[old] == self.len[p] + 1 else self._split(p, w, old)
        else:
            self.link[new] = 0
        return new

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, w: int, old: int) -> int:
        """Part the shorter runs of ``old`` from it."""
        copy = self._state(self.len[p] + 1, dict(self.next[old]))
        self.link[copy] = self.link[old]
        self.link[old] = copy
        while p != -1 and self.next[p].get(w) == old:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit [start, end) intervals (merged), items and the longest match of a run of words."""
        moves, link, length, window = self.next, self.link, self.len, self.window
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        s = size = longest = 0
        for i, w in enumerate(words, 1):
            while s and w not in moves[s]:
                s = link[s]
                size = length[s]
            if w in moves[s]:
                s = moves[s][w]
                size += 1
            else:
                continue
            longest = max(longest, size)
            hit = 0
            if size >= window:
                hit = window
                items.update(self.names[self.top[s]])
            for n, name in self.short[s]:
                if n <= size:
                    hit = max(hit, n)
                    items.add(name)
            if hit:
                start = i - hit
                while spans and start <= spans[-1][1]:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
        return spans, items, longest


def _vocabulary(texts: list[str]) -> tuple[np.ndarray, list[list[int]]]:
    """Sorted hashes of the items' words; each item's words as places among them."""
    hashes = [np.concatenate([np.empty(0, np.uint64), *(w.hashes() for _, _, w in pieces(pa.array([t]), LETTER_OR_DIGIT, lower=True))]) for t in texts]
    known = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]))
    return known, [np.searchsorted(known, h).tolist() for h in hashes]


def _runs(mask: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the runs of known words, within one text, of at least ``least`` words."""
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = bounds[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(mask))])
    cuts = cuts[mask[cuts] & mask[cuts - 1]]
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    long = ends - starts >= least
    return starts[long], ends[long]


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, automaton = shared.value
        for batch in batches:
            texts = batch.column("_text")
            n = len(texts)
            counts, longest = np.zeros(n, np.int64), np.zeros(n, np.int64)
            spans: list[list] = [[] for _ in range(n)]
            items: list[set[str]] = [set() for _ in range(n)]
            for first, _, words in pieces(texts, LETTER_OR_DIGIT, lower=True):
                counts[first : first + len(words.counts)] = words.counts
                hashes = words.hashes()
                if not len(hashes) or not len(known):
                    continue
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                starts, ends = _runs(known[at] == hashes, words.bounds, automaton.least)
                in_text = np.searchsorted(words.bounds, starts, "right") - 1
                for t, lo, hi in zip(in_text.tolist(), starts.tolist(), ends.tolist(), strict=True):
                    found, names, size = automaton.stream(at[lo:hi].tolist())
                    row, base = first + t, lo - int(words.bounds[t])
                    longest[row] = max(longest[row], size)
                    items[row] |= names
                    spans[row] += [{"start": base + a, "end": base + b} for a, b in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(counts),
                    pa.array(longest),
                    pa.array(spans, _SPANS),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                names=[*batch.schema.names, "_n", "_longest", "_spans", "_items"],
            )

    return run


def _without(text: str, spans: list[dict[str, int]]) -> str:
    """The text without the bytes from the first to the last word of each interval."""
    raw = text.encode()
    ((_, _, words),) = pieces(pa.array([text]), LETTER_OR_DIGIT, lower=True)
    parts, done = [], 0
    for s in spans:
        parts.append(raw[done : words.starts[s["start"]]])
        done = words.ends[s["end"] - 1]
    return b"".join([*parts, raw[done:]]).decode()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, texts, spans = batch.columns
        hit = np.flatnonzero(pa.compute.list_value_length(spans).to_numpy(zero_copy_only=False) > 0).tolist()
        if hit:
            rest = texts.to_pylist()
            for i in hit:
                rest[i] = _without(rest[i], spans[i].as_py())
            texts = pa.array(rest, pa.string())
        yield pa.RecordBatch.from_arrays([rows, texts], names=["_row", "_rest"])


def _merged(one: Column, two: Column) -> Column:
    """Union of two sorted lists of intervals."""
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")

    def add(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        wider = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")))
        return F.when(
            (F.size(done) > 0) & (last["end"] >= s["start"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), wider),
        ).otherwise(F.concat(done, F.array(s)))

    both = F.aggregate(F.array_sort(F.concat(one, two)), empty, add)
    return F.when(F.size(one) == 0, two).when(F.size(two) == 0, one).otherwise(both)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, row: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``row`` (a struct), ``text``, n_words, longest, spans, items.

    ``row`` holds the named columns (default doc_id); ``longest`` is the longest run of words
    of the text that stands in an item; ``spans`` are the hit word intervals, merged;
    ``items`` the ids, as strings in their order, of the items with a window in the text.
    Words are runs of digits, letters a-z after lower-casing A-Z, and characters beyond
    ASCII; a window is ``window`` words of an item, or all words of a shorter one. Null and
    empty texts have no words; items without words are ignored; a null item_id is listed as
    the empty string; rows of either table may repeat.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text")
    )
    # repeated rows would fall into one shard, and count as text
    items = materialise(items.distinct())
    shards = max(1, -(-text_bytes(items) * 5 // (4 * SHARD_BYTES)))
    found = docs.select(
        F.struct(*(row or ["doc_id"])).alias("row"),
        F.col("text").alias("_text"),
        F.lit(0).cast("long").alias("longest"),
        F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for k in range(shards):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k).collect()
        known, words = _vocabulary([r.text for r in part])
        automaton = Automaton(list(zip((r.item for r in part), words, strict=True)), window)
        shared = docs.sparkSession.sparkContext.broadcast((known, automaton))
        fields = [f"{f.name} {f.dataType.simpleString()}" for f in found.select("row", "_text", "longest", "spans", "items").schema]
        more = "_n long, _longest long, _spans array<struct<start: bigint, end: bigint>>, _items array<string>"
        found = found.select("row", "_text", "longest", "spans", "items").mapInArrow(
            _scan(shared), ", ".join(fields) + ", " + more
        )
        if shards == 1:
            found = found.select("row", "_text", F.col("_n").alias("n_words"), F.col("_longest").alias("longest"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))
        else:
            found = materialise(
                found.select(
                    "row",
                    "_text",
                    F.col("_n").alias("n_words"),
                    F.greatest("longest", "_longest").alias("longest"),
                    _merged(F.col("spans"), F.col("_spans")).alias("spans"),
                    F.array_sort(F.array_union("items", "_items")).alias("items"),
                )
            )
    return found.withColumnRenamed("_text", "text")


def n_hit(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without leaked spans: same columns, ``text`` cut where benchmark windows stand.

    A row of whose words more than ``max_coverage`` are hit is dropped whole. Other rows
    stay; without a hit the text is unchanged. Nulls and empty texts stay as they are.
    """
    found = find_leaks(docs, benchmark, window, row=docs.columns)
    kept = found.where(n_hit() <= max_coverage * F.col("n_words"))
    fields = f"_row {found.schema['row'].dataType.simpleString()}, _rest string"
    cut = kept.select("row", "text", "spans").mapInArrow(_cut, fields)
    return cut.select(*[F.col("_rest").alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
