"""Token counts by byte-pair merging over a heap and a linked list.

A word starts as its bytes, the last one marked as the word's end. The pair of lowest rank,
leftmost first, is taken from a heap again and again and its two symbols become one in a
linked list; the word has as many tokens as symbols less merges. No ids are made. Counts of
words are kept in a bounded table per Python worker.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts a Python worker keeps.
KEPT_WORDS = 1 << 19


class MergeCounter(dict):
    """word -> tokens, for a tokenizer description of byte-pair merges with word ends."""

    def __init__(self, merges: list[tuple[str, str]], word_end: str, alphabet: dict[int, str]) -> None:
        super().__init__()
        self.ranks = {(a, b): i for i, (a, b) in reversed(list(enumerate(merges)))}
        self.word_end = word_end
        self.alphabet = alphabet

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        n = self[word] = self.merge(word)
        return n

    def merge(self, word: str) -> int:
        symbols = [self.alphabet[b] for b in word.encode()]
        if not symbols:
            return 0
        symbols[-1] += self.word_end
        n = len(symbols)
        after = [*range(1, n), -1]
        before = list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            # the entry is stale if one of its symbols has changed since
            if j < 0 or symbols[i] is None or ranks.get((symbols[i], symbols[j])) != rank:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            k = after[i] = after[j]
            merges += 1
            if k >= 0:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return n - merges


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level tokenizers write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class TokenCounter:
    """Counts of a ``tokenizers`` description: NFC, lower case, split by a pattern, bytes, merges."""

    def __init__(self, described: dict) -> None:
        model = described["model"]
        split = described["pre_tokenizer"]["pretokenizers"][0]
        known = [n["type"] for n in described["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or known != ["NFC", "Replace", "Lowercase"] or not split["invert"] or model["continuing_subword_prefix"]:
            raise ValueError("only byte-pair models with NFC, lower case and an inverted split are read")
        self.words = regex.compile(split["pattern"]["Regex"])
        # inside a text they are taken as they stand, before anything else
        special = sorted((t["content"] for t in described["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.counts = MergeCounter([tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or "", byte_alphabet())

    def __call__(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        count, words = self.counts.__getitem__, self.words.findall
        return len(parts) - 1 + sum(sum(map(count, words(_plain(p)))) for p in parts)


def _plain(text: str) -> str:
    text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # lower-casing goes by character: no final sigma
        text = text.replace("Σ", "σ")
    return text.lower()


_counters: dict[int, TokenCounter] = {}


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(shared.value[0])
        if counter is None:
            _counters.clear()
            counter = _counters[shared.value[0]] = TokenCounter(json.loads(shared.value[1]))
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()),
                    pa.array([counter(t) for t in texts], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, in one pass without a shuffle.

    ``tokenizer`` is the path of a ``tokenizers`` .json file; it is read on the driver. A
    special string inside a text counts as one token. Null and empty texts have 0 bytes
    and 0 tokens; doc_id is handed on as it is, null or repeated. Other columns are not read.
    """
    with open(tokenizer, encoding="utf-8") as f:
        described = f.read()
    described = json.loads(described)
    described["model"].pop("vocab")
    text = json.dumps(described)
    shared = docs.sparkSession.sparkContext.broadcast((hash(text), text))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_count(shared), f"doc_id {id_type}, n_bytes long, n_tokens long")
