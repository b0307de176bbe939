"""Substring dedup: token windows that stand in an earlier document are removed.

Every window of ``window`` consecutive words gets a Rabin-Karp hash. A task names each
window once, with the smallest doc_id it saw, so that a passage in a third of all
documents reaches its bucket once per million windows and not once per document; the bucket
of a window finds the smallest doc_id of all and names the windows to remove to the
documents that hold them. Overlapping windows merge into maximal intervals.

The bucket comes from one 64-bit hash and 56 bits of another go to it; the number of
buckets grows with the text, so the chance of a false match of a window stays near
(windows of a bucket) / 2**56, about 2e-11, at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.tables import id_back, id_key, text_bytes
from tideline.llm.words import NOT_BLANK, mix, pieces, rolling

BASE = 0x2545F4914F6CDD1D
BASE_BUCKET = 0x5851F42D4C957F2D
HASH_BYTES = 7
#: Bytes of text whose windows meet in one bucket.
BUCKET_TEXT = 16 << 20
#: Buckets at least, so that the rows per document do not change with the size of small inputs.
LEAST_BUCKETS = 128
#: Windows that a task holds before it sends them.
HELD_WINDOWS = 1 << 20

_SHORT = np.uint64((1 << 8 * HASH_BYTES) - 1)
_PACKET = pa.schema(
    [("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("done", pa.bool_())]
)


def _packed(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :HASH_BYTES] = raw
    return out.reshape(-1).view(np.uint64)


def _windows(words, width: int):
    """Text index and hashes (short, bucket) of each window that lies within one text."""
    hashes = words.hashes()
    short = rolling(hashes, width, BASE) & _SHORT
    if not len(short):
        return np.empty(0, np.int64), short, short
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    inside = text[: len(short)] == text[width - 1 :]
    where = rolling(mix(hashes + np.uint64(1)), width, BASE_BUCKET)
    return text[: len(short)][inside], short[inside], where[inside]


def _by_run(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Consecutive equal ids as (id, count)."""
    cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[cut].tobytes(), np.diff(np.append(cut, len(ids))).astype(np.int32).tobytes()


def _packets(found: list[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    """One row per bucket with the windows of ``found``, each once, and one with those already judged."""
    doc, short, where = (np.concatenate(x) for x in zip(*found, strict=True))
    bucket = (where % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((doc, short, bucket))
    doc, short, bucket = doc[order], short[order], bucket[order]
    new = np.concatenate([[True], (short[1:] != short[:-1]) | (bucket[1:] != bucket[:-1])])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    known = doc > least  # an earlier document among these has the window
    for part, done in ((new, False), (known, True)):
        d, s, b = doc[part], short[part], bucket[part]
        if not len(b):
            continue
        order = np.lexsort((s, d, b))
        d, s, b = d[order], s[order], b[order]
        cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        rows = [
            (int(b[lo]), *_by_run(d[lo:hi]), _packed(s[lo:hi]), done)
            for lo, hi in zip(cuts, np.append(cuts[1:], len(b)), strict=True)
        ]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PACKET.types, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, schema=_PACKET)


def _send(buckets: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, words in pieces(batch.column(1), NOT_BLANK):
                text, short, where = _windows(words, width)
                if len(short):
                    found.append((ids[first + text], short, where))
                    held += len(short)
                if held >= HELD_WINDOWS:
                    yield from _packets(found, buckets)
                    found, held = [], 0
        if found:
            yield from _packets(found, buckets)

    return run


def _expand(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(b"".join(table["ids"].to_pylist()), np.int64)
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.int32)
    return np.repeat(ids, counts), _unpacked(b"".join(table["hashes"].to_pylist()))


def _judge(table: pa.Table) -> pa.Table:
    """Of one bucket: for each document the windows that an earlier document has."""
    doc, short = _expand(table.filter(pa.compute.invert(table["done"])))
    order = np.lexsort((doc, short))
    doc, short = doc[order], short[order]
    if len(doc):
        new = np.concatenate([[True], short[1:] != short[:-1]])
        later = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        doc, short = doc[later], short[later]
    more_doc, more_short = _expand(table.filter(table["done"]))
    doc, short = np.concatenate([doc, more_doc]), np.concatenate([short, more_short])
    order = np.argsort(doc, kind="stable")
    doc, packed = doc[order], _packed(short[order])
    cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, np.int64)
    ends = np.append(cuts[1:], len(doc)) if len(doc) else cuts
    return pa.table(
        {
            "_key": pa.array(doc[cuts], pa.int64()),
            "_flags": pa.array([packed[a * HASH_BYTES : b * HASH_BYTES] for a, b in zip(cuts, ends, strict=True)], pa.binary()),
        }
    )


def _merged(starts: np.ndarray, width: int) -> list[dict[str, int]]:
    """Maximal intervals [start, end) covered by windows that begin at ``starts`` (ascending)."""
    gap = np.flatnonzero(np.diff(starts) > width)
    first = starts[np.concatenate([[0], gap + 1])]
    last = starts[np.concatenate([gap, [len(starts) - 1]])] + width
    return [{"start": int(a), "end": int(b)} for a, b in zip(first, last, strict=True)]


_RESULT = "doc_id long, n_words long, spans array<struct<start: long, end: long>>, text string"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, flags = batch.columns
            flagged = np.flatnonzero(flags.is_valid().to_numpy(zero_copy_only=False))
            spans_of: dict[int, list] = {}
            for row in flagged.tolist():
                for _, _, words in pieces(texts.slice(row, 1), NOT_BLANK):
                    _, short, _ = _windows(words, width)
                    bad = _unpacked(b"".join(flags[row].as_py()))
                    spans_of[row] = _merged(np.flatnonzero(np.isin(short, bad)), width)
            counts, spans, kept = [], [], []
            for row, text in enumerate(texts.to_pylist()):
                words = (text or "").encode().split()
                counts.append(len(words))
                cut = spans_of.get(row, [])
                if cut:
                    stay = np.ones(len(words), bool)
                    for s in cut:
                        stay[s["start"] : s["end"]] = False
                    words = compress(words, stay.tolist())
                spans.append(cut)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "spans", "text"],
            )

    return run


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, removed word intervals ``spans``, kept ``text``.

    A window is removed when its word sequence also starts in a document with a smaller
    doc_id. Words are runs of bytes other than blanks; kept words are joined by a space.
    A null or empty text has no words and becomes the empty text; a text shorter than the
    window stays whole. A null doc_id counts as larger than all others; rows that share a
    doc_id do not remove each other's windows. Columns besides doc_id and text are not read.
    """
    texts = docs.select(id_key().alias("_key"), F.col("text").alias("_text"))
    buckets = max(LEAST_BUCKETS, -(-text_bytes(docs) // BUCKET_TEXT))
    sent = texts.mapInArrow(_send(buckets, window), "bucket int, ids binary, counts binary, hashes binary, done boolean")
    flags = sent.groupBy("bucket").applyInArrow(_judge, "_key long, _flags binary")
    per_doc = flags.groupBy("_key").agg(F.collect_list("_flags").alias("_flags"))
    joined = texts.join(per_doc, "_key", "left").select("_key", "_text", "_flags")
    return joined.mapInArrow(_cut(window), _RESULT).withColumn("doc_id", id_back("doc_id"))
