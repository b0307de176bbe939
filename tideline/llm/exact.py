"""Exact dedup by an extendible-hash index on shared files.

The directory is a table of 2**depth slots, one for each value of a key's leading bits. It
starts with one bucket; a bucket over ``bucket_bytes`` splits by its next bit, and the
directory doubles when that bit is beyond its depth. Copies of a text have one key and
count once, so they never overfill a bucket. Each bucket is a range of keys and belongs to
one task, which chains the entries of a key, compares the bytes of their texts, and writes
the chain's entries to the shared files; equal texts meet in one entry. Tasks merge equal
texts before they send them, so a text that a third of all rows hold reaches its bucket
once per HELD_BYTES of input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.tables import lower_ascii
from tideline.session import materialise, scratch_path

#: A missing id is smaller than every other, so that a row with an id stays.
NO_ID = -(2**63)
BUCKET_BYTES = 32 << 20
HELD_BYTES = 16 << 20

_ENTRY = "bucket int, key long, slot int, sha256 string, keep long, size long, text string"


@dataclass
class Directory:
    """Bucket of every slot; slot = the leading ``depth`` bits of a key."""

    depth: int
    slots: list[int]

    def bucket(self, key: Column) -> Column:
        """Joinable slot number of a key."""
        return F.lit(0).cast("int") if not self.depth else F.shiftrightunsigned(key, 64 - self.depth).cast("int")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.slots)), "slot int, bucket int")


def split(sizes: dict[int, int], bits: int, bucket_bytes: int) -> Directory:
    """Directory for ``sizes``: bytes by the leading ``bits`` bits of the key."""
    depth, slots = 0, [0]
    held = {0: (0, list(sizes))}  # bucket: its depth, its cells
    waiting = [0]
    while waiting:
        bucket = waiting.pop()
        local, cells = held[bucket]
        if local == bits or len(cells) < 2 or sum(sizes[c] for c in cells) <= bucket_bytes:
            continue
        if local == depth:  # double: every slot becomes two
            slots = [b for b in slots for _ in range(2)]
            depth += 1
        new = len(held)
        held[bucket] = (local + 1, [c for c in cells if not c >> (bits - local - 1) & 1])
        held[new] = (local + 1, [c for c in cells if c >> (bits - local - 1) & 1])
        mine = [s for s, b in enumerate(slots) if b == bucket] if depth < 12 else _span(slots, bucket, bits, depth, cells)
        for s in mine:
            if s >> (depth - local - 1) & 1:
                slots[s] = new
        waiting += [bucket, new]
    return Directory(depth, slots)


def _span(slots: list[int], bucket: int, bits: int, depth: int, cells: list[int]) -> list[int]:
    """Slots of a bucket: they are neighbours around the slot of any of its cells."""
    lo = hi = cells[0] >> (bits - depth)
    while lo > 0 and slots[lo - 1] == bucket:
        lo -= 1
    while hi + 1 < len(slots) and slots[hi + 1] == bucket:
        hi += 1
    return list(range(lo, hi + 1))


def _directory(keys: DataFrame, bucket_bytes: int) -> Directory:
    """Sizes by leading bits come from one aggregate; eight cells per bucket bound what returns."""
    each = keys.groupBy("key").agg(F.max("bytes").alias("bytes"))
    total = each.agg(F.sum("bytes")).first()[0] or 0
    bits = max(1, min(30, (8 * total // bucket_bytes).bit_length()))
    cells = each.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("cell")).agg(F.sum("bytes").alias("bytes"))
    return split({r.cell: r.bytes for r in cells.collect()}, bits, bucket_bytes)


def _merge_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (bucket, key, keep, size, text) with equal texts of one task merged."""

    def flush():
        keys = list(held)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.int32()),
                pa.array([k[1] for k in keys], pa.int64()),
                pa.array([held[k][0] for k in keys], pa.int64()),
                pa.array([held[k][1] for k in keys], pa.int64()),
                pa.array([k[2] for k in keys], pa.string()),
            ],
            names=["bucket", "key", "keep", "size", "text"],
        )

    held: dict[tuple, list[int]] = {}
    size = 0
    for batch in batches:
        for bucket, key, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            entry = held.get((bucket, key, text))
            if entry is None:
                held[bucket, key, text] = [doc, 1]
                size += len(text) + 64
                if size >= HELD_BYTES:
                    yield flush()
                    held, size = {}, 0
            else:
                entry[0] = max(entry[0], doc)
                entry[1] += 1
    if held:
        yield flush()


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by key become chains: one entry per different text of a key."""
    chain: list[list] = []
    last = None
    for batch in batches:
        out: list[tuple] = []
        for bucket, key, keep, size, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (bucket, key) != last:
                out += _entries(last, chain)
                chain, last = [], (bucket, key)
            for entry in chain:
                if entry[2] == text:
                    entry[0] = max(entry[0], keep)
                    entry[1] += size
                    break
            else:
                chain.append([keep, size, text])
        if out:
            yield _as_batch(out)
    if chain:
        yield _as_batch(_entries(last, chain))


def _entries(key, chain: list[list]) -> list[tuple]:
    return [
        (*key, slot, hashlib.sha256(text.encode()).hexdigest(), keep, size, text)
        for slot, (keep, size, text) in enumerate(sorted(chain, key=lambda e: e[2]))
    ]


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["bucket", "key", "slot", "sha256", "keep", "size", "text"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _keyed(docs: DataFrame, key_bits: int) -> DataFrame:
    norm = lower_ascii(F.col("text"))
    key = F.xxhash64(norm)
    if key_bits < 64:
        key = key.bitwiseAND(F.lit(-1 << (64 - key_bits)))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), key.alias("key"), norm.alias("norm"))


def build_index(docs: DataFrame, path: str, key_bits: int = 64, bucket_bytes: int = BUCKET_BYTES) -> Directory:
    """Write the index of ``docs`` to ``path``: one row (bucket, key, slot, sha256, keep, size, text)
    for every different text. ``key_bits`` below 64 makes keys collide, for tests of the chains.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, key_bits)
    directory = _directory(keyed.select("key", F.octet_length("norm").alias("bytes")), bucket_bytes)
    placed = keyed.withColumn("slot", directory.bucket(F.col("key"))).join(directory.table(spark), "slot")
    merged = placed.select("bucket", "key", "doc", "norm").mapInArrow(
        _merge_equal, "bucket int, key long, keep long, size long, text string"
    )
    buckets = len(set(directory.slots))
    owned = merged.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key")
    owned.mapInArrow(_chain, _ENTRY).write.option("compression", "zstd").parquet(path)
    return directory


def lookup(docs: DataFrame, path: str, key_bits: int = 64) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) whose text the index holds, with its entry; bytes are compared."""
    entries = docs.sparkSession.read.schema(_ENTRY).parquet(path).withColumnRenamed("text", "held")
    found = _keyed(docs, key_bits).join(entries, "key").where("norm = held")
    return found.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "bucket", "slot", "keep", "size")


def exact_duplicates(docs: DataFrame, key_bits: int = 64, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest
    doc_id of a group stays. A null doc_id stays only where no row of its group has an id;
    rows that share doc_id and text are one document and are kept or dropped together;
    group_size counts rows. An empty table gives no rows. Other columns are not read.
    """
    path = scratch_path(docs.sparkSession, "exact-index")
    build_index(docs, path, key_bits, bucket_bytes)
    entries = docs.sparkSession.read.schema(_ENTRY).parquet(path).select("key", "sha256", "keep", "size")
    rows = materialise(_keyed(docs, key_bits).select("doc", "key", F.sha2("norm", 256).alias("sha256")))
    both = rows.join(entries, ["key", "sha256"])
    return both.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"),
        F.when(F.col("keep") != NO_ID, F.col("keep")).alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("doc") == F.col("keep")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )
