"""Training-order materialisation: sequences of token ids in shards of fixed stride.

Every document's tokens, closed by an end-of-text token, are cut into sequences of
``length`` tokens. One pass encodes the texts, numbers the sequences by task and place in it,
and sends each to the place that a keyed Feistel permutation of PLACES gives its number. Equal
ranges of places are shards: a task sorts its shard and writes it as one file. A slot is the
rank of its place among those taken, so slots are contiguous, and how many a place has before
it follows from the counts of the shards, once they are written. A slot stands at
(slot - first slot of the shard) * stride. Readers go through slots in order and can start at
any of them. Tokens are on disk twice, on their way and in their shards.

A shard is written under another name and then renamed, and its bytes depend on the input
and key only, so a task that runs again after a lost executor writes the same file.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.words import mix
from tideline.session import materialise

ROUNDS = 6
#: Numbers and places of sequences: a task's number below 2**22, the place in it below 2**40.
PLACES, IN_TASK = 1 << 62, 1 << 40
SHARD_BYTES = 64 << 20


class Feistel:
    """Keyed permutation of 0 .. n - 1."""

    def __init__(self, n: int, key: bytes) -> None:
        self.n = n
        self.half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [
            np.uint64(int.from_bytes(blake2b(bytes([r]), key=key, digest_size=8).digest(), "big")) for r in range(ROUNDS)
        ]

    def _rounds(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self.mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & self.mask)
        return right << shift | left

    def _walk(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        x = self._rounds(np.asarray(x, np.uint64), keys)
        far = np.flatnonzero(x >= self.n)
        while len(far):
            x[far] = self._rounds(x[far], keys)
            far = far[x[far] >= self.n]
        return x.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self.keys)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


@dataclass
class Layout:
    """What a reader has to know; stored as layout.json beside the shards."""

    sequences: int
    length: int
    token_bytes: int
    end_of_text: int
    #: First slot of each shard, and the number of slots.
    first_slots: list[int]

    @property
    def stride(self) -> int:
        return self.length * self.token_bytes

    @property
    def dtype(self) -> str:
        return f"<u{self.token_bytes}"


class _Encoder:
    """Text -> token ids by the public library, without special tokens."""

    def __init__(self, described: dict) -> None:
        import tiktoken

        self.library = tiktoken.Encoding(
            "own", pat_str=described["pattern"], mergeable_ranks=described["ranks"], special_tokens={}
        )

    def ids(self, text: str) -> list[int]:
        return self.library.encode_ordinary(text)


_encoders: dict[tuple, _Encoder] = {}


def _encoder(described: dict) -> _Encoder:
    name = (described["pattern"], len(described["ranks"]))
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = _Encoder(described)
    return _encoders[name]


def read_ranks(path: str, pattern: str) -> dict:
    """A byte-pair vocabulary of base64 lines with ranks."""
    import base64

    with open(path, "rb") as f:
        return {"pattern": pattern, "ranks": {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}}


def _shard(places: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each place: shards are ranges of places, each as long as the others but the last."""
    return (places // -(-PLACES // shards)).astype(np.int32)


def _cut(shared, stride: int, end_of_text: int, dtype: str, id_type: pa.DataType, key: bytes, shards: int):
    """doc_id, text -> sequences with their shard and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value).ids
        order = Feistel(PLACES, key)
        end = np.array([end_of_text], dtype).tobytes()
        part, done = TaskContext.get().partitionId(), 0
        for batch in chain.from_iterable((w.slice(lo, 500) for lo in range(0, w.num_rows, 500)) for w in batches):
            ids, places, sizes, tokens = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                raw = np.array(encode(text), dtype).tobytes() + end
                for place, at in enumerate(range(0, len(raw), stride)):
                    piece = raw[at : at + stride]
                    ids.append(doc)
                    places.append(place)
                    sizes.append(len(piece) // len(end))
                    tokens.append(piece)
            if ids:
                numbers = part * IN_TASK + np.arange(done, done + len(ids))
                done += len(ids)
                if part * IN_TASK >= PLACES or done > IN_TASK:
                    raise ValueError(f"no number for sequence {done} of task {part}")
                at = order.slot(numbers)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_shard(at, shards)),
                        pa.array(at),
                        pa.array(ids, id_type),
                        pa.array(places, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(tokens, pa.binary()),
                    ],
                    names=["shard", "place", "doc_id", "seq_no", "n_tokens", "tokens"],
                )

    return run


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _write(path: str, layout: Layout, id_type: pa.DataType):
    names = ["doc_id", "seq_no", "shard", "byte_offset", "n_tokens", "crc"]
    types = [id_type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(path)
        now, out, part, last, offset = None, None, "", -1, 0

        def close() -> None:
            if out is not None:
                out.close()
                store.move(part, f"{root}/{shard_name(now)}")

        for batch in batches:
            rows = []
            for shard, place, doc, seq, size, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    close()
                    now, offset = shard, 0
                    part = f"{root}/.{shard_name(shard)}.{np.random.default_rng().integers(1 << 62):x}"
                    out = store.open_output_stream(part)
                if place <= last:
                    raise ValueError(f"place {place} of shard {shard} after {last}")
                last = place
                raw += np.full(layout.length - size, layout.end_of_text, layout.dtype).tobytes()
                out.write(raw)
                rows.append((doc, seq, shard, offset, size, zlib.crc32(raw)))
                offset += layout.stride
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        close()

    return run


def write_training_order(
    docs: DataFrame, path: str, ranks: dict, end_of_text: int, key: bytes, length: int = 512, shard_bytes: int = SHARD_BYTES
) -> tuple[Layout, DataFrame]:
    """Write the shards of ``docs`` below ``path``; returns the layout and one row per sequence.

    The rows are doc_id, seq_no (place in the document), slot, shard, byte_offset in the
    shard's file, n_tokens without the filling, and crc (crc32 of the slot's bytes); they are
    written to the shared folder. A null or empty text has no sequence; a null doc_id and
    repeated rows are written like others; an empty table writes no shard. The texts' bytes
    bound the number of sequences, so that shards have ``shard_bytes`` or fewer on average.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    token_bytes = 2 if max(end_of_text, len(ranks["ranks"])) < 1 << 16 else 4
    layout = Layout(0, length, token_bytes, end_of_text, [0])
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    # a token has a byte at least
    bound = docs.agg(F.sum(F.ceil((F.octet_length("text") + 1) / F.lit(length)))).first()[0] or 0
    shards = max(1, -(-int(bound) * layout.stride // max(layout.stride, shard_bytes)))
    cut = docs.select("doc_id", "text").mapInArrow(
        _cut(shared, layout.stride, end_of_text, layout.dtype, id_type, key, shards),
        f"shard int, place long, doc_id {kind}, seq_no long, n_tokens long, tokens binary",
    )
    store, root = _open(path)
    store.create_dir(root, recursive=True)
    dealt = cut.repartition(shards, "shard").sortWithinPartitions("shard", "place")
    written = materialise(
        dealt.mapInArrow(_write(path, layout, id_type), f"doc_id {kind}, seq_no long, shard int, byte_offset long, n_tokens long, crc long")
    )
    # one number per shard
    counts = {r.shard: r.n for r in written.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    for shard in range(shards):
        layout.first_slots.append(layout.first_slots[-1] + counts.get(shard, 0))
    layout.sequences = layout.first_slots[-1]
    with store.open_output_stream(f"{root}/layout.json") as f:
        f.write(json.dumps(asdict(layout)).encode())
    first = spark.createDataFrame([(k, layout.first_slots[k]) for k in sorted(counts)], "shard int, first long")
    rows = written.join(F.broadcast(first), "shard")
    slot = F.col("first") + F.expr(f"byte_offset div {layout.stride}")
    return layout, rows.select("doc_id", "seq_no", slot.alias("slot"), "shard", "byte_offset", "n_tokens", "crc")


def read_slots(path: str, first: int, count: int) -> Iterator[np.ndarray]:
    """Token ids of ``count`` slots from ``first`` on, in order; ends at the last slot."""
    store, root = _open(path)
    with store.open_input_stream(f"{root}/layout.json") as f:
        layout = Layout(**json.loads(f.read()))
    slot, end = first, min(layout.sequences, first + count)
    while slot < end:
        shard = bisect_right(layout.first_slots, slot) - 1
        at = slot - layout.first_slots[shard]
        with store.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(at * layout.stride)
            for _ in range(min(end, layout.first_slots[shard + 1]) - slot):
                yield np.frombuffer(f.read(layout.stride), layout.dtype)
                slot += 1
