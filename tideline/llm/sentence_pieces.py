"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is cut into words where no piece can cross (before a run of word marks). Words form
a matrix, the longest first, and advance together, character by character, until they end: the
hashes of all substrings that end there are probed in the sorted hashes of the pieces, and a
vectorised maximum keeps the best score of a path and the piece that reached it.

The files hold byte-pair pieces, whose encoding is defined by merges and not by a sum of
scores. So a step of a path is admitted only where the merges would leave its two pieces
side by side: going down the right edge of the left piece's merge tree and the left edge of
the right one's, no two parts that exist at the same time merge with each other first. One
path through every prefix is left, and it is the library's encoding. What was found for a
pair of pieces is kept in a table of PAIR_BITS, in which a later pair takes an earlier one's place.

A character that no piece covers becomes its bytes. Encodings of words are kept in a bounded
table per Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.words import mix

MARK = "▁"
#: Words whose ids a Python worker keeps.
KEPT_WORDS = 1 << 18
#: Characters of texts whose new words are encoded together.
MATRIX_CHARS = 1 << 19
#: Bytes of texts that a worker turns into Python strings at a time (or one text).
TEXT_BYTES = 1 << 20
#: Longer words are cut where no piece has the two characters side by side.
LONG_WORD = 64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20
PAIR_BITS = 20


def read_model(path: str) -> dict:
    """Pieces, scores, merges and byte pieces of a .model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    pieces, scores = [model.id_to_piece(i) for i in plain], [model.get_score(i) for i in plain]
    return {
        "pieces": pieces,
        "ids": plain,
        "scores": scores,
        "tree": merge_tree(pieces, scores),
        "bytes": {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)},
        "unknown": model.unk_id(),
    }


def merge_tree(pieces: list[str], scores: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, whole): the two pieces of each piece's last merge, -1 for a character or a
    piece that merging its characters does not give; whole marks those that it gives.
    """
    number = {p: i for i, p in enumerate(pieces)}
    left, right = np.full(len(pieces), -1), np.full(len(pieces), -1)
    whole = np.zeros(len(pieces), bool)
    for i, piece in enumerate(pieces):
        parts = list(piece)
        while len(parts) > 2:
            joined = [number.get(a + b, -1) for a, b in zip(parts, parts[1:], strict=False)]
            at = max(range(len(joined)), key=lambda k: (joined[k] >= 0, scores[joined[k]], -k))
            if joined[at] < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2 and parts[0] in number and parts[1] in number:
            left[i], right[i] = number[parts[0]], number[parts[1]]
        whole[i] = len(parts) == 1 or left[i] >= 0
    return left, right, whole


class Viterbi:
    """Encoding of words; pieces are numbered by the order of their hashes."""

    def __init__(self, model: dict) -> None:
        pieces, self.byte_ids, self.unknown = model["pieces"], model["bytes"], model["unknown"]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses from one word into the next")
        if not {c for p in pieces for c in p} <= set(pieces):
            raise ValueError("a character of a piece is no piece")
        self.longest = max(map(len, pieces), default=1)
        self.power = np.array([pow(int(_BASE), k, 1 << 64) for k in range(2 * self.longest + 1)], np.uint64)
        keys = self._hashes(pieces)
        order = np.argsort(keys)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        self.keys, self.ids = keys[order], np.array(model["ids"], np.int32)[order]
        self.scores = np.array(model["scores"], np.float64)[order]
        self.sizes = np.array([len(p) for p in pieces])[order]
        place = np.empty(len(order) + 1, np.int64)
        place[order] = np.arange(len(order))
        place[-1] = -1
        left, right, whole = model["tree"]
        self.left, self.right, self.whole = place[left[order]], place[right[order]], whole[order]
        # characters exist from the start; a piece from its merge on, best score first
        self.rank = np.where(self.left < 0, -np.inf, -self.scores)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(mix(self.keys) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.side_by_side = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.known: dict[str, bytes] = {}
        # pairs of pieces, and whether they stay apart
        self.pairs = np.full(1 << PAIR_BITS, -1)
        self.apart = np.zeros(1 << PAIR_BITS, bool)

    @staticmethod
    def _flat(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    @classmethod
    def _codes(cls, words: list[str], length: int) -> np.ndarray:
        return cls._flat(words).reshape(-1, length)

    def _hashes(self, pieces: list[str]) -> np.ndarray:
        out = np.zeros(len(pieces), np.uint64)
        lengths = np.array([len(p) for p in pieces])
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            for c in mix(self._codes([pieces[i] for i in rows], int(length)) + np.uint64(1)).T:
                out[rows] = out[rows] * _BASE + c
        return out

    def _probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``keys``, piece) of those that are a piece's hash."""
        rows = np.flatnonzero(self.maybe[(mix(keys) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[rows]), len(self.keys) - 1)
        hit = self.keys[at] == keys[rows]
        return rows[hit], at[hit]

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of a + b gives these two pieces."""
        apart = np.ones(len(a), bool)
        todo = np.arange(len(a))
        until_a, until_b = np.full(len(a), np.inf), np.full(len(a), np.inf)
        while len(todo):
            rows, joined = self._probe(self.keys[a] * self.power[self.sizes[b]] + self.keys[b])
            rank = -self.scores[joined]
            # of equal merges the left one comes first
            first = (rank < until_a[rows]) & (rank <= until_b[rows])
            apart[todo[rows[first]]] = False
            go = np.ones(len(todo), bool)
            go[rows[first]] = False
            go &= (self.left[a] >= 0) | (self.left[b] >= 0)
            todo, a, b, until_a, until_b = todo[go], a[go], b[go], until_a[go], until_b[go]
            down = self.rank[a] > self.rank[b]
            until_a, until_b = np.where(down, self.rank[a], until_a), np.where(down, until_b, self.rank[b])
            a, b = np.where(down, self.right[a], a), np.where(down, b, self.left[b])
        return apart

    def _admitted(self, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether merges leave the pieces ``before`` and ``at`` side by side."""
        both = before * len(self.keys) + at
        slot = (mix(both.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        apart = self.apart[slot]
        new = np.flatnonzero(self.pairs[slot] != both)
        if len(new):
            pairs, back = np.unique(both[new], return_inverse=True)
            found = self._stay_apart(pairs // len(self.keys), pairs % len(self.keys))
            apart[new] = found[back]
            slot = (mix(pairs.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
            # of several pairs of one place the same one must write both
            slot, first = np.unique(slot, return_index=True)
            self.pairs[slot], self.apart[slot] = pairs[first], found[first]
        return apart

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids (32-bit, little-endian) of words, the longest first."""
        lengths = np.array([len(w) for w in words])
        length, n = int(lengths[0]), len(words)
        codes = np.zeros((length, n), np.uint64)
        codes.T[np.arange(length) < lengths[:, None]] = mix(self._flat(words) + np.uint64(1))
        # words with a character at j
        open_ = n - np.searchsorted(lengths[::-1], np.arange(length + 1))
        prefix = np.zeros((length + 1, n), np.uint64)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        piece = np.full((length + 1, n), -1, np.int32)
        size = np.ones((length + 1, n), np.int32)
        for j in range(1, length + 1):
            m = int(open_[j])
            prefix[j, :m] = prefix[j - 1, :m] * _BASE + codes[j - 1, :m]
            most = min(j, self.longest)
            keys = prefix[j, :m] - prefix[j - most : j, :m][::-1] * self.power[1 : most + 1, None]
            flat, at = self._probe(keys.reshape(-1))
            k, row = flat // m + 1, flat % m
            before = piece[j - k, row].astype(np.int64)
            admitted = self.whole[at]
            pairs = np.flatnonzero(admitted & (before >= 0))  # none before: a word's start or a character without a piece
            admitted[pairs] = self._admitted(before[pairs], at[pairs])
            k, row, at = k[admitted], row[admitted], at[admitted]
            score = best[j - k, row] + self.scores[at]
            order = np.argsort(score, kind="stable")  # of several the last written, the greatest, stays
            k, row, at = k[order], row[order], at[order]
            best[j, :m] = best[j - 1, :m]
            best[j, row], piece[j, row], size[j, row] = score[order], at, k
        return self._trace(words, lengths, piece, size)

    def _trace(self, words: list[str], lengths: np.ndarray, piece: np.ndarray, size: np.ndarray) -> list[bytes]:
        """Follow all words' backpointers together; pieces come out from the end."""
        n = len(words)
        at = lengths.copy()
        found_word, found_end, found_id = [], [], []
        open_ = np.arange(n)
        while len(open_):
            p = piece[at[open_], open_]
            ids = np.where(p >= 0, self.ids[p], -1)
            found_word.append(open_)
            found_end.append(at[open_])
            found_id.append(ids)
            at[open_] -= size[at[open_], open_]
            open_ = open_[at[open_] > 0]
        word, end, ids = (np.concatenate(x) for x in (found_word, found_end, found_id))
        order = np.lexsort((end, word))
        word, end, ids = word[order], end[order], ids[order].astype(np.int32)
        cuts = np.searchsorted(word, np.arange(n + 1))
        raw = ids.tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for w in np.unique(word[ids < 0]).tolist():
            found = []
            for i in range(cuts[w], cuts[w + 1]):
                found += [int(ids[i])] if ids[i] >= 0 else self._fallback(words[w][end[i] - 1])
            out[w] = np.array(found, np.int32).tobytes()
        return out

    def _fallback(self, character: str) -> list[int]:
        raw = character.encode("utf-8", "replace")
        return [self.byte_ids[b] for b in raw] if self.byte_ids else [self.unknown]

    def _cut(self, word: str) -> list[str]:
        """A long word in parts that no piece joins."""
        ends = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.side_by_side]
        return [word[a:b] for a, b in zip([0, *ends], [*ends, len(word)], strict=True)]

    def learn(self, words: set[str]) -> None:
        """Segment the words that are not known yet, at most MATRIX_CHARS places together."""
        if len(self.known) + len(words) > KEPT_WORDS:
            self.known.clear()
        new = sorted(words - self.known.keys(), key=len, reverse=True)
        long = 0
        while long < len(new) and len(new[long]) > LONG_WORD:
            long += 1
        for w in new[:long]:
            parts = self._cut(w)
            if len(parts) == 1:
                self.known[w] = self.segment([w])[0]
            else:
                self.learn({p for p in parts if len(p) <= LONG_WORD})
                self.known[w] = b"".join([self.known.get(p) or self.segment([p])[0] for p in parts])
        i = long
        while i < len(new):
            part = new[i : i + max(1, MATRIX_CHARS // len(new[i]))]
            self.known.update(zip(part, self.segment(part), strict=True))
            i += len(part)


_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_encoders: dict[int, Viterbi] = {}


def _words(text: str | None) -> list[str]:
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


def _encoder(shared) -> Viterbi:
    token, model = shared.value
    if token not in _encoders:
        _encoders.clear()
        _encoders[token] = Viterbi(model)
    return _encoders[token]


def encode_texts(texts: list[str | None], viterbi: Viterbi) -> list[bytes]:
    """Ids (32-bit, little-endian) of each text; the texts' new words are segmented together."""
    out: list[bytes] = []
    held: list[list[str]] = []
    chars = 0
    for i, text in enumerate(texts):
        held.append(_words(text))
        chars += len(text or "")
        if chars >= MATRIX_CHARS or i == len(texts) - 1:
            viterbi.learn(set().union(*held))
            out += [_joined(words, viterbi) for words in held]
            held, chars = [], 0
    return out


def _joined(words: list[str], viterbi: Viterbi) -> bytes:
    try:
        return b"".join(map(viterbi.known.__getitem__, words))
    except KeyError:  # forgotten while the same texts were learned
        for i in range(0, len(words), KEPT_WORDS // 2):
            viterbi.learn(set(words[i : i + KEPT_WORDS // 2]))
        return b"".join([viterbi.known.get(w) or viterbi.segment([w])[0] for w in words])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about TEXT_BYTES of text."""
    sizes = np.array([n or 0 for n in pc.binary_length(batch.column("_text")).to_pylist()], np.int64)
    part = np.cumsum(sizes) // TEXT_BYTES
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows] if len(part) else []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(lo, hi - lo)


def _surfaces(model: dict) -> list[bytes]:
    """The bytes that each id stands for."""
    surface = {i: p.replace(MARK, " ").encode() for i, p in zip(model["ids"], model["pieces"], strict=True)}
    surface |= {i: bytes([b]) for b, i in model["bytes"].items()}
    return [surface.get(i, b"") for i in range(max(surface, default=-1) + 1)]


def _decoded(ids: list[int], table: list[bytes]) -> str:
    return b"".join([table[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def _encode(shared, checked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi = _encoder(shared)
        table = _surfaces(shared.value[1]) if checked else []
        for batch in batches:
            for part in _slices(batch):
                texts = part.column("_text").to_pylist()
                ids = encode_texts(texts, viterbi)
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                lists = pa.ListArray.from_arrays(offsets, values)
                if checked:
                    same = [_decoded(np.frombuffer(x, np.int32).tolist(), table) == (t or "") for x, t in zip(ids, texts, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("row"), lists, pa.array(same, pa.bool_())], names=["row", "ids", "round_trip"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column("row"), part.column("_text"), lists], names=["row", "_text", "ids"])

    return run


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _surfaces(shared.value[1])
        for batch in batches:
            ids = batch.column("ids")
            values, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
            texts = [_decoded(values[a:b].tolist(), table) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, model: str, row: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``row`` (a struct of the named columns, default doc_id), text, ids.

    ``model`` is the path of a .model file, read on the driver. A space becomes a word mark
    and one is set before the text; nothing else is normalised. Null and empty texts have
    no ids. Extra columns are only carried if named.
    """
    kind, rows, shared = _rows(docs, model, row)
    return rows.mapInArrow(_encode(shared, False), f"row {kind}, _text string, ids array<int>").withColumnRenamed("_text", "text")


def encode_checked(docs: DataFrame, model: str, row: list[str] | None = None) -> DataFrame:
    """``row`` and ids as ``encode`` gives them, and whether decoding them gives the text back.

    The ids are decoded by the worker that made them, as ``decode`` does it, and no text leaves
    it. A null or empty text comes back as the empty one.
    """
    kind, rows, shared = _rows(docs, model, row)
    return rows.mapInArrow(_encode(shared, True), f"row {kind}, ids array<int>, round_trip boolean")


def _rows(docs: DataFrame, model: str, row: list[str] | None) -> tuple:
    described = read_model(model)
    shared = docs.sparkSession.sparkContext.broadcast((hash(tuple(described["pieces"])), described))
    rows = docs.select(F.struct(*(row or ["doc_id"])).alias("row"), F.col("text").alias("_text"))
    return rows.schema["row"].dataType.simpleString(), rows, shared


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with a column ``decoded``: the text that the column ``ids`` stands for.

    Word marks become spaces, byte pieces their bytes (bytes that are no UTF-8 become the
    replacement character), and one leading space is taken off. A null list is read as empty.
    """
    described = read_model(model)
    shared = encoded.sparkSession.sparkContext.broadcast((0, described))
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.withColumn("ids", ids).mapInArrow(_decode(shared), fields + ", decoded string")
