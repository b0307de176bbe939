"""N-gram Jaccard join: a prefix tree of globally ordered n-gram sets.

0. One pass counts the n-grams of all texts in 2**20 cells. Cells above COMMON times the mean
   are common, in steps of powers of two; the global order is by step, then by hash, so a
   line or passage that many documents share stands at the end of their sets.
1. Every text becomes a set of hashed n-grams in this order; equal sets form one class.
2. Two linked sets have a number of their first n-grams in common that follows from their
   sizes. A class that shares fewer of them with all other classes together links with
   nothing and takes no further part.
   A bit table of the documents that stand for the others tells nearly all other rows apart
   before their texts are sent.
3. The classes left are grouped by the n-grams they share: each joins the smallest class
   that holds enough of its first n-grams. Each group's sets go into a prefix tree.
4. A class that shares enough n-grams with classes outside its group, first of its first ones
   and then of all, is compared once more: such classes form neighbourhoods (components of
   any shared n-gram), and each neighbourhood's sets go into a prefix tree. So no link is
   lost, whatever the groups are.
5. The tree is walked once for a block of sets at a time: sets with a common prefix share the
   partial overlaps, and a subtree is left as soon as overlap plus what remains cannot
   reach the threshold. A group beyond BLOCK_BYTES is dealt in chunks and every two chunks
   meet in a task.
6. Only the links that join two parts leave a task, never all pairs of a group; connected
   components of these links are the result.

N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.components import components
from tideline.llm.words import NOT_BLANK, mix, pieces, rolling
from tideline.session import Scratch, discard, materialise

BASE = 0x2545F4914F6CDD1D
#: Per hundred n-grams, how many more than the shortest sufficient prefix are compared.
EXTRA = 10
CELL_BITS = 20
#: Times the mean count from which a cell is common.
COMMON = 4
#: n-grams that a task counts before it reports its common cells.
COUNTED = 1 << 22
#: n-gram bytes of one task of the tree join.
BLOCK_BYTES = 16 << 20
#: Bits of the table of wanted documents, for each of them and at most (a power of two).
WANTED_BITS, WANTED_MOST = 8, 1 << 28
#: Bytes of the table (n-gram, set) that the tree's walk looks overlaps up in.
TABLE_BYTES = 32 << 20


def _grams(words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram hash), sorted and distinct; a text of fewer words has one n-gram of them all."""
    hashes = words.hashes()
    counts, first = words.counts, words.bounds[:-1]
    text = np.repeat(np.arange(len(counts)), counts)
    full = rolling(hashes, n, BASE)
    inside = text[: len(full)] == text[n - 1 :] if len(full) else np.empty(0, bool)
    found = [(text[: len(full)][inside], full[inside])]
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        found.append((short, mix(rolling(hashes, size, BASE)[first[short]] + np.uint64(size))) if len(short) else (short, hashes[:0]))
    text, grams = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((grams, text))
    text, grams = text[order], grams[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (grams[1:] != grams[:-1])
    return text[new], grams[new]


def _least_common(n: int, threshold: int) -> int:
    """n-grams that a set of n has at least in common with a linked set."""
    return -(-threshold * n // 100)


def _first_grams(n: int, threshold: int) -> tuple[int, int]:
    """How many first n-grams are compared, and how many of them must be shared."""
    least = _least_common(n, threshold)
    more = max(1, n * EXTRA // 100)
    return n - least + more, max(1, least * EXTRA // 100)


def _digest(grams: np.ndarray) -> bytes:
    return blake2b(grams.tobytes(), digest_size=16).digest()


def _cell(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _common_cells(n: int):
    """Cells that are common among the n-grams of a task, with their counts, and the number of n-grams."""

    def report(total: np.ndarray) -> pa.RecordBatch:
        cells = np.flatnonzero(total > COMMON * max(1.0, total.mean()))
        return pa.RecordBatch.from_arrays([pa.array(np.append(cells, -1)), pa.array(np.append(total[cells], total.sum()))], names=["cell", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for _, _, words in pieces(batch.column(0), NOT_BLANK, lower=True):
                found.append(_cell(_grams(words, n)[1]))
                held += len(found[-1])
                if held >= COUNTED:
                    yield report(np.bincount(np.concatenate(found), minlength=1 << CELL_BITS))
                    found, held = [], 0
        if found:
            yield report(np.bincount(np.concatenate(found), minlength=1 << CELL_BITS))

    return run


def _steps(docs: DataFrame, n: int) -> np.ndarray:
    """Step of every cell: 0 below COMMON times the mean count, one more for each doubling."""
    counted = docs.select("text").mapInArrow(_common_cells(n), "cell long, times long")
    counted = counted.groupBy("cell").agg(F.sum("times").alias("times")).toArrow()
    cells, times = counted["cell"].to_numpy(), counted["times"].to_numpy()
    steps = np.zeros(1 << CELL_BITS, np.uint8)
    mean = max(1.0, times[cells < 0].sum() / len(steps)) if len(cells) else 1.0
    times, cells = times[cells >= 0], cells[cells >= 0]
    steps[cells] = np.clip(np.floor(np.log2(np.maximum(times / mean / COMMON, 0.5))) + 1, 0, 255)
    return steps


def _in_order(grams: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Places of sorted n-grams in the global order."""
    return np.argsort(steps[_cell(grams)], kind="stable")


def _sets(n: int, threshold: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, words in pieces(batch.column(1), NOT_BLANK, lower=True):
                text, grams = _grams(words, n)
                at = np.searchsorted(text, np.arange(end - first + 1))
                sizes = np.diff(at)
                digests, needs, heads = [], [], []
                for lo, size in zip(at.tolist(), sizes.tolist(), strict=False):
                    length, need = _first_grams(size, threshold) if size else (0, 0)
                    digests.append(_digest(grams[lo : lo + size]) if size else None)
                    needs.append(need)
                    own = grams[lo : lo + size]
                    heads.append(own[_in_order(own, shared.value)[:length]].view(np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
                heads = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(heads)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(needs, pa.int32()), heads],
                    names=["doc", "n", "digest", "need", "head"],
                )

    return run


def _whole_sets(n: int):
    """Sets of the representatives' texts; another text under the same doc_id is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2)
            for first, end, words in pieces(batch.column(1), NOT_BLANK, lower=True):
                text, grams = _grams(words, n)
                at = np.searchsorted(text, np.arange(end - first + 1)).tolist()
                rows = [i for i in range(end - first) if _digest(grams[at[i] : at[i + 1]]) == wanted[first + i].as_py()]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first, end - first).take(pa.array(rows)),
                            pa.array([grams[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary()),
                        ],
                        names=["row", "grams"],
                    )

    return run


def _wanted_table(hashes: DataFrame) -> np.ndarray:
    """Two bits for each 64-bit ``hash``, in words of 64; the more hashes beyond the most, the more others pass."""
    bits = 64
    while bits < min(WANTED_MOST, WANTED_BITS * hashes.count()):
        bits *= 2
    each = hashes.select(F.explode(F.array(F.col("hash"), F.shiftrightunsigned("hash", 32))).alias("hash"))
    each = each.select(F.col("hash").bitwiseAND(F.lit(bits - 1)).alias("bit"))
    words = each.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("set"))
    found = words.toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[found["word"].to_numpy()] = found["set"].to_numpy()
    return table.view(np.uint64)


def _perhaps_wanted(shared):
    """Rows (doc, _text, hash) that the table does not exclude, without the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        most = np.uint64(len(table) * 64 - 1)
        for batch in batches:
            hashes = batch.column(2).to_numpy().view(np.uint64)
            stay = np.ones(len(hashes), bool)
            for at in (hashes & most, hashes >> np.uint64(32) & most):
                stay &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            yield batch.select([0, 1]).filter(pa.array(stay))

    return run


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc and others) with the texts as _text; other texts are hardly sent."""
    table = docs.sparkSession.sparkContext.broadcast(_wanted_table(wanted.select(F.xxhash64("doc").alias("hash"))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").alias("_text")).where("doc IS NOT NULL")
    some = texts.withColumn("hash", F.xxhash64("doc")).mapInArrow(_perhaps_wanted(table), "doc long, _text string")
    # a sort-merge join of any size: what follows in Python then has a stage, and workers, of its own
    return some.join(wanted.hint("merge"), "doc")


def _all_grams(n: int, threshold: int):
    """The n-grams of whole sets, made and dealt out by one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_sets(n)(batches):
            nodes = batch.column(0).to_numpy()
            grams = [np.frombuffer(g, np.int64) for g in batch.column(1).to_pylist()]
            sizes = np.array([len(g) for g in grams], np.int64)
            needs = -(-threshold * sizes // 100)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(nodes, sizes)), pa.array(np.repeat(needs, sizes).astype(np.int32)), pa.array(np.concatenate([*grams, np.empty(0, np.int64)]))],
                names=["node", "need", "gram"],
            )

    return run


class _Parts:
    """Union-find over the sets of one task."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def tree_links(sets: list[np.ndarray], threshold: int, steps: np.ndarray) -> list[tuple[int, int]]:
    """Links between sets (places in ``sets``) that join two parts; they give the components of all links."""
    sizes = np.array([len(s) for s in sets])
    grams, times = np.unique(np.concatenate(sets), return_counts=True)
    order = _in_order(grams, steps)
    rank = np.empty(len(grams), np.int64)
    rank[order] = np.arange(len(grams))
    times = times[order]
    paths = [np.sort(rank[np.searchsorted(grams, s)]) for s in sets]
    order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">u4").tobytes())
    paths, sizes = [paths[i] for i in order], sizes[order]
    # n-grams of one set only never add to an overlap
    row = np.full(len(grams), -1, np.int64)
    common = np.flatnonzero(times > 1)
    row[common] = np.arange(len(common))
    rows = [row[p] for p in paths]
    same = [0]
    for a, b in zip(paths, paths[1:], strict=False):
        m = min(len(a), len(b))
        differs = np.flatnonzero(a[:m] != b[:m])
        same.append(int(differs[0]) if len(differs) else m)
    same = np.array(same)
    parts, links = _Parts(len(sets)), []
    width = max(16, TABLE_BYTES // max(1, len(common)))
    for lo in range(0, len(sets), width):
        hi = min(len(sets), lo + width)
        table = np.zeros((len(common), hi - lo), np.uint8)
        for q in range(lo, hi):
            table[rows[q][rows[q] >= 0], q - lo] = 1
        _walk(lo, hi, table, rows, sizes, same, threshold, parts, links)
    return [(order[a], order[b]) for a, b in links]


def _walk(lo, hi, table, rows, sizes, same, threshold, parts, links) -> None:
    """Walk the tree of all sets once for the sets lo .. hi."""
    stack = [(lo + 1, len(rows), 0, np.zeros(hi - lo, np.int64), np.arange(lo, hi))]
    while stack:
        a, b, depth, overlap, alive = stack.pop()
        if a >= b:
            continue
        end = len(rows[a]) if b - a == 1 else min(int(same[a + 1 : b].min()), len(rows[a]))
        step = rows[a][depth:end]
        step = step[step >= 0]
        if len(step):
            overlap = overlap + table[step][:, alive - lo].sum(axis=0, dtype=np.int64)
        short, long = int(sizes[a:b].min()), int(sizes[a:b].max())
        need = -(-threshold * (short + sizes[alive]) // (100 + threshold))
        stay = (overlap + np.minimum(long - end, sizes[alive] - overlap) >= need) & (alive < b - 1)
        alive, overlap = alive[stay], overlap[stay]
        if not len(alive):
            continue
        while a < b and len(rows[a]) == end:  # sets that end here
            linked = (100 * overlap >= threshold * (end + sizes[alive] - overlap)) & (alive < a)
            for q in alive[linked].tolist():
                if parts.join(q, a):
                    links.append((q, a))
            a += 1
        if a < b:
            forks = [a, *(a + 1 + np.flatnonzero(same[a + 1 : b] == end)).tolist(), b]
            stack += [(x, y, end, overlap, alive) for x, y in zip(forks, forks[1:], strict=False)]


def _join_blocks(threshold: int, shared):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("node", "ascending")])
        part = table["part"].to_numpy()
        nodes = table["node"].to_numpy()
        grams = table["grams"]
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        out = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi - lo > 1:
                sets = [np.frombuffer(x, np.uint64) for x in grams.slice(lo, hi - lo).to_pylist()]
                out += [(int(nodes[lo + a]), int(nodes[lo + b])) for a, b in tree_links(sets, threshold, shared.value)]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _tree_join(docs: DataFrame, wanted: DataFrame, edges: DataFrame, n: int, threshold: int, shared) -> tuple[DataFrame, DataFrame]:
    """(links within the components of ``edges``, the components as node, part).

    ``wanted`` (node, doc, n, digest) names a text for each node; a set is sent once, to its blocks.
    """
    found = components(edges)
    parts = found.union(found.select(F.col("component").alias("node"), "component").distinct()).toDF("node", "part")
    sizes = materialise(wanted.join(parts, "node"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-total * 8 // BLOCK_BYTES))
    chunks = sizes.groupBy("part").agg(F.ceil(F.sum("n") * 8 / F.lit(BLOCK_BYTES)).cast("int").alias("chunks"))
    dealt = materialise(sizes.join(chunks, "part").select("doc", "digest", F.struct("node", "part", "chunks").alias("row")))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    texts = _texts_of(docs, dealt).select("row", "_text", "digest")
    sets = texts.mapInArrow(_whole_sets(n), "row struct<node: bigint, part: bigint, chunks: int>, grams binary")
    sets = sets.select("row.*", "grams").select("node", "part", "chunks", "grams", own.alias("own"), other.alias("other"))
    one = F.col("chunks") == 1
    block = F.struct(
        F.when(one, F.pmod(F.xxhash64("part"), F.lit(tasks))).otherwise(F.col("part")).alias("of"),
        F.when(one, -1).otherwise(F.least("own", "other")).alias("i"),
        F.when(one, -1).otherwise(F.greatest("own", "other")).alias("j"),
    )
    blocks = sets.select(block.alias("block"), "part", "node", "grams")
    return blocks.groupBy("block").applyInArrow(_join_blocks(threshold, shared), "a long, b long"), parts


def _spanned(postings: DataFrame, label: str) -> DataFrame:
    """Postings of n-grams that more than one label holds, with the smallest of these as ``center``.

    The count and the join both read every column, so that one exchange of the rows serves both.
    """
    # the filters that the join would push under its own side only
    sent = postings.where(F.col("gram").isNotNull() & F.col(label).isNotNull()).repartition("gram")
    others = [c for c in postings.columns if c not in ("gram", label)]
    ends = sent.groupBy("gram").agg(F.min(label).alias("center"), F.max(label).alias("last"), *[F.max(c).alias(c) for c in others])
    spans = ends.where("center < last").where(" AND ".join(["true", *(f"{c} IS NOT NULL" for c in others)]))
    return sent.join(spans.select("gram", "center"), "gram").where(F.col(label) >= F.col("center"))


def _enough(postings: DataFrame) -> DataFrame:
    """Nodes with as many rows as a link takes."""
    counts = postings.groupBy("node").agg(F.count("*").alias("shared"), F.max("need").alias("need"))
    return counts.where("shared >= need").select("node")


def _links(docs: DataFrame, sent: DataFrame, classes: DataFrame, n: int, threshold: int, shared) -> DataFrame:
    """Links of the classes; the table ``sent`` is deleted once its first n-grams are read."""
    heads = sent.join(classes.select("node", F.col("rep").alias("doc")), ["node", "doc"], "left_semi")
    postings = heads.select("node", "need", F.explode("head").alias("gram"))
    postings = materialise(_spanned(postings, "node"))
    near = materialise(_enough(postings))
    wanted = materialise(heads.join(near, "node", "left_semi").select("node", "doc", "n", "digest").distinct())
    discard(sent)
    postings = postings.join(near, "node", "left_semi")
    strong = postings.groupBy("node", "center").agg(F.count("*").alias("shared"), F.max("need").alias("need"))
    strong = strong.where("2 * shared >= need").select(F.col("node").alias("a"), F.col("center").alias("b"))
    strong = strong.join(near.select(F.col("node").alias("b")), "b", "left_semi")
    inside, parts = _tree_join(docs, wanted, strong, n, threshold, shared)
    labelled = postings.drop("center").join(parts, "node", "left").withColumn("label", F.coalesce("part", "node")).drop("part")
    far = _enough(_spanned(labelled, "label"))
    # the same with all n-grams of what is left, of which a link takes far more
    texts = _texts_of(docs, materialise(wanted.join(far, "node", "left_semi"))).select("node", "_text", "digest")
    whole = texts.mapInArrow(_all_grams(n, threshold), "node long, need int, gram long")
    whole = materialise(whole.join(parts, "node", "left").withColumn("label", F.coalesce("part", "node")).drop("part"))
    left = whole.join(_enough(_spanned(whole, "label")), "node", "left_semi")
    edges = _spanned(left.select("gram", "node"), "node").select(F.col("node").alias("a"), F.col("center").alias("b"))
    across, _ = _tree_join(docs, wanted, edges, n, threshold, shared)
    return inside.union(across)


def near_duplicates(docs: DataFrame, n: int = 3, threshold: int = 90) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Texts are lower-cased (A-Z) and cut into words at blanks; a document's set holds its
    distinct shingles of ``n`` words, or all its words as one when it has fewer. Documents
    link when 100 * intersection >= ``threshold`` * union; component_id is the smallest
    doc_id reachable by links. A null, empty or blank text has no shingles and links with
    nothing. A null doc_id links with nothing and has a null component_id. Rows that share a
    doc_id are one document with the links of both. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_steps(docs, n))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").alias("_text"))
    sent = rows.mapInArrow(_sets(n, threshold, shared), "doc long, n long, digest binary, need int, head array<long>")
    sent = materialise(sent.withColumn("node", F.when(F.col("doc").isNotNull() & (F.col("n") > 0), F.xxhash64("digest"))))
    base = materialise(sent.select("doc", "n", "node"))
    full = base.where("node IS NOT NULL")
    classes = materialise(full.groupBy("node").agg(F.min("doc").alias("rep")))
    # one doc_id with several texts joins the classes of these texts
    several = full.groupBy("doc").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b < last")
    bridges = full.join(several, "doc").select(F.col("node").alias("a"), "b")
    with Scratch() as scratch:
        links = _links(docs, sent.where("node IS NOT NULL"), classes, n, threshold, shared)
        found = scratch.keep(components(links.union(bridges)))
    parts = classes.join(found, "node", "left").withColumn("part", F.coalesce("component", "node"))
    least = parts.groupBy("part").agg(F.min("rep").alias("label"))
    labels = parts.join(least, "part").select("node", "label")
    own = base.select("doc", "n", "node").join(labels, "node", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("label", "doc"))
    return own.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
