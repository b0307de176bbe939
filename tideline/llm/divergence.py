"""Source divergence audit: how the word use of the sources of a language differs.

Chunk factorization. The whitespace chunks of every document are counted in tasks, summed to
one entry for each (chunk, lang, source) of a task, and dealt in packets to the bucket of the
chunk. There each globally distinct chunk is cut into terms once; its terms are joined back to
the entries, and the entries of the terms go on to the bucket of the term, where occurrences
and distinct documents are complete. A term never reaches over a chunk, as all whitespace of
ASCII separates terms.

Distinct documents are needed only up to ``min_docs`` (at most 3). An entry with fewer
documents has no others than its first and its last one, so two numbers name them all and
entries are merged in a bounded space, whatever the order.

Hot keys: a chunk of all documents is one entry a task and group, and a bucket folds its
packets one after the other, so its memory follows from its distinct texts and not from the
number of tasks. The number of buckets grows with the text. Terms and sources meet in blocks
of bounded size for the sums over pairs of sources, so neither a large language nor one with
very many sources comes to one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.packets import FAN, HELD, PACKET_SQL, Counts, dealt, merged, summed, unpacked
from tideline.llm.tables import text_bytes
from tideline.session import materialise

#: Text counted at once in a task.
PIECE_BYTES = 4 << 20
#: Text whose chunks (and then terms) meet in one bucket, and buckets at least.
BUCKET_TEXT = 16 << 20
LEAST_BUCKETS = 128
#: Kept terms, and sources, of a language that meet in one block of the sums over pairs.
BLOCK_TERMS = 4096
TILE_SOURCES = 256
#: Probabilities are in parts of this.
SCALE = 1_000_000_000

#: Terms are runs of these bytes, A-Z lower-cased: letters and all characters beyond ASCII.
_TERM_BYTES = [*range(0x61, 0x7B), *range(0x80, 0x100)]
_TO_TERMS = bytes(b if b in _TERM_BYTES or b == 0x0A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _chunks(batch: pa.RecordBatch, limit: int) -> Counts:
    """Occurrences and documents of each chunk and group of a batch (doc, lang, source, text)."""
    doc, lang, source, text = batch.columns
    doc = doc.to_numpy()
    number: dict[tuple[str, str], int] = {}
    group = np.array([number.setdefault(g, len(number)) for g in zip(lang.to_pylist(), source.to_pylist(), strict=True)], np.int64)
    split = pc.ascii_split_whitespace(text.cast(pa.large_string()))
    row = np.repeat(np.arange(len(doc)), np.diff(split.offsets.to_numpy()))
    coded = split.flatten().dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    full = pc.binary_length(coded.dictionary).to_numpy() > 0
    if not full.all():
        row, code = row[full[code]], code[full[code]]
    # the chunks of each document, each once
    pair, times = np.unique(code * len(doc) + row, return_counts=True)
    code, row = pair // len(doc), pair % len(doc)
    return summed(Counts(coded.dictionary.cast(pa.string()), list(number), code, group[row], times, np.ones(len(row), np.int64), doc[row], doc[row]), limit)


def _folded(parts: Iterator[Counts], limit: int, send: Callable[[Counts], Iterator] | None = None):
    """Merge as it comes; beyond HELD entries that do not merge, ``send`` takes them."""
    held: list[Counts] = []
    size = least = 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= HELD + least:
            held = [merged(held, limit)]
            size = least = len(held[0])
            if send and size >= HELD // 2:
                yield from send(held.pop())
                size = least = 0
    if held:
        yield from (send or (lambda c: iter([c])))(merged(held, limit))


def _pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Counts]:
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(3)).to_numpy().astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + PIECE_BYTES, "right")))
            yield _chunks(batch.slice(start, end - start), limit)
            start = end


def _count(limit: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _folded(_pieces(batches, limit), limit, lambda c: dealt(c, buckets))

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[Counts]:
    for batch in batches:
        for data in batch.column("packet"):
            yield unpacked(data.as_py())


def _terms(c: Counts, limit: int) -> Counts:
    """The entries of chunks as entries of their terms; each chunk is cut once."""
    lines = "\n".join(c.texts.to_pylist()).encode().translate(_TO_TERMS).split(b"\n")
    cut = [line.split() for line in lines]
    terms = pa.array([t.decode() for line in cut for t in line], pa.string()).dictionary_encode()
    sizes = np.array([len(line) for line in cut], np.int64)
    starts = np.cumsum(sizes) - sizes
    # join back: every entry once for each term of its chunk
    each = sizes[c.text]
    entry = np.repeat(np.arange(len(c)), each)
    place = np.arange(len(entry)) - np.repeat(np.cumsum(each) - each, each)
    wide = c.take(entry)
    wide.text = terms.indices.to_numpy().astype(np.int64)[starts[wide.text] + place]
    wide.texts = terms.dictionary
    return summed(wide, limit)


def _to_terms(limit: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunks in _folded(_entries(batches), limit):
            yield from dealt(_terms(chunks, limit), buckets)

    return run


_KEPT_SQL = "lang string, source string, term string, count long"
_KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64())])


def _keep(limit: int):
    """Entries of the terms that ``limit`` documents of their language hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _folded(_entries(batches), limit):
            langs = sorted({lang for lang, _ in c.groups})
            of = np.array([langs.index(lang) for lang, _ in c.groups])[c.group]
            whole = summed(Counts(c.texts, [(lang, "") for lang in langs], c.text, of, c.n, c.docs, c.first, c.last), limit)
            good = whole.docs >= limit
            kept = np.isin(c.text * len(langs) + of, whole.text[good] * len(langs) + whole.group[good])
            c = c.take(np.flatnonzero(kept))
            lang, source = (pa.array([g[i] for g in c.groups], pa.string()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(c.group)), source.take(pa.array(c.group)), c.texts.take(pa.array(c.text)), pa.array(c.n)], schema=_KEPT)

    return run


def _again(limit: int, coarse: int, fine: int):
    """Packets of coarse buckets as packets of all buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _folded(_entries(batches), limit, lambda c: dealt(c, fine, coarse))

    return run


def _gathered(packets: Callable[[int], DataFrame], limit: int, buckets: int):
    """Packets grouped by bucket; beyond FAN buckets by way of coarse ones, in tasks of any packets of them."""
    if buckets <= FAN:
        return packets(buckets).groupBy("bucket")
    fine = -(-buckets // FAN)
    mixed = packets(FAN).withColumn("salt", F.pmod(F.xxhash64("packet"), F.lit(fine)))
    mixed = mixed.repartition(buckets, "bucket", "salt").select("bucket", "packet")
    return mixed.mapInArrow(_again(limit, FAN, fine), PACKET_SQL).groupBy("bucket")


def kept_terms(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """lang, source, term, count of the terms that ``min_docs`` (1 to 3) documents of their language hold.

    Every row is a document, repeated rows too.
    """
    if not 1 <= min_docs <= 3:
        raise ValueError("min_docs: two ends name all documents below 1 to 3 only")
    empty = F.lit("")
    texts = docs.select(
        F.monotonically_increasing_id().alias("_doc"),
        F.coalesce(F.col("lang").cast("string"), empty).alias("_lang"),
        F.coalesce(F.col("source").cast("string"), empty).alias("_source"),
        F.coalesce("text", empty).alias("_text"),
    )
    buckets = max(LEAST_BUCKETS, -(-text_bytes(docs) // BUCKET_TEXT))
    chunks = _gathered(lambda n: texts.mapInArrow(_count(min_docs, n), PACKET_SQL), min_docs, buckets)
    terms = _gathered(lambda n: chunks.applyInArrow(_to_terms(min_docs, n), PACKET_SQL), min_docs, buckets)
    return terms.applyInArrow(_keep(min_docs), _KEPT_SQL)


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)); the product may pass a long."""
    return F.expr(f"1 + (cast({count} + 1 AS decimal(20,0)) * {SCALE}) div ({total} + {kept})")


def _gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); both are at most 1 + SCALE, so the square fits a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


_SUMS = "lang string, source string, item string, high long, low long"
_SUMS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("high", pa.int64()), ("low", pa.int64())])
_LOW = (1 << 32) - 1


def _pair_sums(key: tuple, block: pa.Table) -> pa.Table:
    """Of one block of terms: the gaps of every two sources of two tiles, in halves that fit a long.

    Rows without a term name the sources: ``p`` is that of a term they lack, ``kept`` the
    number of terms of the block.
    """
    lang, _, left, right = (k.as_py() for k in key)
    heads = block.filter(pc.is_null(block["term"]))
    rows = block.filter(pc.is_valid(block["term"]))
    sources = heads["source"].combine_chunks()
    rest, tile = heads["p"].to_numpy(), heads["tile"].to_numpy()
    kept = int(heads["kept"][0].as_py()) if len(heads) else 0
    terms = rows["term"].combine_chunks().dictionary_encode()
    shares = np.repeat(rest[:, None], len(terms.dictionary), axis=1)
    shares[pc.index_in(rows["source"].combine_chunks(), sources).to_numpy(), terms.indices.to_numpy()] = rows["p"].to_numpy()
    a, b = np.flatnonzero(tile == left), np.flatnonzero(tile == right)
    out: list[tuple] = []
    q, q_rest = shares[b], rest[b]
    for s in a:
        gap = (shares[s] - q) ** 2 // q
        same = (rest[s] - q_rest) ** 2 // q_rest
        more = kept - shares.shape[1]
        other = b != s
        out.append((np.full(other.sum(), s), b[other], ((gap >> 32).sum(1) + (same >> 32) * more)[other], ((gap & _LOW).sum(1) + (same & _LOW) * more)[other]))
    if not out:
        return _SUMS_ARROW.empty_table()
    one, two, high, low = (np.concatenate(x) for x in zip(*out, strict=True))
    langs = pa.array([lang] * len(one), pa.string())
    return pa.Table.from_arrays([langs, sources.take(pa.array(one)), sources.take(pa.array(two)), pa.array(high), pa.array(low)], schema=_SUMS_ARROW)


def pair_values(groups: DataFrame, found: DataFrame) -> DataFrame:
    """lang, source, item, value: the gaps of ``source`` to every other source, over all kept terms.

    Terms are dealt to blocks by hash, sources to tiles; each block and two tiles is one group.
    """
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("kept").alias("kept"))
    most = sizes.agg(F.max("sources"), F.max("kept")).first()
    tiles = max(1, -(-(most[0] or 0) // TILE_SOURCES))
    blocks = max(1, -(-(most[1] or 0) // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")
    tile = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int")
    both = F.sequence(F.lit(0), F.lit(tiles - 1))
    to = F.explode(
        F.array_distinct(
            F.concat(
                F.transform(both, lambda t: F.struct(F.col("tile").alias("left"), t.alias("right"))),
                F.transform(both, lambda t: F.struct(t.alias("left"), F.col("tile").alias("right"))),
            )
        )
    ).alias("to")
    held = found.select("lang", "term").distinct().groupBy("lang", block.alias("block")).agg(F.count("*").alias("held"))
    heads = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(held, ["lang", "block"], "left")
    heads = heads.select("lang", "block", tile.alias("tile"), "source", F.lit(None).cast("string").alias("term"), F.col("rest").alias("p"), F.coalesce("held", F.lit(0)).alias("kept"))
    rows = found.select("lang", block.alias("block"), tile.alias("tile"), "source", "term", "p", F.lit(0).cast("long").alias("kept"))
    dealt = heads.union(rows).select("lang", "block", to, "tile", "source", "term", "p", "kept")
    dealt = dealt.select("lang", "block", "to.left", "to.right", "tile", "source", "term", "p", "kept")
    sums = dealt.groupBy("lang", "block", "left", "right").applyInArrow(_pair_sums, _SUMS)
    wide = sums.groupBy("lang", "source", "item").agg(F.sum(F.expr("cast(high AS decimal(38,0))")).alias("high"), F.sum(F.expr("cast(low AS decimal(38,0))")).alias("low"))
    return wide.select("lang", "source", "item", F.expr(f"cast(high * {1 << 32} + low AS long)").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank.

    A share of a term in a group is 1 + floor(SCALE (count + 1) / (N + V)), N the group's
    occurrences of kept terms and V the kept terms of its language; value is
    floor((p - q)^2 / q). Part ``pair``: against every other source of the language, summed
    over all its kept terms; part ``term``: against the whole language, for the ``top`` terms
    that the group uses more. Ranks count from 1 per group, value descending, item ascending.

    Null lang, source and text are ''. A group without terms takes part with counts of 0; a
    language without kept terms has pairs of value 0 and no terms; a language of one source
    has no pairs. Repeated rows are documents of their own, other columns (doc_id too) are
    not read. An empty table gives no rows.
    """
    empty = F.lit("")
    groups = docs.select(F.coalesce(F.col("lang").cast("string"), empty).alias("lang"), F.coalesce(F.col("source").cast("string"), empty).alias("source")).distinct()
    found = materialise(kept_terms(docs, min_docs))
    kept = found.groupBy("lang").agg(F.countDistinct("term").alias("kept"))
    total = found.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    zero = F.lit(0).cast("long")
    groups = groups.join(total, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("kept", zero).alias("kept"))
    groups = materialise(groups.withColumn("rest", F.when(F.col("kept") > 0, _share("0", "total", "kept")).otherwise(F.lit(1))))
    found = found.join(groups.select("lang", "source", "total", "kept"), ["lang", "source"])
    found = found.select("lang", "source", "term", "count", "kept", _share("count", "total", "kept").alias("p"))
    pairs = pair_values(groups, found.select("lang", "source", "term", "p"))

    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    whole = found.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.first("kept").alias("kept")).join(langs, "lang")
    whole = whole.select("lang", "term", _share("lang_count", "lang_total", "kept").alias("q"))
    terms = found.join(whole, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), _gap("p", "q").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [
        part.withColumn("rank", F.row_number().over(by_value)).select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
        for name, part in (("pair", pairs), ("term", terms))
    ]
    return ranked[0].union(ranked[1].where(F.col("rank") <= top))
