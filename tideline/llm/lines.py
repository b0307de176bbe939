"""Fuzzy line dedup by MinHash, with DataFrame functions only.

Documents are written once as a table in buckets of their row id, so that the later steps
read a document's lines without another shuffle of text. Copies of a line meet by a 64-bit
hash; one occurrence of each different line is signed: the hashes of its character shingles in
VIEWS rotations, and in each the nearest neighbours, under exclusive or, of constants spread
evenly: BANDS * ROWS minima, each a uniform choice from the union of two sets, so two lines
agree on it with the probability of their Jaccard similarity. The minima of a band are of
different views, so they are close to independent, for sets of few shingles too. Lines that
agree on a whole band and, by four bits of each, on AGREED of all minima are candidates,
compared by the exact Jaccard similarity of all their shingles in two rounds. First each
meets the first and the NEIGHBOURS lines before it, in an order of lines that is another one
in every band; up to six lines of a band have then all met. Larger bands whose lines do not
lie in one component yet are open. In those of up to MEET lines each meets each of another
component. All lines of larger ones are joined exactly: with shingles ordered rarest first,
two similar lines share one among the first fifth of each (prefix filter), at places that
leave enough others to share (positional filter). Connected components of the similar pairs,
with all copies, keep the first occurrence.

With 10 bands of 3 rows a pair of similarity 0.8 meets in a band with probability 0.9992; it
then misses AGREED with a probability of about 5e-5. A pair that meets and agrees is compared,
or its lines are in one component already.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.components import components
from tideline.llm.tables import id_key, text_bytes
from tideline.session import Scratch, delete_folder, discard, materialise, owned, scratch_path, shuffles_freed

BANDS = 10
ROWS = 3
#: Lines before it, in each band, that a line is compared with in the first round.
NEIGHBOURS = 4
#: Lines of an open band up to which each meets each, by their minima.
MEET = 1024
#: Characters of a shingle.
SHINGLE = 8
SIMILARITY = 0.8
#: Bytes of text in one bucket of the document table.
BUCKET_TEXT = 24 << 20

#: Consecutive shingles that one row brings to the minima.
RUN = 8
#: Rotations of a shingle's hash; each gives BANDS * ROWS / VIEWS minima.
VIEWS = 5
_TURNS = [64 * v // VIEWS for v in range(VIEWS)]
_EACH = BANDS * ROWS // VIEWS
#: Of BANDS * ROWS minima, those that a pair must agree on to be compared.
AGREED = 15

#: In each view the constants' leading bits are spread evenly, the others are random.
_CONSTANTS = [
    int(np.uint64(i // VIEWS * (2**64 // _EACH) + int(x)).astype(np.int64))
    for i, x in enumerate(np.random.default_rng(7).integers(0, 2**64 // _EACH, BANDS * ROWS, np.uint64))
]


def _written(docs: DataFrame) -> tuple[DataFrame, int]:
    """The documents as a table in buckets of ``rid``, a hash of id and text, and the number of buckets."""
    spark = docs.sparkSession
    buckets = max(8, -(-text_bytes(docs) // BUCKET_TEXT))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.xxhash64("doc_id", text).alias("rid"), id_key().alias("key"), F.struct("*").alias("row"))
    name = f"lines_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)

    def remove() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_folder(spark, path)

    owned(path, remove)
    with shuffles_freed(spark):
        (
            rows.repartition(buckets, "rid")
            .write.bucketBy(buckets, "rid")
            .option("path", path)
            .option("compression", "zstd")
            .saveAsTable(name)
        )
    return spark.table(name), buckets


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _is_blank(line: Column) -> Column:
    return F.trim(line) == ""


def _shingle(codes: Column, start: Column) -> Column:
    return F.xxhash64(F.substring(codes, start, F.lit(4 * SHINGLE)))


def _last(codes: Column) -> Column:
    """First byte, from 1, of the last shingle; a shorter line is one shingle."""
    return F.greatest(F.octet_length(codes) - (4 * SHINGLE - 1), F.lit(1))


def _shingles(line: Column) -> Column:
    # as an element of an array the codes are made once, not for each shingle
    each = F.transform(F.array(F.encode(line, "UTF-32")), lambda c: F.transform(F.sequence(F.lit(1), _last(c), F.lit(4)), lambda i: _shingle(c, i)))
    return F.array_distinct(F.get(each, F.lit(0)))


def _signed(lines: DataFrame) -> DataFrame:
    """(h, bands, s, t) of lines (rid, h, line) that are dealt by rid; s and t hold four bits of each minimum."""
    codes = lines.select("rid", "h", F.encode("line", "UTF-32").alias("codes"))
    last = _last(F.col("codes"))
    each = codes.select("rid", "h", "codes", last.alias("last"), F.explode(F.sequence(F.lit(1), last, F.lit(4 * RUN))).alias("at"))
    # the last row repeats the last shingle, which changes no minimum
    runs = [_shingle(F.col("codes"), F.least(F.col("at") + 4 * k, F.col("last"))).alias(f"x{k}") for k in range(RUN)]
    each = each.select("rid", "h", *runs)
    turned = [_turned(F.col(f"x{k}"), t).alias(f"x{k}_{t}") for k in range(RUN) for t in _TURNS]
    each = each.select("rid", "h", *turned)
    least = [
        F.min(F.least(*[F.col(f"x{k}_{_TURNS[i % VIEWS]}").bitwiseXOR(F.lit(c)) for k in range(RUN)])).alias(f"m{i}")
        for i, c in enumerate(_CONSTANTS)
    ]
    signed = each.groupBy("rid", "h").agg(*least)
    # the minima of a band are of different views
    band = [F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)]
    half = BANDS * ROWS // 2
    return signed.select("h", F.array(*band).alias("bands"), _bits(range(half)).alias("s"), _bits(range(half, 2 * half)).alias("t"))


def _turned(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits)) if bits else x


def _bits(minima: range) -> Column:
    """The last four bits of each of up to 16 minima, in one number."""
    return reduce(Column.bitwiseOR, [F.shiftleft(F.col(f"m{i}").bitwiseAND(F.lit(15)), 4 * k) for k, i in enumerate(minima)])


def _agreed(one: str, two: str) -> Column:
    """Minima that two signed lines agree on, by four bits of each."""
    unlike = F.lit(0)
    for c in ("s", "t"):
        d = F.col(f"{one}.{c}").bitwiseXOR(F.col(f"{two}.{c}"))
        d = d.bitwiseOR(F.shiftright(d, 1))
        unlike += F.bit_count(d.bitwiseOR(F.shiftright(d, 2)).bitwiseAND(F.lit(0x0111111111111111)))
    return F.lit(BANDS * ROWS) - unlike


def _shared(signed: DataFrame) -> DataFrame:
    """(h, band, n, s, t) for the bands that n > 1 lines agree on; count and join read one exchange."""
    rows = signed.select("h", F.explode("bands").alias("band")).where("h IS NOT NULL AND band IS NOT NULL").repartition("band")
    counts = rows.groupBy("band").agg(F.count("h").alias("n")).where("n > 1")
    shared = materialise(rows.join(counts, "band").select("h", "band", "n"))
    return shared.join(signed.select("h", "s", "t"), "h")


def _candidates(shared: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of lines that agree on a band: each with the first and those just before it."""
    rows = shared.select("band", F.struct("h", "s", "t").alias("x"))
    band = Window.partitionBy("band").orderBy(F.xxhash64("x.h", "band"), "x.h")
    near = [F.lag("x", k).over(band) for k in range(1, NEIGHBOURS + 1)]
    before = rows.select("x", F.array(F.first("x").over(band), *near).alias("near")).where(F.get("near", F.lit(1)).isNotNull())
    return _ends(before.select("x", F.explode("near").alias("y")).where("y IS NOT NULL AND x.h <> y.h"))


def _ends(pairs: DataFrame) -> DataFrame:
    """(a, b), a < b, once each, of pairs (x, y) of signed lines that agree on AGREED minima."""
    like = pairs.where(_agreed("x", "y") >= AGREED)
    return like.select(F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b")).distinct()


def similar_lines(table: DataFrame, places: DataFrame, buckets: int) -> DataFrame:
    """(a, b): hashes of different lines that are similar, enough of them to give the components."""
    with Scratch() as scratch:
        return scratch.keep(_all_links(table, places, buckets))


def _all_links(table: DataFrame, places: DataFrame, buckets: int) -> DataFrame:
    first = places.where("h IS NOT NULL").groupBy("h").agg(F.min("rid").alias("rid"))
    named = materialise(first)
    # which lines of a document stand for their copies, in the order of its lines
    chosen = places.join(named.withColumn("chosen", F.lit(True)), ["rid", "h"], "left")
    flags = _by_document(chosen.select("rid", "pos", F.col("chosen").isNotNull().alias("flag")), buckets)
    signed = materialise(_signed(_picked(table, flags)))
    shared = materialise(_shared(signed))
    discard(signed)
    pairs = materialise(_candidates(shared))
    large = shared.where(F.col("n") > NEIGHBOURS + 2)
    ends = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).union(large.select("h")).distinct()
    wanted = materialise(named.join(ends, "h"))
    chosen = places.join(wanted.withColumn("chosen", F.lit(True)), ["rid", "h"])
    docs = chosen.select("rid").distinct()
    flags = _by_document(
        places.join(docs, "rid", "left_semi")
        .join(wanted.withColumn("chosen", F.lit(True)), ["rid", "h"], "left")
        .select("rid", "pos", F.col("chosen").isNotNull().alias("flag")),
        buckets,
    )
    texts = materialise(_picked(table, flags).select("h", "line").distinct())
    links = materialise(_similar(pairs, texts))
    open_bands = _open(large, components(links))
    met = materialise(_met(open_bands.where(F.col("n") <= MEET)))
    links = links.union(materialise(_similar(met, texts)))
    hot = open_bands.where(F.col("n") > MEET).select("h", "part").distinct()
    if hot.isEmpty():
        return links
    return links.union(materialise(_similar(_rest(hot, texts), texts)))


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines are similar."""
    both = (
        pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a")
        .join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
        # behind a generator, so that the shingles of a pair are made once
        .select("a", "b", F.explode(F.array(F.struct(_shingles(F.col("x")).alias("x"), _shingles(F.col("y")).alias("y")))).alias("z"))
    )
    # same / (x + y - same) >= SIMILARITY
    same = F.size(F.array_intersect("z.x", "z.y"))
    return both.where(same >= _least_same(F.size("z.x"), F.size("z.y"))).select("a", "b")


def _least_same(x: Column, y: Column) -> Column:
    """Shingles that similar lines of x and y shingles share at least."""
    return F.ceil(SIMILARITY / (1 + SIMILARITY) * (x + y) - 1e-9)


def _open(large: DataFrame, groups: DataFrame) -> DataFrame:
    """(h, part, band, n, s, t) of the bands with pairs that were not compared and lie in two components."""
    rows = large.join(groups.select(F.col("node").alias("h"), "component"), "h", "left")
    rows = rows.select("h", F.coalesce("component", "h").alias("part"), "band", "n", "s", "t")
    bands = rows.groupBy("band").agg(F.min("part").alias("least"), F.max("part").alias("most"))
    bands = bands.where(F.col("least") != F.col("most"))
    return materialise(rows.join(bands.select("band"), "band", "left_semi"))


def _met(rows: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of the lines of a band that are of different parts."""
    each = rows.select("band", "part", F.struct("h", "s", "t").alias("x"))
    other = each.select("band", F.col("part").alias("other"), F.col("x").alias("y"))
    return _ends(each.join(other, "band").where("part < other").select("x", "y"))


def _rest(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of the lines (h, part): all similar ones of different parts are among them."""
    sets = lines.join(texts, "h").select("h", "part", F.explode(F.array(_shingles(F.col("line")))).alias("xs"))
    each = sets.select("h", "part", F.size("xs").alias("size"), F.explode("xs").alias("x"))
    each = each.where("h IS NOT NULL AND part IS NOT NULL AND x IS NOT NULL").repartition("x")
    # the count reads every column, as the join does, so that one exchange of the rows serves both
    counts = each.groupBy("x").agg(F.count("h").alias("n"), F.max("part").alias("p"), F.max("size").alias("s"))
    shared = counts.where("n > 1 AND p IS NOT NULL AND s IS NOT NULL").select("x", "n")
    # shingles of one line only come first in its order and meet nothing
    known = each.join(shared, "x").groupBy("h", "part", "size").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("xs"))
    own = F.col("size") - F.size("xs")
    prefix = F.col("size") - F.ceil(SIMILARITY * F.col("size") - 1e-9).cast("int") + 1
    first = known.where(own < prefix).select(
        "h", "part", "size", own.alias("own"), F.posexplode(F.slice("xs", F.lit(1), prefix - own)).alias("i", "z")
    )
    # behind it: shingles of the line from this one on
    first = materialise(first.select("h", "part", F.col("z.x").alias("x"), "size", (F.col("size") - F.col("own") - F.col("i")).alias("behind")))
    one, two = first.alias("one"), first.alias("two")
    enough = F.least("one.behind", "two.behind") >= _least_same(F.col("one.size"), F.col("two.size"))
    pairs = one.join(two, (F.col("one.x") == F.col("two.x")) & (F.col("one.part") < F.col("two.part")) & enough)
    return materialise(pairs.select(F.least("one.h", "two.h").alias("a"), F.greatest("one.h", "two.h").alias("b")).distinct())


def _by_document(flags: DataFrame, buckets: int) -> DataFrame:
    """(rid, flags): an array with one boolean per line, dealt as the document table is, so that no text is sent to meet it."""
    each = flags.repartition(buckets, "rid").groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("pos", "flag"))).alias("flags"))
    return each.select("rid", F.transform("flags", lambda f: f["flag"]).alias("flags"))


def _picked(table: DataFrame, flags: DataFrame) -> DataFrame:
    """(rid, h, line) of the flagged lines."""
    lines = F.arrays_zip(_lines(F.col("row.text")).alias("line"), F.col("flags").alias("flag"))
    each = table.join(flags.where(F.exists("flags", lambda f: f)), "rid").select("rid", F.explode(lines).alias("z"))
    return each.where("z.flag").select("rid", F.xxhash64("z.line").alias("h"), F.col("z.line").alias("line"))


def line_decisions(table: DataFrame, buckets: int) -> DataFrame:
    """(rid, keep): for each document an array with one boolean per line."""
    each = table.select("rid", "key", F.posexplode(_lines(F.col("row.text"))).alias("pos", "line"))
    places = materialise(each.select("rid", "key", "pos", F.when(~_is_blank(F.col("line")), F.xxhash64("line")).alias("h")))
    groups = components(similar_lines(table, places.select("rid", "pos", "h"), buckets))
    grouped = places.join(groups.select(F.col("node").alias("h"), "component"), "h", "left").withColumn(
        "part", F.coalesce("component", "h")
    )
    keepers = grouped.where("part IS NOT NULL").groupBy("part").agg(F.min("key").alias("keeper"))
    placed = grouped.join(keepers, "part", "left")
    first = F.min("pos").over(Window.partitionBy("rid", "part"))
    keep = F.col("part").isNull() | ((F.col("key") == F.col("keeper")) & (F.col("pos") == first))
    return _by_document(placed.select("rid", "pos", keep.alias("flag")), buckets)


def _rebuilt(docs: DataFrame) -> DataFrame:
    table, buckets = _written(docs)
    both = table.join(line_decisions(table, buckets).withColumnRenamed("flags", "keep"), "rid", "left")
    lines = F.arrays_zip(_lines(F.col("row.text")).alias("line"), F.col("keep").alias("keep"))
    rest = F.transform(F.filter(lines, lambda z: z["keep"]), lambda z: z["line"])
    return both.select(
        "row",
        F.size("keep").cast("long").alias("n_lines"),
        F.size(F.filter("keep", lambda k: ~k)).cast("long").alias("n_removed"),
        F.when(F.col("row.text").isNotNull(), F.array_join(rest, "\n")).alias("rest"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, text of the lines kept.

    Lines are cut at line feeds. Two lines are similar when the Jaccard similarity of their
    sets of 8-character shingles is 0.8 or more; a shorter line is one shingle. Of each
    component of equal or similar lines the first stays: the first one in the document with
    the smallest doc_id. Blank lines stay. A null text stays null and has one blank line; a
    null doc_id comes after all others. Rows that share a doc_id are one document for the
    choice of the keeper; rows equal in doc_id and text get the same result. Other columns
    are not read.
    """
    done = _rebuilt(docs.select("doc_id", "text"))
    return done.select("row.doc_id", "n_lines", "n_removed", F.col("rest").alias("text"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines of ``text`` that ``line_report`` keeps; every row and column stays."""
    done = _rebuilt(docs)
    return done.select(*[F.col("rest").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
