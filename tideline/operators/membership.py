"""Known-sensor filter: exact, and with a Bloom filter kept as a table.

The filter is a table of pages; a key sets all its bits in one page, so a probe is
one equality join and a few bit tests instead of one lookup per bit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.joins import lookup_join

WORDS = 64
WORD_BITS = 64
PAGE_BITS = WORDS * WORD_BITS
# 512 bytes a page: 128 MB of filter, about 100 million keys at one percent.
BROADCAST_PAGES = 250_000


def keep_members(df: DataFrame, members: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is in ``members``; no member table lets everything pass."""
    if members is None:
        return df
    return lookup_join(df, members.select(key).distinct(), [key], how="left_semi")


@dataclass(frozen=True)
class BloomTable:
    pages: DataFrame
    page_count: int
    hashes: int

    def write(self, path: str) -> None:
        self.pages.withColumns(
            {"page_count": F.lit(self.page_count), "hashes": F.lit(self.hashes)}
        ).write.mode("overwrite").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> BloomTable:
        table = spark.read.parquet(path)
        size = table.select("page_count", "hashes").first()
        if size is None:
            raise ValueError(f"no filter pages in {path}")
        return BloomTable(table.select("page", "words"), size["page_count"], size["hashes"])


def bloom_size(expected: int, ratio: float) -> tuple[int, int]:
    """(pages, hashes) for ``expected`` keys at false-positive ratio ``ratio``."""
    bits = -expected * math.log(ratio) / math.log(2) ** 2
    hashes = max(1, round(bits / max(1, expected) * math.log(2)))
    return max(1, math.ceil(bits / PAGE_BITS)), hashes


def _page(key: Column, pages: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(0)), F.lit(pages))


def _bit_positions(key: Column, hashes: int) -> list[Column]:
    """Bits of the key in its page; one 64-bit hash yields five 12-bit positions."""
    out = []
    for i in range(hashes):
        h = F.xxhash64(key.cast("string"), F.lit(1 + i // 5))
        out.append(F.shiftrightunsigned(h, 12 * (i % 5)).bitwiseAND(F.lit(PAGE_BITS - 1)))
    return out


def _one_bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (position % WORD_BITS).cast("int"))


def bloom_build(keys: DataFrame, key: str, expected: int, ratio: float = 0.01) -> BloomTable:
    page_count, hashes = bloom_size(expected, ratio)
    bits = (
        keys.select(key)
        .distinct()
        .select(
            _page(F.col(key), page_count).alias("page"),
            F.explode(F.array(*_bit_positions(F.col(key), hashes))).alias("position"),
        )
        .select("page", F.expr(f"position div {WORD_BITS}").alias("word"), _one_bit(F.col("position")).alias("bit"))
    )
    words = bits.groupBy("page", "word").agg(F.bit_or("bit").alias("bits"))
    by_word = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    pages = words.groupBy("page").agg(by_word.alias("by_word")).select(
        "page",
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.lit(WORDS - 1).cast("bigint")),
            lambda w: F.coalesce(F.try_element_at("by_word", w), F.lit(0)),
        ).alias("words"),
    )
    return BloomTable(pages, page_count, hashes)


def bloom_filter(df: DataFrame, bloom: BloomTable | None, key: str) -> DataFrame:
    """Rows whose key may be in the filter; no filter lets everything pass."""
    if bloom is None:
        return df
    if bloom.page_count <= BROADCAST_PAGES:
        return _probe(df, F.broadcast(bloom.pages), bloom, key)
    if df.isStreaming:
        return _probe(df, bloom.pages, bloom, key)
    # A filter too large for every executor: probe each key once, then keep rows by key.
    survivors = _probe(df.select(key).distinct(), bloom.pages, bloom, key)
    return lookup_join(df, survivors, [key], how="left_semi")


def _probe(df: DataFrame, pages: DataFrame, bloom: BloomTable, key: str) -> DataFrame:
    def is_set(position: Column) -> Column:
        word = F.get(F.col("words"), F.expr("0") + F.floor(position / WORD_BITS).cast("int"))
        return word.bitwiseAND(_one_bit(position)) != 0

    hit = reduce(lambda a, b: a & b, [is_set(p) for p in _bit_positions(F.col(key), bloom.hashes)])
    on = (_page(F.col(key), bloom.page_count) == F.col("page")) & hit
    return df.join(pages, on, "left_semi")
