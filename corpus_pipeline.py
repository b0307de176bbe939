"""The corpus pipeline: quality, lines, near duplicates, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and is
written as Parquet before the next one reads it. All but the last return the columns of
documents. Rows without an id, null and empty texts go through as the operators state it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.catalog import table
from tideline.llm.leaks import decontaminate
from tideline.llm.lines import dedup_lines
from tideline.llm.ngram_join import near_duplicates
from tideline.llm.quality import keep_good
from tideline.llm.sentence_pieces import encode_checked
from tideline.llm.workload import tokenizer
from tideline.session import Scratch, discard, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line repeats or resembles.

    A document with lines that all stand in earlier documents goes; one that was null, empty
    or blank from the start stays.
    """
    before = F.struct(*docs.columns).alias("before")
    done = dedup_lines(docs.select("doc_id", "text", before))
    kept = done.where((F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "")) != "") | (F.trim(F.regexp_replace(F.coalesce("before.text", F.lit("")), "\n", "")) == ""))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*[new.get(c, F.col(f"before.`{c}`")).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: word five-grams, similarity 0.8 or more.

    The smallest doc_id of a group stays; documents without words or without an id all stay.
    """
    groups = near_duplicates(docs, n=5, threshold=80)
    dropped = groups.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly benchmark go."""
    cut = decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and their number, with the decoded text compared."""
    model = tokenizer("piece_bpe_32k.model")
    done = encode_checked(docs, model, row=["doc_id", "lang", "source"])
    return done.select(
        "row.doc_id",
        "row.lang",
        "row.source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        "round_trip",
    )


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", leaks),
    ("SentencePiece encoding", token_ids),
]

#: The classifier and byte-pair encoding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again.

    A stage's own tables go when it is written, and so does what it read.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with Scratch() as scratch:
            docs = scratch.keep(materialise(stage(spark, docs, sf_dir)))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
