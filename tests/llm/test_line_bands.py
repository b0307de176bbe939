"""The line dedup's minima, and the two ways for bands that are not one component."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.llm import lines


def _hub(rnd):
    """A line and variants of it, each with another stretch of eight changed: similar to it, not to each other."""
    hub = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=107))
    variants = [hub[:i] + "#" + hub[i + 1 :] for i in range(8, 99)]
    docs = list(enumerate([*variants[:40], hub, *variants[40:], "a line that resembles no other one"]))
    return docs


def _kept(spark, docs):
    done = lines.line_report(spark.createDataFrame(docs, "doc_id long, text string"))
    return {r.doc_id for r in done.collect() if r.text}


def test_open_bands_are_met_without_sending_shingles(spark, monkeypatch):
    """Lines of bands of up to MEET meet by their minima; the join by shingles is for larger bands."""

    def sent(*_):
        raise AssertionError("whole shingle sets were sent")

    monkeypatch.setattr(lines, "_rest", sent)
    docs = _hub(random.Random(5))
    assert _kept(spark, docs) == {0, len(docs) - 1}


@pytest.mark.parametrize("meet", [6, 1024])
def test_both_ways_for_open_bands(spark, monkeypatch, meet):
    monkeypatch.setattr(lines, "MEET", meet)
    docs = _hub(random.Random(6))
    assert _kept(spark, docs) == {0, len(docs) - 1}


def _signatures(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "h long, line string").withColumn("rid", F.col("h"))
    return {r.h: r for r in lines._signed(rows).collect()}


def test_minima_depend_on_the_set_of_shingles_alone(spark):
    """Lines of every length around a row of shingles: a line twice over a period has the same set."""
    period = "abcdefghijkl"
    texts = [(period * 9)[: len(period) + lines.SHINGLE - 1 + k] for k in range(3 * lines.RUN)]
    signed = _signatures(spark, texts)
    assert len({(tuple(r.bands), r.s, r.t) for r in signed.values()}) == 1


def test_agreed_counts_equal_minima(spark):
    texts = ["the same line of text", "the same line of text", "another one altogether, 1234567890"]
    signed = _signatures(spark, texts)
    rows = [((signed[a].s, signed[a].t), (signed[b].s, signed[b].t)) for a, b in ((0, 1), (0, 2))]
    pairs = spark.createDataFrame(rows, "x struct<s:long,t:long>, y struct<s:long,t:long>")
    same, unlike = [r.n for r in pairs.select(lines._agreed("x", "y").alias("n")).collect()]
    assert same == lines.BANDS * lines.ROWS and unlike < lines.AGREED
