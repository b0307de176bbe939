"""What the n-gram join sends and writes: rows once, and no whole sets on disk."""

import re

from tideline.llm import ngram_join


def test_shared_grams_are_sent_once(spark):
    rows = [(node, 1, gram) for node in range(60) for gram in (node, node // 2 + 1000, 7777)]
    postings = spark.createDataFrame(rows, "node long, need int, gram long").repartition(3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shared = ngram_join._spanned(postings, "node")
        plan = shared._jdf.queryExecution().executedPlan().toString()
        got = {(r.node, r.need, r.gram, r.center) for r in shared.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(n, 1, g, c) for n in range(60) for g, c in ((n // 2 + 1000, n // 2 * 2), (7777, 0))}
    assert len(re.findall(r"\+- Exchange hashpartitioning\(gram", plan)) == 1 and "ReusedExchange" in plan


def test_whole_sets_are_not_written(spark, monkeypatch):
    written = []
    real = ngram_join.materialise
    monkeypatch.setattr(ngram_join, "materialise", lambda df: written.append(df.columns) or real(df))
    texts = [f"{' '.join(f'w{i % 40}x{j}' for j in range(60))} end{i}" for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs, 3, 90).collect()}
    assert got == {i: i % 40 for i in range(120)}
    assert written and not any("grams" in columns for columns in written)
