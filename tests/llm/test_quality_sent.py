"""The quality filter sends texts alone to Python."""

import re

from tests.conftest import SF_DIR
from tideline.llm.quality import keep_good, quality_scores


def test_quality_sends_texts_only(spark, documents):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    good = keep_good(documents, labels)
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and re.search(r"ArrowEvalPython \[score\(text#\d+\)", plan)
    wanted = quality_scores(documents, labels).where("predicted = 1").select("doc_id")
    assert sorted(r.doc_id for r in good.select("doc_id").collect()) == sorted(r.doc_id for r in wanted.collect())
