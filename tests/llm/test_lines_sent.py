"""The line dedup sends whole texts once."""

import re

from tideline.llm import lines


def test_document_table_is_not_sent_again(spark):
    docs = spark.createDataFrame([(i, f"line {i}\nshared line") for i in range(50)], "doc_id long, text string")
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {c: spark.conf.get(c) for c in names}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lines.line_report(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    scan = plan[: plan.index("lines_")].rsplit("SortMergeJoin", 1)[-1]
    assert not re.search(r"Exchange hashpartitioning\(rid", scan)
