"""Places of lines in their files, with files cut into many splits."""

from tideline.plans.convert import convert_fit_logs
from tideline.sources.files import in_file_order, read_fitness_logs
from tideline.specs import FIT


def test_lines_are_numbered_over_many_splits(spark, tmp_path):
    sizes = {1: 5000, 2: 1, 3: 40, 4: 0}
    width = len(FIT.field_names) - 2
    for subject, n in sizes.items():
        rows = ("\t".join([str(i * 0.5)] * width + [str(i % 13)]) + "\n" for i in range(n))
        (tmp_path / f"mHealth_subject{subject}.log").write_text("".join(rows))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        logs = read_fitness_logs(spark, str(tmp_path), numbered=True)
        plain = read_fitness_logs(spark, str(tmp_path))
        assert plain.rdd.getNumPartitions() > 10
        rows = logs.select("subjectId", "line", FIT.field_names[1]).collect()
        delays = convert_fit_logs(logs, 2.0).select("delay").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert all(r[2] == r.line * 0.5 for r in rows)
    for subject, n in sizes.items():
        assert sorted(r.line for r in rows if r.subjectId == f"subject{subject}") == list(range(n))
    assert sorted(r.delay for r in delays) == sorted(4 * i for n in sizes.values() for i in range(n))


def test_no_rows(spark, tmp_path):
    (tmp_path / "subject1.log").write_text("")
    assert read_fitness_logs(spark, str(tmp_path), numbered=True).collect() == []
    lines = in_file_order(spark.read.text(str(tmp_path)))
    assert lines.columns == ["value", "file", "line"] and lines.count() == 0
