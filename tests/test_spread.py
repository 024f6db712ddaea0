"""Texts made from narrow columns: tasks grow in number, not in length."""

from auditflow.sources.tables import read_event_stream, spread
from auditflow.streaming import guard


def test_tasks_follow_the_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    narrow = spark.range(0, 100_000, 1, cores)  # as many splits as cores
    assert spread(narrow, "id").rdd.getNumPartitions() == cores
    assert spread(narrow, "id", rows=1000).rdd.getNumPartitions() == 100
    assert spread(narrow, "id", rows=1000).distinct().count() == 100_000
    assert spread(narrow.limit(10), "id", rows=1000).rdd.getNumPartitions() == 4 * cores


def test_a_file_of_a_stream_is_audited_by_many_tasks(spark, tmp_path):
    events = read_event_stream(spark, str(tmp_path))
    analyzed = guard.guard_stream(events)._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression [seq" in analyzed
