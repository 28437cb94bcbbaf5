"""What a task of the numbering of documents holds."""

from lemmagraph.operators import scans
from lemmagraph.plans.scanning import _line_events


def test_rows_are_sorted_twice(spark, data):
    """A sort for each level and counter held the rows again."""
    plan = scans.numbered(_line_events(spark, data))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Sort [") == 2


def test_tasks_grow_with_the_events(spark, data, monkeypatch):
    few = scans.numbered(_line_events(spark, data))
    monkeypatch.setattr(scans, "EVENTS", 100)
    many = scans.numbered(_line_events(spark, data))
    assert many.rdd.getNumPartitions() == -(-few.count() // 100) > 4
    assert sorted(map(repr, many.collect())) == sorted(map(repr, few.collect()))
