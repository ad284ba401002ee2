"""Stored results."""

from micro import values

from tidecrew.sources.sinks import append_rows, appended_rows


def test_a_repeated_append_replaces_its_own_batch(spark, tmp_path):
    folder = str(tmp_path / "rows")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, kind string")
    two = spark.createDataFrame([(3, "a")], "id long, kind string")
    append_rows(one, folder, "1", ("kind",))
    append_rows(two, folder, "2", ("kind",))
    append_rows(two, folder, "2", ("kind",))
    assert sorted(values(appended_rows(spark, folder), "id", "kind")) == [(1, "a"), (2, "b"), (3, "a")]
