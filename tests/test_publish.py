"""Two-step publishing: killed and repeated runs, two writers, replacement."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from faultspark.sources import publish


def test_killed_and_repeated(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.range(100)
    with pytest.raises(AnalysisException):
        publish.published(spark, path)
    assert publish.publish(rows.where("id < 50"), path, "a")
    broken = rows.where("id >= 50").withColumn("id", F.when(F.col("id") == 99, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        publish.publish(broken, path, "b")  # killed while it writes
    publish.write_part(rows.where("id >= 50"), path, "b")  # killed between the steps
    assert publish.published(spark, path).count() == 50 and len(publish.unnamed_parts(spark, path)) >= 1
    assert publish.publish(rows.where("id >= 50"), path, "b")
    assert not publish.publish(rows.where("id >= 50"), path, "b") and not publish.publish(rows, path, "a")
    assert sorted(r.id for r in publish.published(spark, path).collect()) == list(range(100))


def test_two_writers(spark, tmp_path, monkeypatch):
    """Both read number 1; the one that comes second goes on to number 3 and loses nothing."""
    path = str(tmp_path / "t")
    publish.publish(spark.range(1), path, "a")
    part, real, first = publish.write_part(spark.range(2), path, "c"), publish.manifest_of, []

    def stale(*args):
        found = real(*args)
        if not first:
            first.append(1)
            assert publish._claim(spark, path, found[0] + 1, found[1] | {"b": publish.write_part(spark.range(3), path, "b")})
        return found

    monkeypatch.setattr(publish, "manifest_of", stale)
    assert publish.name_part(spark, path, "c", part)
    number, parts = real(spark, path)
    assert number == 3 and set(parts) == {"a", "b", "c"} and publish.published(spark, path).count() == 6


def test_replace_keeps_a_reader(spark, tmp_path):
    path = str(tmp_path / "t")
    publish.publish(spark.range(5), path, "v1")
    before = publish.published(spark, path)
    assert publish.publish(spark.range(7), path, "v2", replace=True) and not publish.publish(spark.range(9), path, "v2", replace=True)
    assert not publish.publish(spark.range(5), path, "v1")  # a late repetition of what was replaced
    assert publish.published(spark, path).count() == 7 and before.count() == 5
    assert [p.split("-")[0] for p in publish.unnamed_parts(spark, path)] == ["v1"]
