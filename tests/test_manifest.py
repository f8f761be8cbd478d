"""Manifests of files: digests, unchanged files not read again, changes named."""

import hashlib
import os

import pytest

from faultspark.sources import manifest


def names(df):
    return {(os.path.basename(r.path), r.change) for r in df.collect()}


def test_freeze_and_changes(spark, tmp_path):
    folder = tmp_path / "d"
    (folder / "sub").mkdir(parents=True)
    for name, content in (("a.csv", b"x" * 3000), ("sub/b.csv", b"b"), ("c.csv", b"same")):
        (folder / name).write_bytes(content)
    first = spark.createDataFrame(manifest.freeze(spark, str(folder)).collect())
    assert {(os.path.basename(r.path), r.length, r.sha256) for r in first.collect()} == {
        ("a.csv", 3000, hashlib.sha256(b"x" * 3000).hexdigest()), ("b.csv", 1, hashlib.sha256(b"b").hexdigest()), ("c.csv", 4, hashlib.sha256(b"same").hexdigest())}
    assert names(manifest.changed_files(first, manifest.freeze(spark, str(folder), first))) == set()
    wrong = first.withColumn("sha256", first.sha256.substr(1, 5))  # digests of unchanged files come from the manifest
    assert {r.sha256 for r in manifest.freeze(spark, str(folder), wrong).collect()} == {r.sha256 for r in wrong.collect()}
    (folder / "a.csv").write_bytes(b"y" * 3000)
    os.utime(folder / "a.csv", (1, 1))
    os.utime(folder / "c.csv", (2, 2))  # only touched
    (folder / "sub/b.csv").rename(folder / "e.csv")
    now = manifest.freeze(spark, str(folder), first)
    assert now.count() == 3 and names(manifest.changed_files(first, now)) == {("a.csv", "changed"), ("b.csv", "missing"), ("e.csv", "added")}


def test_large_files_are_read_in_pieces(spark, tmp_path, monkeypatch):
    """Files that may not be one row have the same digests, whatever their names."""
    for name, size in (("a b.bin", 5000), ("c%20d.bin", 3001), ("e.bin", 10)):
        (tmp_path / name).write_bytes(os.urandom(size))
    whole = {r.path: r.sha256 for r in manifest.freeze(spark, str(tmp_path)).collect()}
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "2000")  # in place of two gigabytes
    try:
        with pytest.raises(Exception, match="max length"):
            manifest.freeze(spark, str(tmp_path)).collect()
        monkeypatch.setattr(manifest, "WHOLE_BYTES", 2000)
        first = manifest.freeze(spark, str(tmp_path))
        assert {r.path: r.sha256 for r in first.collect()} == whole and len(whole) == 3
        old = spark.createDataFrame(first.collect())
        (tmp_path / "a b.bin").write_bytes(b"z" * 4000)
        now = manifest.freeze(spark, str(tmp_path), old)
        assert names(manifest.changed_files(old, now)) == {("a b.bin", "changed")}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
