from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from coldledger import session


def fake(master, configured=None):
    conf = SimpleNamespace(get=lambda key, default: configured if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_configured_folder_wins():
    assert session.shared_folder(fake("yarn", "hdfs://x/checkpoints")) == "hdfs://x/checkpoints"
    assert session.new_folder(fake("yarn", "hdfs://x/checkpoints/"), "t").startswith("hdfs://x/checkpoints/t-")


def test_only_local_sessions_make_a_folder():
    own = session.shared_folder(fake("local[2]"))
    assert os.path.isdir(own) and session.shared_folder(fake("local[2]")) == own
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("yarn"))


def test_mounted_path():
    assert session.mounted_path("file:///a/b") == "/a/b"
    assert session.mounted_path("/a/b") == "/a/b"
    with pytest.raises(ValueError, match="not mounted"):
        session.mounted_path("s3a://bucket/x")


def test_durable_keeps_rows_and_schema(spark):
    df = spark.sql(
        "SELECT id, CAST(id AS DECIMAL(38,0)) AS d, X'00FF' AS b, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS t FROM range(10)"
    )
    assert sorted(map(str, session.durable(df).collect())) == sorted(map(str, df.collect()))
    empty = session.durable(df.where("id < 0"))
    assert empty.count() == 0 and empty.dtypes == df.dtypes


def test_staged_tables_go_with_their_owner(spark, tmp_path):
    target = str(tmp_path / "out")
    with session.staged(spark) as owner:
        first = session.durable(spark.range(5).toDF("id"))
        session.durable(first.where("id > 2")).write.parquet(target)
        folders = list(owner.folders)
        assert len(folders) == 2 and all(os.path.isdir(folder) for folder in folders)
    assert not any(os.path.exists(folder) for folder in folders)
    assert spark.read.parquet(target).count() == 2
    kept = session.durable(spark.range(1).toDF("id"))
    assert folders != owner.folders == [] and kept.count() == 1


def test_staged_tables_go_after_a_failure(spark):
    with pytest.raises(RuntimeError), session.staged(spark) as owner:
        session.durable(spark.range(5).toDF("id"))
        folders = list(owner.folders)
        raise RuntimeError
    assert folders and not any(os.path.exists(folder) for folder in folders)
